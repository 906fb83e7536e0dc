"""URL filters: association rules mined by FP-growth, below a short list of fixed rules.

A URL becomes a set of tokens: scheme, host labels and suffixes, path segments, file ending, keys of the query;
digits are written as their count, so numbered pages share tokens.  FP-growth over the labelled URLs, with the
label as one more item, gives the combinations whose presence predicts it.  A combination of any length is a rule if
it reaches ``MIN_SUPPORT`` and ``MIN_CONFIDENCE`` and lies ``MIN_Z`` standard errors over the share of bad pages, so
that labels which do not depend on URLs give no rules however many are bad; and if no rule with fewer of its tokens is
as sure.  Tokens that stand on the same labelled pages count as one, the shortest of them, which keeps combinations few.

An inverted index leads from each rule's rarest token to the rule; a URL looks up its own tokens there and checks the
rest of each rule found.  Up to ``MAX_BROADCAST`` rules the index is sent to the tasks, more are met by a join: the
verdicts are the same.

Defined results: a null URL, or one without ``://``, has empty host and path and no tokens, and is allowed; where
pages repeat an id or labels repeat one, any bad label makes the page bad for mining; a null quality does not make a
page bad, nor does a null toxic; labels without a page are left out; no labels, or labels of one kind, mean no rules;
rows map one to one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Fixed rules: verdict, host (and its subdomains), start of the path.
FIXED = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
LABEL = "label:block"
#: Support as a share of the labelled pages, and in pages; the share of bad pages, and how far it lies over that of all.
MIN_SUPPORT, MIN_PAGES, MIN_CONFIDENCE, MIN_Z = 0.005, 20, 0.6, 5.0
#: Rules that are broadcast at most; more are matched by a join.
MAX_BROADCAST = 10_000
RULES = "items array<string>, confidence double, support double"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; none without a host."""
    plain = lambda x: F.concat(F.regexp_replace(x, "[0-9]+", "0"), F.when(x.rlike("[0-9]"), F.concat(F.lit("~"), F.length(F.regexp_replace(x, "[^0-9]", "")).cast("string"))).otherwise(F.lit("")))
    labels = F.split(host(url), r"\.")
    suffix = F.regexp_extract(host(url), r"([^.]*\.[^.]*)$", 1)
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    keys = F.regexp_extract_all(url, F.lit("[?&]([^=&#]+)"), F.lit(1))
    tag = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), plain(x)))
    parts = [F.array(F.concat(F.lit("s:"), F.regexp_extract(url, "^([^:]*):", 1))), tag("h:", labels), F.array(F.concat(F.lit("d:"), suffix)), tag("p:", segments), tag("q:", keys), F.array(F.concat(F.lit("x:"), F.regexp_extract(path(url), r"(\.[A-Za-z]+)$", 1)), F.concat(F.lit("f:"), F.regexp_extract(url, "#(.*)$", 1)))]
    real = F.filter(F.concat(*parts), lambda x: F.length(x) > 2)
    return F.when(url.contains("://"), F.array_distinct(real)).otherwise(F.expr("cast(array() as array<string>)"))


def mine(pages: DataFrame, labels: DataFrame, scratch: Scratch, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES, min_z: float = MIN_Z) -> DataFrame:
    """Pruned rules (items, confidence, support).  ``labels``: doc_id, quality, toxic; a page is bad if it is toxic or of no quality."""
    spark = pages.sparkSession
    nothing = spark.createDataFrame([], RULES)
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad"))
    rows = pages.where("url is not null and page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), tokens(F.col("url").cast("string")).alias("items"))
    rows = scratch.write(rows.where("size(items) > 0").join(bad, "page_id"), "labelled")
    seen = rows.agg(F.count("*").alias("n"), F.avg("bad").alias("rate")).first()
    n, rate = seen["n"], seen["rate"]
    least = max(min_support, min_pages / n) if n else 1.0
    if n < min_pages or not 0 < rate < 1:
        return nothing
    # of frequent tokens there are at most 1 / support times as many as a URL has; those of equal pages count as one
    where = F.xxhash64("page_id", "items")
    counts = rows.select(F.explode("items").alias("token"), where.alias("at")).groupBy("token").agg(F.count("*").alias("k"), F.sum(F.col("at").cast("decimal(38,0)")).alias("a"), F.bit_xor("at").alias("b"))
    kept = [r.token for r in counts.where(F.col("k") >= least * n).groupBy("k", "a", "b").agg(F.min(F.struct(F.length("token").alias("l"), "token"))["token"].alias("token")).collect()]
    if not kept:
        return nothing
    items = F.array_intersect("items", F.array(*(F.lit(t) for t in sorted(kept))))
    rows = rows.select(F.when(F.col("bad") == 1, F.concat(items, F.array(F.lit(LABEL)))).otherwise(items).alias("items")).where("size(items) > 0")
    sets = scratch.write(FPGrowth(itemsCol="items", minSupport=least * n / rows.count(), minConfidence=min_confidence).fit(rows).freqItemsets, "sets")
    whole = sets.where(~F.array_contains("items", LABEL)).select(F.array_sort("items").alias("items"), F.col("freq").alias("all"))
    found = sets.where(F.array_contains("items", LABEL)).select(F.array_sort(F.array_remove("items", LABEL)).alias("items"), "freq").where("size(items) > 0").join(whole, "items")
    sure = F.col("freq") / F.col("all")
    far = (sure - rate) / F.sqrt(F.lit(rate * (1 - rate)) / F.col("all"))
    found = scratch.write(found.select("items", sure.alias("confidence"), (F.col("freq") / n).alias("support"), ((sure >= min_confidence) & (far >= min_z)).alias("rule")), "found")
    return pruned(found, scratch)


def pruned(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The rules among ``found`` (items, confidence, support, rule) that no rule with fewer of their tokens equals in confidence.

    Every part of a frequent combination is frequent, so the surest rule among the parts of a combination is handed on
    from those with one token less, length by length.
    """
    longest = found.where("rule").agg(F.max(F.size("items"))).first()[0] or 0
    below, out = None, None
    for k in range(1, longest + 1):
        now = found.where(F.size("items") == k)
        if below is not None:
            parts = now.select("items", F.explode("items").alias("x")).select("items", F.array_remove("items", F.col("x")).alias("part"))
            best = parts.join(below, "part", "left").groupBy("items").agg(F.max("best").alias("best"))
            now = now.join(best, "items")
        else:
            now = now.withColumn("best", F.lit(None).cast("double"))
        now = scratch.write(now.withColumn("keep", F.col("rule") & ~F.coalesce(F.col("best") >= F.col("confidence"), F.lit(False))), f"length{k}")
        below = now.select(F.col("items").alias("part"), F.greatest("best", F.when(F.col("rule"), F.col("confidence"))).alias("best"))
        own = now.where("keep").select("items", "confidence", "support")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else found.where("false").select("items", "confidence", "support")


def frequency(rules: list[dict]) -> dict[str, int]:
    seen: dict[str, int] = {}
    for r in rules:
        for x in r["items"]:
            seen[x] = seen.get(x, 0) + 1
    return seen


def index(rules: list[dict]) -> dict[str, list[tuple[int, frozenset]]]:
    """From the token that is in fewest rules to the numbers and tokens of the rules that have it."""
    often, out = frequency(rules), {}
    for i, r in enumerate(rules):
        out.setdefault(min(r["items"], key=lambda x: (often[x], x)), []).append((i, frozenset(r["items"])))
    return out


def first_rule(found: dict, own: set[str]) -> int | None:
    """The surest mined rule that fits a set of tokens."""
    return min((i for t in own for i, items in found.get(t, ()) if items <= own), default=None)


def order(rules: list[dict]) -> list[dict]:
    """Surest first."""
    return sorted(rules, key=lambda r: (-r["confidence"], -r["support"], list(r["items"])))


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """items, mined: of every distinct token set the surest rule that fits it, by a join on the rule's rarest token."""
    often = rules.select(F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("k"))
    first = rules.select("*", F.explode("items").alias("t")).join(often, "t").groupBy("items", "confidence", "support").agg(F.min(F.struct("k", "t"))["t"].alias("t"))
    first = first.select("t", F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.col("items").alias("need")).alias("rule"))
    own = sets.where("size(items) > 0").distinct()
    met = own.select("items", F.explode("items").alias("t")).join(first, "t").where(F.size(F.array_except("rule.need", "items")) == 0)
    return met.groupBy("items").agg(F.array_join(F.min("rule")["need"], " ").alias("mined"))


def judge(pages: DataFrame, rules: DataFrame | None = None, most: int = MAX_BROADCAST) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the tokens of the mined rule that blocked it) of every page."""
    u, h, p = F.col("url"), host(F.col("url")), path(F.col("url"))
    fixed = sorted(FIXED, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((h == r[1]) | h.endswith("." + r[1])) & p.startswith(r[2])
    rule = F.coalesce(*(F.when(fits(r), F.lit(r[1] + r[2])) for r in fixed))
    said = F.coalesce(*(F.when(fits(r), F.lit(r[0])) for r in fixed))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    own = own.select("page_id", "url", h.alias("host"), p.alias("path"), rule.alias("rule"), said.alias("said"))
    few = order([r.asDict() for r in rules.limit(most + 1).collect()]) if rules is not None else []
    if len(few) > most:
        own = own.withColumn("items", F.when(F.col("said").isNull(), tokens(u)))
        own = own.join(matched(own.select("items"), rules), "items", "left")
    elif few:
        held = pages.sparkSession.sparkContext.broadcast((index(few), [" ".join(r["items"]) for r in few]))

        @F.pandas_udf("string")
        def lookup(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            found, names = held.value
            for batch in batches:
                at = [None if x is None else first_rule(found, set(x)) for x in batch]
                yield pd.Series([None if i is None else names[i] for i in at], dtype=object)

        own = own.withColumn("mined", lookup(F.when(F.col("said").isNull(), tokens(u))))
    else:
        own = own.withColumn("mined", F.lit(None).cast("string"))
    return own.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined")
