"""Secret scans: base patterns, and character Markov models for secrets that have no pattern.

Two first-order Markov models over the characters of a token, one of random strings and one of ordinary
identifiers, are counted: the first from drawn samples, the second from the words of all documents and, weighing as
much, from samples of what programs, paths and dates look like.  A token is a secret if the log of its likelihood
under the first over that under the second exceeds ``MIN_LOG_ODDS`` (e**12 to 1, the prior against a secret).  The
table of transitions is as large as the alphabet squared, whatever the samples.  Characters do not tell hex secrets from
UUIDs, nor secret numbers from others, so short or upper-case hex is mostly, and a number always, left alone.

Everything is built-in functions: regexes, arrays and aggregates.  The base patterns stay as they are; the model
only adds spans that meet none of theirs.

Defined results: a null or empty text has no spans; rows map one to one; other columns are ignored.  Offsets are
code points.  Spans are sorted by start, then kind in the order of ``KINDS``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, free, joined, let, located, matches, no_spans, part, slices, walk

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run fails only by its length, so asking for the length at once finds the same runs.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What a token may be made of; the first is the edge of a token.
ALPHABET = "^ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
MIN_LOG_ODDS = 12.0
#: Random and ordinary strings drawn of each kind.
TRAIN_RANDOM = 20_000
#: Words of programs, of which ordinary samples are made.
WORDS = """
abstract access account action active adapter address admin agent alpha amount analysis android animation api app application archive array article asset async attribute audio auth author auto
background backup base batch bean beta binary block blog body bool bootstrap border bottom branch browser bucket buffer build builder button byte cache calendar callback camera cancel canvas card
catalog category center certificate channel char chart chat check child class clear client clone cloud cluster code collection color column command comment common compare component compress config
connect console const container content context control controller cookie copy core count country create credit currency current custom customer dashboard data database date debug decimal default
delete delivery demo deploy description design desktop detail developer device dialog digest dimension directory disable discount display document domain download draft driver dynamic editor element
email empty enable encoding encrypt engine entity entry enum error event example exception execute export express extension external factory failed favorite feature feed fetch field file filter final
find firebase flag float folder font footer form format frame framework front function gallery game gateway general generator get global graph grid group guest guide handler hash header height helper
hidden history home host html http icon identity image import index info init inline input insert install instance integer interface internal invalid invoice item iterator java job join json kernel
keyboard label language latest layout left length level library license light limit line link linux list listener load local location lock log login logo long machine main manager map margin market
master match maximum media member memory menu merge message meta method metric migration minimum mobile mock mode model module monitor month multiple name native navigation network news node normal
notes notification null number object offset online open operation option order origin output overview owner package page panel parameter parent parser partner password path pattern payment pending
permission person phone photo picture pixel plain platform player plugin point policy pool popup port position post prefix preview price primary print private process product production profile
program progress project prompt property protocol provider proxy public publish query queue quick random range rate reader receipt record redirect reference refresh region register release remote
remove render replace report repository request required reset resize resolver resource response rest result retry return review right role root route router rule sample save scale schedule schema
screen screenshot script scroll search section secure security select sender sequence serial server service session setting setup shadow shape share shell shipping shop show sidebar sign signal
signature simple single singleton size slide snapshot social socket sort source space spring stack staff stage standard start state static statistics status step stock storage store stream string style
submit summary support switch symbol sync system table target task team template temp terminal test text theme thread thumbnail ticket time timeout title toggle token tool toolbar top total trace track
transaction transfer transform translate tree trigger type unicode unique unit update upload url user username utf util utils valid validate value variable vector vendor version video view visible
visitor volume warning watch web week widget width wiki window word work worker wrapper writer xml year zone
"""
#: Tasks over which they are spread.
TRAIN_TASKS = 32


def random_samples(spark, n: int = TRAIN_RANDOM) -> DataFrame:
    """Labelled random strings: base 64, base 64 for URLs, letters and digits in both cases or one, letters alone in both cases or one,
    and hex in either case."""
    ids = spark.range(0, n, 1, TRAIN_TASKS)
    drawn = lambda k: F.regexp_replace(F.base64(F.unhex(F.concat(*(F.sha2(F.concat(F.lit(f"sample:{k}:{j}:"), F.col("id").cast("string")), 256) for j in range(2))))), "=+$", "")
    only = lambda k, kept: F.regexp_replace(k, f"[^{kept}]", "")
    hexes = F.substring(F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256), 1, 40)
    kinds = [drawn(0), F.translate(drawn(1), "+/", "-_"), only(drawn(2), "A-Za-z0-9"), only(drawn(3), "A-Z0-9"), only(drawn(4), "a-z0-9"), only(drawn(5), "A-Za-z"), only(drawn(6), "a-z"), only(drawn(7), "A-Z"), hexes, F.upper(hexes)]
    return ids.select(F.lit("random").alias("label"), F.explode(F.array(*kinds)).alias("token"))


def ordinary_samples(spark, n: int = TRAIN_RANDOM) -> DataFrame:
    """Labelled ordinary strings beyond words of documents: names as programs join and number them, paths, dates, versions, UUIDs."""
    row = spark.range(0, n, 1, TRAIN_TASKS)
    digest = lambda k: F.sha2(F.concat(F.lit(f"ordinary:{k}:"), F.col("id").cast("string")), 256)
    drawn = lambda k, most: F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(most))
    word = lambda k: F.element_at(F.array(*(F.lit(w) for w in WORDS.split())), (drawn(k, len(WORDS.split())) + 1).cast("int"))
    number = lambda k, most: drawn(k, most).cast("string")
    two = lambda k, most: F.lpad((drawn(k, most) + 1).cast("string"), 2, "0")
    date = F.concat_ws("-", (drawn(50, 60) + 1980).cast("string"), two(51, 12), two(52, 28))
    u = digest(0)
    uuid = F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.concat(F.lit("4"), F.substring(u, 14, 3)), F.concat(F.lit("a"), F.substring(u, 18, 3)), F.substring(u, 21, 12))
    kinds = [
        F.concat_ws("_", word(1), word(2), word(3)), F.concat_ws("-", word(4), word(5), word(6), number(7, 100)), F.concat(word(8), *(F.initcap(word(k)) for k in (9, 10, 11)), number(12, 20)),
        F.concat(*(F.initcap(word(k)) for k in (13, 14, 15)), number(16, 3000)), F.concat(F.upper(word(17)), number(18, 600), F.initcap(word(19)), F.upper(word(20)), F.initcap(word(21))),
        F.concat(word(22), number(23, 64), F.substring(word(24), 1, 2), number(25, 9), F.lit("_"), word(26), F.lit("_"), number(27, 1000), F.lit("_"), F.substring(word(28), 1, 2)),
        F.concat_ws("/", word(29), word(30), (drawn(31, 30) + 1995).cast("string"), two(32, 12), F.concat_ws("-", word(33), date)), F.concat_ws("/", word(34), F.concat(F.initcap(word(35)), F.initcap(word(36))), word(37), number(38, 10000)),
        F.concat_ws("_", F.upper(word(39)), F.upper(word(40)), F.upper(word(41)), number(42, 12)), uuid, F.upper(uuid), F.concat(date, F.lit("T"), two(43, 23), F.lit("-"), two(44, 59)),
        F.concat_ws("-", F.concat(word(45), F.lit("v"), number(46, 30)), number(47, 30), number(48, 100), word(49)), F.concat(F.regexp_replace(date, "-", ""), two(53, 23), two(54, 59), number(55, 1000000)),
    ]
    return row.select(F.lit("sample").alias("label"), F.explode(F.array(*kinds)).alias("token"))


def ordinary_pairs(docs: DataFrame) -> DataFrame:
    """(label, pair, k): pairs of characters, with the edges, in identifiers made of the words of all documents: words
    alone, joined as programs join them, and beside numbers.

    An identifier is made of a word and the one after it, and its pairs lie in one of the two or between them, so each
    task adds up its words by the initial of the next (empty for the last) and the identifiers are never written out.
    """
    edge = ALPHABET[0]
    own = F.filter(F.regexp_extract_all(F.col("text").cast("string"), F.lit("(?<![A-Za-z0-9])[A-Za-z]+(?![A-Za-z0-9])"), F.lit(0)), lambda w: F.length(w) > 1)
    words = docs.select(own.alias("w")).where("size(w) > 2")
    entry = lambda w, c: F.struct(w.alias("word"), c.alias("next"))
    after = F.transform("w", lambda w, i: entry(w, F.upper(F.substring(F.coalesce(F.get("w", i + 1), F.lit("")), 1, 1))))
    # a document's first word stands once more, as the only one that is not after another
    entries = words.select(F.explode(F.concat(F.array(entry(F.element_at("w", 1), F.lit(edge))), after)).alias("e"))
    counts = entries.groupBy("e.word", "e.next").agg(F.count("*").alias("k"))
    w, number = F.col("word"), F.pmod(F.xxhash64("word"), F.lit(1000)).cast("string")
    part = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    whole = [part(edge, w, edge)]
    left = [part(edge, w, "_"), part(edge, w, F.col("next"))]
    right = [part("_", w, edge), part(F.initcap(w), number, edge)]
    first = F.col("next") == edge
    made = F.when(first, F.array(*right)).when(F.col("next") == "", F.array(*whole, *right)).otherwise(F.array(*whole, *left, *right))
    parts = counts.select(F.explode(made).alias("part"), F.when(first, -F.col("k")).otherwise(F.col("k")).alias("k"))
    pairs = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("part") - 1), lambda i: F.substring("part", i, F.lit(2)))).alias("pair"), "k")
    return pairs.groupBy("pair").agg(F.sum("k").alias("k")).select(F.lit("ordinary").alias("label"), "pair", "k")


def sample_pairs(samples: DataFrame) -> DataFrame:
    """(label, pair, k) of samples (label, token)."""
    edged = F.concat(F.lit(ALPHABET[0]), "token", F.lit(ALPHABET[0]))
    pairs = samples.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") + 1), lambda i: F.substring(edged, i, F.lit(2)))).alias("pair"))
    return pairs.groupBy("label", "pair").agg(F.count("*").alias("k"))


def _codes(token: Column) -> Column:
    """Places in ALPHABET of a token's characters, with an edge before and after; what is not in it counts as edge."""
    inner = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET[1:]), c))
    return F.concat(F.array(F.lit(0)), inner, F.array(F.lit(0)))


def train(pairs: DataFrame) -> list[float]:
    """Log-ratio of the two models for every pair of characters, row by row, from counts (label, pair, k).

    Counts are added up by Spark, at most a row for each label and pair of characters; one is added to every count.
    """
    n = len(ALPHABET)
    counts = {k: [0.0] * (n * n) for k in ("random", "ordinary", "sample")}
    place = {c: i for i, c in enumerate(ALPHABET)}
    for row in pairs.collect():
        a, b = (place.get(c, 0) for c in row.pair)
        counts[row.label][a * n + b] += row.k
    # documents and samples weigh alike, however many documents there are
    texts, made = sum(counts["ordinary"]), sum(counts["sample"])
    if texts and made:
        counts["ordinary"] = [a * made / texts + b for a, b in zip(counts["ordinary"], counts["sample"], strict=True)]
    elif made:
        counts["ordinary"] = counts["sample"]
    counts = {k: [x + 1.0 for x in counts[k]] for k in ("random", "ordinary")}
    # ordinary words are joined by other marks as by _, and lines are ruled with marks
    own, joint = counts["ordinary"], place["_"]
    after, before = own[joint * n : joint * n + n], own[joint::n]
    edges = sum(own[:n])
    for m in (place[c] for c in "-/+=_"):
        for i in range(n) if m != joint else ():
            own[m * n + i] += after[i]
            own[i * n + m] += before[i]
        for at in (m, m * n + m, m * n):
            own[at] += edges / 100

    def logs(c: list[float]) -> list[float]:
        return [math.log(x / sum(c[i - i % n : i - i % n + n])) for i, x in enumerate(c)]

    return [round(a - b, 6) for a, b in zip(logs(counts["random"]), logs(counts["ordinary"]), strict=True)]


def log_odds(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token: above 0 it is rather random."""
    n = len(ALPHABET)
    table = F.array(*(F.lit(x) for x in model))
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    after = F.slice(_codes(token), 2, F.length(token) + 1)
    return F.aggregate(after, start, lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.element_at(table, a["last"] * n + c + 1)).alias("sum")), lambda a: a["sum"])


def _spans(rows: DataFrame, text: Column, model: list[float] | None, min_log_odds: float) -> DataFrame:
    """Adds _base and _spans to rows with a text that is not null."""
    none = F.lit(None).cast("struct<pieces:array<string>,found:array<string>>")
    rows = rows.withColumns(
        {
            "_m0": matches(text, ASSIGN, text.rlike(r"(?i)passw|secret|token|api_?key")),
            "_m1": matches(text, ACCESS, text.contains("AKIA")),
            "_m2": matches(text, HEX, text.rlike(HEX)),
            "_m3": matches(text, CANDIDATE, text.rlike(r"[A-Za-z0-9+/_=-]{16}")) if model else none,
        }
    )
    value = F.transform(F.col("_m0.found"), lambda x: F.regexp_extract(x, ASSIGN, 2))
    spans = [located(F.col("_m0"), 0, value), located(F.col("_m1"), 1), located(F.col("_m2"), 2)]
    base = F.concat(F.filter(spans[0], lambda s: F.length(s["value"]) >= 6), *spans[1:])
    rows = rows.withColumns({"_base": base, "_more": located(F.col("_m3"), 3)})
    if model:
        scored = F.filter(free(F.col("_more"), F.col("_base")), lambda s: log_odds(s["value"], model) > min_log_odds)
        rows = rows.withColumn("_more", F.when(F.size("_more") > 0, scored).otherwise(no_spans()))
    order = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), s["value"].alias("value"))))
    return rows.withColumns({"_base": order(F.col("_base")), "_spans": order(F.concat("_base", "_more"))}).drop("_m0", "_m1", "_m2", "_m3", "_more")


def scan(docs: DataFrame, model: list[float] | None = None, min_log_odds: float = MIN_LOG_ODDS) -> DataFrame:
    """doc_id, base and spans (start, no in KINDS, end, value) of every row of ``docs`` (doc_id, text).  No model: base patterns only."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = _spans(own, F.col("text"), model, min_log_odds)
    return found.select("doc_id", F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def mask(docs: DataFrame, model: list[float] | None = None, min_log_odds: float = MIN_LOG_ODDS) -> DataFrame:
    """``docs`` with ``[REDACTED:kind]`` in place of every span; of spans that meet, the first one names the whole."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text.alias("_text"))
    names = F.array(*(F.lit(k) for k in KINDS))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        fresh = s["start"] >= at
        return F.greatest(at, s["end"]), F.struct(at.alias("from"), s["start"].alias("start"), F.element_at(names, s["no"] + 1).alias("kind"), fresh.alias("fresh"))

    def cleaned(spans: Column, cut: Column) -> Column:
        marks = F.filter(walk(spans, F.lit(0), "bigint", "struct<from:bigint,start:bigint,kind:string,fresh:boolean>", step), lambda m: m["fresh"])
        texts = F.transform(marks, lambda m: F.concat(part(cut, m["from"], m["start"]), F.lit("[REDACTED:"), m["kind"], F.lit("]")))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(texts, ""), part(cut, end, F.length("_text").cast("bigint")))

    clean = let(slices(F.col("_text")), lambda cut: cleaned(F.col("_spans"), cut))
    found = _spans(own, F.col("_text"), model, min_log_odds)
    new = F.when(F.size("_spans") > 0, clean).otherwise(F.col("_row.text"))
    return found.select(*(new.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def trained(docs: DataFrame) -> list[float]:
    drawn = random_samples(docs.sparkSession).unionByName(ordinary_samples(docs.sparkSession))
    return train(sample_pairs(drawn).unionByName(ordinary_pairs(docs)))


def report(found: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans as text."""
    many = lambda k: F.size(F.filter("base", lambda s: s["no"] == k)).cast("long")
    return found.select("doc_id", many(0).alias("n_assign"), many(1).alias("n_access"), many(2).alias("n_hex"), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
