"""Token counts by an exact histogram of encoded lengths.

Every text is encoded once; each batch gives one row for each length it saw, and Spark adds these up.  Sums over
all shorter and all longer texts then answer, exactly and for every context limit, how many texts fit, how many
tokens there are, how many are left after cutting, and the quantiles.

The sums run in two steps, inside ranges of lengths and over the ranges, so no task holds the whole histogram.

Defined results: a null or empty text has length 0; repeated rows count each; an empty table has an empty
histogram; other columns are ignored.  Strings of special tokens inside a text are ordinary text.  White space of any
length is encoded as the pattern splits it: a run without its last character, which belongs to what follows.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import before

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Lengths of one range: neither a range nor the list of ranges of texts of a million tokens is long.
RANGE = 64
#: Runs of white space (the Unicode property) from this length on are split by hand: matching them takes a stack as deep as they are long.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """The ranks of a byte-pair vocabulary file (about a mebibyte) and the pattern that splits texts for it."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ranks, public_tokenizers.PATTERN


def counter(ranks: dict[bytes, int], pattern: str) -> Callable[[str], int]:
    """How many tokens a text encodes to."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        n, at = 0, 0
        for run in LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            n += len(own.encode_ordinary(text[at : run.start()])) + len(own._core_bpe.encode_single_piece(text[run.start() : end].encode()))
            at = end
        return n + len(own.encode_ordinary(text[at:]))

    return count


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """length and n_docs: how many texts of ``docs`` (text) encode to that many tokens."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(*held.value)
        for batch in batches:
            seen: Counter = Counter(tokens(x.as_py() or "") for x in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "length bigint, n bigint")
    return rows.groupBy("length").agg(F.sum("n").alias("n_docs"))


def answers(hist: DataFrame) -> DataFrame:
    """One row for each length as a limit.

    docs_within and docs_over: texts of at most, and of more, tokens; tokens_within and tokens_over: their tokens;
    tokens_cut_to: what is left if every text is cut to the limit; share_within: the quantile that the limit is.
    """
    h = hist.withColumns({"place": F.floor(F.col("length") / RANGE), "tokens": F.col("length") * F.col("n_docs"), "all": F.lit(0)})
    h = before(before(h, ["all"], "place", ["length"], "n_docs", "docs_below"), ["all"], "place", ["length"], "tokens", "tokens_below")
    totals = F.broadcast(hist.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("length") * F.col("n_docs")).alias("whole")).withColumn("all", F.lit(0)))
    h = h.join(totals, "all").withColumns({"docs_within": F.col("docs_below") + F.col("n_docs"), "tokens_within": F.col("tokens_below") + F.col("tokens")})
    over = F.col("docs") - F.col("docs_within")
    return h.select(
        "length", "n_docs", "docs_within", over.alias("docs_over"), "tokens_within", (F.col("whole") - F.col("tokens_within")).alias("tokens_over"),
        (F.col("tokens_within") + F.col("length") * over).alias("tokens_cut_to"), (F.col("docs_within") / F.col("docs")).alias("share_within"),
    )


def at_limit(answered: DataFrame, limit: int) -> dict:
    """Totals for any context limit: those of the greatest length within it, with longer texts cut to the limit."""
    row = answered.where(F.col("length") <= limit).orderBy(F.desc("length")).first()
    if row is None:
        whole = answered.agg(F.sum("n_docs")).first()[0] or 0
        return {"docs_within": 0, "docs_over": whole, "tokens_cut_to": limit * whole}
    return {"docs_within": row.docs_within, "docs_over": row.docs_over, "tokens_cut_to": row.tokens_within + limit * row.docs_over}


def quantile(answered: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the texts do not exceed."""
    return answered.where(F.col("share_within") >= q).agg(F.min("length")).first()[0]
