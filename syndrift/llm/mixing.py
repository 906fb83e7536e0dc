"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled (by a seeded hash) and laid end to end; the words are cut into blocks of
equal size, which may begin and end inside a document.  The schedule is a row of slots: the golden ratio's
multiples, or van der Corput's points, fall into the sources' shares of the unit interval, and the k-th slot of a
source takes its k-th block, from the first again after the last.  Any stretch of the schedule is then close to
the target shares.  Slots are drawn until each source has as many as its target needs; later ones are left out and
the last one of a source stops at its target.  Every slot has its place in the schedule.

Targets share all words by weight; no target exceeds ``epochs`` times its source, and what a source cannot take
goes to the others by weight until none is above.

Ranks and running totals inside a source are taken in two steps, over ranges of the shuffled order and then over
the ranges' totals.  There are as many ranges as a range has rows, the root of the source's documents, so neither
step puts more than that in one task, and a source with a third of all documents spreads over all tasks.  Weights, targets and cut points are one small row for each source, gathered up to ``MAX_SOURCES``.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last
in order; equal doc_ids are told apart by nothing, so repeated rows each take what the tie gives them; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
SEED = 20
MAX_SOURCES = 100_000
#: Words of a block: about a ``SLOTS``-th of the mix, so the schedule stays small against the documents; and no
#: more than a full context of a common model.
SLOTS, MAX_BLOCK = 50_000, 4096
GOLDEN = 0.6180339887498949
#: Cells of the unit interval by which points find their source.
CELLS = 1 << 16


def size_of(text: Column) -> Column:
    """Number of runs of non-white-space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[float], weights: list[float], epochs: float = EPOCHS) -> list[float]:
    """Each source's share of all words by weight, none above ``epochs`` times its size."""
    open_, out, left = {i for i, s in enumerate(sizes) if s > 0}, [0.0] * len(sizes), float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / whole > epochs * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(epochs * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def golden(i: Column) -> Column:
    """The i-th multiple of the golden ratio, less its whole part."""
    return i * F.lit(GOLDEN) - F.floor(i * F.lit(GOLDEN))


def van_der_corput(i: Column, bits: int = 40) -> Column:
    """The binary digits of i mirrored at the point."""
    mirrored = F.reverse(F.lpad(F.bin(i.cast("long")), bits, "0"))
    return F.conv(mirrored, 2, 10).cast("double") / F.lit(float(1 << bits))


def before(df: DataFrame, group: list[str], place: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the group.  Rows go by the range ``place``, then ``order``."""
    totals = df.groupBy(*group, place).agg(F.sum(value).alias("_range"))
    ahead = Window.partitionBy(*group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_range").over(ahead), F.lit(0))).drop("_range")
    inside = Window.partitionBy(*group, place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(totals, [*group, place]).withColumn(out, F.col("_ahead") + F.col("_inside")).drop("_ahead", "_inside")


def plan(sized: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> list[dict]:
    """One entry for each source, by code point and null last: its size, weight and target."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes, own = [r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))]
    return [{"sid": i, "source": r.source, "docs": r.docs, "source_size": r["size"], "weight": w, "target": t} for i, (r, w, t) in enumerate(zip(rows, own, targets(sizes, own, epochs), strict=True))]


def cut_points(source: dict, block: int) -> dict:
    """Adds the slots that a source needs: ``full`` whole ones and, if anything is left, one of ``rest`` words.

    A turn through all blocks takes the source once; its last block may be short, so whole turns count first.
    """
    want, size = round(source["target"]), source["source_size"]
    turns, left = divmod(want, size) if size else (0, 0)
    blocks = -(-size // block)
    full, rest = turns * blocks + left // block, left % block
    return source | {"blocks": blocks, "full": full, "rest": rest, "slots": full + (rest > 0)}


def schedule(spark: SparkSession, sources: list[dict], point: Callable = golden) -> DataFrame:
    """slot, sid and rank: as many slots of a source as it needs, in the order of the points drawn.

    A source's part of the unit interval is its part of all slots needed, the target in whole blocks.  Of n slots in all,
    multiples of the golden ratio meet an interval of length w at least once in 2.62 / w points and van der Corput's once in
    4 / w, wherever they begin; so with 4 n points, and some for rounding, every source has what it needs.
    """
    need = {s["sid"]: s["slots"] for s in sources if s["slots"]}
    whole = sum(need.values())
    if not whole:
        return spark.createDataFrame([], "slot bigint, sid int, rank bigint")
    edges, at = [], 0
    for sid, n in need.items():
        edges.append((sid, at / whole, (at + n) / whole, n))
        at += n
    table = spark.createDataFrame(edges, "sid int, low double, high double, need long")
    slots = 4 * whole + 64
    # a point's source by its cell of the unit interval, then the exact share
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    shares = F.broadcast(table.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high"))))))
    drawn = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", cell(F.col("u")))
    drawn = drawn.join(shares, "cell").where("low <= u and u < high").select("slot", "sid", "need")
    drawn = drawn.withColumns({"place": F.floor(F.col("slot") / (math.isqrt(slots) + 1)), "one": F.lit(1)})
    ranked = before(drawn, ["sid"], "place", ["slot"], "one", "rank")
    return ranked.where("rank < need").select("slot", "sid", F.col("rank").cast("long").alias("rank"))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))


def mix(docs: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, point: Callable = golden, block: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target and ``taken`` (words that the mix takes of it, repeats counted) of every row."""
    spark = docs.sparkSession
    sized = scratch.write(sized_documents(docs), "sized")
    sources = plan(sized, weights, epochs)
    words = sum(s["source_size"] for s in sources)
    block = block or max(1, min(MAX_BLOCK, words // SLOTS))
    sources = [cut_points(s, block) | {"ranges": math.isqrt(s["docs"]) + 1} for s in sources]
    kinds = {"sid": "int", "source": "string", "source_size": "long", "target": "double", "blocks": "long", "ranges": "long", "full": "long", "rest": "long"}
    facts = spark.createDataFrame([tuple(s[k] for k in kinds) for s in sources], ", ".join(f"{k} {v}" for k, v in kinds.items()))

    own = sized.join(F.broadcast(facts.drop("blocks", "full", "rest")), sized["source"].eqNullSafe(facts["source"])).drop("source")
    shuffled = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    own = own.withColumn("order", shuffled).withColumn("place", F.floor(F.col("order") / F.lit(2.0**60) * F.col("ranges")))
    laid = scratch.write(before(own, ["sid"], "place", ["order", "doc_id", "size"], "size", "begin"), "laid")

    # of every scheduled block: which of the source's it is, and how far it is taken
    slots = schedule(spark, sources, point).join(F.broadcast(facts.select("sid", "blocks", "full", "rest")), "sid")
    used = slots.select("sid", F.pmod("rank", "blocks").alias("block"), F.when(F.col("rank") == F.col("full"), F.col("rest")).otherwise(F.lit(block)).alias("upto"))
    used = used.groupBy("sid", "block").agg(F.sum(F.when(F.col("upto") == block, 1).otherwise(0)).alias("times"), F.sum(F.when(F.col("upto") < block, F.col("upto")).otherwise(0)).alias("upto"))

    # documents meet the blocks that they reach into
    reach = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))
    cut = laid.where("size > 0").select("sid", "begin", "size", F.explode(reach).alias("block"))
    low, high = F.greatest("begin", F.col("block") * block), F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block)
    words = F.col("times") * (high - low) + F.greatest(F.lit(0), F.least(high, F.col("block") * block + F.col("upto")) - low)
    took = cut.join(used, ["sid", "block"]).withColumn("words", words).groupBy("sid", "begin").agg(F.sum("words").alias("taken"))
    out = laid.join(took, (laid["sid"] == took["sid"]) & (laid["begin"] == took["begin"]) & (laid["size"] > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
