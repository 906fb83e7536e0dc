"""Near-duplicates by fast similarity sketching, banding and exact verification.

1. ``sketches``: the set of hashed word shingles of each text, and of every set a sketch of bands * rows
   coordinates.  Round by round each element is hashed to one coordinate; a coordinate keeps the smallest hash
   of the first round that reached it, and after as many random rounds as coordinates, fixed rounds reach the
   rest, so all are filled.  Equal coordinates then estimate the Jaccard similarity, tightly concentrated, for
   about the cost of one pass over the set.
2. Equal sets fall together into classes by a 128-bit digest; only one representative of each goes on.
3. Each band of coordinates is a key.  The smallest representative of a key is tied to its others, which
   takes one row for each member however many share the key; connected, these ties make *families*.
4. Every member is first compared, on full sets, with the one that it is tied to by most bands and with the one of its
   family that shares most of its bands with others, as the text that all others are copies of does; most families are
   then one component, and done.  In the others all pairs of different components are compared, so whatever the sketch would
   estimate, no link between two members is lost.  Members of a family are cut into blocks, large components apart from
   the rest and sets of like size together, and blocks meet in separate tasks: not those of one component, nor those whose
   sizes are too far apart for a link.  Tasks give back a spanning forest of the links, never the pairs.
5. The components of all these links are the near-duplicate groups.

``shape`` derives rows and bands from the threshold t: two sets at t miss each other in every band with probability
(1 - t**rows)**bands, at most ``MISS`` (4.6e-6 at 0.85); even then a third member can bring them into one family.
Sets too small to reach t with another set (5 or fewer shingles at 0.85, 3 or fewer at 0.8) need no band.

Defined results: a null or empty text has no shingles, is linked with nothing and is its own component; rows that
share a doc_id count as one document and each comes out with its own n_shingles; other columns are ignored.
A null doc_id stays out of the links: its component is null and it is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .store import Scratch

SHINGLE = 5
NUMERATOR, DENOMINATOR = 85, 100
#: Most coordinates of a sketch, and the chance that two sets at the threshold miss each other in every band.
COORDINATES, MISS = 560, 5e-6
#: Members of a block of a family, and bytes of their sets; two blocks meet in one task.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Up to so many family members their ids are broadcast (16 bytes each); beyond, the texts are shuffled to them.
BROADCAST_ROWS = 400_000
PART_BYTES = 1 << 20

U = np.uint64
FULL = U(0xFFFFFFFFFFFFFFFF)


def shape(numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[int, int, int]:
    """Size of the smallest set that can reach a threshold (below 1) with another, and rows and bands for the threshold.

    Of two sets of which the smaller has s elements the similarity is s / (s + 1) at most.  Rows are as many as
    ``COORDINATES`` allow with the bands that keep the chance of a miss at ``MISS``.
    """
    t = numerator / denominator
    least = -(-numerator // (denominator - numerator))
    bands = lambda r: math.ceil(math.log(MISS) / math.log1p(-(t**r)))
    rows = max((r for r in range(1, 65) if r * bands(r) <= COORDINATES), default=1)
    return least, rows, bands(rows)


def sketch(elements: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates for each of the non-empty sets that lie end to end in ``elements``."""
    out = np.full(len(counts) * t, FULL, U)
    base = np.repeat(np.arange(len(counts)) * t, counts)
    open_ = np.arange(len(counts))
    owner = np.repeat(open_, counts)
    for k in range(2 * t):
        if k < t:
            h = T.mix(elements ^ U((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            at = base + (((h >> U(32)) * U(t)) >> U(32)).astype(np.int64)
        else:
            h = T.mix(elements ^ U((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            at = base + (k - t)
        np.minimum.at(out, at, (U(k) << U(52)) | (h >> U(12)))
        left = (out.reshape(-1, t)[open_] == FULL).any(axis=1)
        if not left.all():
            open_ = open_[left]
            if not len(open_):
                break
            stays = np.zeros(len(counts), bool)
            stays[open_] = True
            stays = stays[owner]
            elements, base, owner = elements[stays], base[stays], owner[stays]
    return out.reshape(-1, t)


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    parts = rows.reshape(len(rows), bands, -1)
    key = np.zeros(parts.shape[:2], U)
    for k in range(parts.shape[2]):
        key = key * U(T.BASE) + parts[:, :, k]
    return T.mix(key + (np.arange(bands, dtype=U) + U(1)) * U(0xD6E8FEB86659FD93))


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    buf, offs = T.pack(texts)
    starts, ends, counts = T.words(buf, offs, T.SPACE)
    return list(T.shingles(T.hashes(buf, starts, ends, T.LOWER), counts, n))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, n: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, the digest (d1, d2) of the set, and its band keys (none for sets too small for the threshold)."""
    least, rows, bands = shape(numerator, denominator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.parts(batch.column(1), PART_BYTES):
                sets = _sets(batch.column(1).slice(lo, hi - lo), n)
                size = np.array([len(x) for x in sets])
                digest = [np.array([T.mix(x ^ U(s)).sum(dtype=U) for x in sets], U).view(np.int64) for s in (1, 0x5851F42D4C957F2D)]
                some = np.flatnonzero(size >= least)
                keys = band_keys(sketch(np.concatenate([sets[i] for i in some]), size[some], rows * bands), bands) if len(some) else np.zeros((0, bands), U)
                cut = np.concatenate([[0], np.cumsum((size >= least) * bands)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(cut), pa.array(keys.ravel().view(np.int64)))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), *(pa.array(x) for x in digest), keys]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "keys"])

    return _narrow(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>")


def _apart(keyed: DataFrame, key: str = "a") -> DataFrame:
    """The same rows, no longer known to be dealt by a key: a join then deals both sides, and splits a key with many rows."""
    return keyed.withColumn(key, F.bitwise_not(F.bitwise_not(key)))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that it reaches.

    Large-star and small-star steps in turn: each ties a node's larger, then its smaller neighbours to the
    smallest.  A step keeps at most one row for each edge; both end after a logarithmic number of rounds in a
    forest of stars.  Each round is a written table.
    """
    now = scratch.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, k = print_of(now), 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _apart(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(_apart(least), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        k += 1
        after = scratch.write(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        now, found = after, print_of(after)
        if found == before:
            break
        before = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def links(sets: list[np.ndarray], numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> np.ndarray:
    """Matrix of the linked pairs: ``denominator * intersection >= numerator * union``, neither empty."""
    size = np.array([len(x) for x in sets])
    n = len(sets)
    if n <= 8:
        meet = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i):
                meet[i, j] = meet[j, i] = np.intersect1d(sets[i], sets[j], assume_unique=True).size
    else:
        # columns: the elements that two or more have; rows: the sets
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
        _, column, many = np.unique(flat, return_inverse=True, return_counts=True)
        shared = many[column] > 1
        rank = np.cumsum(many > 1) - 1
        column, owner = rank[column[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        meet = np.zeros((n, n), np.float32)
        step = 4096
        for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, step):
            lo, hi = np.searchsorted(column, [at, at + step])
            part = np.zeros((n, step), np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            meet += part @ part.T
        meet = meet.astype(np.int64)
    union = size[:, None] + size[None, :] - meet
    out = (denominator * meet >= numerator * union) & (union > 0) & (meet > 0)
    np.fill_diagonal(out, False)
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what ``linked`` joins, fewer than there are rows."""
    left, out = set(range(len(linked))), []
    while left:
        todo = [left.pop()]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(linked[x]).tolist():
                if y in left:
                    left.remove(y)
                    out.append((x, y))
                    todo.append(y)
    return out


def near_duplicates(docs: DataFrame, scratch: Scratch, n: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    drawn = scratch.write(sketches(docs, n, numerator, denominator), "sketches")
    classes = scratch.write(drawn.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    keyed = drawn.where(F.col("n_shingles") >= shape(numerator, denominator)[0]).join(classes, ["d1", "d2"]).where("doc_id = rep")
    reps = scratch.write(keyed.select("rep", F.explode("keys").alias("key")), "keys")
    least = reps.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    pairs = reps.join(_apart(least, "key"), "key").groupBy(F.col("rep").alias("a"), F.col("least").alias("b")).agg(F.count("*").alias("n"))
    pairs = scratch.write(pairs, "pairs")
    family = scratch.write(components(pairs.select("a", "b"), scratch, "ties"), "family")
    scratch.drop("keys")

    member = family.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    if family.count() <= BROADCAST_ROWS:
        member = F.broadcast(member)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.parts(batch.column(1), PART_BYTES):
                part = batch.slice(lo, hi - lo)
                raw = pa.array([x.tobytes() for x in _sets(part.column(1), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), raw], ["doc_id", "family", "shingles"])

    sets = _narrow(docs).join(member, "doc_id").select("doc_id", "text", "family").mapInArrow(full, "doc_id bigint, family bigint, shingles binary")
    sets = scratch.write(sets.dropDuplicates(["doc_id", "shingles"]), "sets")
    tied = scratch.write(verified(likely(pairs, family), sets, numerator, denominator), "tied")
    home = scratch.write(components(tied, scratch, "near"), "home")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["doc_id"].to_numpy()
        pairs = forest(links([np.frombuffer(x, U) for x in rows["shingles"]], numerator, denominator))
        return pd.DataFrame({"a": [ids[i] for i, _ in pairs], "b": [ids[j] for _, j in pairs]}, dtype="int64")

    met = dealt(sets, home, numerator / denominator).groupBy("family", "x", "y").applyInPandas(compare, "a bigint, b bigint")
    found = tied.unionByName(scratch.write(met, "met"))
    linked = components(found, scratch, "links")
    group = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = drawn.select("doc_id", "n_shingles", "d1", "d2").join(group, ["d1", "d2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def likely(pairs: DataFrame, family: DataFrame) -> DataFrame:
    """(a, b): at most two ties of each member, from ``pairs`` (a, b, number of shared bands): the strongest, and that to its family's hub."""
    best = pairs.where("a != b").groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b")))["b"].alias("b")).select("a", (-F.col("b")).alias("b"))
    shared = pairs.groupBy("a").agg(F.sum("n").alias("n")).join(family, F.col("a") == F.col("node"))
    hubs = shared.groupBy("component").agg(F.max(F.struct("n", (-F.col("a")).alias("a")))["a"].alias("hub"))
    to_hub = family.join(_apart(hubs, "component"), "component").select(F.col("node").alias("a"), (-F.col("hub")).alias("b")).where("a != b")
    return best.unionByName(to_hub).distinct()


def verified(ties: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Those of ``ties`` (a, b) whose full sets are linked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                meet = np.intersect1d(p, q, assume_unique=True).size
                ok.append(denominator * meet >= numerator * (len(p) + len(q) - meet))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # the one that many are held against comes to them, each goes to its own place
    with_b = ties.join(_apart(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b"), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(check, "a bigint, b bigint").distinct()


def dealt(sets: DataFrame, home: DataFrame, t: float) -> DataFrame:
    """family, x, y, doc_id, shingles: the members of every two blocks (x, y) that may have links between components not yet known."""
    info = sets.select("doc_id", "family", F.length("shingles").alias("size")).join(home.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    info = info.withColumn("component", F.coalesce("component", "doc_id"))
    parts = info.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    families = parts.groupBy("family").agg(F.sum("n").alias("members"), F.sum("bytes").alias("all"), F.count("*").alias("k")).where("k > 1").drop("k")
    parts = _apart(parts, "family").join(families, "family")
    # blocks: of a large component, or of the rest; of sets of like size (two linked sets are at most one step of t apart)
    few = (F.col("members") <= BLOCK) & (F.col("all") <= BLOCK_BYTES)
    large = (F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)
    parts = parts.select("family", "component", F.when(large & ~few, F.col("component")).alias("large"), few.alias("few"))
    step = F.floor(F.log(F.col("size") / 8) / (-math.log(t) * 1.0001))
    info = info.join(_apart(parts, "component").withColumnRenamed("family", "f"), "component").where("family = f").drop("f").withColumn("step", F.when(F.col("few"), F.lit(0)).otherwise(step).cast("int"))
    kinds = info.groupBy("family", "large", "step").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    name = lambda i: F.xxhash64("family", "large", "step", i)
    each = kinds.select("family", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct("large", "step", name(i).alias("name"))).alias("own"))
    each = each.groupBy("family").agg(F.flatten(F.collect_list("own")).alias("others"))
    info = info.join(_apart(each, "family"), "family").join(_apart(kinds, "family").withColumnsRenamed({"family": "f", "large": "l", "step": "s"}), (F.col("family") == F.col("f")) & F.col("large").eqNullSafe(F.col("l")) & (F.col("step") == F.col("s")))
    own = name(F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int"))
    near = F.filter("others", lambda o: (F.abs(o["step"] - F.col("step")) <= 1) & F.coalesce(o["large"] != F.col("large"), F.lit(True)))
    info = info.select("doc_id", "family", own.alias("own"), F.explode(F.transform(near, lambda o: o["name"])).alias("other")).distinct()
    out = info.join(sets.drop("family"), "doc_id")
    return out.select("family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "doc_id", "shingles")


def report(found: DataFrame) -> DataFrame:
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
