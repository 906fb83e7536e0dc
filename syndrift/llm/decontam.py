"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` writes the postings of the training texts in segments: a segment holds some consecutive texts
of one partition, and for each of its terms the sorted positions at which it stands.  ``find_phrases`` and
``find_near`` send the queries to every segment and intersect posting lists there, beginning with the term that
is rarest in the segment.  Nothing is shuffled, no list outgrows a segment, and a term that stands in every text
is as cheap as any other, because only lists of rare terms are walked.

Queries are held in memory by block: their size is measured first, and beyond ``BLOCK_CHARS`` they are split by
a hash of their id into blocks that each search the whole index, so a broadcast never exceeds about that bound
(one longer text makes a block of its own size).

Defined results: a null or empty text has no words and is found by nothing; an empty query is found nowhere; a
row of ``docs`` yields one row, so repeated rows repeat, however many blocks are searched; queries with a null id are left out; other columns are
ignored.  Terms are 64-bit hashes of words, so a false match needs a collision of two words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .store import Scratch

WINDOW = 13
#: Bytes of text in a segment; one longer text is a segment of its own.
SEGMENT_BYTES = 2 << 20
BLOCK_CHARS = 32 << 20
#: As ``textnum.LOWER``: A-Z only.
FOLD = {c: c + 32 for c in range(65, 91)}

SEGMENT = "doc_ids array<bigint>, starts array<bigint>, terms array<bigint>, heads array<bigint>, places array<int>"
FOUND = "doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<bigint>"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offs = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, kind))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = T.pack(texts)
    starts, ends, counts = T.words(buf, offs, T.MARKS)
    return T.hashes(buf, starts, ends, T.LOWER), counts


def build_index(docs: DataFrame, scratch: Scratch, terms: np.ndarray | None = None, table: str = "index") -> DataFrame:
    """Postings of ``docs`` (doc_id, text), written once.  ``terms``: hashes of the only terms to keep, sorted."""
    kept = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.parts(batch.column(1), SEGMENT_BYTES):
                h, counts = _tokens(batch.column(1).slice(lo, hi - lo))
                # one empty place after each text keeps phrases inside it
                starts = np.concatenate([[0], np.cumsum(counts + 1)])
                place = np.arange(len(h)) + np.repeat(np.arange(len(counts)), counts)
                if kept is not None:
                    at = np.searchsorted(kept.value, h)
                    at[at == len(kept.value)] = 0
                    here = kept.value[at] == h if len(kept.value) else np.zeros(len(h), bool)
                    h, place = h[here], place[here]
                order = np.argsort(h, kind="stable")
                found, heads = np.unique(h[order], return_index=True)
                ids = batch.column(0).slice(lo, hi - lo)
                row = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids)]
                row += [_lists([x], pa.int64()) for x in (starts, found.view(np.int64), np.append(heads, len(h)))]
                row.append(_lists([place[order].astype(np.int32)], pa.int32()))
                yield pa.RecordBatch.from_arrays(row, ["doc_ids", "starts", "terms", "heads", "places"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.write(narrow.mapInArrow(segments, SEGMENT), table)


class Segment:
    """One row of the index, as numpy arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        column = lambda name: batch.column(name)[i].values
        self.doc_ids = column("doc_ids")
        self.starts = column("starts").to_numpy()
        self.terms = column("terms").to_numpy().view(np.uint64)
        self.heads = column("heads").to_numpy()
        self.places = column("places").to_numpy().astype(np.int64)
        self.width = int(self.starts[-1]) + 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.starts) - 1

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in this segment; -1 where it has none."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place of its first word) of every occurrence; ``terms`` has one phrase a row."""
        number = self.numbers(terms)
        phrase = np.flatnonzero((number >= 0).all(axis=1))
        number = number[phrase]
        sizes = self.heads[number + 1] - self.heads[number]
        order = np.argsort(sizes, axis=1, kind="stable")
        # the rarest list of each phrase, shifted to the phrase's start ...
        rare = np.take_along_axis(number, order[:, :1], 1)[:, 0]
        n = self.heads[rare + 1] - self.heads[rare]
        which = np.repeat(np.arange(len(phrase)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.heads[rare][which]
        begin = self.places[at] - order[which, 0]
        # ... meets the others from rare to frequent; lists lie end to end, so one search serves all phrases
        keys = np.repeat(np.arange(len(self.terms)), np.diff(self.heads)) * self.width + self.places
        for k in range(1, terms.shape[1]):
            if not len(which):
                break
            wanted = begin + order[which, k]
            key = number[which, order[which, k]] * self.width + wanted
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = (keys[found] == key) & (wanted >= 0) & (wanted < self.width)
            which, begin = which[ok], begin[ok]
        return phrase[which], begin

    def near(self, terms: np.ndarray, within: int) -> list[tuple[int, int, int]]:
        """(text, first place, last place) of every shortest run of at most ``within`` words with all terms."""
        number = self.numbers(terms)
        if not len(terms) or (number < 0).any():
            return []
        lists = [self.places[self.heads[x] : self.heads[x + 1]] for x in number]
        rare = min(lists, key=len)
        close = lambda x: x[_near(rare, x) < within]  # noqa: E731  only what can reach a place of the rarest term
        marked = sorted((int(p), k) for k, x in enumerate(lists) for p in close(x))
        last, out = {}, []
        for p, k in marked:
            last[k] = p
            first = min(last.values())
            if len(last) == len(lists) and p - first < within:
                text = int(np.searchsorted(self.starts, p, "right")) - 1
                if first >= self.starts[text] and all(v < first or v == last[j] for j, v in last.items()):
                    out.append((text, first - int(self.starts[text]), p - int(self.starts[text])))
        return [x for i, x in enumerate(out) if i + 1 == len(out) or out[i + 1][:2] != x[:2] or out[i + 1][2] < x[2]]


def _near(rare: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(rare, x)
    left = np.abs(x - rare[np.maximum(at - 1, 0)])
    return np.minimum(left, np.abs(x - rare[np.minimum(at, len(rare) - 1)]))


def phrase_windows(ids: list[int], texts: list[str], n: int = WINDOW) -> dict[int, tuple[np.ndarray, list[set]]]:
    """By length: distinct n-word windows (one a row) and the ids that hold each; a shorter text is one window."""
    h, counts = _tokens(pa.array(texts, pa.string()))
    at, by = 0, {}
    for i, c in zip(ids, counts.tolist(), strict=True):
        own = h[at : at + c]
        at += c
        for k in range(max(c - n + 1, 1) if c else 0):
            w = own[k : k + n]
            by.setdefault(len(w), {}).setdefault(w.tobytes(), set()).add(i)
    return {n: (np.frombuffer(b"".join(x), np.uint64).reshape(-1, n), list(x.values())) for n, x in by.items()}


def find_phrases(index: DataFrame, windows: dict[int, tuple[np.ndarray, list[set]]]) -> DataFrame:
    """For every text the word ranges that windows cover (merged, end exclusive) and the ids found in it."""
    held = index.sparkSession.sparkContext.broadcast(windows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch, i)
                n = len(seg.doc_ids)
                edge = np.zeros(seg.width + 1, np.int64)
                items: list[set] = [set() for _ in range(n)]
                for length, (terms, ids) in held.value.items():
                    phrase, begin = seg.phrases(terms)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + length, -1)
                    pairs = np.unique(np.stack([np.searchsorted(seg.starts, begin, "right") - 1, phrase]), axis=1)
                    for text, p in pairs.T.tolist():
                        items[text] |= ids[p]
                hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
                lo, hi = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
                text = np.searchsorted(seg.starts, lo, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(x - seg.starts[text], pa.int32()) for x in (lo, hi)], ["start", "end"])
                cut = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [seg.doc_ids, pa.array(seg.n_words, pa.int64()), pa.ListArray.from_arrays(cut, spans), _lists([np.array(sorted(x), np.int64) for x in items], pa.int64())],
                    ["doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(search, FOUND)


def find_near(index: DataFrame, queries: dict[int, list[str]], within: int) -> DataFrame:
    """Every shortest run of at most ``within`` words that has all words of a query, in any order.  Words are folded as in the index."""
    held = index.sparkSession.sparkContext.broadcast({i: np.unique(np.array([T.word_hash(x.translate(FOLD)) for x in q], np.uint64)) for i, q in queries.items()})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch, i)
                rows = [(seg.doc_ids[t].as_py(), q, a, b) for q, terms in held.value.items() for t, a, b in seg.near(terms, within)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "query_id", "first", "last"])

    return index.mapInArrow(search, "doc_id bigint, query_id bigint, first bigint, last bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, n: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """FOUND for every row of ``docs``: where windows of ``benchmark`` (item_id, text) stand, and of which items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1

    def block(k: int) -> dict:
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        return phrase_windows([r.item_id for r in rows], [r.text for r in rows], n)

    found, own = None, docs
    if blocks > 1:
        # the same rows in every block: each keeps a key of its own, written once with its text
        keyed = scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "keyed")
        own = keyed.select(F.col("row").alias("doc_id"), "text")
    for k in range(blocks):
        windows = block(k)
        terms = np.unique(np.concatenate([x.ravel() for x, _ in windows.values()] or [np.zeros(0, np.uint64)]))
        index = build_index(own, scratch, terms, f"index{k}")
        if blocks == 1:
            return find_phrases(index, windows)
        part = scratch.write(find_phrases(index, windows).where((F.size("spans") > 0) | F.lit(k == 0)), f"found{k}")
        scratch.drop(f"index{k}")
        found = part if found is None else found.unionByName(part)
    merged = merge_found(found).withColumnRenamed("doc_id", "row")
    return merged.join(keyed.select("row", "doc_id"), "row").select("doc_id", "n_words", "spans", "items")


def merge_found(found: DataFrame) -> DataFrame:
    """One row for each doc_id from those of several blocks: their ranges and ids together."""
    rows = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate(
        "s",
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return rows.select("doc_id", "n_words", merged.alias("spans"), "items")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of a contamination check: word counts, ids and the verdict (a twentieth of all words)."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    rows = found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))

