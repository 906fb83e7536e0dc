"""Quality classifier by co-training of two views.

The text view sees what a text is made of: shares of kinds of characters, repetition, and the presence of telling
words and word beginnings.  The metadata view sees language, source, length class and the tokens of the page's URL.
Each is a logistic regression, first fitted to labelled documents.  In every round each view labels, of all documents
without a label, those of which it is sure, and the *other* view is fitted again with these added.  What they add comes
from one pass over the whole table: their slope at the view's present weights and a bound of their curvature, summed for
each weight (``pseudo``), so fitting works on the labelled documents and this bound, however many documents there are.
They weigh at most as much as the labelled ones.  At the end each view's score is calibrated on labelled documents kept
apart, and the two are combined as independent evidence: their log-odds add up, less the prior's.

A document is good if its label says quality and not toxic.  Fitting uses at most ``MAX_LABELLED`` labelled documents,
those with the smallest hashed ids, and tells them apart by the ``MAX_TERMS`` most telling terms; documents without a
label all take part.  Scoring covers every document, and shuffles no texts.

Defined results: a null or empty text has no terms and zero shares; null metadata is a value of its own; labels of
unknown documents are left out, repeated ones count as bad if any is, a null quality counts as good and a null toxic as not; without both kinds of labels (or with fewer than 20)
every score is the prior, 1 if there are none; rows map one to one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .sampling import smallest
from .store import Scratch
from .url_filter import tokens as url_tokens

MAX_LABELLED, MAX_TERMS = 12_000, 4096
MIN_DOCS, MIN_Z = 6, 5.0
ROUNDS, SURE = 3, 0.98
#: Scores below are rejected.
THRESHOLD = 0.5
PREFIX = 5
PART_BYTES = 1 << 20
META_DIMS = 1 << 12

KINDS = [np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>", b"!?", b"|", b".,;:", range(128, 256), b"\n")]
DENSE = len(KINDS) + 7


def _terms(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without marks around, and of their beginnings."""
    whole = T.hashes(buf, starts, ends, T.LOWER)
    return whole, T.mix(T.hashes(buf, starts, np.minimum(ends, starts + PREFIX), T.LOWER) ^ np.uint64(0x5A5A))


def dense(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shares and averages for each text."""
    starts, ends, counts = T.words(buf, offs, T.SPACE)
    sums = lambda v, at: np.diff(np.concatenate([[0], np.cumsum(v)])[at])
    size, cut = np.maximum(np.diff(offs), 1), np.concatenate([[0], np.cumsum(counts)])
    n = np.maximum(counts, 1)
    text = np.repeat(np.arange(len(counts)), counts)
    cols = [sums(k[buf], offs) / size for k in KINDS]
    width = ends - starts
    upper = KINDS[0][buf[starts]] & KINDS[0][buf[np.maximum(ends - 2, starts)]]
    odd = ~(KINDS[0] | KINDS[1] | KINDS[2] | KINDS[7])[buf[np.maximum(ends - 1, starts)]]
    key = T.mix(T.hashes(buf, starts, ends, T.LOWER) ^ T.mix(text.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    distinct = np.bincount(text[first], minlength=len(counts)) if len(key) else np.zeros(len(counts))
    again = counts - distinct
    pair = T.mix(key[:-1] * np.uint64(T.BASE) + key[1:])[text[:-1] == text[1:]] if len(key) > 1 else key[:0]
    owner = text[:-1][text[:-1] == text[1:]] if len(key) > 1 else text[:0]
    _, first = np.unique(pair, return_index=True)
    pairs = np.bincount(owner, minlength=len(counts))
    pairs_again = pairs - np.bincount(owner[first], minlength=len(counts))
    cols += [sums(upper, cut) / n, sums(odd, cut) / n, sums(width, cut) / n / 10, sums(width == 1, cut) / n, np.log1p(counts) / 10, again / n, pairs_again / np.maximum(pairs, 1)]
    return np.stack(cols, axis=1)


def features(texts: pa.Array, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense features, and CSR (cut, column) of the distinct terms: numbers in ``chosen`` (sorted), or hashes if none."""
    buf, offs = T.pack(texts)
    x = dense(buf, offs)
    starts, ends, counts = T.words(buf, offs, T.MARKS)
    text = np.repeat(np.arange(len(counts)), counts)
    t = np.concatenate(_terms(buf, starts, ends))
    owner = np.concatenate([text, text])
    if chosen is not None:
        if not len(chosen):
            return x, np.zeros(len(counts) + 1, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(chosen, t), len(chosen) - 1)
        here = chosen[at] == t
        key = np.unique(owner[here] * len(chosen) + at[here])
        owner, column = key // len(chosen), key % len(chosen)
    else:
        key, first = np.unique(T.mix(t ^ T.mix(owner.astype(np.uint64))), return_index=True)
        first = first[np.argsort(owner[first], kind="stable")]
        owner, column = owner[first], t[first]
    return x, np.searchsorted(owner, np.arange(len(counts) + 1)), column


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def raw(self, x: np.ndarray, cut: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Log-odds of dense rows and CSR indicator columns."""
        d = x.shape[1]
        z = ((x - self.mean) / self.scale) @ self.weights[:d] + self.bias
        total = np.concatenate([[0.0], np.cumsum(self.weights[d:][column])])
        return z + total[cut[1:]] - total[cut[:-1]]

    def calibrated(self, *rows: np.ndarray) -> np.ndarray:
        return self.a * self.raw(*rows) + self.b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Bound:
    """What pseudo-labelled documents add to a loss: near weights ``at`` (the bias last), no more than slope and curvature say."""

    at: np.ndarray
    slope: np.ndarray
    curve: np.ndarray
    n: float


def fit(x: np.ndarray, cut: np.ndarray, column: np.ndarray, dims: int, y: np.ndarray, more: Bound | None = None, ridge: float = 1e-3, steps: int = 200) -> Logistic:
    """Ridge logistic regression by Adam over all rows; deterministic."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    d = x.shape[1]
    owner = np.repeat(np.arange(len(y)), np.diff(cut))
    w = np.zeros(d + dims + 1)
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    share = min(1.0, len(y) / more.n) if more else 0.0
    n = len(y) + (share * more.n if more else 0)
    for k in range(1, steps + 1):
        s = z @ w[:d] + w[-1] + np.bincount(owner, w[d:-1][column], len(y))
        e = (sigmoid(s) - y) / n
        g = np.concatenate([z.T @ e, np.bincount(column, e[owner], dims), [e.sum()]])
        if more:
            g += share / n * (more.slope + more.curve * (w - more.at))
        g[:-1] += ridge * w[:-1] / len(y) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9) * (1 if k < steps // 2 else 0.3)
    return Logistic(w[:-1].copy(), float(w[-1]), mean, scale)


def bound_of(model: Logistic, rows: tuple, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature that rows with labels ``y`` add for each weight.

    A row's share of the curvature is spread by the sum of its features, which is never less than the true one.
    Values are rounded to powers of two, so that sums do not depend on the order of the rows.
    """
    x, cut, column = rows
    z = np.round((x - model.mean) / model.scale * 256) / 256
    p = sigmoid(model.raw(*rows))
    e, c = (np.round(v * 2**20) / 2**20 for v in (p - y, np.maximum(p * (1 - p), 0.02)))
    owner = np.repeat(np.arange(len(y)), np.diff(cut))
    c = c * np.round(1 + np.diff(cut) + np.abs(z).sum(axis=1))
    dims = len(model.weights) - x.shape[1]
    return np.concatenate([z.T @ e, np.bincount(column, e[owner], dims), [e.sum()]]), np.concatenate([np.abs(z).T @ c, np.bincount(column, c[owner], dims), [c.sum()]])


def pseudo(pool: DataFrame, models: dict[str, Logistic]) -> dict[str, Bound]:
    """For each view the bound of all documents in ``pool`` (dense, terms, meta) that the other view is sure of."""
    held = pool.sparkSession.sparkContext.broadcast(models)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        for batch in batches:
            views = {"text": _flat_text(batch.column(0), batch.column(1)), "meta": _flat_meta(batch.column(2))}
            good = {k: sigmoid(m.calibrated(*views[k])) for k, m in held.value.items()}
            for k, other in (("text", "meta"), ("meta", "text")):
                sure = np.flatnonzero((good[other] >= SURE) | (good[other] <= 1 - SURE))
                if len(sure):
                    slope, curve = bound_of(held.value[k], _take(views[k], sure), (good[other][sure] >= 0.5).astype(float))
                    at = own.setdefault(k, [0, 0, 0])
                    own[k] = [at[0] + slope, at[1] + curve, at[2] + len(sure)]
        for k, (slope, curve, n) in own.items():
            i = np.flatnonzero((slope != 0) | (curve != 0))
            size = len(i) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k] * size), pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(slope[i], n)), pa.array(np.append(curve[i], 0.0))], ["view", "i", "slope", "curve"])

    rows = pool.select("dense", "terms", "meta").mapInArrow(sums, "view string, i int, slope double, curve double")
    found = rows.groupBy("view", "i").agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve")).toArrow().to_pandas()
    out = {}
    for k, own in found.groupby("view"):
        m = models[k]
        slope, curve = np.zeros(len(m.weights) + 1), np.zeros(len(m.weights) + 1)
        real = own[own.i >= 0]
        slope[real.i], curve[real.i] = real.slope, real.curve
        out[k] = Bound(np.append(m.weights, m.bias), slope, curve, float(own[own.i < 0].slope.sum()))
    return out


def calibrate(model: Logistic, rows: tuple, y: np.ndarray) -> None:
    """Platt's scaling: a line through the log-odds, fitted to held-out labels by Newton's method."""
    z = model.raw(*rows)
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - goal) * z).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.a, model.b = max(float(a), 0.0), float(b)


def choose_terms(rows: DataFrame, most: int = MAX_TERMS) -> np.ndarray:
    """Sorted hashes of the terms most telling of the class, from rows (text, good): those with the largest z-scores of
    their document counts.  Counts are added up by Spark; only the chosen come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.parts(batch.column(0), PART_BYTES):
                _, cut, term = features(batch.column(0).slice(lo, hi - lo), None)
                bad = 1 - batch.column(1).slice(lo, hi - lo).to_numpy()
                found, at = np.unique(term, return_inverse=True)
                n, k = np.bincount(at, minlength=len(found)), np.bincount(at, np.repeat(bad, np.diff(cut)), len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64()), pa.array(k.astype(np.int64))], ["term", "n", "bad"])

    rate = rows.agg((1 - F.avg("good")).alias("r")).first()["r"]
    counts = rows.select("text", "good").mapInArrow(count, "term bigint, n bigint, bad bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    z = F.abs(F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    best = counts.where(F.col("n") >= MIN_DOCS).select("term", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").limit(most)
    return np.sort(np.array([r.term for r in best.collect()], np.int64).view(np.uint64))


META = {"lang": "string", "source": "string", "n_chars": "bigint"}


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).cast(k).alias(c) for c, k in META.items()))


def _with_meta(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Hashed metadata values, as ``meta``, in place of the columns that they come from."""
    named = lambda kind, c: F.concat(F.lit(kind), F.coalesce(c, F.lit("null")))
    size = F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(1)).cast("double"))).cast("string")
    values = F.array(named("lang:", F.col("lang")), named("source:", F.col("source")), named("size:", size), named("both:", F.concat_ws("/", "lang", "source")))
    if pages is not None:
        url = pages.where("page_id is not null").groupBy(F.col("page_id").cast("long").alias("doc_id")).agg(F.min(F.col("url").cast("string")).alias("url"))
        rows = rows.join(url.select("doc_id", url_tokens(F.col("url")).alias("url")), "doc_id", "left")
        values = F.concat(values, F.coalesce("url", F.expr("cast(array() as array<string>)")))
    return rows.withColumn("meta", F.array_distinct(F.transform(values, lambda v: F.pmod(F.xxhash64(v), F.lit(META_DIMS)).cast("int")))).drop(*META, "url")


def _flat_meta(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    cut = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return np.zeros((len(lists), 1)), cut, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _flat_text(dense_: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dense_, terms = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (dense_, terms))
    cut = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return dense_.flatten().to_numpy(zero_copy_only=False).reshape(-1, DENSE).astype(float), cut, terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _take(rows: tuple, at: np.ndarray) -> tuple:
    x, cut, column = rows
    n = np.diff(cut)[at]
    to = np.concatenate([[0], np.cumsum(n)])
    return x[at], to, column[np.repeat(cut[at], n) + np.arange(to[-1]) - np.repeat(to[:-1], n)]


@dataclass
class Model:
    terms: np.ndarray
    text: Logistic | None
    meta: Logistic | None
    prior: float

    def of_text(self, texts: pa.Array) -> np.ndarray:
        """Calibrated log-odds of good by the text."""
        return self.text.calibrated(*features(texts, self.terms)) if self.text else np.full(len(texts), self.odds)

    def of_meta(self, meta: pa.Array) -> np.ndarray:
        return self.meta.calibrated(*_flat_meta(meta)) if self.meta else np.full(len(meta), self.odds)

    @property
    def odds(self) -> float:
        p = min(max(self.prior, 1e-9), 1 - 1e-9)
        return float(np.log(p / (1 - p)))


def featured(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``dense`` and ``terms`` (numbers in ``chosen``) in place of ``text``."""
    held = rows.sparkSession.sparkContext.broadcast(chosen)
    other = [c for c in rows.columns if c != "text"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.parts(batch.column(0), PART_BYTES):
                x, cut, column = features(batch.column(0).slice(lo, hi - lo), held.value)
                terms = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(column.astype(np.int16)))
                dense_ = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * DENSE), pa.array(x.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], dense_, terms], [*other, "dense", "terms"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*other).schema)
    return rows.select("text", *other).mapInArrow(part, f"{kinds}, dense array<float>, terms array<smallint>")


def train(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    # ids first: the texts of a bounded number of labelled documents are written for the passes below
    scratch = Scratch(docs.sparkSession, "cotrain")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().join(good, "doc_id")
    picked = smallest(scratch.write(known, "known"), max_labelled).withColumn("held", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)) == 0)
    rows = scratch.write(_with_meta(_own(docs).join(F.broadcast(picked), "doc_id"), pages), "rows")
    seen = rows.agg(F.count("*").alias("n"), F.avg("good").alias("p")).first()
    prior = float(seen["p"]) if seen["n"] else 1.0
    if not 0 < prior < 1 or seen["n"] < 20:
        return Model(np.zeros(0, np.uint64), None, None, prior)
    chosen = choose_terms(rows.where("not held"))
    got = featured(rows.select("text", "doc_id", "meta", "good", "held"), chosen).toArrow().sort_by("doc_id")
    scratch.drop("rows", "known")
    y, held = got["good"].to_numpy().astype(float), got["held"].to_numpy(zero_copy_only=False).astype(bool)
    fold, rest = np.flatnonzero(held), np.flatnonzero(~held)
    views = {"text": (_flat_text(got["dense"], got["terms"]), len(chosen)), "meta": (_flat_meta(got["meta"]), META_DIMS)}

    pool = _with_meta(featured(_own(docs), chosen), pages).join(good.select("doc_id"), "doc_id", "left_anti")
    pool = scratch.write(pool.select("dense", "terms", "meta"), "pool") if rounds else None
    models: dict[str, Logistic] = {}
    more: dict[str, Bound] = {}
    for turn in range(rounds + 1):
        for k, (view, dims) in views.items():
            models[k] = fit(*_take(view, rest), dims, y[rest], more.get(k))
            calibrate(models[k], _take(view, fold), y[fold])
        if turn < rounds:
            more = pseudo(pool, models)
    scratch.drop("pool")
    return Model(chosen, models["text"], models["meta"], prior)


def score(docs: DataFrame, model: Model, pages: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, meta_score, score (probability of good) and kept of every row of ``docs``.

    Texts are scored where they are read; only narrow rows go on to meet the pages' URLs.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.parts(batch.column(1), PART_BYTES):
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column(0), *own.columns[2:], pa.array(held.value.of_text(own.column(1)))], ["doc_id", *META, "text_odds"])

    def by_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_numpy(), held.value.of_meta(batch.column(2))
            both = sigmoid(a + b - held.value.odds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.float64()) for v in (sigmoid(a), sigmoid(b), both)), pa.array(both >= threshold)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    texts = _own(docs).mapInArrow(by_text, "doc_id bigint, " + ", ".join(f"{c} {k}" for c, k in META.items()) + ", text_odds double")
    return _with_meta(texts, pages).select("doc_id", "text_odds", "meta").mapInArrow(by_both, "doc_id bigint, text_score double, meta_score double, score double, kept boolean")
