"""Decoders: from the fired detectors of a window to predicted observable flips.

A decoder is any object with ``decode(active) -> (flips, confidence)``; ``decoded`` runs it over windows.  A
prediction depends on the fired detectors alone, so each distinct set is decoded once, and sets with nothing fired
never reach Python.  The graph goes to the tasks by broadcast; it is as large as the model's text, which was read
on the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blossoms import heaviest
from .graph import Graph


#: Windows that a decoder gets at once.
BATCH = 8192
#: Windows left for which one by one is faster than all at once.
FEW = 48


class Decoder(Protocol):
    """May also have ``decode_batch(actives) -> (64-bit flips, confidences)``, and ``quiet``, (flips, confidence) of a window with nothing fired, if other than (0, 1.0); None: to be asked."""

    def decode(self, active: np.ndarray) -> tuple[int, float]: ...


class Null:
    """Predicts no flip, with full confidence."""

    quiet = (0, 1.0)

    def decode(self, active: np.ndarray) -> tuple[int, float]:
        return 0, 1.0


class UnionFind:
    """Clusters grow along edges in model order while their count of fired detectors is odd.

    Weights do not matter, the boundary takes up no parity, and there is no peeling: the prediction is the exclusive
    or of the masks of all edges inside clusters.  A pass that merges nothing would repeat forever, so growth stops
    there.
    """

    quiet = (0, 1.0)

    def __init__(self, graph: Graph):
        self.graph = graph
        self.edges = list(zip(graph.u.tolist(), graph.v.tolist(), strict=True))

    def clusters(self, active: np.ndarray) -> list[int]:
        n = self.graph.nodes
        parent, rank, odd = list(range(n)), [0] * n, [0] * n

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a in active.tolist():
            odd[a] = 1
        for _ in range(n):
            grew, left = False, False
            for u, v in self.edges:
                a, b = root(u), root(v)
                if odd[a] % 2 or odd[b] % 2:
                    left = True
                    if a != b:
                        if rank[a] < rank[b]:
                            a, b = b, a
                        parent[b] = a
                        rank[a] += rank[a] == rank[b]
                        odd[a] += odd[b]
                        grew = True
            if not left or not grew:
                break
        return [root(x) for x in range(n)]

    def decode(self, active: np.ndarray) -> tuple[int, float]:
        if not len(active):
            return 0, 1.0
        home = np.array(self.clusters(active))
        inside = home[self.graph.u] == home[self.graph.v]
        return int(np.bitwise_xor.reduce(self.graph.mask[inside], initial=np.uint64(0))), 0.9


    def decode_batch(self, actives: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Flips and confidences of many windows: edges one by one, all windows at each at once.

        Columns are windows, rows are nodes.  Which root a merged cluster keeps does not matter to the result.  An edge
        is only looked at in windows where a cluster with a fired detector has come to one of its ends.  Windows in
        which a pass merged nothing are done and leave the arrays.
        """
        n, b = self.graph.nodes, len(actives)
        size = np.array([len(a) for a in actives])
        odd = np.zeros((n, b), bool)
        if size.sum():
            odd[np.concatenate(actives), np.repeat(np.arange(b), size)] = True
        home = np.repeat(np.arange(n, dtype=np.int32)[:, None], b, axis=1)
        live, reached = np.flatnonzero(size), odd[:, size > 0]
        for _ in range(n):
            k = len(live)
            if k <= FEW:
                for w in live.tolist():
                    home[:, w] = self.clusters(actives[w])
                break
            # parents as places in the flat array of the live columns
            up = (home[:, live] * k + np.arange(k, dtype=np.int32)).ravel()
            now, grew = odd[:, live].ravel(), np.zeros(k, bool)
            for u, v in self.edges:
                near = (reached[u] | reached[v]).nonzero()[0]
                a, c = _roots(up, near + u * k), _roots(up, near + v * k)
                odd_a, odd_c = now.take(a), now.take(c)
                joins = ((odd_a | odd_c) & (a != c)).nonzero()[0]
                if len(joins):
                    at, windows = a.take(joins), near.take(joins)
                    up[c.take(joins)] = at
                    now[at] = odd_a.take(joins) ^ odd_c.take(joins)
                    grew[windows] = reached[u, windows] = reached[v, windows] = True
            home[:, live], odd[:, live] = up.reshape(n, k) // k, now.reshape(n, k)
            live, reached = live[grew], reached[:, grew]
        while True:
            above = np.take_along_axis(home, home, axis=0)
            if np.array_equal(above, home):
                break
            home = above
        flips = np.zeros(b, np.uint64)
        for (u, v), mask in zip(self.edges, self.graph.mask, strict=True):
            if mask:
                flips[(home[u] == home[v]) & (size > 0)] ^= mask
        return flips, np.where(size > 0, 0.9, 1.0)


def _roots(up: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Places of the roots of nodes at places of their own; these then hang directly below them."""
    at = up.take(nodes)
    above = up.take(at)
    if (above == at).all():
        return at
    while not (above == at).all():
        at, above = above, up.take(above)
    up[nodes] = at
    return at


class Matching:
    """Exact minimum-weight matching of fired detectors along shortest paths, each with another or the boundary.

    Weights are scaled by a million and rounded, odd ones up.  Connected parts are matched one by one: over all pairings
    up to ``EXACT`` detectors, by blossoms beyond; both give a least cost, but may choose differently among equal ones.
    """

    EXACT = 16
    #: Cost of a way that does not exist.
    FAR = 1 << 50

    quiet = (0, 1.0)

    def __init__(self, graph: Graph):
        self.graph = graph
        scaled = np.rint(graph.weight * 1e6).astype(np.int64)
        scaled += scaled % 2
        self.near: list[list[tuple[int, int, int]]] = [[] for _ in range(graph.nodes)]
        for u, v, w, m in zip(graph.u.tolist(), graph.v.tolist(), np.maximum(scaled, 0).tolist(), graph.mask.tolist(), strict=True):
            self.near[u].append((v, w, m))
            self.near[v].append((u, w, m))
        self.paths: dict[int, dict[int, tuple[int, int]]] = {}

    def shortest(self, start: int) -> dict[int, tuple[int, int]]:
        """Cost and mask of the shortest path to every node; the boundary ends a path."""
        if start not in self.paths:
            done: dict[int, tuple[int, int]] = {}
            todo = [(0, start, 0)]
            while todo:
                cost, x, mask = heapq.heappop(todo)
                if x in done:
                    continue
                done[x] = cost, mask
                if x == self.graph.detectors:
                    continue
                for y, w, m in self.near[x]:
                    if y not in done:
                        heapq.heappush(todo, (cost + w, y, mask ^ m))
            self.paths[start] = done
        return self.paths[start]

    def decode(self, active: np.ndarray) -> tuple[int, float]:
        flips = 0
        for cost, i, j in self._pairs(active.tolist()):
            flips ^= cost(i, j)[1]
        return flips, 1.0

    def weight(self, active: np.ndarray) -> int:
        """Scaled cost of the matching."""
        return sum(cost(i, j)[0] for cost, i, j in self._pairs(active.tolist()))

    def _pairs(self, fired: list[int]) -> Iterator[tuple[Callable, int, int | None]]:
        """Places that are matched with each other, or with the boundary (None), and the cost function."""
        edge = self.graph.detectors
        cost = lambda i, j: self.shortest(fired[i]).get(edge if j is None else fired[j], (self.FAR, 0))
        left = set(range(len(fired)))
        while left:
            part, todo = [], [min(left)]
            while todo:
                i = todo.pop()
                if i in left:
                    left.remove(i)
                    part.append(i)
                    todo += [j for j in left if cost(i, j)[0] < cost(i, None)[0] + cost(j, None)[0]]
            part.sort()
            for i, j in self._all_pairings(part, cost) if len(part) <= self.EXACT else self._blossoms(part, cost):
                yield cost, i, j

    @staticmethod
    def _all_pairings(part: list[int], cost: Callable) -> list[tuple[int, int | None]]:
        best: dict[int, tuple[int, tuple | None]] = {0: (0, None)}
        whole = (1 << len(part)) - 1
        for done in range(whole):
            if done not in best:
                continue
            c = best[done][0]
            i = next(k for k in range(len(part)) if not done >> k & 1)
            for k in [None, *range(i + 1, len(part))]:
                if k is not None and done >> k & 1:
                    continue
                w = cost(part[i], None if k is None else part[k])[0]
                to = done | 1 << i | (0 if k is None else 1 << k)
                if to not in best or c + w < best[to][0]:
                    best[to] = c + w, (done, part[i], None if k is None else part[k])
        pairs, at = [], whole
        while best[at][1]:
            at, i, j = best[at][1]
            pairs.append((i, j))
        return pairs

    @staticmethod
    def _blossoms(part: list[int], cost: Callable) -> list[tuple[int, int | None]]:
        """What a pair saves against two ways to the boundary is its weight; those left go to the boundary."""
        saved = np.zeros((len(part), len(part)), np.int64)
        for x, i in enumerate(part):
            for y, j in enumerate(part[:x]):
                saved[x, y] = saved[y, x] = cost(i, None)[0] + cost(j, None)[0] - cost(i, j)[0]
        mate = heaviest(saved)
        return [(i, None if m < 0 else part[m]) for x, (i, m) in enumerate(zip(part, mate, strict=True)) if m < 0 or m > x]


class Neural:
    """Any model from a flat window to one score for each observable: a callable, or an object with a usual method.

    Scores below 0 or above 1 are taken as logits.  A bit is set above the threshold; the confidence is the product
    of the chosen sides' probabilities.  The model is asked about windows with nothing fired as about others.
    """

    quiet = None

    def __init__(self, model, detectors: int, observables: int = 1, threshold: float = 0.5):
        self.model, self.detectors, self.observables, self.threshold = model, detectors, observables, threshold

    def scores(self, x: np.ndarray) -> np.ndarray:
        call = next((getattr(self.model, name) for name in ("predict_proba", "predict", "forward") if hasattr(self.model, name)), self.model)
        return np.atleast_1d(np.asarray(call(x), float)).ravel()[: self.observables]

    def decode(self, active: np.ndarray) -> tuple[int, float]:
        x = np.zeros(self.detectors, np.float32)
        x[active] = 1
        return self.result(self.scores(x), self.threshold)

    @staticmethod
    def result(scores: np.ndarray, threshold: float = 0.5) -> tuple[int, float]:
        p = 1 / (1 + np.exp(-scores)) if len(scores) and (scores.min() < 0 or scores.max() > 1) else scores
        on = p > threshold
        return sum(1 << i for i, b in enumerate(on[:64]) if b), float(np.prod(np.where(on, p, 1 - p)))


class Proxy:
    """Flips if any ancilla fires in more than half of a window's rounds."""

    quiet = (0, 1.0)

    def __init__(self, ancillas: int, depth: int):
        self.ancillas, self.depth = ancillas, depth

    def decode(self, active: np.ndarray) -> tuple[int, float]:
        rates = np.bincount(active % self.ancillas, minlength=self.ancillas) / self.depth
        return int((rates > 0.5).any()), 1.0


DECODERS: dict[str, Callable[[Graph | None], Decoder]] = {
    "null": lambda graph: Null(),
    "union-find": UnionFind,
    "uf": UnionFind,
    "mwpm": Matching,
    "matching": Matching,
}


def register(name: str, make: Callable[[Graph | None], Decoder]) -> None:
    """A decoder plug-in under a name, made from a graph in each Python worker."""
    DECODERS[name] = make


def decoded(windows: DataFrame, decoder: str | Callable[[], Decoder], graph: Graph | None = None) -> DataFrame:
    """Adds observable_flips and confidence to windows with ``active``.

    A decoder whose ``quiet`` is None, as a trained model, is asked once for the empty set; others are not asked where
    nothing fired.  A null ``active`` is no window to decode: 0 flips, confidence 1.

    Distinct sets meet their windows by a digest of 128 bits.  Windows with nothing fired, mostly the most, meet nothing
    and are spread at random, so they make no hot key.
    """
    if decoder == "null":
        return windows.withColumns({"observable_flips": F.lit(0).cast("bigint"), "confidence": F.lit(1.0)})
    make = (lambda: DECODERS[decoder](graph)) if isinstance(decoder, str) else decoder
    one = make()
    quiet = getattr(one, "quiet", (0, 1.0))
    flips, confidence = (0, 1.0) if quiet is None else quiet
    if quiet is None:
        flips, confidence = one.decode(np.zeros(0, np.int64))
        flips = int(np.uint64(flips).view(np.int64))
    held = windows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(one))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                lists = part.column(2)
                ends = np.cumsum(lists.value_lengths().to_numpy())
                sets = np.split(lists.flatten().to_numpy().astype(np.int64), ends[:-1])
                if hasattr(own, "decode_batch"):
                    flips, confidence = own.decode_batch(sets)
                else:
                    found = [own.decode(a) for a in sets]
                    flips, confidence = np.array([f for f, _ in found], np.uint64), [c for _, c in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(flips.view(np.int64)), pa.array(confidence, pa.float64())], ["_k", "_j", "_flips", "_confidence"])

    fired = F.size("active") > 0
    keyed = windows.withColumns({"_k": F.when(fired, F.xxhash64("active")).otherwise((F.rand(7) * 2**62).cast("bigint")), "_j": F.when(fired, F.xxhash64(F.lit(1), "active"))})
    distinct = keyed.where(fired).select("_k", "_j", F.col("active").cast("array<int>").alias("active")).distinct()
    said = distinct.mapInArrow(run, "_k bigint, _j bigint, _flips bigint, _confidence double")
    out = keyed.join(said, ["_k", "_j"], "left")
    none = F.col("active").isNull()
    rest = lambda c, value: F.coalesce(c, F.when(none, F.lit(0 if c == "_flips" else 1.0)).otherwise(F.lit(value)))
    return out.withColumns({"observable_flips": rest("_flips", flips).cast("bigint"), "confidence": rest("_confidence", confidence).cast("double")}).drop("_k", "_j", "_flips", "_confidence")
