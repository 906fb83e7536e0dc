from functools import cache

import numpy as np
import pytest

from syndrift.operators import decode
from syndrift.operators.blossoms import heaviest
from syndrift.operators.graph import Graph
from syndrift.sources import dem


def best(w: np.ndarray) -> int:
    """Over all matchings, by the set of nodes left."""

    @cache
    def left(nodes: int) -> int:
        if not nodes:
            return 0
        i = (nodes & -nodes).bit_length() - 1
        rest = nodes & ~(1 << i)
        return max([left(rest), *(int(w[i, j]) + left(rest & ~(1 << j)) for j in range(i + 1, len(w)) if rest >> j & 1 and w[i, j] > 0)])

    return left((1 << len(w)) - 1)


def total(w: np.ndarray, mate: list[int]) -> int:
    assert all(m < 0 or mate[m] == v and w[v, m] > 0 for v, m in enumerate(mate))
    return sum(int(w[v, m]) for v, m in enumerate(mate) if m > v)


@pytest.mark.parametrize("nodes", [0, 1, 2, 5, 8, 11, 14])
@pytest.mark.parametrize("top", [2, 6, 1000])
def test_heaviest_equals_brute_force(nodes, top):
    rng = np.random.default_rng([nodes, top])
    for k in range(60 if nodes < 12 else 12):
        w = np.triu(rng.integers(1, top, (nodes, nodes)) * (rng.random((nodes, nodes)) < (0.3, 0.6, 1.0)[k % 3]), 1)
        w += w.T
        assert total(w, heaviest(w)) == best(w)


def test_many_nodes_keep_the_duals_promise():
    rng = np.random.default_rng(5)
    at = rng.random((60, 2))
    d = (1000 * np.hypot(*(at[:, None] - at).T)).astype(int)
    w = np.where(np.eye(60, dtype=bool), 0, 3000 - d)
    mate = heaviest(w)
    assert -1 not in mate
    pairs = [(v, m) for v, m in enumerate(mate) if m > v]
    for a, b in pairs:
        for x, y in pairs:
            assert {a, b} == {x, y} or max(w[a, x] + w[b, y], w[a, y] + w[b, x]) <= w[a, b] + w[x, y]


def _cost(g: Graph, fired: list[int], m: decode.Matching) -> int:
    """Least cost over all pairings, with the boundary for one of them or not."""

    @cache
    def left(nodes: tuple) -> int:
        if not nodes:
            return 0
        i, *rest = nodes
        reach = m.shortest(i)
        ways = [reach[g.detectors][0] + left(tuple(rest))] if g.detectors in reach else []
        ways += [reach[j][0] + left(tuple(x for x in rest if x != j)) for j in rest if j in reach]
        return min(ways)

    return left(tuple(fired))


def test_large_sets_are_matched_at_least_cost():
    rng = np.random.default_rng(3)
    text = "".join(f"error({p:.3f}) D{i} D{(i + step) % 30}\n" for step in (1, 4, 7) for i, p in enumerate(rng.uniform(0.01, 0.3, 30))) + "error(0.05) D0\nerror(0.05) D11\n"
    g = Graph.of(dem.parse(text))
    dp, own = decode.Matching(g), decode.Matching(g)
    own.EXACT = 0
    for _ in range(20):
        fired = sorted(rng.choice(30, 14, replace=False).tolist())
        assert own.weight(np.array(fired)) == dp.weight(np.array(fired)) == _cost(g, fired, dp)
    whole = np.arange(30)
    assert own.weight(whole) == dp.weight(whole) and isinstance(own.decode(whole)[0], int)


def test_detectors_without_a_way_to_the_boundary():
    g = Graph.of(dem.parse("".join(f"error(0.1) D{i} D{i + 1}\n" for i in range(29))))
    own = decode.Matching(g)
    own.EXACT = 0
    assert own.weight(np.arange(0, 30, 3)) == decode.Matching(g).weight(np.arange(0, 30, 3))
