import itertools

import numpy as np
import pytest

from syndrift.operators import decode, sample
from syndrift.operators.graph import Graph
from syndrift.plans.tables import MIXED, REPETITION
from syndrift.sources import dem, hardware


def test_parse():
    m = dem.parse("# x\n\nerror(0.1) D0 D1 ^ L0\n  error(0.05) D1 D2\ndetector(0,1,0) D0\ndetector(1,zz) D1\ndetector D2\nlogical_observable L3\nshift_detectors 5\n")
    assert (len(m.errors), m.detector_count, m.observable_count) == (2, 3, 4)
    assert m.detectors == {0: (0.0, 1.0, 0.0), 1: (1.0, 0.0, 0.0), 2: None}
    assert m.mean_probability == pytest.approx(0.075) and dem.parse("").mean_probability == 0
    assert len(dem.parse("repeat 3 {\n error(0.01) D0 D1\n}\nerror(0.1) D2").errors) == 4
    assert len(dem.parse("repeat 3 { error(0.01) D0 D1 }").errors) == 3
    assert dem.parse(dem.render(m)).errors == m.errors


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("error(0.1 D0", "InvalidProbability"), ("error(x) D0", "InvalidProbability"), ("error(0.1) Q0", "MalformedTarget"), ("error(0.1) L256", "MalformedTarget"),
        ("detector(0) Q", "MalformedTarget"), ("detector(0 D1", "MalformedCoords"), ("repeat x {", "InvalidRepeatCount"), ("repeat 2 {\nerror(0.1) D0", "UnterminatedRepeat"),
        ("repeat 2 {\nrepeat 2 {\nerror(0.1) D0\n}\n}", "UnterminatedRepeat"),
    ],
)
def test_parse_errors(line, kind):
    with pytest.raises(dem.ModelError, match=kind):
        dem.parse(line)


def test_graph():
    g = Graph.of(dem.parse(REPETITION))
    assert list(zip(g.u, g.v, g.mask, strict=True)) == [(0, 1, 1), (1, 2, 0), (2, 3, 1)]
    assert g.weight[0] == float(np.float32(2.197224577336219)) and g.nodes == 4
    assert len(Graph.of(dem.parse(MIXED)).u) == 5


def test_graph_rows_agree(spark):
    from syndrift.operators import graph

    m = dem.parse(MIXED)
    a, b = Graph.of(m), Graph.collect(graph.edges(dem.tables(spark, m)[0], m.detector_count), m.detector_count)
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("u", "v", "weight", "mask"))


UNION_FIND, EXACT = [0, 0, 0, 1, 0, 1, 1, 0], [0, 0, 1, 1, 1, 1, 0, 0]


@pytest.mark.parametrize("syndrome", range(8))
def test_goldens(syndrome):
    g = Graph.of(dem.parse(REPETITION))
    active = np.array([j for j in range(3) if syndrome >> j & 1], np.int64)
    assert decode.UnionFind(g).decode(active) == (UNION_FIND[syndrome], 0.9 if syndrome else 1.0)
    assert decode.Matching(g).decode(active) == (EXACT[syndrome], 1.0)


def _by_hand(n, ends, masks, active):
    """Clusters as plain sets, for comparison."""
    home, odd = {x: {x} for x in range(n)}, set(active)
    for _ in range(n):
        grew = False
        for u, v in ends:
            a, b = home[u], home[v]
            if a is not b and (len(a & odd) % 2 or len(b & odd) % 2):
                joined = a | b
                for x in joined:
                    home[x] = joined
                grew = True
        if not grew:
            break
    out = 0
    for (u, v), m in zip(ends, masks, strict=True):
        if home[u] is home[v]:
            out ^= m
    return out if active else 0


def test_union_find_on_random_graphs(monkeypatch):
    monkeypatch.setattr(decode, "FEW", 0)
    rng = np.random.default_rng(1)
    for _ in range(120):
        n, e = int(rng.integers(2, 9)), int(rng.integers(1, 14))
        ends = [tuple(int(x) for x in rng.choice(n + 1, 2, replace=False)) for _ in range(e)]
        masks = [int(x) for x in rng.integers(0, 4, e)]
        g = Graph(n, np.array([a for a, _ in ends]), np.array([b for _, b in ends]), np.ones(e), np.array(masks, np.uint64))
        active = np.flatnonzero(rng.random(n) < 0.4)
        assert decode.UnionFind(g).decode(active)[0] == _by_hand(n + 1, ends, masks, active.tolist())
        many = [np.flatnonzero(rng.random(n) < rng.random()) for _ in range(20)]
        flips, confidence = decode.UnionFind(g).decode_batch(many)
        assert list(zip(flips.tolist(), confidence.tolist(), strict=True)) == [decode.UnionFind(g).decode(a) for a in many]


def test_order_of_edges_matters():
    flips = []
    for ends in ([(0, 1), (1, 2), (2, 3)], [(1, 2), (0, 1), (2, 3)]):
        masks = [1 if e == (0, 1) else 0 for e in ends]
        g = Graph(4, *(np.array([e[k] for e in ends]) for k in (0, 1)), np.ones(3), np.array(masks, np.uint64))
        flips.append(decode.UnionFind(g).decode(np.array([1, 2]))[0])
    assert flips == [1, 0]


def test_matching_against_all_error_sets():
    m = dem.parse("error(0.1) D0 L0\nerror(0.08) D0 D1\nerror(0.05) D1 D2\nerror(0.11) D2 D3\nerror(0.09) D3\nerror(0.03) D0 D2 L1\nerror(0.07) D1 D3 L0\n")
    g = Graph.of(m)
    costs = np.rint(g.weight * 1e6).astype(int)
    costs += costs % 2
    best: dict[tuple, tuple[int, set]] = {}
    for on in itertools.product((0, 1), repeat=len(costs)):
        events, flips = np.zeros(5, int), 0
        for k in np.flatnonzero(on):
            events[[g.u[k], g.v[k]]] ^= 1
            flips ^= int(g.mask[k])
        key, cost = tuple(events[:4]), int(costs[np.flatnonzero(on)].sum())
        if key not in best or cost < best[key][0]:
            best[key] = cost, {flips}
        elif cost == best[key][0]:
            best[key][1].add(flips)
    for key, (_, flips) in best.items():
        assert decode.Matching(g).decode(np.flatnonzero(key))[0] in flips
    greedy = decode.Matching(g)
    greedy.EXACT = 0
    assert all(isinstance(greedy.decode(np.flatnonzero(k))[0], int) for k in best)


def test_neural():
    assert decode.Neural.result(np.array([0.9, 0.2])) == (1, pytest.approx(0.72))
    flips, confidence = decode.Neural.result(np.array([3.0, -3.0]))
    assert flips == 1 and confidence == pytest.approx(0.9526**2, abs=1e-3)
    assert decode.Proxy(2, 2).decode(np.array([0, 2])) == (1, 1.0) and decode.Proxy(2, 2).decode(np.array([0, 3]))[0] == 0


def test_sampling(spark):
    sure, never = dem.parse("error(1) D0 D1 L0"), dem.parse("error(0) D0 L0")
    assert {(tuple(r.active), r.observable_flips) for r in sample.sample_fast(spark, sure, 50).collect()} == {((0, 1), 1)}
    assert {(tuple(r.active), r.observable_flips) for r in sample.sample_fast(spark, never, 50).collect()} == {((), 0)}
    m = dem.parse(REPETITION)
    a = sample.sample_fast(spark, m, 9000, 7).collect()
    assert sorted(a) == sorted(sample.sample_fast(spark, m, 9000, 7).collect()) and len(a) == 9000
    share = sum(0 in r.active for r in a) / len(a)
    assert abs(share - 0.1) < 0.02
    slow = sample.sample(spark, dem.tables(spark, m)[0], 4000, 7).collect()
    assert abs(sum(2 in r.active for r in slow) / 4000 - 0.18) < 0.03
    assert [sample.threshold(p) for p in (0, 0.5, 1)] == [0, 1 << 63, (1 << 64) - 1]


def test_bicycle_codes(spark):
    for name, first_z, first_x, nnz in (("bb_72_12_6", [4, 5, 18, 39, 42, 48], [3, 24, 30, 37, 38, 54], 216), ("bb_144_12_12", [4, 5, 54, 75, 78, 84], [3, 60, 66, 73, 74, 90], 432)):
        code = hardware.PRESETS[name]
        z, x = hardware._rows(code, "Z"), hardware._rows(code, "X")
        assert z[0] == first_z and x[0] == first_x and sum(map(len, z)) == nnz
        assert all(len(set(a) & set(b)) % 2 == 0 for a in z for b in x)
        assert hardware.csr_rows(hardware.csr_base64(z, code.n)) == (z, code.n)
        got = {(r.type, r.row): list(r.qubits) for r in hardware.check_rows(spark, code).collect()}
        assert [got["Z", k] for k in range(len(z))] == z and [got["X", k] for k in range(len(x))] == x
    assert hardware.parse_poly("3,0 0,1 0,2") == ((3, 0), (0, 1), (0, 2))
    assert hardware.PRESETS["bb_144_12_12"].encoding_rate == pytest.approx(1 / 12)
