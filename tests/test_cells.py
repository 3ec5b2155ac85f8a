"""Cells of the unit sphere: pairs, density clusters and nearest neighbours equal to brute force, with few candidates where vectors lie in groups."""

import numpy as np
import pytest

from emberlog.operators import cells
from emberlog.operators import errors as E
from emberlog.operators import signals as S

SCHEMA = "service_id string, id long, embedding array<double>, label string, alert_id string"


def grouped(n, groups, dims, spread, seed):
    """n vectors around as many directions as groups, a third of them equal."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims))
    v = centre[rng.integers(groups, size=n)] + rng.normal(0, spread, (n, dims))
    v[: n // 3] = v[0]
    return v


def frame(spark, v, keys=1):
    rows = [(f"s{k % keys}", k, [float(x) for x in row], f"p{k % 3}", f"a{k}" if k % 2 else None) for k, row in enumerate(v)]
    return spark.createDataFrame([*rows, ("s0", len(v), None, "n", None), ("s0", len(v) + 1, [0.0] * v.shape[1], "z", None), (None, len(v) + 2, [1.0] * v.shape[1], "k", None), ("s0", len(v) + 3, [1.0, 2.0], "d", None)], SCHEMA).repartition(3)


def brute_near(v, keys, eps):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = 1 - unit @ unit.T <= eps
    np.fill_diagonal(near, False)
    of = np.arange(len(v)) % keys
    return near & (of[:, None] == of)


@pytest.mark.parametrize(("tile", "pivots"), [(16, 64), (1000, 64)])
@pytest.mark.parametrize("eps", [0.02, 1.5])
def test_pairs_equal_brute_force(spark, tile, pivots, eps):
    v = grouped(90, 6, 5, 0.2, 1)
    i, j = np.nonzero(brute_near(v, 2, eps))
    found = E.pairs_within(frame(spark, v, 2), "service_id", eps, tile, pivots)
    assert sorted((r.src, r.dst) for r in found.collect()) == sorted(zip(i.tolist(), j.tolist(), strict=True))


def brute_labels(v, keys, eps, least):
    near = brute_near(v, keys, eps)
    core = near.sum(1) >= least
    root = np.arange(len(v))
    for i in range(len(v)):
        for j in np.flatnonzero(near[i]):
            if core[i] and core[j]:
                a, b = root[i], root[j]
                root[root == max(a, b)] = min(a, b)
    out = np.full(len(v), -1)
    for s in range(keys):
        own = [k for k in range(s, len(v), keys)]
        number = {r: n for n, r in enumerate(sorted({root[k] for k in own if core[k]}))}
        for k in own:
            labels = [number[root[j]] for j in np.flatnonzero(near[k] & core)]
            out[k] = number[root[k]] if core[k] else min(labels, default=-1)
    return out.tolist()


@pytest.mark.parametrize(("tile", "pivots"), [(12, 64), (1000, 64)])
@pytest.mark.parametrize(("eps", "least"), [(0.01, 2), (0.1, 3)])
def test_dbscan_equals_brute_force(spark, tile, pivots, eps, least):
    v = grouped(80, 9, 4, 0.12, 2)
    found = E.dbscan(frame(spark, v, 2), "service_id", eps, least, tile, pivots).orderBy("id").collect()
    assert [r.label for r in found[:80]] == brute_labels(v, 2, eps, least)
    assert [r.label for r in found[80:]] == [-1] * 4 and len(found) == 84
    assert E.dbscan(frame(spark, v[:3]).limit(0), "service_id", eps, least).count() == 0


@pytest.mark.parametrize(("tile", "pivots"), [(12, 64), (1000, 64)])
@pytest.mark.parametrize("least", [0.3, 0.95])
def test_nearest_equal_brute_force(spark, tile, pivots, least):
    v = grouped(120, 8, 6, 0.3, 3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 12)
    df = frame(spark, v, 2)
    expected = {}
    for q in range(0, 120, 7):
        own = [j for j in range(q % 2, 120, 2) if j != q and near[q, j] >= least]
        expected[q] = sorted(own, key=lambda j: (-near[q, j], j))[:5]
    split = cells.split(df, "service_id", tile, pivots)
    asked = df.where("id % 7 = 0 and id < 120")
    found, _ = cells.nearest(split, cells.unit_length(asked, "service_id"), 5, least, tile)
    got = {q: [] for q in expected}
    for r in found.orderBy("query_id", "similarity").collect():
        got[r.query_id].append((-r.similarity, r.id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == expected
    matched = {r.query_id: r for r in S.match_patterns(asked, df, 5, least, tile, pivots).collect()}
    for q, ids in expected.items():
        assert matched[q].matches == len(ids) and matched[q].alert_ids == sorted(f"a{i}" for i in ids if i % 2)
        assert not ids or matched[q].matched_pattern == f"p{ids[0] % 3}"


def test_few_candidates_where_vectors_lie_in_groups(spark):
    """Of all pairs a small part meets, and a query opens few cells; brute force would take all of them."""
    counted = {}
    for n in (500, 1000):
        v = grouped(n, 40, 16, 0.15, 4)
        split = cells.split(frame(spark, v), "service_id", n // 40, 256)
        counted[n] = cells.candidates(cells.placed(split, np.arccos(1 - 0.1)))
        assert counted[n] < n * n / 4
        queries = cells.unit_length(frame(spark, v).where("id % 50 = 0"), "service_id")
        _, (first, second) = cells.nearest(split, queries, 5, 0.75, n // 40)
        assert first.count() + second.count() < queries.count() * len(split.pivots["s0", 16][0]) / 3


def test_least_similarity_is_positive(spark):
    df = frame(spark, grouped(6, 2, 3, 0.1, 5))
    with pytest.raises(ValueError):
        cells.nearest(cells.split(df, "service_id"), cells.unit_length(df, "service_id"), 2, 0.0)


def test_dbscan_sends_a_vector_to_few_tasks(spark, monkeypatch):
    """A key of 5,000 vectors is one tile, and the forest that grows from some rows at a time is that of all: chains of cores across them, each with a border."""
    made, split = [], cells.split
    monkeypatch.setattr(E.cells, "split", lambda *a: made.append(split(*a)) or made[-1])
    step, place = 2 * np.pi / 10_000, np.arange(5000) * 7919 % 5000
    angle = place * step + np.where(place < 2500, 0, 0.5)
    df = spark.createDataFrame([(k, "a", [float(np.cos(x)), float(np.sin(x))]) for k, x in enumerate(angle)], "id long, service_id string, embedding array<double>")
    found = {r.id: r.label for r in E.dbscan(df, eps=float(1 - np.cos(1.5 * step))).collect()}
    # the smallest core is 1, as 0 is an end of the other chain
    assert [found[k] for k in range(5000)] == [int(x < 2500) for x in place] and not made[0].pivots


def test_one_pass_of_a_query(spark, monkeypatch):
    """cluster_pass clusters once."""
    from emberlog.plans import analysis_queries as A

    runs, dbscan = [], E.dbscan
    monkeypatch.setattr(E, "dbscan", lambda *a, **k: runs.append(1) or dbscan(*a, **k))
    assert A.cluster_pass(spark, "/root/testdata/sf0.001").count() > 0 and len(runs) == 1
