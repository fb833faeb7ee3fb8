import math

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, node bigint, place string"
EVERY = "vec_id % 10 = 0"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, 7, "x") for k, (i, v) in enumerate(rows)], SCHEMA).repartition(4)


def valid(rows):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return sorted({(i, tuple(np.array(v, np.float32) + np.float32(0))) for i, v in fine})


def brute(rows, most=10):
    rows, out = valid(rows), {}
    x = np.array([v for _, v in rows], np.float64)
    for k, (i, v) in enumerate(rows):
        if i % 10 == 0:
            d = np.sqrt(((x - x[k]) ** 2).sum(1))
            near = sorted((s, j) for m, (s, (j, _)) in enumerate(zip(d, rows)) if m != k)[:most]
            out.setdefault(i, []).append([(r + 1, j, s) for r, (s, j) in enumerate(near)])
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def cloud(n, dims=8, seed=1, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims)) * 3
    return (centres[rng.integers(0, groups, n)] + rng.standard_normal((n, dims))).astype(np.float32)


def test_small_tables_are_exact(spark):
    """Copies, ties, repeated rows, vectors that take no part, a frequent vector, awkward names."""
    rows = [(i, v.tolist()) for i, v in enumerate(cloud(150))]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [rows[10]] * 5
    rows += [(1000, None), (1010, []), (1020, [0.0] * 8), (1030, [1.0] * 7 + [None]), (1040, [math.nan] * 8), (1050, [math.inf] * 8)]
    rows += [(None, rows[0][1]), (1060, [1.0, 2.0]), (1070, [-0.0] * 7 + [1.0]), (1080, [0.0] * 7 + [1.0])]
    got, want = found(neighbours.nearest(table(spark, rows), EVERY)), brute([r for r in rows if r[0] != 1060])
    assert {q: [(a, b) for a, b, _ in v] for q, v in got.items()} == {q: [(a, b) for a, b, _ in v[0]] for q, v in want.items()}
    for q, near in got.items():
        assert [s for _, _, s in near] == pytest.approx([s for _, _, s in want[q][0]], abs=1e-12)


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_fewer_candidates_than_asked(spark, n):
    rows = [(10 * i, [float(i), 1.0]) for i in range(n)]
    got = found(neighbours.nearest(table(spark, rows), EVERY))
    assert {q: [b for _, b, _ in v] for q, v in got.items()} == {q: [b for _, b, _ in v[0]] for q, v in brute(rows).items() if v[0]}


def test_one_id_with_two_vectors_is_two_rows(spark):
    rows = [(10, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [0.6, 0.6])]
    got = neighbours.nearest(table(spark, rows), EVERY).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(10, 1, 11), (10, 1, 11), (10, 2, 10), (10, 2, 10)]


def test_recall_of_a_graph_with_cells_and_hubs(spark, monkeypatch):
    """Random vectors without groups, small cells, and a hub at every place with over 60 links."""
    for name, value in {"WHOLE": 64, "CELL": 128, "HUB": 60, "BLOCK": 64, "NEIGHBOURS": 24, "TOGETHER": 48}.items():
        monkeypatch.setattr(neighbours, name, value)
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[cloud(900, 16, 2, 1), cloud(600, 16, 3)])]
    got, want = found(neighbours.nearest(table(spark, rows), EVERY)), brute(rows)
    assert got.keys() == want.keys() and all([a for a, _, _ in v] == list(range(1, 11)) for v in got.values())
    hits = sum(len({b for _, b, _ in v} & {b for _, b, _ in want[q][0]}) for q, v in got.items())
    assert hits / (10 * len(want)) >= 0.9
    x = {i: np.array(v, np.float64) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near) and [s for *_, s in near] == sorted(s for *_, s in near)
        assert all(s == pytest.approx(np.sqrt(((x[q] - x[b]) ** 2).sum()), abs=1e-12) for _, b, s in near)


def test_a_pair_has_one_distance_wherever_it_meets():
    v = cloud(40, 64, 5).astype(np.float64)
    codes = neighbours._Codes(pa.array(neighbours.packed(v)))
    every = codes.among(np.arange(40)[None])[0]
    some = np.random.default_rng(0).permutation(40)[:17]
    assert (codes.among(some[None])[0] == every[np.ix_(some, some)]).all() and (every == every.T).all()
    exact = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    assert np.abs(np.sqrt(every) - exact).max() < 0.03 * exact.max()
