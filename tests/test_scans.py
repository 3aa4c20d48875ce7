"""Scans of all pairs: candidates by rough distances, and measures by blocks in which pairs are never rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.functions import metrics
from karst.operators import evaluate, knn
from karst.queries import QUERIES

SF = "/root/testdata/sf0.001"


def odd_vectors(case, n=1500, dim=16):
    rng = np.random.default_rng(case)
    x = rng.normal(size=(n, dim))
    if case == 1:  # many copies, zero vectors
        x[100:400], x[0], x[5] = x[7], 0, 0
    if case == 2:  # ties
        x = np.rint(x * 2)
    if case == 3:  # far from the origin, one row farther
        x = x * 1e3 + 1e6
        x[3] = 1e9
    return x, rng.permutation(n)


def check_screen(metric, decimals, monkeypatch):
    seen, held = [], metrics.block
    monkeypatch.setattr(metrics, "block", lambda m, a, b, **p: seen.append(len(a) * len(b)) or held(m, a, b, **p))
    for case in range(4):
        x, ids = odd_vectors(case)
        got = list(knn.block_top(ids[:120], x[:120], ids, x, 10, metric, decimals))
        order = np.argsort(ids)
        d = held(metric, x[:120], x[order])
        d = d if decimals is None else d.round(decimals)
        best = np.argsort(d, axis=1, kind="stable")[:, :10]
        assert (np.concatenate([g[1] for g in got]) == ids[order][best].ravel()).all()
        assert (np.concatenate([g[2] for g in got]) == np.take_along_axis(d, best, 1).ravel()).all()
        if case == 0:
            assert sum(seen) < 0.05 * 120 * len(x)  # the metric itself is taken of few pairs


def test_cosine_by_candidates(monkeypatch):
    check_screen("cosine", 9, monkeypatch)


def test_manhattan_by_candidates(monkeypatch):
    check_screen("manhattan", None, monkeypatch)


def test_chebyshev_by_candidates(monkeypatch):
    check_screen("chebyshev", None, monkeypatch)


@pytest.mark.parametrize("decimals", [None, 2])
@pytest.mark.parametrize("case", [0, 1, 2, 3, "clusters"])
def test_chebyshev_by_bytes(case, decimals, monkeypatch):
    """Bytes wrap where differences exceed half the range, and say nothing beside one far row; the result is the metric's all the same."""
    if case == "clusters":
        x, ids = odd_vectors(4)
        x = x * 0.1 + np.where(ids % 2, 20.0, -20.0)[:, None]
    else:
        x, ids = odd_vectors(case)
    kinds, held = [], knn._tiles
    monkeypatch.setattr(knn, "_tiles", lambda *a, **b: kinds.append((out := held(*a, **b)).dtype.name) or out)
    got = list(knn.block_top(ids[:120], x[:120], ids, x, 10, "chebyshev", decimals))
    order = np.argsort(ids)
    d = metrics.block("chebyshev", x[:120], x[order])
    d = d if decimals is None else d.round(decimals)
    best = np.argsort(d, axis=1, kind="stable")[:, :10]
    assert (np.concatenate([g[1] for g in got]) == ids[order][best].ravel()).all()
    assert (np.concatenate([g[2] for g in got]) == np.take_along_axis(d, best, 1).ravel()).all()
    assert "uint8" in kinds and (case != 0 or kinds.count("int16") < 12)  # rows that need 16 bits, one by one


def test_canberra_by_candidates(monkeypatch):
    check_screen("canberra", None, monkeypatch)


def test_scan_of_a_table_with_itself_moves_no_vectors(spark, monkeypatch):
    """The broadcast copy has every row, so none is shuffled, and it's in single precision where that is exact."""
    x, ids = odd_vectors(0, 300)
    for values, kind in ((x.astype(np.float32).astype(float), "float32"), (x, "float64")):
        df, sent, held = spark.createDataFrame([(int(i), r) for i, r in zip(ids, values.tolist())], "id long, features array<double>"), [], spark.sparkContext.broadcast
        monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: sent.append(v) or held(v))
        found = knn.against_all(df, lambda x, y: knn._emit(knn.block_top(*x, *y, 5, "chebyshev")), "i long, j long, d double")
        monkeypatch.undo()
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert [v.dtype.name for v in sent[0]] == ["int64", kind]
        got = {(r.i, r.j, r.d) for r in found.collect()}
        d, order = metrics.block("chebyshev", values, values), np.argsort(ids)
        best = order[np.argsort(d[:, order], axis=1, kind="stable")[:, :5]]
        assert got == {(int(ids[a]), int(ids[b]), float(d[a, b])) for a in range(len(ids)) for b in best[a]}


def spaces(spark, case, n=200):
    """(id, high, low) and the distances of all pairs of both, by difference."""
    x, ids = odd_vectors(case, n)
    df = spark.createDataFrame([(int(i), r, r[:2]) for i, r in zip(ids, x.tolist())], "id long, high array<double>, low array<double>").repartition(3)
    d = [metrics.block("euclidean", v, v) for v in (x, x[:, :2])]
    return df, ids, d


def table(spark, ids, d):
    return spark.createDataFrame([(int(ids[a]), int(ids[b]), float(d[a, b])) for a in range(len(ids)) for b in range(len(ids))], "i long, j long, d double")


@pytest.fixture(params=["broadcast", "blocks"])
def path(request, monkeypatch):
    if request.param == "blocks":
        monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)


@pytest.mark.parametrize("case", [0, 1, 3])
def test_pair_correlation_without_pairs(spark, path, case):
    df, ids, d = spaces(spark, case)
    upper = np.triu_indices(len(ids), 1)
    assert abs(evaluate.pair_correlation_of(df).first()[0] - np.corrcoef(d[0][upper], d[1][upper])[0, 1]) < 1e-9
    assert evaluate.pair_correlation_of(df.limit(2)).first()[0] == 1  # one pair has no correlation


@pytest.mark.parametrize("case", [0, 1, 3])
def test_density_gap_without_pairs(spark, path, case):
    df, ids, d = spaces(spark, case)
    a, b = (np.exp(-v * v / 0.1).sum(1) for v in d)
    assert abs(evaluate.density_gap_of(df).first()[0] - np.abs(a / a.sum() - b / b.sum()).sum()) < 1e-9


@pytest.mark.parametrize("case", [0, 1, 2, 3])
def test_trustworthiness_without_full_ranks(spark, path, case):
    df, ids, d = spaces(spark, case, 120)
    low = knn.exact(df.select("id", F.col("low").alias("features")), 8).where("i <> j")
    high = evaluate.ranks(table(spark, ids, d[0]))
    assert abs(evaluate.trustworthiness_of(df, low, 7).first()[0] - evaluate.trustworthiness(high, low, 7).first()[0]) < 1e-12


def test_all_pairs_are_streamed(spark, path):
    plan = QUERIES["pairwise_distances"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    _, ids = odd_vectors(2, 150)
    df, ids, d = spaces(spark, 2, 150)
    got = knn.all_pairs(df.select("id", F.col("high").alias("features"))).collect()
    assert {(r.i, r.j): round(r.d, 9) for r in got} == {(int(a), int(b)): round(d[0][p, q], 9) for p, a in enumerate(ids) for q, b in enumerate(ids)}
    assert len(got) == 150 * 150


def test_pairs_come_in_short_runs_of_j(monkeypatch):
    """A page of a written file holds many runs of the same j, so it has little to keep beside the distances; no pair is left out or doubled."""
    monkeypatch.setattr(knn, "against_all", lambda df, step, schema: step)
    x, ids = odd_vectors(0, 1500, 3)
    batches = [[c.to_numpy() for c in b.columns] for b in knn.all_pairs(None, 6)([ids[:150], x[:150]], [ids, x])]
    assert max(len(np.unique(j)) for _, j, _ in batches) <= 512 and max(len(i) for i, _, _ in batches) <= 1 << 15
    i, j, d = (np.concatenate(c) for c in zip(*batches))
    assert len(i) == 150 * 1500 == len(set(zip(i.tolist(), j.tolist())))
    place = np.argsort(ids)
    assert np.abs(d - np.sqrt(((x[place[i]] - x[place[j]]) ** 2).sum(1))).max() <= 5.1e-7


def test_precomputed_keeps_few_rows_of_a_batch(spark):
    df, ids, d = spaces(spark, 2, 100)
    edges = table(spark, ids, d[0]).repartition(3)
    got = {}
    for r in knn.precomputed(edges, 6).orderBy("i", "rank").collect():
        got.setdefault(r.i, []).append(r.j)
    at = np.argsort(ids)
    for p, i in enumerate(ids):
        assert got[i] == ids[at][np.argsort(d[0][p][at], kind="stable")[:6]].tolist()
    assert "MapInArrow" in knn.precomputed(edges, 6)._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(1, 2, None), (1, 3, float("nan")), (1, 4, 1.0), (None, 4, 2.0)], "i long, j long, d double")
    assert knn.precomputed(odd, 1).count() == 2


@pytest.mark.parametrize("case", [0, 1, 2, 3])
def test_pairs_that_cannot_be_near_stay_in_the_worker(spark, path, case):
    """Neighbours of distances made here are those of all distances, and few of the pairs become rows."""
    df, ids, d = spaces(spark, case, 300)
    v, at = df.select("id", F.col("high").alias("features")), np.argsort(ids)
    near = knn.all_pairs(v, nearest=6)
    assert near.count() <= 6 * 300 * (1 if knn.BROADCAST_BYTES else 2)
    got = {(r.i, r["rank"]): (r.j, r.d) for r in knn.precomputed(near, 6).collect()}
    best = np.argsort(d[0][:, at], axis=1, kind="stable")[:, :6]
    assert got == {(int(i), k + 1): (int(ids[at][b]), float(d[0][p, at[b]])) for p, i in enumerate(ids) for k, b in enumerate(best[p])}


def test_euclidean_bound_with_vectors_that_are_no_numbers():
    """A vector with NaN or infinity is nobody's neighbour and takes none from others, wherever it stands."""
    x, ids = odd_vectors(0)
    x[::3, 0], x[1, 2] = np.nan, np.inf
    sound = np.isfinite(x).all(1)
    asked = np.flatnonzero(sound)[:50]
    got = list(knn.block_top(ids[asked], x[asked], ids, x, 10, "euclidean"))
    y, y_ids = x[sound][np.argsort(ids[sound])], np.sort(ids[sound])
    best = np.argsort(metrics.block("euclidean", x[asked], y), axis=1, kind="stable")[:, :10]
    assert (np.concatenate([g[1] for g in got]) == y_ids[best].ravel()).all()


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_tables_above_the_exact_limit_are_scanned(spark, monkeypatch, metric):
    """Where candidates are found by rough distances the neighbours stay exact beyond EXACT_ROWS."""
    x, ids = odd_vectors(0, 300)
    df = spark.createDataFrame([(int(i), r) for i, r in zip(ids, x.tolist())], "id long, features array<double>")
    monkeypatch.setattr(knn, "EXACT_ROWS", 100)
    monkeypatch.setattr(knn, "approximate", None)
    got = {(r.i, r["rank"]): r.j for r in knn.neighbours(df, 5, metric).collect()}
    at = np.argsort(ids)
    best = np.argsort(metrics.block(metric, x, x[at]), axis=1, kind="stable")[:, :5]
    assert got == {(int(i), k + 1): int(ids[at][b]) for i, row in zip(ids, best) for k, b in enumerate(row)}


@pytest.mark.parametrize("metric", ["manhattan", "chebyshev"])
def test_rough_distances_of_opposite_corners_fit_16_bits(metric):
    """The farthest pair there can be has the largest rough value, in tables wider than a tile."""
    rng = np.random.default_rng(5)
    y = rng.uniform(-1, 1, (9000, 64))
    y[0], y[1] = 1, -1
    rough, slack = knn._screen(metric, y[:20], y, None)
    found = rough(0, 20).astype(float)
    exact = metrics.block(metric, y[:20], y)
    scale = found[0, 1] / exact[0, 1]
    assert found.min() >= 0 and found[0].argmax() == 1 and np.abs(found / scale - exact).max() * scale <= slack


def test_bound_of_the_nearest_holds_k_values():
    rng = np.random.default_rng(6)
    for n, k in ((50, 10), (73, 1), (9001, 10), (4096, 30)):
        rough = rng.integers(0, 500, (5, n)).astype(np.int16)
        assert ((rough <= knn._kth(rough, k)[:, None]).sum(1) >= k).all()
