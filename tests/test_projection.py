import warnings
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.functions import metrics
from karst.operators import evaluate, fuzzy, graph, hubs, knn, layout
from karst.plans.projection import ManifoldProjection, Params, trace
from karst.session import shared_dir
from karst.sources import runlog, tables

SMALL = {"n_neighbors": 10, "hub_num": 15, "global_n_epochs": 11, "local_n_epochs": 11}


def blobs(n=120, d=4, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) + 6 * np.repeat(np.eye(3, d), -(-n // 3), 0)[:n]


def frame(spark, x, shift=0):
    return spark.createDataFrame([(i + shift, r) for i, r in enumerate(x.tolist())], "id long, features array<double>")


def brute_knn(x, k, metric="euclidean"):
    d = metrics.block(metric, x, x)
    return [sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))]


def listed(g):
    out = {}
    for r in g.orderBy("i", "rank").collect():
        out.setdefault(r.i, []).append(r.j)
    return out


def positions(model):
    rows = model.embedding.collect()
    assert all(np.isfinite(r.embedding).all() for r in rows)
    return {r.id: np.array(r.embedding) for r in rows}


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_fit(spark, dims):
    x = blobs()
    m = ManifoldProjection(n_components=dims, **SMALL).fit(frame(spark, x, 1000))
    pos = positions(m)
    assert sorted(pos) == list(range(1000, 1120)) and all(len(p) == dims for p in pos.values())
    w = m.graph.agg(F.min("weight"), F.max("weight")).first()
    assert 0 < w[0] and w[1] <= 1 + 1e-12
    back = m.graph.alias("a").join(m.graph.alias("b"), (F.col("a.head") == F.col("b.tail")) & (F.col("a.tail") == F.col("b.head")))
    assert back.where("abs(a.weight - b.weight) < 1e-9").count() == m.graph.count()
    assert trace(m)["role_2"] == 15 and m.fingerprint == tables.fingerprint(m.rows)


def test_layout_keeps_neighbourhoods(spark):
    x = blobs(150, 8)
    m = ManifoldProjection(n_neighbors=10, hub_num=30, global_n_epochs=60, local_n_epochs=40).fit(frame(spark, x))
    pos = positions(m)
    z = np.array([pos[i] for i in range(150)])
    high = evaluate.ranks(knn.exact(frame(spark, x), 150).select("i", "j", "d"))
    trust = lambda z: evaluate.trustworthiness(high, knn.exact(frame(spark, z), 11).where("i <> j"), 10).first()[0]
    assert trust(z) > trust(np.random.default_rng(0).normal(size=z.shape)) + 0.08


def test_same_result_for_any_partitions(spark):
    df = frame(spark, blobs())
    a, b = (positions(ManifoldProjection(**SMALL).fit(d)) for d in (df.repartition(1), df.repartition(7)))
    assert all(np.allclose(a[i], b[i], atol=1e-9) for i in a)


def test_precomputed(spark):
    x = blobs(60)
    edges = knn.exact(frame(spark, x), 60).select("i", "j", "d")
    m = ManifoldProjection(metric="precomputed", **SMALL).fit(edges)
    assert len(positions(m)) == 60


def test_truncation_and_duplicates(spark):
    with pytest.warns(UserWarning, match="truncating"):
        m = ManifoldProjection(n_neighbors=50, hub_num=3, global_n_epochs=11, local_n_epochs=11).fit(frame(spark, blobs(10)))
    assert m.params.n_neighbors == 9 and len(positions(m)) == 10
    x = np.random.default_rng(0).integers(0, 3, (100, 2)).astype(float)
    m = ManifoldProjection(n_neighbors=5, hub_num=10, global_n_epochs=11, local_n_epochs=11, negative_sample_rate=1).fit(frame(spark, x))
    assert len(positions(m)) == 100


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_sparse(spark, metric):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(80):
        idx = sorted(set(rng.integers(0, 1_000_000, rng.integers(0, 9)).tolist()) | set(rng.integers(0, 20, 2).tolist()) if i else set())
        rows.append((i, (idx, rng.random(len(idx)).tolist())))
    df = spark.createDataFrame(rows, "id long, features struct<indices:array<int>,values:array<double>>")
    m = ManifoldProjection(n_neighbors=5, hub_num=10, global_n_epochs=11, local_n_epochs=11, metric=metric).fit(df, n_features=1_000_000)
    assert len(positions(m)) == 80
    assert m.rows.schema["features"].dataType.typeName() == "struct"


@pytest.mark.parametrize("init", ["random", "spectral"])
def test_inits_and_fast_mode(spark, init):
    m = ManifoldProjection(init=init, execution_mode="fast", n_jobs=2, **SMALL).fit(frame(spark, blobs()))
    assert len(positions(m)) == 120


def test_given_init(spark):
    df = frame(spark, blobs())
    good = df.select("id", F.slice("features", 1, 2).alias("init"))
    assert len(positions(ManifoldProjection(init=good, **SMALL).fit(df))) == 120
    with pytest.raises(ValueError, match="init array first dimension must match n_samples"):
        ManifoldProjection(init=good.where("id > 0"), **SMALL).fit(df)
    with pytest.raises(ValueError, match="init array second dimension must match n_components"):
        ManifoldProjection(init=good.select("id", F.slice("init", 1, 1).alias("init")), **SMALL).fit(df)


@pytest.mark.parametrize(
    "bad,text",
    [
        ({"hub_num": None}, "must be an integer"), ({"hub_num": "10"}, "must be an integer"), ({"hub_num": 3.5}, "must be an integer"), ({"hub_num": 1}, "must be at least 2"),
        ({"hub_num": 100}, "must be less than the number of data points"), ({"negative_sample_rate": 0}, "negative_sample_rate must be greater than 0"),
        ({"n_neighbors": "15"}, "n_neighbors"), ({"n_neighbors": 1}, "n_neighbors"), ({"execution_mode": "turbo"}, "execution_mode"), ({"n_jobs": 0}, "n_jobs"), ({"metric": "nope"}, "metric"),
        ({"local_n_epochs": 3}, "local_n_epochs"), ({"min_dist": 2.0}, "min_dist"), ({"set_op_mix_ratio": 2}, "set_op_mix_ratio"), ({"gamma": -1}, "gamma"), ({"n_components": "2"}, "n_components"), ({"init": "no"}, "init"),
    ],
)
def test_bad_parameters(bad, text):
    with pytest.raises(ValueError, match=text):
        Params(**{"hub_num": 10, "n_neighbors": 5} | bad).check(100)


def test_bad_tables(spark):
    ok = [(0, [1.0, 2.0]), (1, [2.0, 3.0])]
    for rows in ([*ok, (2, None)], [*ok, (2, [1.0, None])], [*ok, (2, [float("nan"), 1.0])], [*ok, (2, [1.0])], [*ok, (1, [1.0, 1.0])], [*ok, (None, [1.0, 1.0])]):
        with pytest.raises(ValueError):
            tables.checked(spark.createDataFrame(rows, "id long, features array<double>"))


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "chebyshev"])
def test_exact_both_ways(spark, monkeypatch, metric):
    x = blobs(70, 5)
    want = dict(enumerate(brute_knn(x, 6, metric)))
    assert listed(knn.exact(frame(spark, x), 6, metric)) == want
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    assert listed(knn.exact(frame(spark, x), 6, metric)) == want


def test_approximate_recall_and_search(spark):
    x = np.random.default_rng(0).normal(size=(400, 8))
    df = frame(spark, x)
    want = brute_knn(x, 10)
    got = listed(knn.approximate(df, 10, low_memory=True, rounds=4))
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in range(400)]) > 0.95
    q = x[:40] + 0.01
    found = listed(knn.search(frame(spark, q), df, knn.exact(df, 10), 5))
    d = metrics.block("euclidean", q, x)
    assert np.mean([len(set(found[i]) & set(np.argsort(d[i])[:5])) / 5 for i in range(40)]) > 0.9


def test_leaves_hold_every_row_once(spark):
    x = np.concatenate([blobs(100), np.zeros((60, 4))])  # many equal rows
    rows = knn.leaves(frame(spark, x), 2, 15, angular=False).collect()
    assert sorted((r.tree, r.id) for r in rows) == [(t, i) for t in range(2) for i in range(160)]


def test_groups_both_ways(spark):
    x = blobs(50)
    df = frame(spark, x)
    deg = hubs.indegree(knn.exact(df, 5), df)
    a = sorted(hubs.greedy_groups(df, deg, 12).collect())
    assert a == sorted(hubs.greedy_groups(df, deg, 12, driver_bytes=0).collect())
    assert sorted(r.id for r in a) == list(range(50)) and len({r.group_id for r in a}) == hubs.group_law(50, 12)[2]
    b = hubs.groups_from_graph(knn.exact(df, 5), deg, 12).collect()
    assert sorted(r.id for r in b) == list(range(50))
    assert hubs.group_law(100, 30) == (4, 25, 25)


def test_closure_and_roles(spark):
    g = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0), (4, 4)], "i long, j long")
    ids = spark.range(6)
    r = {x.id: x.round for x in graph.closure(spark.createDataFrame([(0,)], "id long"), g).collect()}
    assert r == {0: 0, 1: 1, 2: 2}
    role = graph.roles(ids, spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(k,) for k in r], "id long"))
    assert {x.id: x.role for x in role.collect()} == {0: 2, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_sigma_reaches_its_target(spark):
    x = blobs(40)
    g = knn.exact(frame(spark, x), 8)
    for r in g.join(fuzzy.smooth(g, 8), "i").groupBy("i").agg(F.sum(F.when(F.col("rank") > 1, F.when(F.col("d") > F.col("rho"), F.exp(-(F.col("d") - F.col("rho")) / F.col("sigma"))).otherwise(1.0))).alias("s")).collect():
        assert r.s == pytest.approx(3, abs=2e-5)


def test_kernel_fit():
    for args, want in (((1.0, 0.1), (1.57694361, 0.89506072)), ((1.0, 0.0), (1.93280909, 0.79049466)), ((1.0, 0.5), (0.58303, 1.33417)), ((2.0, 0.1), (0.54466, 0.84206))):
        assert np.allclose(fuzzy.fit_ab(*args), want, atol=1e-4)


def test_schedule_against_counters(spark):
    """Running counters per edge, as sequential sampling keeps them."""
    eps, rate, epochs = np.array([1.0, 1.25, 2.0, 3.7, 9.0, 40.0]), 5.0, 30
    rows = []
    for e, p in enumerate(eps):
        nxt, neg, step = p, p / rate, p / rate
        for n in range(epochs):
            if nxt <= n:
                m = int((n - neg) / step)
                rows.append((e, n, m))
                nxt += p
                neg += m * step
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(eps)], "e int, eps double").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    got = df.where(fuzzy.fires(F.col("eps"), F.col("n"))).select("e", "n", fuzzy.negatives_at(F.col("eps"), F.col("n"), rate).cast("int").alias("m")).collect()
    assert sorted((r.e, r.n, r.m) for r in got) == rows


def test_local_phase_alike_on_driver_and_as_joins(spark):
    x = blobs(40)
    df = frame(spark, x)
    w, _ = fuzzy.fuzzy_graph(knn.exact(df, 5), 5)
    hub = spark.createDataFrame([(i,) for i in range(0, 40, 8)], "id long")
    light = fuzzy.reweighted(w, hub, 4)
    start = layout.minmax(df.select("id", F.slice("features", 1, 2).alias("pos")), 2)
    args = (light, start, hub, 1.577, 0.895, 0.01, 4)
    a, b = ({r.id: r.pos for r in layout.optimise_local(*args, mode="fast", driver_edges=m).collect()} for m in (10**6, 0))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-9) for i in a)
    assert any(not np.allclose(a[r.id], r.pos) for r in start.collect())


def test_outliers_and_minmax(spark):
    p = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0])], "id long, pos array<double>")
    assert {r.id: r.pos for r in layout.minmax(p, 2).collect()} == {0: [0.0, 5.0], 1: [10.0, 5.0]}
    g = spark.createDataFrame([(2, 0, 1.0, 2), (2, 1, 1.0, 3), (3, 2, 1.0, 2), (4, 4, 0.0, 1)], "i long, j long, d double, rank int")
    role = spark.createDataFrame([(0, 2), (1, 1), (2, 0), (3, 0), (4, 0)], "id long, role int")
    out = {r.id: r.pos for r in layout.place_outliers_by_graph(g, role, p, 2, spread=0).collect()}
    assert out[2] == [2.0, 5.0] and out[3] == [2.0, 5.0] and set(out) == {2, 3, 4}


def test_intersection_and_samples(spark):
    e = lambda *w: spark.createDataFrame([(0, 1, w[0]), (1, 2, w[1])], "head long, tail long, weight double")
    got = {(r.head, r.tail): r.weight for r in fuzzy.intersect(e(0.5, 0.5), e(0.4, 0.2), e(0.9, 0.3), 0.5).collect()}
    assert got[0, 1] == pytest.approx(0.36) and got[1, 2] == pytest.approx(0.06)
    df = frame(spark, blobs())
    assert tables.sample(df, 30).collect() == tables.sample(df.repartition(5), 30).collect()
    assert tables.subset(df, spark.range(7)).count() == 7


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    row = {"run_id": "a", "dataset": "x", "scenario": "sample", "n_jobs": 1, "execution_mode": "fast", "duration_sec": 2.0, "success": True, "embedding_path": "p"}
    for mode, run, sec in (("fast", "a", 2.0), ("deterministic", "b", 4.0), ("deterministic", "c", 6.0)):
        runlog.append(spark.createDataFrame([row | {"run_id": run, "execution_mode": mode, "duration_sec": sec}]), path)
    (tmp_path / "log" / "part-blank.json").write_text("\n\n")
    out = evaluate.speedup(evaluate.paired_runs(runlog.read(spark, path))).first()
    assert (out.deterministic, out.fast, out.fast_speedup) == (6.0, 2.0, 3.0)
    s = spark.createDataFrame([("x", 1, 0.001, 0.9, 0.999, 3.0)], "dataset string, n_jobs int, trustworthiness_delta double, knn_overlap double, pairwise_corr double, fast_speedup double")
    assert "| x | 1 | 0.0010 | 0.9000 | 0.9990 | 3.0000 | True |" in runlog.markdown(evaluate.report(evaluate.passes(s)))


def test_npy_tables(spark, tmp_path):
    np.save(tmp_path / "d.npy", np.arange(24.0).reshape(4, 3, 2))
    np.save(tmp_path / "l.npy", np.arange(4))
    rows = tables.load_npy(spark, str(tmp_path / "d.npy"), str(tmp_path / "l.npy")).orderBy("id").collect()
    assert rows[1].features == [6, 7, 8, 9, 10, 11] and rows[3].label == 3
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert layout.cross_entropy(np.full((3, 3), 0.5), np.eye(3)[:, :2], 1.5, 0.9) > 0


def test_whole_table_positions(spark):
    x = blobs(90, 5)
    df = frame(spark, x).repartition(4)
    got = {r.id: r.pos for r in layout.init_position(df, "pca").collect()}
    z = layout.init_hubs(x, 2, "pca")
    z = z - z.mean()
    assert np.allclose([got[i] for i in range(90)], z / z.max() * np.max([got[i] for i in range(90)]), atol=1e-6)
    p = frame(spark, x[:, :2]).select("id", F.col("features").alias("pos"))
    d = metrics.block("euclidean", x[:, :2], x[:, :2]) + np.diag([np.inf] * 90)
    assert layout.nearest_gap(p) == pytest.approx(d.min(1).mean())


def test_discovery(tmp_path):
    for name, data in (("b", np.zeros((3, 2))), ("a", np.zeros(4)), ("c", np.array(1.0))):
        (tmp_path / name).mkdir()
        np.save(tmp_path / name / "data.npy", data)
        np.save(tmp_path / name / "label.npy", np.zeros(3))
    (tmp_path / "empty").mkdir()
    assert tables.discover(str(tmp_path)) == [("a", (4,)), ("b", (3, 2))]


def test_fit_leaves_no_edges_behind(spark):
    """Selected, reweighted and numbered edges and places are read by nothing that a model holds."""
    folder = Path(urlparse(shared_dir(spark)).path)
    before = set(folder.iterdir())
    m = ManifoldProjection(**SMALL).fit(frame(spark, blobs()))
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert not left & {"edges", "places"} and {"features", "knn", "fuzzy", "roles", "layout"} <= left
    assert len(positions(m)) == 120 and m.graph.count() and m.neighbours.count() and m.roles.count() == 120 and m.rows.count() == 120


@pytest.mark.parametrize("most", [500_000, 0])
def test_outliers_are_placed_without_moving_vectors(spark, monkeypatch, most):
    """Outliers come to their nearest members of their own group; ids are broadcast, so vectors are not shuffled."""
    monkeypatch.setattr(layout, "BROADCAST_IDS", most)
    x, n, k = blobs(90), 90, 4
    group, role = np.arange(n) % 3, np.where(np.arange(n) % 10 == 0, 0, 1)
    role[group == 2] = 1  # a group without outliers
    pos = np.random.default_rng(1).normal(size=(n, 2))
    groups = spark.createDataFrame([(i, int(group[i])) for i in range(n)], "id long, group_id int")
    roles = spark.createDataFrame([(i, int(role[i])) for i in range(n)], "id long, role int")
    placed = spark.createDataFrame([(i, pos[i].tolist()) for i in range(n) if role[i] and i != 4], "id long, pos array<double>")  # one member without a position
    found = layout.place_outliers(frame(spark, x), groups, roles, placed, 2, k)
    got = {r.id: r.pos for r in found.collect()}
    assert set(got) == {i for i in range(n) if not role[i]}
    for i, p in got.items():
        mem = np.array([j for j in range(n) if role[j] and group[j] == group[i] and j != 4])
        near = mem[np.argsort(((x[mem] - x[i]) ** 2).sum(1), kind="stable")[:k]]
        assert np.allclose(p, pos[near].mean(0))
    if most:
        held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the tables were large
        try:
            plan = layout.place_outliers(frame(spark, x), groups, roles, placed, 2, k)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        assert "SortMergeJoin" not in plan


@pytest.mark.parametrize("small", [True, False])
def test_outliers_meet_only_their_group_and_in_blocks(spark, monkeypatch, small):
    """Distances of outliers to members are never rows of a join; ties go to the smaller id, groups without members have none."""
    if not small:
        monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(3)
    n, k = 400, 3
    x, group, out = rng.integers(0, 3, (n, 4)).astype(float), rng.integers(0, 4, n), rng.random(n) < 0.4
    group[n - 1], out[n - 1] = 9, True
    df = spark.createDataFrame([(i, int(group[i]), x[i].tolist(), bool(out[i])) for i in range(n)], "id long, group_id int, features array<double>, out boolean").repartition(3)
    found = knn.in_groups(df.where("not out"), df.where("out"), k)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not (small and "Join" in plan)
    got = {(r.i, r["rank"]): r.j for r in found.collect()}
    want = {}
    for i in np.flatnonzero(out):
        mem = np.flatnonzero(~out & (group == group[i]))
        want |= {(int(i), r + 1): int(j) for r, j in enumerate(mem[np.argsort(((x[mem] - x[i]) ** 2).sum(1), kind="stable")[:k]])}
    assert got == want
    groups, roles = df.select("id", "group_id"), df.select("id", F.when(F.col("out"), 0).otherwise(1).alias("role"))
    placed = df.where("not out").select("id", F.slice("features", 1, 2).alias("pos"))
    pos = {r.id: r.pos for r in layout.place_outliers(df.select("id", "features"), groups, roles, placed, 2, k).collect()}
    assert set(pos) == {i for i, _ in want} and all(np.allclose(p, np.mean([x[want[i, r]][:2] for r in (1, 2, 3)], axis=0)) for i, p in pos.items())


def test_long_closures_start_no_job_for_each_round(spark, monkeypatch):
    """A path of many rounds is walked on the driver; the rounds of joins say the same."""
    pairs = [(i, i + 1) for i in range(20)] + [(3, 0), (7, 30), (30, 31), (40, 41), (41, 0)]
    g, start = spark.createDataFrame(pairs, "i long, j long"), spark.createDataFrame([(0,), (41,), (99,), (0,)], "id long")
    jobs, held = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name="step": jobs.append(name) or held(df, name))
    walked = graph.closure(start, g)
    assert not jobs
    joined = graph.closure(start, g, driver_edges=0)
    rounds = [{r.id: r["round"] for r in t.collect()} for t in (walked, joined)]
    assert walked.schema.simpleString() == joined.schema.simpleString() == "struct<id:bigint,round:int>"
    assert rounds[0] == rounds[1] == {i: i for i in range(21)} | {41: 0, 99: 0, 30: 8, 31: 9}
    assert walked.count() == 25
    assert {r.id for r in graph.closure(start.limit(0), g).collect()} == set() and graph.closure(start, g.limit(0)).count() == 3
