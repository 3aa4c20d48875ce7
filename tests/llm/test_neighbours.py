import numpy as np
import pytest

from karst.llm import neighbours


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = np.array(v, float)
    out = {}
    for i, q in ok.items():
        s = sorted((-float((q * v).sum()), j) for j, v in ok.items() if j != i)
        out[i] = [(j, -x) for x, j in s[:k]]
    return out


def recall_of(got, want, k):
    hit = total = 0
    for q, near in want.items():
        mine = [x for x in sorted(got.get(q, []))]
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        for _, j, s in mine:
            assert np.isfinite(s)
        hit += len({j for _, j, _ in mine} & {j for j, _ in near})
        total += len(near)
    return hit / max(total, 1)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_on_tables(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    vec = dict(rows)
    got = {}
    for r in neighbours.op7_nearest(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert r.score == pytest.approx(float(np.dot(np.array(vec[r.query_id], float), np.array(vec[r.vec_id], float))), abs=1e-12)
    want = {q: n for q, n in brute(rows, 20).items() if q % 20 == 0}
    assert set(got) == set(want) and recall_of(got, want, 20) >= 0.93


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    rows += [(40 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(50)]  # one vector many times
    rows += [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (3, rows[3][1]), (106, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as leaf", "3 as v", "4 as key")
    got = {}
    for r in neighbours.nearest(df, df, "vec_id", "embedding", k=20, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    want = brute(rows[:-1], 20)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [j for _, j, _ in sorted(got[q])] == [j for j, _ in near]
    few = spark.createDataFrame(rows[:3], df.select("vec_id", "embedding").schema)
    assert sorted((r.query_id, r.rank) for r in neighbours.nearest(few, few, "vec_id", "embedding").collect()) == [(q, r) for q in range(3) for r in (1, 2)]
    assert neighbours.nearest(few.limit(0), few.limit(0), "vec_id", "embedding").count() == 0
