import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.functions import gradients, metrics, sparse

RNG = np.random.default_rng(0)


def data(needs, n=12, d=6):
    x = RNG.normal(size=(n, d))
    x[0] = 0
    x[1] = x[2]
    return {
        "any": x, "nonnegative": np.abs(x), "ball": x / (2 * np.linalg.norm(x, axis=1, keepdims=True) + 1), "pair": x[:, :2],
        "counts": np.floor(np.abs(x[3:]) * 5) + 1, "bits": (x > 0).astype(float),
    }[needs]


def table(spark, x):
    rows = [(i * len(x) + j, a.tolist(), b.tolist()) for i, a in enumerate(x) for j, b in enumerate(x)]
    return spark.createDataFrame(rows, "n long, x array<double>, y array<double>")


def params(name, d):
    c = np.linspace(1, 2, d)
    return {"minkowski": {"p": 3.0}, "seuclidean": {"c": c}, "wminkowski": {"c": c, "p": 1.5}, "mahalanobis": {"c": np.diag(c) + 0.1}}.get(name, {})


@pytest.mark.parametrize("name", sorted({m.name for m in metrics.REGISTRY.values()}))
def test_expression_equals_block(spark, name):
    x = data(metrics.REGISTRY[name].needs)
    p = params(name, x.shape[1])
    got = np.array([r.d for r in table(spark, x).select("n", metrics.distance(name, "x", "y", **p).alias("d")).orderBy("n").collect()], float).reshape(len(x), -1)
    want = metrics.block(name, x, x, **p)
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)
    assert np.allclose(want, want.T, atol=1e-9, equal_nan=True)
    if name not in ("kulsinski", "russellrao", "ll_dirichlet"):
        assert np.allclose(np.diag(want), 0, atol=1e-6)
    if name in sparse.SPARSE:
        s = table(spark, x).select("n", sparse.sparsify(F.col("x")).alias("x"), sparse.sparsify(F.col("y")).alias("y"))
        thin = np.array([r.distance for r in sparse.distance(s, name, "x", "y", n_features=x.shape[1], **p).orderBy("n").collect()], float).reshape(len(x), -1)
        assert np.allclose(thin, want, atol=1e-7, equal_nan=True)


def test_registry_names():
    assert len(metrics.names()) + len(metrics.SCALAR) == 39 and metrics.lookup("l1").name == "manhattan"
    with pytest.raises(ValueError):
        metrics.lookup("no such")
    with pytest.raises(ValueError):
        metrics.distance("euclidean", "x", "y", p=3)
    with pytest.raises(ValueError):
        metrics.block("haversine", np.ones((2, 3)), np.ones((2, 3)))


def test_sparse_arithmetic(spark):
    row = ("struct<indices:array<int>,values:array<double>>",)
    df = spark.createDataFrame([(([0, 3], [1.0, 2.0]), ([3, 5], [-2.0, 4.0]))], f"x {row[0]}, y {row[0]}")
    r = df.select(sparse.add(F.col("x"), F.col("y")).alias("a"), sparse.subtract(F.col("x"), F.col("y")).alias("s"), sparse.multiply(F.col("x"), F.col("y")).alias("m"), sparse.densify(F.col("x"), 5).alias("d")).first()
    assert (r.a.indices, r.a.values) == ([0, 5], [1.0, 4.0])
    assert (r.s.indices, r.s.values) == ([0, 3, 5], [1.0, 4.0, -4.0])
    assert (r.m.indices, r.m.values) == ([3], [-4.0])
    assert r.d == [1.0, 0.0, 0.0, 2.0, 0.0]


TRUE_GRADIENTS = ["euclidean", "seuclidean", "manhattan", "chebyshev", "mahalanobis", "canberra", "hyperboloid", "spherical_gaussian_energy", "diagonal_gaussian_energy"]


@pytest.mark.parametrize("name", TRUE_GRADIENTS)
def test_gradients_by_differences(name):
    d = {"spherical_gaussian_energy": 3, "diagonal_gaussian_energy": 4, "gaussian_energy": 5}.get(name, 4)
    x, y = RNG.normal(size=(20, d)) + 0.3, RNG.normal(size=(20, d))
    f = gradients.GRADIENTS[name]
    p = {k: v for k, v in params(name, d).items() if k != "p"}
    value, grad = f(x, y, **p)
    for c in range(d):
        up, down = x.copy(), x.copy()
        up[:, c] += 1e-6
        down[:, c] -= 1e-6
        slope = (f(up, y, **p)[0] - f(down, y, **p)[0]) / 2e-6
        assert np.allclose(slope, grad[:, c], atol=2e-3, rtol=2e-3)


def test_all_gradients_have_values():
    for name, f in gradients.GRADIENTS.items():
        d = {"haversine": 2, "spherical_gaussian_energy": 3, "diagonal_gaussian_energy": 4, "gaussian_energy": 5}.get(name, 6)
        x, y = np.abs(RNG.normal(size=(9, d))) + 0.1, np.abs(RNG.normal(size=(9, d))) + 0.1
        x0, y0 = x.copy(), y.copy()
        v, g = f(x, y)
        assert v.shape == (9,) and g.shape == (9, d) and np.isfinite(v).all() and np.isfinite(g).all()
        assert np.array_equal(x, x0) and np.array_equal(y, y0)  # inputs stay
    v, g = gradients.spherical_gaussian(np.array([[1.0, 2, 1]]), np.array([[0.0, 0, -1]]))
    assert v[0] == 10 and g[0].tolist() == [0, 0, -1]


def test_gradients_at_ties_and_zeros():
    """Equal coordinates have no slope; a zero side of hellinger has none at all."""
    x, y = np.array([[1.0, 2, 0, -3]]), np.array([[1.0, 4, 0, -1]])
    assert gradients.GRADIENTS["canberra"](x, y)[1][0].tolist() == pytest.approx([0, -1 / 6 - 2 / 36, 0, -1 / 4 + 2 / 16])
    assert gradients.GRADIENTS["braycurtis"](x, y)[1][0].tolist() == pytest.approx([-4 / 12 / 12, (-1 - 4 / 12) / 12, -4 / 12 / 12, (-1 - 4 / 12) / 12])
    zero = np.zeros((1, 3))
    for a, b, d in ((zero, zero, 0), (zero, zero + 1, 1), (zero + 1, zero, 1)):
        value, grad = gradients.GRADIENTS["hellinger"](a, b)
        assert value[0] == d and not grad.any()


def test_gaussian_energy_values():
    x, y = np.array([[1.0, 2, 1, 2, 0.3]]), np.array([[0.0, 0, 1, 1, 0.1]])
    value, grad = gradients.GRADIENTS["gaussian_energy"](x, y)
    c, s = np.cos(0.3), np.sin(0.3)
    cov = np.array([[c * c + 2 * s * s, -c * s], [-c * s, s * s + 2 * c * c]]) + np.eye(2)
    m, inv = np.array([1.0, 2.0]), np.linalg.inv(cov)
    assert value[0] == pytest.approx(m @ inv @ m + np.log(np.linalg.det(cov)) + np.log(2 * np.pi)) and value[0] == pytest.approx(5.695, abs=1e-3)
    assert grad[0, :2].tolist() == pytest.approx((2 * inv @ m).tolist())
    assert gradients.GRADIENTS["gaussian_energy"](np.zeros((1, 5)) + 1, np.zeros((1, 5)) - 0.0)[1].shape == (1, 5)


def test_scalar_distances(spark):
    df = spark.createDataFrame([("kitten", "sitting", 2, 5), ("a", "a" * 40, 3, 3)], "a string, b string, x int, y int")
    rows = df.select(metrics.string_distance(F.col("a"), F.col("b")).alias("s"), metrics.count_distance(F.col("x"), F.col("y"), 2.0).alias("c"), metrics.sign(F.col("x") - F.col("y")).alias("g"), metrics.categorical(F.col("a"), F.col("b")).alias("k")).collect()
    want = sum(k * np.log(2) - 2 - np.log(float(np.prod(range(1, k + 1)))) for k in (2, 3, 4))
    assert [r.s for r in rows] == [3, 39] and rows[0].c == pytest.approx(want) and rows[1].c == 0
    assert [r.g for r in rows] == [-1, 1] and [r.k for r in rows] == [1, 1]


def test_sinkhorn_marginals():
    x, y = np.array([0.5, 0.5]), np.array([0.5, 0.5])
    cost = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert metrics.sinkhorn(x, y, np.exp(-cost * 50), cost) == pytest.approx(0, abs=1e-12)


def test_sql_functions(spark):
    assert len(metrics.register(spark)) == 34
    r = spark.sql("SELECT dist_euclidean(array(1D, 2D), array(4D, 6D)) AS a, dist_cosine(array(1D, 0D), array(0D, 2D)) AS b, dist_correlation(array(1D, 2D, 3D), array(2D, 4D, 6D)) AS c").first()
    assert (r.a, r.b) == (5.0, 1.0) and r.c == pytest.approx(0)
