"""Queries of the manifold engine over the whole tables, and the SQL they are held against.

Floating values are rounded to six to eight decimals on both sides: blocks and
folds add in different orders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.plans.projection import ManifoldProjection, sparse_neighbours
from karst import oracles
from karst.functions import gradients, metrics, sparse
from karst.operators import evaluate, fuzzy, graph, hubs, knn, layout
from karst.session import stored
from karst.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, features)`` of the embeddings, as doubles."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


_E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings)"

# distances of consecutive rows ----------------------------------------------------

_SHAPES = {
    "any": ("{v}", "{v}"),
    "nonnegative": ("transform({v}, z -> abs(z))", "list_transform({v}, lambda z: abs(z))"),
    "ball": ("transform({v}, z -> z / 2)", "list_transform({v}, lambda z: z / 2)"),
    "pair": ("slice({v}, 1, 2)", "{v}[1:2]"),
    "counts": ("transform({v}, z -> cast(floor(abs(z) * 50) as double))", "list_transform({v}, lambda z: floor(abs(z) * 50)::DOUBLE)"),
    "bits": ("transform({v}, z -> if(z > 0, 1D, 0D))", "list_transform({v}, lambda z: CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"),
}
_PARAMS = {
    "minkowski": {"p": 3.0},
    "seuclidean": {"c": [1 + (i % 4) / 2 for i in range(64)]},
    "wminkowski": {"c": [1 + (i % 3) / 4 for i in range(64)], "p": 3.0},
    "mahalanobis": {"c": [[2.0 if i == j else 0.5 if abs(i - j) == 1 else 0.0 for j in range(64)] for i in range(64)]},
}


def _pairs(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """Each row with the row of the next id: ``(id, x, y)``."""
    v = vectors(spark, sf_dir).select("id", F.expr(_SHAPES[shape][0].format(v="features")).alias("x"))
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")


def _dense(m: metrics.Metric):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir, m.needs).select("id", F.round(metrics.distance(m.name, "x", "y", **_PARAMS.get(m.name, {})), 8).alias("distance"))

    shape = _SHAPES[m.needs][1].format(v="v")
    return run, f"WITH {_E}, {oracles.distance(m.name, f'SELECT id, {shape} AS x FROM e')}"


def _sparse(m: metrics.Metric):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir).select("id", F.expr(_SHAPES[m.needs][0].format(v="features")).alias("x"))
        v = v.select("id", sparse.sparsify(F.col("x"), 3.0 if m.needs == "counts" else 0.15).alias("x"))
        pairs = v.join(v.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")
        return sparse.distance(pairs, m.name, "x", "y", n_features=64, **_PARAMS.get(m.name, {})).select("id", F.round("distance", 8).alias("distance"))

    least = 3.0 if m.needs == "counts" else 0.15
    shape = f"list_transform({_SHAPES[m.needs][1].format(v='v')}, lambda z: CASE WHEN abs(z) > {least} THEN z ELSE 0 END)"
    return run, f"WITH {_E}, {oracles.distance(m.name, f'SELECT id, {shape} AS x FROM e')}"


for _m in dict.fromkeys(metrics.REGISTRY.values()):
    QUERIES[f"dist_{_m.name}"], ORACLES[f"dist_{_m.name}"] = _dense(_m)
    if _m.name in sparse.SPARSE and _m.name != "poincare":
        QUERIES[f"sparse_{_m.name}"], ORACLES[f"sparse_{_m.name}"] = _sparse(_m)


def _gradient(name: str):
    needs = metrics.REGISTRY[name].needs if name in metrics.REGISTRY else {"hyperboloid": "any", "spherical_gaussian_energy": "s3", "diagonal_gaussian_energy": "s4", "gaussian_energy": "s5"}[name]
    width = {"s3": 3, "s4": 4, "s5": 5}.get(needs)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = _pairs(spark, sf_dir, "any" if width else needs)
        if width:
            pairs = pairs.select("id", F.slice("x", 1, width).alias("x"), F.slice("y", 1, width).alias("y"))
        out = gradients.with_gradient(pairs.repartition(8, "id"), name, "x", "y")
        return out.select("id", F.round("gradient.d", 6).alias("distance"), F.posexplode("gradient.grad").alias("coordinate", "g")).select("id", "distance", "coordinate", F.round("g", 6).alias("gradient"))

    shape = f"v[1:{width}]" if width else _SHAPES[needs][1].format(v="v")
    return run, f"WITH {_E}, {oracles.gradient(name, f'SELECT id, {shape} AS x FROM e')}"


for _name in dict.fromkeys(next(n for n, g in gradients.GRADIENTS.items() if g is f) for f in gradients.GRADIENTS.values()):
    QUERIES[f"grad_{_name}"], ORACLES[f"grad_{_name}"] = _gradient(_name)

# scalar distances -------------------------------------------------------------------


@_query(
    "dist_categorical",
    "SELECT a.c_custkey, CASE WHEN a.c_mktsegment = b.c_mktsegment THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS distance FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1",
)
def dist_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    pairs = c.join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_mktsegment").alias("other")), "c_custkey")
    return pairs.select("c_custkey", metrics.categorical(F.col("c_mktsegment"), F.col("other")).alias("distance"))


_PART = "FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_size").alias("size2"), F.col("p_name").alias("name2")), "p_partkey")


@_query("dist_ordinal", f"SELECT a.p_partkey, abs(a.p_size - b.p_size) / ((SELECT (max(p_size) - min(p_size)) / 2.0 FROM part)) AS distance {_PART}")
def dist_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the support taken from the column: half its range."""
    support = spark.read.parquet(f"{sf_dir}/part.parquet").agg(((F.max("p_size") - F.min("p_size")) / 2.0).alias("support"))
    return _parts(spark, sf_dir).crossJoin(F.broadcast(support)).select("p_partkey", metrics.ordinal(F.col("p_size"), F.col("size2"), F.col("support")).alias("distance"))


@_query(
    "dist_count",
    f"""WITH s AS (SELECT avg(p_size) AS rate, sum(1) AS n FROM part)
    SELECT p_partkey, round(CASE WHEN lo = hi THEN 0.0 ELSE list_sum(list_transform(range(lo, hi), lambda k: k * ln(rate) - rate - lgamma(k + 1))) END, 6) AS distance
    FROM (SELECT a.p_partkey, least(a.p_size, b.p_size) AS lo, greatest(a.p_size, b.p_size) AS hi {_PART}), s""",
)
def dist_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.avg("p_size").alias("rate"))
    return _parts(spark, sf_dir).crossJoin(F.broadcast(rate)).select("p_partkey", F.round(metrics.count_distance(F.col("p_size"), F.col("size2"), F.col("rate")), 6).alias("distance"))


@_query("dist_string", f"SELECT a.p_partkey, (CASE WHEN abs(length(a.p_name) - length(b.p_name)) > 20 THEN abs(length(a.p_name) - length(b.p_name)) ELSE levenshtein(a.p_name, b.p_name) END)::DOUBLE AS distance {_PART}")
def dist_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", metrics.string_distance(F.col("p_name"), F.col("name2")).alias("distance"))


@_query(
    "dist_hierarchical_categorical",
    """SELECT a.c_custkey, CASE WHEN a.c_nationkey = b.c_nationkey THEN 0.0::DOUBLE WHEN x.n_regionkey = y.n_regionkey THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS distance
    FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 JOIN nation x ON x.n_nationkey = a.c_nationkey JOIN nation y ON y.n_nationkey = b.c_nationkey""",
)
def dist_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    pairs = c.join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_nationkey").alias("n2"), F.col("n_regionkey").alias("r2")), "c_custkey")
    levels = [(F.col("c_nationkey"), F.col("n2")), (F.col("n_regionkey"), F.col("r2"))]
    return pairs.select("c_custkey", metrics.hierarchical_categorical(levels).alias("distance"))


@_query(
    "discrete_params",
    "SELECT ((max(p_size) - min(p_size)) / 2.0)::DOUBLE AS support, avg(p_size) AS rate, (count(DISTINCT p_size) / 2.0)::DOUBLE AS norm, (max(length(p_name)) / 1.5 / 2.0)::DOUBLE AS normalisation FROM part",
)
def discrete_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the scalar distances, taken from the data."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.agg(((F.max("p_size") - F.min("p_size")) / F.lit(2.0)).alias("support"), F.avg("p_size").alias("rate"), (F.count_distinct("p_size") / F.lit(2.0)).alias("norm"), (F.max(F.length("p_name")) / F.lit(1.5) / F.lit(2.0)).alias("normalisation"))


# neighbour tables -------------------------------------------------------------------

_EUC = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def _knn(k: int, d: str = _EUC, shape: str = "any", name: str = "knn") -> str:
    """CTEs ``e`` and ``knn(i, j, d, rank)``."""
    v = _SHAPES[shape][1].format(v="list_transform(embedding, lambda q: q::DOUBLE)")
    return f"e AS (SELECT vec_id AS id, {v} AS v FROM embeddings), {name} AS (SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM (SELECT a.id AS i, b.id AS j, {d} AS d FROM e a, e b)) WHERE rank <= {k})"


_KNN_SQL = {
    "euclidean": _EUC,
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
    "chebyshev": "list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
    "cosine": "round(1 - list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(a.v, lambda z: z * z)) * list_sum(list_transform(b.v, lambda z: z * z))), 9)",
    "canberra": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: CASE WHEN z[1] = 0 AND z[2] = 0 THEN 0 ELSE abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2])) END))",
    "hamming": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: CASE WHEN z[1] <> z[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) / 64",
    "jaccard": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) / greatest(list_sum(list_transform(list_zip(a.v, b.v), lambda z: greatest(z[1], z[2]))), 1)",
}


def _shaped(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.expr(_SHAPES[metrics.REGISTRY[metric].needs][0].format(v="features")).alias("features"))


def _knn_query(metric: str):
    decimals = 9 if metric == "cosine" else None

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return knn.exact(_shaped(spark, sf_dir, metric), 10, metric, decimals=decimals).select("i", "j", F.round("d", 6).alias("d"), "rank")

    return run


for _name, _sql in _KNN_SQL.items():
    QUERIES[f"knn_{_name}"] = _knn_query(_name)
    ORACLES[f"knn_{_name}"] = f"WITH {_knn(10, _sql, metrics.REGISTRY[_name].needs)} SELECT i, j, round(d, 6) AS d, rank::INTEGER AS rank FROM knn"


@_query("pairwise_distances", f"WITH {_E} SELECT a.id AS i, b.id AS j, round({_EUC}, 6) AS d FROM e a, e b")
def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.all_pairs(vectors(spark, sf_dir), 6)


@_query("knn_precomputed", f"WITH {_knn(8)} SELECT i, j, round(d, 6) AS d, rank::INTEGER AS rank FROM knn")
def knn_precomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.precomputed(knn.all_pairs(vectors(spark, sf_dir), nearest=8), 8).select("i", "j", F.round("d", 6).alias("d"), "rank")


@_query("knn_blocks", f"WITH {_knn(5)} SELECT i, j, round(d, 6) AS d, rank::INTEGER AS rank FROM knn")
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without broadcasting the table: block by block."""
    held, knn.BROADCAST_BYTES = knn.BROADCAST_BYTES, 0
    try:
        return knn.exact(vectors(spark, sf_dir), 5).select("i", "j", F.round("d", 6).alias("d"), "rank")
    finally:
        knn.BROADCAST_BYTES = held


@_query("knn_sparse", f"WITH {_knn(5).replace('list_transform(embedding, lambda q: q::DOUBLE)', 'list_transform(embedding, lambda q: CASE WHEN abs(q) > 0.15 THEN q::DOUBLE ELSE 0.0::DOUBLE END)')} SELECT i, j, round(d, 6) AS d, rank::INTEGER AS rank FROM knn")
def knn_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", F.expr("transform(features, z -> if(abs(z) > cast(0.15 as double), z, 0D))").alias("f"))
    return sparse_neighbours(v.select("id", sparse.sparsify(F.col("f")).alias("features")), 5, "euclidean", 64).select("i", "j", F.round("d", 6).alias("d"), "rank")


@_query("knn_approx")
def knn_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.approximate(vectors(spark, sf_dir), 10)


@_query("rp_leaves")
def rp_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.leaves(vectors(spark, sf_dir), 3, 20)


@_query("knn_search")
def knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows searched for slightly moved copies of themselves."""
    v = stored(vectors(spark, sf_dir))
    moved = v.select("id", F.transform("features", lambda x, i: x + 0.01 * F.sin(i.cast("double"))).alias("features"))
    return knn.search(moved, v, stored(knn.exact(v, 10)), 5)


# order, groups, hubs, closure ---------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return stored(knn.exact(vectors(spark, sf_dir), k), "knn")


_DEGREE = "deg AS (SELECT e.id, count(knn.j) AS degree FROM e LEFT JOIN knn ON knn.j = e.id GROUP BY e.id)"
_ORDER = "ORDER BY degree = 0, -degree, CASE WHEN degree > 0 THEN -id ELSE id END"


@_query("indegree_order", f"WITH {_knn(6)}, {_DEGREE} SELECT id, degree, row_number() OVER ({_ORDER})::INTEGER AS place FROM deg")
def indegree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = hubs.order_keys(hubs.indegree(_graph(spark, sf_dir, 6), vectors(spark, sf_dir)))
    return keys.select("id", "degree", F.row_number().over(Window.orderBy("unseen", "by", "tie")).alias("place"))


@_query("missing_ids", f"WITH {_knn(3)} SELECT id FROM e WHERE id NOT IN (SELECT j FROM knn WHERE i <> j)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are no other row's neighbour."""
    return hubs.missing(_graph(spark, sf_dir, 3).where("i <> j"), vectors(spark, sf_dir))


@_query("group_law", "SELECT h AS hub_num, ceil(n / h::DOUBLE)::INTEGER AS size, floor(n / ceil(n / h::DOUBLE))::INTEGER AS full_groups, ceil(n / ceil(n / h::DOUBLE))::INTEGER AS all_groups FROM (SELECT count(*) AS n FROM embeddings), unnest([2, 10, 30, 50, 99]) AS t(h)")
def group_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vectors(spark, sf_dir).count()
    return spark.createDataFrame([(h, *hubs.group_law(n, h)) for h in (2, 10, 30, 50, 99)], "hub_num int, size int, full_groups int, all_groups int")


def _groups(spark: SparkSession, sf_dir: str, k: int, hub_num: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, g = stored(vectors(spark, sf_dir)), _graph(spark, sf_dir, k)
    return v, g, stored(hubs.greedy_groups(v, hubs.indegree(g, v), hub_num))


@_query("hub_groups")
def hub_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, 6, 20)[2]


@_query("hub_groups_graph")
def hub_groups_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir, 6)
    return hubs.groups_from_graph(g, hubs.indegree(g, vectors(spark, sf_dir)), 20)


def _starts(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, neighbours, and as hubs the ten first of the in-degree order."""
    v, g = vectors(spark, sf_dir), _graph(spark, sf_dir, k)
    return v, g, hubs.order_keys(hubs.indegree(g, v)).orderBy("unseen", "by", "tie").limit(10).select("id")


def _reach(k: int) -> str:
    return f"RECURSIVE {_knn(k)}, {_DEGREE}, hubs AS (SELECT id FROM deg {_ORDER} LIMIT 10), reach AS (SELECT id FROM hubs UNION SELECT knn.j AS id FROM reach JOIN knn ON knn.i = reach.id)"


def _reach_query(k: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, g, h = _starts(spark, sf_dir, k)
        return graph.closure(h, g).select("id")

    return run


for _k in (3, 6):
    QUERIES[f"hub_reach_k{_k}"], ORACLES[f"hub_reach_k{_k}"] = _reach_query(_k), f"WITH {_reach(_k)} SELECT id FROM reach"

_ROLES = "roles AS (SELECT e.id, CASE WHEN e.id IN (SELECT id FROM hubs) THEN 2 WHEN e.id IN (SELECT id FROM reach) THEN 1 ELSE 0 END AS role FROM e)"


@_query("roles", f"WITH {_reach(3)}, {_ROLES} SELECT id, role::TINYINT AS role FROM roles")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, g, h = _starts(spark, sf_dir, 3)
    return graph.roles(v, h, graph.closure(h, g))


@_query("edge_select", f"WITH {_knn(5)}, m AS (SELECT vec_id AS id FROM embeddings WHERE label < 6) SELECT i, j, round(d, 6) AS d, row_number() OVER (PARTITION BY i ORDER BY rank)::INTEGER AS rank FROM knn WHERE i IN (SELECT id FROM m) AND j IN (SELECT id FROM m)")
def edge_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the rows of some labels."""
    m = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label < 6").select(F.col("vec_id").alias("id"))
    return graph.select_edges(_graph(spark, sf_dir, 5), m, 5).select("i", "j", F.round("d", 6).alias("d"), "rank")


_CUT = "s AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY rank) AS rank FROM knn WHERE rank <= CASE WHEN i % 3 = 0 THEN 5 ELSE 8 END)"


def _cut(g: DataFrame) -> DataFrame:
    """A table in which every third row is short."""
    return g.where(F.col("rank") <= F.when(F.col("i") % 3 == 0, 5).otherwise(8))


@_query(
    "edge_topup_2hop",
    f"""WITH {_knn(8)}, {_CUT}, short AS (SELECT i FROM s GROUP BY i HAVING count(*) < 8),
    new AS (SELECT DISTINCT s.i, t.j FROM s JOIN s t ON t.i = s.j WHERE s.i IN (SELECT i FROM short) AND s.i <> t.j AND NOT EXISTS (SELECT 1 FROM s u WHERE u.i = s.i AND u.j = t.j)),
    d AS (SELECT i, j, d FROM s UNION ALL SELECT n.i, n.j, {_EUC} FROM new n JOIN e a ON a.id = n.i JOIN e b ON b.id = n.j)
    SELECT i, j, round(d, 6) AS d, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d) WHERE rank <= 8""",
)
def edge_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return graph.top_up(_cut(_graph(spark, sf_dir, 8)), v, v, 8).select("i", "j", F.round("d", 6).alias("d"), "rank")


@_query("edge_refill", f"WITH {_knn(8)} SELECT i, j, round(d, 6) AS d, rank::INTEGER AS rank FROM knn")
def edge_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir, 8)
    return graph.refill(_cut(g), g, vectors(spark, sf_dir), 8).select("i", "j", F.round("d", 6).alias("d"), "rank")


@_query("edge_shortfall", f"WITH {_knn(8)}, {_CUT} SELECT i AS id, count(*) AS have FROM s GROUP BY i HAVING count(*) < 8")
def edge_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortfall(_cut(_graph(spark, sf_dir, 8)), vectors(spark, sf_dir), 8)


# fuzzy graph ------------------------------------------------------------------------

_K = 10
_SIGMA = f"""RECURSIVE {_knn(_K)}, r AS (SELECT i, list(d ORDER BY rank) AS ds, avg(d) AS mean, coalesce(min(CASE WHEN d > 0 THEN d END), 0) AS rho FROM knn GROUP BY i),
b AS (SELECT i, ds, rho, 0 AS n, 0.0::DOUBLE AS lo, 'Infinity'::DOUBLE AS hi, 1.0::DOUBLE AS mid, false AS done FROM r
 UNION ALL SELECT i, ds, rho, n + 1, CASE WHEN q OR p > t THEN lo ELSE mid END, CASE WHEN q OR p <= t THEN hi ELSE mid END,
  CASE WHEN q THEN mid WHEN p > t THEN (lo + mid) / 2 WHEN hi = 'Infinity'::DOUBLE THEN mid * 2 ELSE (mid + hi) / 2 END, q
  FROM (SELECT *, {math.log2(_K)!r}::DOUBLE AS t, abs(p - {math.log2(_K)!r}::DOUBLE) < 1e-5 AS q FROM (SELECT *, list_sum(list_transform(ds[2:], lambda z: CASE WHEN z - rho > 0 THEN exp(-(z - rho) / mid) ELSE 1.0::DOUBLE END)) AS p FROM b WHERE n < 64 AND NOT done))),
sig AS (SELECT b.i, b.rho, greatest(arg_max(b.mid, b.n), 1e-3 * CASE WHEN b.rho > 0 THEN any_value(r.mean) ELSE (SELECT avg(d) FROM knn) END) AS sigma FROM b JOIN r ON r.i = b.i GROUP BY b.i, b.rho)"""


@_query("smooth_rho_sigma", f"WITH {_SIGMA} SELECT i, round(rho, 6) AS rho, round(sigma, 6) AS sigma FROM sig")
def smooth_rho_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.smooth(_graph(spark, sf_dir, _K), _K).select("i", F.round("rho", 6).alias("rho"), F.round("sigma", 6).alias("sigma"))


_MEMBER = "m AS (SELECT knn.i AS head, knn.j AS tail, CASE WHEN knn.i = knn.j THEN 0.0 WHEN d <= rho OR sigma = 0 THEN 1.0 ELSE exp(-(d - rho) / sigma) END AS weight FROM knn JOIN sig ON sig.i = knn.i)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir, _K)
    return stored(fuzzy.memberships(g, fuzzy.smooth(g, _K)), "members")


@_query("membership", f"WITH {_SIGMA}, {_MEMBER} SELECT head, tail, round(weight, 6) AS weight FROM m")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("head", "tail", F.round("weight", 6).alias("weight"))


def _union_sql(mix: float) -> str:
    return f"u AS (SELECT coalesce(a.head, b.tail) AS head, coalesce(a.tail, b.head) AS tail, {mix} * (coalesce(a.weight, 0) + coalesce(b.weight, 0) - coalesce(a.weight, 0) * coalesce(b.weight, 0)) + {1 - mix} * coalesce(a.weight, 0) * coalesce(b.weight, 0) AS weight FROM (SELECT * FROM m WHERE weight <> 0) a FULL JOIN (SELECT * FROM m WHERE weight <> 0) b ON a.head = b.tail AND a.tail = b.head)"


def _union_query(mix: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fuzzy.union(_members(spark, sf_dir), mix).select("head", "tail", F.round("weight", 6).alias("weight"))

    return run


for _name, _mix in (("fuzzy_union", 1.0), ("fuzzy_union_mix", 0.5), ("fuzzy_intersection", 0.0)):
    QUERIES[_name] = _union_query(_mix)
    ORACLES[_name] = f"WITH {_SIGMA}, {_MEMBER}, {_union_sql(_mix)} SELECT head, tail, round(weight, 6) AS weight FROM u WHERE weight <> 0"


@_query("epochs_per_sample", f"WITH {_SIGMA}, {_MEMBER}, {_union_sql(1.0)} SELECT head, tail, round((SELECT max(weight) FROM u) / weight, 4) AS eps FROM u")
def epochs_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.epochs_per_sample(fuzzy.union(_members(spark, sf_dir))).select("head", "tail", F.round("eps", 4).alias("eps"))


_SCHEDULE = """s AS (SELECT vec_id AS id, (1 + (vec_id * 37 % 101) / 8.0)::DOUBLE AS eps FROM embeddings), t AS (SELECT id, eps, unnest(range(1, 31)) AS epoch FROM s),
f AS (SELECT *, floor(epoch / eps) AS c FROM t WHERE floor(epoch / eps) > floor((epoch - 1) / eps)),
g AS (SELECT *, greatest(0, floor(epoch / (eps / 5.0)) - 1) AS upto FROM f)"""


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), (1 + (F.col("vec_id") * 37 % 101) / F.lit(8.0)).alias("eps"))
    return s.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(30)))).where(fuzzy.fires(F.col("eps"), F.col("epoch")))


@_query("edge_schedule", f"WITH {_SCHEDULE} SELECT id, epoch::INTEGER AS epoch FROM f")
def edge_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epochs in which edges of these periods are used."""
    return _schedule(spark, sf_dir).select("id", "epoch")


@_query("neg_schedule", f"WITH {_SCHEDULE} SELECT id, epoch::INTEGER AS epoch, (upto - coalesce(lag(upto) OVER (PARTITION BY id ORDER BY epoch), 0))::BIGINT AS negatives FROM g")
def neg_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative samples that they draw there."""
    return _schedule(spark, sf_dir).select("id", "epoch", fuzzy.negatives_at(F.col("eps"), F.col("epoch"), 5.0).cast("long").alias("negatives"))


@_query(
    "reweight_edges",
    f"""WITH {_SIGMA}, {_MEMBER}, {_union_sql(1.0)}, {_DEGREE}, hubs AS (SELECT id FROM deg {_ORDER} LIMIT 10),
    w AS (SELECT head, tail, CASE WHEN head IN (SELECT id FROM hubs) THEN 0.0 WHEN tail IN (SELECT id FROM hubs) THEN 1.0 ELSE weight END AS weight FROM u WHERE weight <> 0)
    SELECT head, tail, round(weight, 6) AS weight FROM w WHERE weight > 0 AND weight >= (SELECT max(weight) FROM w) / 11""",
)
def reweight_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, h = _starts(spark, sf_dir, _K)
    return fuzzy.reweighted(fuzzy.union(_members(spark, sf_dir)), stored(h), 11).select("head", "tail", F.round("weight", 6).alias("weight"))


# layout -----------------------------------------------------------------------------


def _plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two coordinates as a layout."""
    return vectors(spark, sf_dir).select("id", F.slice("features", 1, 2).alias("pos"))


@_query(
    "init_from_hubs",
    f"""WITH {_knn(6)}, {_DEGREE}, hubs AS (SELECT id FROM deg {_ORDER} LIMIT 10),
    n AS (SELECT a.id, b.v[1] AS x, b.v[2] AS y, row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.id) AS r FROM e a, e b WHERE b.id IN (SELECT id FROM hubs) AND a.id NOT IN (SELECT id FROM hubs))
    SELECT id, round(sum(x) / (count(*) - 1), 6) AS x, round(sum(y) / (count(*) - 1), 6) AS y FROM n WHERE r <= 7 GROUP BY id""",
)
def init_from_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without noise."""
    v, _, h = _starts(spark, sf_dir, 6)
    out = layout.init_from_hubs(v, v.join(stored(h), "id"), _plane(spark, sf_dir), 2, most=7, spread=0)
    return out.select("id", F.round(F.col("pos")[0], 6).alias("x"), F.round(F.col("pos")[1], 6).alias("y"))


@_query(
    "init_from_graph",
    f"""WITH {_knn(6)}, {_DEGREE}, hubs AS (SELECT id FROM deg {_ORDER} LIMIT 10)
    SELECT i AS id, round(sum(e.v[1] / (d + 1e-6)) / sum(1 / (d + 1e-6)), 6) AS x, round(sum(e.v[2] / (d + 1e-6)) / sum(1 / (d + 1e-6)), 6) AS y FROM knn JOIN e ON e.id = knn.j WHERE j IN (SELECT id FROM hubs) AND i NOT IN (SELECT id FROM hubs) GROUP BY i""",
)
def init_from_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without noise; the rows that have hubs among their neighbours."""
    v, g, h = _starts(spark, sf_dir, 6)
    h = stored(h)
    ids = g.join(h.select(F.col("id").alias("j")), "j", "left_semi").select(F.col("i").alias("id")).distinct()
    out = layout.init_from_graph(ids, g, _plane(spark, sf_dir).join(h, "id"), 2, spread=0)
    return out.select("id", F.round(F.col("pos")[0], 6).alias("x"), F.round(F.col("pos")[1], 6).alias("y"))


_LABEL = "label AS (SELECT vec_id AS id, label FROM embeddings)"


@_query(
    "outlier_place",
    f"""WITH {_E}, {_LABEL}, o AS (SELECT e.*, label, (e.id % 9 = 0) AS outlier FROM e JOIN label USING (id)),
    n AS (SELECT a.id, b.v[1] AS x, b.v[2] AS y, row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.id) AS r FROM o a JOIN o b ON a.label = b.label WHERE a.outlier AND NOT b.outlier)
    SELECT id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM n WHERE r <= 5 GROUP BY id""",
)
def outlier_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups are the labels here, and every ninth row stands outside."""
    v = vectors(spark, sf_dir)
    groups = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("group_id"))
    role = v.select("id", F.when(F.col("id") % 9 == 0, 0).otherwise(1).cast("byte").alias("role"))
    out = layout.place_outliers(v, groups, role, _plane(spark, sf_dir), 2, 5)
    return out.select("id", F.round(F.col("pos")[0], 6).alias("x"), F.round(F.col("pos")[1], 6).alias("y"))


@_query("minmax_scale", f"WITH {_E} SELECT id, round(10 * (v[1] - min(v[1]) OVER ()) / (max(v[1]) OVER () - min(v[1]) OVER ()), 6) AS x, round(10 * (v[2] - min(v[2]) OVER ()) / (max(v[2]) OVER () - min(v[2]) OVER ()), 6) AS y FROM e")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.minmax(_plane(spark, sf_dir), 2).select("id", F.round(F.col("pos")[0], 6).alias("x"), F.round(F.col("pos")[1], 6).alias("y"))


@_query(
    "init_position_class",
    """WITH p AS (SELECT vec_id AS id, label * 1.5 * CASE WHEN label % 4 IN (0, 3) THEN -1 ELSE 1 END AS x, label * 1.5 * CASE WHEN label % 4 IN (0, 1) THEN -1 ELSE 1 END AS y FROM embeddings),
    s AS (SELECT (avg(x) + avg(y)) / 2 AS mean, greatest(max(x), max(y)) AS most FROM p) SELECT id, round((x - mean) / most, 6)::DOUBLE AS x, round((y - mean) / most, 6)::DOUBLE AS y FROM p, s""",
)
def init_position_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without noise."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label")
    return layout.init_position(df, "class", spread=0).select("id", F.round(F.col("pos")[0], 6).alias("x"), F.round(F.col("pos")[1], 6).alias("y"))


@_query("init_position_pca")
def init_position_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.init_position(vectors(spark, sf_dir), "pca")


@_query("hub_layout")
def hub_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _, groups = _groups(spark, sf_dir, 10, 30)
    a, b = fuzzy.fit_ab()
    ids, z = layout.hub_layout(v.join(hubs.hubs(groups).select("id"), "id"), 2, "pca", a, b, 0.0065, 100)
    return spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, z)], "id long, x double, y double")


@_query("kernel_fit")
def kernel_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, m, *(round(x, 6) for x in fuzzy.fit_ab(s, m))) for s, m in ((1.0, 0.1), (1.0, 0.0), (1.0, 0.5), (2.0, 0.1))]
    return spark.createDataFrame(rows, "spread double, min_dist double, a double, b double")


@_query("fit_embedding")
def fit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ManifoldProjection(n_neighbors=15, hub_num=30, global_n_epochs=50, local_n_epochs=30).fit(vectors(spark, sf_dir))
    return model.embedding.join(model.roles, "id")


@_query("fit_embedding_outliers")
def fit_embedding_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k of 3 leaves many rows out of the hubs' reach."""
    model = ManifoldProjection(n_neighbors=3, hub_num=10, global_n_epochs=20, local_n_epochs=11, metric="cosine").fit(vectors(spark, sf_dir))
    return model.embedding.join(model.roles, "id")


# evaluation -------------------------------------------------------------------------


def _half(spark: SparkSession, sf_dir: str, first: int, n: int) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.slice("features", first, n).alias("features"))


def _space(name: str, a: int, b: int) -> str:
    return f"{name} AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM (SELECT a.id AS i, b.id AS j, sqrt(list_sum(list_transform(list_zip(a.v[{a}:{b}], b.v[{a}:{b}]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM e a, e b WHERE a.id <> b.id))"


@_query("knn_overlap", f"WITH {_E}, {_space('h', 1, 32)}, {_space('l', 33, 64)} SELECT round(count(*) / ((SELECT count(*) FROM e) * 15.0), 8) AS overlap FROM h JOIN l USING (i, j) WHERE h.rank <= 15 AND l.rank <= 15")
def knn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the two halves of the vectors."""
    a, b = (knn.exact(_half(spark, sf_dir, f, 32), 16) for f in (1, 33))
    return evaluate.knn_overlap(a, b, 15, first=2).select(F.round("overlap", 8).alias("overlap"))


def _spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, high, low)``: the vectors, and their first two coordinates as a layout."""
    return vectors(spark, sf_dir).select("id", F.col("features").alias("high"), F.slice("features", 1, 2).alias("low"))


@_query("pair_corr", f"WITH {_E}, {_space('h', 1, 64)}, {_space('l', 1, 2)} SELECT round(corr(h.d, l.d), 6) AS correlation FROM h JOIN l USING (i, j) WHERE i < j")
def pair_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pair_correlation_of(_spaces(spark, sf_dir)).select(F.round("correlation", 6).alias("correlation"))


@_query(
    "trustworthiness",
    f"WITH {_E}, {_space('h', 1, 64)}, {_space('l', 1, 2)}, n AS (SELECT count(*)::DOUBLE AS n FROM e) SELECT round(1 - 2.0 / (any_value(n) * 15 * (2 * any_value(n) - 46)) * sum(greatest(h.rank - 15, 0)), 8) AS trustworthiness FROM l JOIN h USING (i, j), n WHERE l.rank <= 15",
)
def trustworthiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = knn.exact(_half(spark, sf_dir, 1, 2), 16).where("i <> j")
    low = low.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where("r <= 15")
    return evaluate.trustworthiness_of(_spaces(spark, sf_dir), low, 15).select(F.round("trustworthiness", 8).alias("trustworthiness"))


@_query(
    "density_gap",
    f"WITH {_E}, {_space('h', 1, 64)}, {_space('l', 1, 2)}, x AS (SELECT i, (sum(exp(-d * d / 0.1)) + 1) AS s FROM h GROUP BY i), y AS (SELECT i, (sum(exp(-d * d / 0.1)) + 1) AS s FROM l GROUP BY i) SELECT round(sum(abs(x.s / (SELECT sum(s) FROM x) - y.s / (SELECT sum(s) FROM y))), 6) AS density_gap FROM x JOIN y USING (i)",
)
def density_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.density_gap_of(_spaces(spark, sf_dir)).select(F.round("density_gap", 6).alias("density_gap"))


_RUNS = "SELECT o_orderkey, o_custkey % 50 AS dataset, (o_orderkey % 2 = 0) AS fast, o_totalprice AS sec FROM orders WHERE o_orderstatus <> 'P'"


@_query(
    "paired_speedup",
    f"WITH r AS ({_RUNS}), p AS (SELECT dataset, arg_max(sec, o_orderkey) FILTER (NOT fast) AS deterministic, arg_max(sec, o_orderkey) FILTER (fast) AS fast FROM r GROUP BY dataset) SELECT dataset::VARCHAR AS dataset, deterministic, fast, round(deterministic / fast, 8) AS fast_speedup FROM p",
)
def paired_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the part of runs: a customer group is a data set, odd and even keys are the modes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    log = o.select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 50).cast("string").alias("dataset"), F.lit("sample").alias("scenario"), F.lit(1).alias("n_jobs"),
        F.when(F.col("o_orderkey") % 2 == 0, "fast").otherwise("deterministic").alias("execution_mode"), F.col("o_totalprice").alias("duration_sec"), (F.col("o_orderstatus") != "P").alias("success"), F.lit("x").alias("embedding_path"),
    )
    return evaluate.speedup(evaluate.paired_runs(log)).select("dataset", "deterministic", "fast", F.round("fast_speedup", 8).alias("fast_speedup"))


@_query("pass_flags", "SELECT p_partkey, abs(p_size / 10000.0 - 0.0025) <= 0.005 AND p_retailprice / 2000 >= 0.85 AND p_size / 50.0 >= 0.5 AS passed FROM part")
def pass_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    s = p.select("p_partkey", (F.col("p_size") / 10000.0 - 0.0025).alias("trustworthiness_delta"), (F.col("p_retailprice") / 2000).alias("knn_overlap"), (F.col("p_size") / 50.0).alias("pairwise_corr"))
    return evaluate.passes(s, corr=0.5).select("p_partkey", "passed")


# sources ----------------------------------------------------------------------------


@_query("one_hot", "SELECT c_custkey, array_to_string([(c_mktsegment = m)::INTEGER FOR m IN (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) FROM customer)], ',') AS bits FROM customer")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.one_hot(spark.read.parquet(f"{sf_dir}/customer.parquet"), ["c_mktsegment"])
    return out.select("c_custkey", F.array_join(F.transform("features", lambda x: x.cast("int").cast("string")), ",").alias("bits"))


@_query("clean_values", "SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0.0 ELSE value END AS value FROM events")
def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", tables.finite(F.array("value"))[0].alias("value"))


@_query("distinct_vectors", "SELECT min(vec_id) AS first_id, count(*) AS n FROM embeddings GROUP BY embedding")
def distinct_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hubs.distinct_rows(vectors(spark, sf_dir)).select("first_id", "n")


@_query("size_representatives")
def size_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the customers' nations by number of customers."""
    sizes = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("name")).agg(F.count("*").alias("n"))
    return tables.representatives(sizes)
