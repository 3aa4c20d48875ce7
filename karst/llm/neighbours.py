"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted to a bounded sample; every vector is then filed under a leaf.
A query walks the tree best bin first, through a priority queue ordered by the
best product a node's members can have judged by its centre and spread, and
visits leaves in that order. How many leaves are visited is calibrated: for a
bounded sample of queries the true neighbours are found by a scan of all vectors
in blocks, and visits widen until the wanted share of them lies in the leaves
visited. A query widens further until its leaves hold enough vectors.

Neighbouring leaves of the tree make up groups of about ``BLOCK_ROWS`` vectors. A
query's vector travels once to each group that holds a leaf it visits, is
compared with the whole group and leaves its k best there, so what is moved grows
with the groups met and not with the leaves. A group beyond that size (one leaf)
is cut into blocks by a hash of the id, the queries of a group likewise, and each
pair of blocks is one matrix product, so neither a large leaf nor a popular one
lands in one task. Equal vectors would fill a leaf
without end; since at most k of them can be among the k nearest, only the k + 1
smallest ids of each distinct vector are filed (found with a partial group
limit), and equal queries are searched once.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do those of another length than the commonest;
null and repeated ids: a null id takes no part, of rows equal in id and vector
one counts; fewer candidates than k give all of them; an empty table gives no
rows. Scores are sums of products in double precision, added in one fixed order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.llm.common import stored

#: Vectors that the tree is fitted to: these, or one in ``FIT_SHARE`` of a larger table, but not more numbers than ``FIT_NUMBERS``.
FIT_ROWS, FIT_SHARE, FIT_NUMBERS = 16_384, 64, 1 << 24
#: Queries that it is calibrated with, at most.
CALIBRATION = 192
BRANCHES, LEAF_SAMPLE, BLOCK_ROWS, BLOCK_QUERIES = 8, 48, 4_096, 512


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        member = of == np.arange(k)[:, None]
        counts, sums = member.sum(1), member.astype(np.float64) @ x
        empty = counts == 0
        centres = np.where(empty[:, None], x[rng.choice(len(x), k)], sums / np.maximum(counts, 1)[:, None])
    return centres, np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


class Tree:
    """children[n]: nodes below n (empty for a leaf); centre and spread (root mean square distance to the centre) of each node."""

    def __init__(self, sample: np.ndarray, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.centre, self.spread, self.children = [sample.mean(0) if len(sample) else np.zeros(1)], [0.0], [[]]
        work = [(0, sample)]
        while work:
            node, x = work.pop()
            if len(x) <= LEAF_SAMPLE or len(distinct := np.unique(x, axis=0)) < 2:
                continue
            centres, of = _kmeans(x, min(BRANCHES, len(distinct)), rng)
            used = np.unique(of)
            if len(used) < 2:
                continue
            for c in used:
                part = x[of == c]
                self.children[node].append(len(self.centre))
                work.append((len(self.centre), part))
                self.centre.append(centres[c])
                self.spread.append(float(np.sqrt(((part - centres[c]) ** 2).sum(1).mean())))
                self.children.append([])
        self.centre, self.spread = np.array(self.centre), np.array(self.spread)
        self.leaves = sum(not c for c in self.children)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: nearest centre at every level."""
        at = np.zeros(len(x), np.int64)
        todo = np.arange(len(x)) if self.children[0] else np.zeros(0, int)
        while len(todo):
            for node in np.unique(at[todo]):
                rows = todo[at[todo] == node]
                kids = np.array(self.children[node])
                c = self.centre[kids]
                at[rows] = kids[np.argmin((c**2).sum(1) - 2 * x[rows] @ c.T, axis=1)]
            todo = todo[[bool(self.children[a]) for a in at[todo]]]
        return at

    def groups(self, counts: dict[int, int], most: int) -> dict[int, int]:
        """A number for each leaf that has vectors: leaves next to one another in the tree share it as long as they have ``most`` in all."""
        out, number, held, todo = {}, 0, 0, [0]
        while todo:
            node = todo.pop()
            todo += reversed(self.children[node])
            if node in counts:
                if held and held + counts[node] > most:
                    number, held = number + 1, 0
                out[node] = number
                held += counts[node]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: by the product with the centre and two deviations along the query's direction."""
        best = self.centre @ q + 2 * self.spread * np.sqrt(q @ q / len(q))
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                yield node
            for c in self.children[node]:
                heapq.heappush(heap, (-best[c], c))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """``(id, v)``: rows that take part; of length ``dim``, or the commonest."""
    v = F.col(vec_col)
    ok = F.expr(f"{id_col} is not null and size(`{vec_col}`) > 0 and forall(`{vec_col}`, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(`{vec_col}`, x -> x <> 0)")
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    if dim is not None:
        return rows.where(F.size("v") == dim)
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("v") == (dims.dim if dims else -1))


def _exact(queries: np.ndarray, ids: np.ndarray, rows: DataFrame, k: int) -> dict[int, list[int]]:
    """True neighbours of a bounded set of queries, by a scan of all rows in blocks."""
    dim = queries.shape[1]

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, own = _matrix(b.column(1), dim), b.column(0).to_numpy()
            if not len(own):
                continue
            s = queries @ x.T
            s[ids[:, None] == own] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), best.shape[1])), pa.array(own[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["q", "id", "s"])

    top = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    found = rows.mapInArrow(scan, "q long, id long, s double").where("s > double('-Infinity')").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k)
    out: dict[int, list[int]] = {}
    for r in found.select("q", "id").collect():  # CALIBRATION * k rows
        out.setdefault(r.q, []).append(r.id)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 20, recall: float = 0.97, seed: int = 42) -> DataFrame:
    """``(query_id, rank, id, score)`` of the k rows of ``vectors`` nearest to each row of ``queries`` (same columns), itself apart."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    out = "query_id long, rank int, id long, score double"
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size.n:
        return spark.createDataFrame([], out)
    dim = size.dim
    fit = min(max(FIT_ROWS, size.n // FIT_SHARE), max(1, FIT_NUMBERS // dim))
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(fit).select("v").toArrow().column(0).combine_chunks()
    tree = Tree(_matrix(sample, dim), seed)
    shared = spark.sparkContext.broadcast(tree)

    def filed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            leaf = shared.value.file(_matrix(b.column(1), dim)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], names=["leaf", "id", "v"])

    smallest = Window.partitionBy("v").orderBy("id")
    kept = rows.distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1).select("id", "v")
    v_type = rows.schema["v"].dataType.simpleString()
    leafed = stored(kept.mapInArrow(filed, f"leaf long, id long, v {v_type}"), "leaves")
    counts = {r.leaf: r["count"] for r in leafed.groupBy("leaf").count().collect()}  # a row for each leaf
    group = tree.groups(counts, BLOCK_ROWS)
    group_rows: dict[int, int] = {}
    for leaf, g in group.items():
        group_rows[g] = group_rows.get(g, 0) + counts[leaf]
    grouped = leafed.join(F.broadcast(spark.createDataFrame(sorted(group.items()), "leaf long, grp long")), "leaf").select("grp", "id", "v")

    asked = usable(queries, id_col, vec_col, dim).distinct()
    keyed = stored(asked.select("id", F.xxhash64("v").alias("h"), "v"), "asked")
    classes = keyed.groupBy("v").agg(F.min("id").alias("key"), F.min("h").alias("h"))  # equal queries are one
    tuning = classes.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(CALIBRATION).select("key", "v").toArrow()
    tune_ids, tune_vecs = tuning.column(0).to_numpy(), _matrix(tuning.column(1).combine_chunks(), dim)
    truth = _exact(tune_vecs, tune_ids, leafed.select("id", "v"), k) if len(tune_ids) else {}
    where = {i: leaf for leaf, i in leafed.join(F.broadcast(_ids(spark, sorted({i for t in truth.values() for i in t}))), "id", "left_semi").select("leaf", "id").collect()}
    needed = np.zeros(tree.leaves + 1)
    for q, ids in truth.items():
        place: dict[int, int] = {}  # the visit that a group is met with
        for n, leaf in enumerate(tree.visits(tune_vecs[q]), 1):
            if leaf in group:
                place.setdefault(group[leaf], n)
        for i in ids:
            needed[place[group[where[i]]]] += 1 / max(1, sum(map(len, truth.values())))
    widen = int(np.searchsorted(np.cumsum(needed), min(recall, needed.sum()) - 1e-9)) if truth else 1
    widen = max(1, min(tree.leaves, widen + max(1, widen // 10)))  # a tenth more: the calibration queries are a sample

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, groups = [], []
            for n, q in enumerate(_matrix(b.column(1), dim)):
                met: set[int] = set()
                held = 0
                for m, leaf in enumerate(shared.value.visits(q), 1):
                    g = group.get(leaf)
                    if g is not None and g not in met:
                        met.add(g)
                        held += group_rows[g]
                    if m >= widen and held > 2 * k or len(met) == len(group_rows):
                        break
                rows += [n] * len(met)
                groups += sorted(met)
                if len(rows) > 1 << 14:  # bounds the batch
                    yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), *(c.take(pa.array(rows, pa.int64())) for c in b.columns)], names=["grp", "key", "v"])
                    rows, groups = [], []
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), *(c.take(pa.array(rows, pa.int64())) for c in b.columns)], names=["grp", "key", "v"])

    tasks = max(1, min(10_000, -(-classes.count() // 256)))  # few rows, much to do for each
    visits = classes.select("key", "v").repartition(tasks, "key").mapInArrow(walk, f"grp long, key long, v {v_type}")

    def packed(df: DataFrame, key: str, most: int, name: str) -> DataFrame:
        """Blocks of a group: arrays of ids and vectors of about ``most`` rows."""
        sizes = df.groupBy("grp").agg(F.ceil(F.count("*") / most).alias("blocks"))  # a row for each group
        cut = df.join(F.broadcast(sizes), "grp").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), key), "blocks"))
        return cut.groupBy("grp", "block").agg(F.collect_list(F.struct(F.col(key).alias("id"), "v")).alias(name)).select("grp", name)

    pairs = packed(grouped, "id", BLOCK_ROWS, "xs").join(packed(stored(visits, "visits"), "key", BLOCK_QUERIES, "qs"), "grp").select("xs", "qs")

    def products(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for n in range(b.num_rows):
                xs, qs = (b.column(c).slice(n, 1).flatten() for c in (0, 1))
                (x_id, x), (q_id, q) = ((s.field(0).to_numpy(), _matrix(s.field(1), dim)) for s in (xs, qs))
                s = q @ x.T
                least = np.partition(s, max(0, s.shape[1] - k - 1), axis=1)[:, max(0, s.shape[1] - k - 1)]
                slack = 1e-9 * (1 + np.abs(least))
                i, j = np.nonzero(s >= (least - slack)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(q_id[i]), pa.array(x_id[j]), pa.array((q[i] * x[j]).sum(axis=1))], names=["key", "id", "score"])

    top = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    best = pairs.mapInArrow(products, "key long, id long, score double").distinct().withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    listed = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("found"))  # k + 1 each
    named = keyed.join(classes.select("v", "key"), "v").select(F.col("id").alias("query_id"), "key")
    ranked = named.join(listed, "key").select("query_id", F.posexplode(F.expr(f"slice(filter(found, x -> x.id <> query_id), 1, {k})")))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("id"), (-F.col("col.s")).alias("score"))


def _ids(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
