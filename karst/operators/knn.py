"""k-nearest-neighbour tables ``(i, j, d, rank)``: a row itself has rank 1, ties go to the smaller id."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.functions import metrics
from karst.session import stored

#: Bytes of vectors that are sent to every task; larger tables are compared block by block.
BROADCAST_BYTES = 64 << 20
EXACT_ROWS = 50_000
#: As many rows for metrics whose candidates are found by rough distances: there the scan takes less time and far less disk than the forest, whose levels hold all vectors once for each tree.
SCREENED_ROWS, SCREENED = 200_000, ("euclidean", "manhattan", "chebyshev", "cosine", "canberra")


def top(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each i; a partial group limit runs before the shuffle."""
    near = Window.partitionBy("i").orderBy("d", "j")
    return pairs.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("i", "j", "d", "rank")


def precomputed(edges: DataFrame, k: int) -> DataFrame:
    """From distances ``(i, j, d)``; missing pairs are no neighbours. Each batch keeps its own k nearest of every i before anything is sorted or shuffled."""

    def nearest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if any(c.null_count for c in b.columns):
                yield b
                continue
            i, j, d = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            begin = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
            keep = []  # runs of one i are cut on their own: a second run of it only keeps more
            for a, z in zip(begin, np.append(begin[1:], len(i))):
                at = np.arange(a, z)
                if z - a > k:
                    at = at[~(d[a:z] > np.partition(d[a:z], k - 1)[k - 1])]
                    at = at[np.lexsort((j[at], d[at]))[:k]]
                keep.append(at)
            yield b.take(pa.array(np.concatenate(keep))) if keep else b

    edges = edges.select("i", "j", "d")
    return top(edges.mapInArrow(nearest, edges.schema), k)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _narrow(x: np.ndarray) -> np.ndarray:
    """A matrix in single precision where that keeps every value: half of what a broadcast puts on each disk."""
    with np.errstate(over="ignore", invalid="ignore"):
        single = x.astype(np.float32) if x.ndim == 2 else x
    return single if np.array_equal(single, x) else x


def _tiles(x: np.ndarray, y_by_coordinate: np.ndarray, start: Callable, step: Callable, rows: int = 16, width: int = 8192) -> np.ndarray:
    """A value of every row of x and row of y, folded coordinate by coordinate in tiles that stay in a core's cache and are wide enough for what a call of numpy costs."""
    n, out = y_by_coordinate.shape[1], None
    for c in range(0, n, width):
        for r in range(0, len(x), rows):
            part = x[r : r + rows]
            acc = start(len(part), slice(c, min(n, c + width)))
            spare = np.empty_like(acc), np.empty_like(acc)
            for k in range(x.shape[1]):
                step(acc, y_by_coordinate[k, c : c + width], part[:, k, None], k, slice(c, min(n, c + width)), *spare)
            if out is None:
                out = np.empty((len(x), n), acc.dtype)
            out[r : r + rows, c : c + width] = acc
    return out if out is not None else np.zeros((len(x), n))


def _screen(name: str, x: np.ndarray, y: np.ndarray, decimals: int | None) -> tuple[Callable, float] | None:
    """(rough, slack): ``rough(a, b)`` ranks all rows of y from rows a to b of x as the metric does, up to ``slack``; None where no bound holds.

    Manhattan and Chebyshev distances of whole numbers of 16 bits, cosine and Canberra
    distances in single precision. The slack is twice the largest error, so the k
    nearest are among the rows within it of the k-th smallest rough value.
    """
    dim, rounding = x.shape[1], 10.0**-decimals if decimals is not None else 0.0
    ends = np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)
    if not dim or not all(1e-100 < e < 1e100 for e in ends):  # null and non-finite vectors too
        return None
    if name in ("manhattan", "chebyshev"):
        low, high = np.minimum(x.min(0), y.min(0)), np.maximum(x.max(0), y.max(0))
        most = min(16_000, 32_767 // (2 * dim)) if name == "manhattan" else 16_000
        if most < 16 or not (high - low).max() > 0:
            return None
        scale = most / ((high - low).max() / 2)
        whole = lambda v: np.rint((v - (low + high) / 2) * scale).astype(np.int16)
        xs, ys = whole(x), np.ascontiguousarray(whole(y).T)
        start = lambda m, at: np.zeros((m, at.stop - at.start), np.int16)
        fold, slack = (np.add, 2 * dim + 3) if name == "manhattan" else (np.maximum, 3)  # a sum is 2 * most * dim at most, which 16 bits hold

        def step(acc, b, a, k, at, s, t):  # not by the larger of both: numpy has no fast loop for that with one value on a side
            fold(acc, np.abs(np.subtract(b, a, out=s), out=s), out=acc)

        slack += rounding * scale
        return lambda a, b: _tiles(xs[a:b], ys, start, step), math.ceil(slack)
    if name == "cosine":
        norms = [np.sqrt((v * v).sum(1)) for v in (x, y)]
        xs, ys = ((v / np.where(n > 0, n, 1)[:, None]).astype(np.float32) for v, n in zip((x, y), norms))
        ys = ys.T
        return lambda a, b: -(xs[a:b] @ ys), 2 * (dim + 16) * 2.0**-23 + rounding
    if name == "canberra":
        small = [np.abs(v[v != 0]).min(initial=1.0) for v in (x, y)]
        if not all(1e-30 < s and e < 1e30 for s, e in zip(small, ends)):
            return None
        xs, ys = x.astype(np.float32), np.ascontiguousarray(y.T.astype(np.float32))
        size = np.abs(ys) + np.float32(1e-37)  # 0 / 0 is 0

        def step(acc, b, a, k, at, s, t):
            np.divide(np.subtract(b, a, out=s), np.add(size[k, at], np.abs(a), out=t), out=s)
            acc += np.abs(s, out=s)

        return lambda a, b: _tiles(xs[a:b], ys, lambda m, at: np.zeros((m, at.stop - at.start), np.float32), step, width=4096), 2 * dim * (dim + 16) * 2.0**-23 + rounding
    return None


def _coarse(x: np.ndarray, y: np.ndarray) -> tuple[Callable, float]:
    """(rough, scale) for Chebyshev distances in bytes: ``rough(a, b)`` is at most ``scale`` times the distance and 1 for rounding, and less where a difference wraps."""
    low, high = np.minimum(x.min(0), y.min(0)), np.maximum(x.max(0), y.max(0))
    scale = 127 / ((high - low).max() / 2)
    whole = lambda v: np.rint((v - (low + high) / 2) * scale).astype(np.int8)
    xs, ys = whole(x), np.ascontiguousarray(whole(y).T)

    def step(acc, b, a, k, at, s, t):  # the magnitude of -128 is 128 as an unsigned byte
        signed = s.view(np.int8)
        np.abs(np.subtract(b, a, out=signed), out=signed)
        np.maximum(acc, s, out=acc)

    return lambda a, b: _tiles(xs[a:b], ys, lambda m, at: np.zeros((m, at.stop - at.start), np.uint8), step, width=16_384), scale


def _kth(rough: np.ndarray, k: int, group: int = 64) -> np.ndarray:
    """Of each row a bound that k values at least are within: the k-th smallest of the least ones of groups of columns."""
    group = min(group, rough.shape[1] // (4 * k))
    if group > 1:
        rough = rough[:, : rough.shape[1] // group * group].reshape(len(rough), group, -1).min(1)
    return np.partition(rough, k - 1, axis=1)[:, k - 1]


def block_top(x_ids: np.ndarray, x: np.ndarray, y_ids: np.ndarray, y: np.ndarray, k: int, metric: str | Callable, decimals: int | None = None, **params) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of x: (i, j, d) of the k rows of y nearest to each; candidates by a cheaper rough distance, distances and order by the metric itself.

    With ``decimals`` distances are rounded before they are compared.
    """
    plain = metric if callable(metric) else lambda a, b: metrics.block(metric, a, b, **params)
    measure = plain if decimals is None else lambda a, b: plain(a, b).round(decimals)
    fast = metric in ("euclidean", "l2") and not params and decimals is None
    order_y = np.argsort(y_ids, kind="stable")  # so that a stable sort by distance breaks ties by id
    y_ids, y = y_ids[order_y], y[order_y]
    many = len(y) > 4 * k + 32
    screen = _screen(metrics.lookup(metric).name, x, y, decimals) if many and not callable(metric) and not params and not fast and x.shape[1:] == y.shape[1:] else None
    coarse = _coarse(x, y) if screen and metrics.lookup(metric).name == "chebyshev" else None
    blurred = 0  # rows that bytes told too little of
    norms = (y * y).sum(1) if fast and many else np.zeros(0)
    whole = np.isfinite(norms).all()  # the least of a group says nothing where one isn't a number
    rounding = 10.0**-decimals if decimals is not None else 0.0
    zero = (x * x).sum(1) == 0 if screen and metrics.lookup(metric).name == "cosine" else np.zeros(len(x), bool)
    rows = max(16, min(256, (1 << 23) // max(1, len(y))))
    for a in range(0, len(x), rows):
        part, ids = x[a : a + rows], x_ids[a : a + rows]
        if fast and many:
            rough = (-2 * part) @ y.T
            rough += norms
            m = min(len(y), k + 8)
            least = _kth(rough, m)[:, None] if whole else np.partition(rough, m - 1, axis=1)[:, m - 1 : m]
            slack = 1e-9 * (1 + np.abs(least))
            for row in range(len(part)):
                cand = np.flatnonzero(rough[row] <= least[row] + slack[row])
                d = metrics.REGISTRY["euclidean"].block(part[row][None], y[cand])
                best = np.argsort(d, kind="stable")[:k]
                yield np.repeat(ids[row], len(best)), y_ids[cand[best]], d[best]
        elif coarse and blurred <= a // 2:
            rough = coarse[0](a, a + rows)
            least = _kth(rough, k).tolist()
            for row in range(len(part)):
                # bytes may fall short of a distance, so the bound is a distance itself: the k-th of k rows or more
                d = measure(part[row][None], y[np.flatnonzero(rough[row] <= least[row])])[0]
                near = rough[row] <= min(255, math.floor((np.partition(d, k - 1)[k - 1] + rounding) * coarse[1] + 1 + 1e-6))
                if np.count_nonzero(near) > max(64 * k, len(y) // 16):
                    blurred += 1
                    fine = screen[0](a + row, a + row + 1)
                    near = fine[0] <= min(_kth(fine, k)[0] + screen[1], 32_767)
                cand = np.flatnonzero(near)
                d = measure(part[row][None], y[cand])[0]
                best = np.argsort(d, kind="stable")[:k]
                yield np.repeat(ids[row], len(best)), y_ids[cand[best]], d[best]
        elif screen:
            rough = screen[0](a, a + rows)
            least = _kth(rough, k).tolist()
            for row in range(len(part)):
                # a zero vector is at cosine distance 0 from others of them, which its rough value does not tell
                cand = np.arange(len(y)) if zero[a + row] else np.flatnonzero(rough[row] <= (min(least[row] + screen[1], 32_767) if rough.dtype == np.int16 else least[row] + screen[1]))
                d = measure(part[row][None], y[cand])[0]
                best = np.argsort(d, kind="stable")[:k]
                yield np.repeat(ids[row], len(best)), y_ids[cand[best]], d[best]
        else:
            d = measure(part, y)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            yield np.repeat(ids, best.shape[1]), y_ids[best].ravel(), np.take_along_axis(d, best, 1).ravel()


def _emit(parts: Iterator) -> Iterator[pa.RecordBatch]:
    held = list(parts)
    if held:
        i, j, d = (np.concatenate(x) for x in zip(*held))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d)], names=["i", "j", "d"])


def against_all(df: DataFrame, step: Callable, schema: str, columns: tuple[str, ...] = ("features",), queries: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """What ``step(x, y)`` yields of every batch x of rows (``queries``, or ``df`` itself) with all rows of ``df``.

    x and y are lists of ids and a matrix for each of ``columns``; x ends with
    Python lists of its columns ``extra``. y is a broadcast copy of the table where
    that is small, of which x is a part if the table is compared with itself; else
    it comes block by block, and results are for each block.
    """
    spark, asked = df.sparkSession, df if queries is None else queries
    n, dim = df.agg(F.count("*"), F.coalesce(F.max(sum(F.size(c) for c in columns)), F.lit(0))).first()
    rows, asked = df.select("id", *columns), asked.select("id", *columns, *extra)
    read = lambda cols: [cols[0].to_numpy(zero_copy_only=False), *map(_matrix, cols[1 : 1 + len(columns)]), *(c.to_pylist() for c in cols[1 + len(columns) :])]
    if n * dim * 8 <= BROADCAST_BYTES:
        table = rows.toArrow()
        data = spark.sparkContext.broadcast([_narrow(c) for c in read([c.combine_chunks() for c in table.columns])])
        parts = max(1, min(spark.sparkContext.defaultParallelism * 2, n // 64))
        own = queries is None and not extra  # then every task has its rows already, and takes them by place

        def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = None
            for b in it:
                if b.num_rows and len(data.value[0]):
                    y = y or [c.astype(np.float64) if c.dtype == np.float32 else c for c in data.value]
                    at = b.column(0).to_numpy() if own else None
                    yield from step([c[at] for c in y] if own else read(b.columns), y)

        places = spark.range(0, table.num_rows, 1, parts) if own else asked.repartition(parts, "id")
        return places.mapInArrow(scan, schema)

    blocks = max(2, math.ceil(n * dim * 8 / (16 << 20)))

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(name)).agg(F.collect_list(F.struct(*df.columns)).alias(name + "s"))

    left = packed(asked, "x").withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    both = left.join(packed(rows, "y"), "y").repartition(blocks * 2, "x", "y").select("xs", "ys")

    def products(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                yield from step(*(read(b.column(c).slice(r, 1).flatten().flatten()) for c in (0, 1)))

    return both.mapInArrow(products, schema)


def exact(df: DataFrame, k: int, metric: str | Callable = "euclidean", queries: DataFrame | None = None, decimals: int | None = None, **params) -> DataFrame:
    """All pairs in Arrow blocks: against a broadcast copy where it is small, else block by block with partial top-k."""
    return top(against_all(df, lambda x, y: _emit(block_top(*x, *y, k, metric, decimals, **params)), "i long, j long, d double", queries=queries), k)


def in_groups(df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k rows of ``df(id, group_id, features)`` nearest (euclidean) to each of ``queries`` in its own group; a group without rows has none.

    ``df`` is broadcast where it is small, and queries are taken where they are; else
    chunks of a group's queries meet chunks of its rows.
    """
    df, queries = (d.select("id", "group_id", "features").where("group_id is not null") for d in (df, queries))
    n, dim = df.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    schema = "i long, j long, d double"
    if n * dim * 8 <= BROADCAST_BYTES:
        table = df.toArrow().sort_by([("group_id", "ascending"), ("id", "ascending")]).combine_chunks()
        names, begin = np.unique(table.column("group_id").to_numpy(), return_index=True)
        ends = dict(zip(names.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), n])))
        data = df.sparkSession.sparkContext.broadcast((ends, table.column("id").to_numpy(), _narrow(_matrix(table.column("features").combine_chunks()))))

        def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends, ids, y = data.value
            for b in it:
                group = b.column(1).to_numpy(zero_copy_only=False)
                order = np.argsort(group, kind="stable")
                asked, at = np.unique(group[order], return_index=True)
                for name, rows in zip(asked.tolist(), np.split(order, at[1:])):
                    if name in ends:
                        a, z = ends[name]
                        part = b.take(pa.array(rows))
                        yield from _emit(block_top(part.column(0).to_numpy(), _matrix(part.column(2)), ids[a:z], y[a:z].astype(np.float64), k, "euclidean"))

        return top(queries.mapInArrow(scan, schema), k)

    most = df.groupBy("group_id").count().agg(F.max("count")).first()[0]
    chunks = max(1, math.ceil(most * dim * 8 / (16 << 20)))

    def packed(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("group_id", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias(name)).agg(F.collect_list(F.struct("id", "features")).alias(name + "s"))

    both = packed(queries, "x").join(packed(df, "y"), "group_id").repartition("group_id", "x", "y").select("xs", "ys")

    def products(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                x, y = (b.column(c).slice(r, 1).flatten().flatten() for c in (0, 1))
                yield from _emit(block_top(x[0].to_numpy(), _matrix(x[1]), y[0].to_numpy(), _matrix(y[1]), k, "euclidean"))

    return top(both.mapInArrow(products, schema), k)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the row x to the rows of y, by difference."""
    return metrics.REGISTRY["euclidean"].block(x[None, :], y)


def squares(x: np.ndarray, y: np.ndarray, tolerance: float = 1e-10, exact_below: float | None = 1e-6) -> np.ndarray:
    """Squared euclidean distances of all rows of x to all of y, by matrix product seen from a row of y where its error is within ``tolerance``, else by difference; pairs nearer than the root of ``exact_below`` by difference always."""
    if x.shape[1] > 8 and len(y):
        u, v = x - y[0], y - y[0]
        uu, vv = (u * u).sum(1), (v * v).sum(1)
        if exact_below is None or (x.shape[1] + 8) * 2.0**-50 * (uu.max(initial=0) + vv.max()) <= tolerance:
            d = np.maximum(uu[:, None] + vv - 2 * (u @ v.T), 0)
            if exact_below is not None:
                i, j = np.nonzero(d < exact_below)
                d[i, j] = ((x[i] - y[j]) ** 2).sum(1)
            return d

    def step(acc, b, a, k, at, s, t):
        acc += np.multiply(np.subtract(b, a, out=s), s, out=t)

    return _tiles(x, np.ascontiguousarray(y.T), lambda m, at: np.zeros((m, at.stop - at.start)), step, 8, 2048)


def all_pairs(df: DataFrame, decimals: int | None = None, nearest: int | None = None) -> DataFrame:
    """``(i, j, d)``: the euclidean distances of all ordered pairs, a row to itself too, in batches of bounded size and without a shuffle of pairs.

    With ``nearest`` every row is compared with all rows all the same, but of each i
    only its so many nearest in a block (ties to the smaller j) leave the worker: all
    that ``precomputed`` can keep.
    """
    rounded = lambda d: d if decimals is None else np.floor(d * 10.0**decimals + 0.5) / 10.0**decimals
    if nearest is not None:
        metric = "euclidean" if decimals is None else lambda a, b: rounded(metrics.block("euclidean", a, b))
        return against_all(df, lambda x, y: _emit(block_top(*x, *y, nearest, metric)), "i long, j long, d double")

    def pairs(x: list, y: list) -> Iterator[pa.RecordBatch]:
        for c in range(0, len(y[0]), 512):  # short runs of j over many i: a written file then holds little more than the distances
            ids = pa.array(y[0][c : c + 512])
            across = np.ascontiguousarray(y[1][c : c + 512].T)
            for a in range(0, len(x[0]), 64):
                part = x[1][a : a + 64]
                d = np.zeros((len(part), len(ids)))
                for k in range(len(across)):
                    e = across[k] - part[:, k, None]
                    d += np.multiply(e, e, out=e)
                d = rounded(np.sqrt(d, out=d))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x[0][a : a + 64], len(ids))), pa.concat_arrays([ids] * len(part)), pa.array(d.ravel())], names=["i", "j", "d"])

    return against_all(df, pairs, "i long, j long, d double")


def tuning(n: int) -> tuple[int, int]:
    """Numbers of trees and of descent rounds for n rows."""
    return 5 + round(math.sqrt(n) / 20), max(5, round(math.log2(max(n, 2))))


# random-projection forest -------------------------------------------------------


def leaves(df: DataFrame, n_trees: int, leaf_size: int, angular: bool = False, seed: int = 42) -> DataFrame:
    """``(tree, leaf, id)``: all trees split level by level on the plane between two hash-picked members.

    A node stops at ``leaf_size``; one whose members the plane does not part is
    split by a hash, so depth stays logarithmic.
    """
    h = F.xxhash64(F.lit(seed), "tree", "node", "id")
    rows = stored(df.select("id", "features", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node")), "trees")
    n = df.count()
    done = None
    for level in range(min(62, 2 * math.ceil(math.log2(max(n / leaf_size, 2))) + 8)):
        nodes = rows.groupBy("tree", "node").agg(F.count("*").alias("n"), F.min_by("features", h).alias("p"), F.max_by("features", h).alias("q"))
        open_ = rows.join(nodes, ["tree", "node"])
        stop = open_.where(F.col("n") <= leaf_size).select("tree", F.col("node").alias("leaf"), "id")
        go = open_.where(F.col("n") > leaf_size)
        if angular:
            unit = lambda v: f"transform({v}, z -> z / greatest(sqrt(aggregate({v}, 0D, (s, t) -> s + t * t)), 1e-12D))"
            margin = F.expr(f"aggregate(zip_with(zip_with({unit('p')}, {unit('q')}, (a, b) -> a - b), features, (a, b) -> a * b), 0D, (s, t) -> s + t)")
        else:
            margin = F.expr("aggregate(zip_with(zip_with(p, q, (a, b) -> struct(a - b as n, (a + b) / 2 as m)), features, (a, x) -> a.n * (x - a.m)), 0D, (s, t) -> s + t)")
        coin = F.pmod(F.xxhash64(F.lit(seed + 1), "tree", "node", "id"), F.lit(2)).cast("long")
        side = F.when(F.abs(margin) < 1e-8, coin).when(margin > 0, 0).otherwise(1)
        rows = stored(go.select("id", "features", "tree", (F.col("node") * 2 + side).alias("node")), "trees")
        done = stop if done is None else done.union(stop)
        if not rows.limit(1).count():
            return stored(done, "leaves")
    return stored(done.union(rows.select("tree", F.col("node").alias("leaf"), "id")), "leaves")


# neighbour descent --------------------------------------------------------------


def measured(pairs: DataFrame, df: DataFrame, metric: str, **params) -> DataFrame:
    """Distances of ``pairs(i, j)``."""
    left, right = df.select(F.col("id").alias("i"), F.col("features").alias("x")), df.select(F.col("id").alias("j"), F.col("features").alias("y"))
    return pairs.join(left, "i").join(right, "j").select("i", "j", metrics.distance(metric, "x", "y", **params).alias("d"))


def random_pairs(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k pseudo-random partners of each row, by dealing rows into hash groups of k + 1; both directions."""
    n = df.count()
    groups = max(1, n // (k + 1))
    dealt = df.select("id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(groups)).alias("g"))
    return dealt.alias("a").join(dealt.alias("b"), "g").where("a.id <> b.id").select(F.col("a.id").alias("i"), F.col("b.id").alias("j"))


def leaf_pairs(leafed: DataFrame) -> DataFrame:
    """All ordered pairs inside the leaves, each once; leaves are bounded by ``leaf_size``."""
    a, b = leafed.select("tree", "leaf", F.col("id").alias("i")), leafed.select("tree", "leaf", F.col("id").alias("j"))
    return a.join(b, ["tree", "leaf"]).where("i <> j").select("i", "j").distinct()


def candidates(graph: DataFrame, most: int = 60, rho: float = 1.0, seed: int = 0) -> DataFrame:
    """``(p, c, new)``: of the edges and reversed edges of each p at most ``most`` new and ``most`` old ones, by random priority."""
    both = graph.select(F.col("i").alias("p"), F.col("j").alias("c"), "new").union(graph.select(F.col("j").alias("p"), F.col("i").alias("c"), "new"))
    both = both.groupBy("p", "c").agg(F.max("new").alias("new"))
    if rho < 1:
        both = both.where(F.pmod(F.xxhash64(F.lit(seed), "p", "c"), F.lit(1000)) < int(1000 * rho))
    by = Window.partitionBy("p", "new").orderBy(F.xxhash64(F.lit(seed + 1), "p", "c"), "c")
    return both.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).drop("r")


def descend(df: DataFrame, graph: DataFrame, k: int, metric: str, rounds: int, most: int = 60, delta: float = 0.001, low_memory: bool = False, **params) -> DataFrame:
    """Improves ``graph(i, j, d, new)`` by comparing neighbours of neighbours until at most ``delta * k * n`` entries change."""
    n = df.count()
    tried = graph.select("i", "j")
    for r in range(rounds):
        cand = stored(candidates(graph, most, seed=r), "candidates")
        a, b = cand.alias("a"), cand.alias("b")
        met = a.join(b, F.col("a.p") == F.col("b.p")).where("(a.new or b.new) and a.c < b.c").select(F.col("a.c").alias("i"), F.col("b.c").alias("j")).distinct()
        fresh = met.union(met.select(F.col("j").alias("i"), F.col("i").alias("j")))
        fresh = fresh.join((graph if low_memory else tried).select("i", "j"), ["i", "j"], "left_anti")
        scored = stored(measured(fresh, df, metric, **params), "scored")
        if not low_memory:
            tried = stored(tried.union(scored.select("i", "j")), "tried")
        old = graph.join(cand.where("new").select(F.col("p").alias("i"), F.col("c").alias("j"), F.lit(True).alias("used")), ["i", "j"], "left").select("i", "j", "d", (F.col("new") & F.col("used").isNull()).alias("new"))
        near = Window.partitionBy("i").orderBy("d", "j")
        merged = old.withColumn("is", F.lit(0)).union(scored.select("i", "j", "d", F.lit(True).alias("new"), F.lit(1).alias("is")))
        after = stored(merged.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("i", "j", "d", "new", "is"), "graph")
        changed = after.agg(F.sum("is")).first()[0] or 0
        graph = after.drop("is")
        if changed <= delta * k * n:
            break
    return graph


def approximate(df: DataFrame, k: int, metric: str = "euclidean", n_trees: int | None = None, rounds: int | None = None, low_memory: bool = False, seed: int = 42, **params) -> DataFrame:
    """Random pairs and forest leaves, improved by descent; a row itself comes first."""
    n = df.count()
    trees, its = tuning(n)
    pairs = random_pairs(df, k, seed)
    leafed = leaves(df, n_trees or trees, max(10, k), metrics.lookup(metric).angular, seed)
    pairs = pairs.union(leaf_pairs(leafed)).distinct()
    start = stored(top(measured(pairs, df, metric, **params), k).select("i", "j", "d", F.lit(True).alias("new")), "graph")
    graph = descend(df, start, k, metric, rounds or its, low_memory=low_memory, **params)
    own = df.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"))
    return top(graph.select("i", "j", "d").union(own), k)


def neighbours(df: DataFrame, k: int, metric: str = "euclidean", method: str = "auto", **params) -> DataFrame:
    """Exact up to ``EXACT_ROWS`` rows (``SCREENED_ROWS`` for some metrics), else approximate; ``precomputed`` takes ``(i, j, d)``."""
    if metric == "precomputed":
        return precomputed(df, k)
    most = SCREENED_ROWS if not callable(metric) and not params and metrics.lookup(metric).name in SCREENED else EXACT_ROWS
    if callable(metric) or method == "exact" or (method == "auto" and df.count() <= most):
        return exact(df, k, metric, **params)
    return approximate(df, k, metric, **params)


def search(queries: DataFrame, df: DataFrame, graph: DataFrame, k: int, metric: str = "euclidean", n_trees: int = 4, rounds: int = 20, seed: int = 42, **params) -> DataFrame:
    """The k nearest rows of ``df`` to new rows: joint forest leaves as a start, then the neighbours of the best found, until none changes."""
    shift = df.agg(F.max("id")).first()[0] or 0
    asked = queries.select((-1 - F.col("id")).alias("id"), "features")  # ids that no row has
    leafed = leaves(df.select("id", "features").where(F.col("id") >= 0).union(asked), n_trees, max(10, 2 * k), metrics.lookup(metric).angular, seed)
    q, x = leafed.where("id < 0").select("tree", "leaf", F.col("id").alias("i")), leafed.where("id >= 0").select("tree", "leaf", F.col("id").alias("j"))
    first = q.join(x, ["tree", "leaf"]).select("i", "j")
    spare = asked.select(F.col("id").alias("i"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda s: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), s), F.lit(shift + 1)))).alias("j"))
    both = df.select("id", "features").union(asked)
    found = stored(top(measured(first.union(spare).distinct(), both, metric, **params), k), "found")
    seen = found.select("i", "j")
    for _ in range(rounds):
        near = found.select("i", F.col("j").alias("p")).join(graph.select(F.col("i").alias("p"), "j"), "p").select("i", "j").distinct().join(seen, ["i", "j"], "left_anti")
        scored = stored(measured(near, both, metric, **params), "scored")
        if not scored.limit(1).count():
            break
        seen = stored(seen.union(scored.select("i", "j")), "seen")
        found = stored(top(found.select("i", "j", "d").union(scored), k), "found")
    return found.select((-1 - F.col("i")).alias("i"), "j", "d", "rank")


def short_rows(graph: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Rows with fewer than k neighbours."""
    have = graph.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("have"))
    return ids.select("id").join(have, "id", "left").select("id", F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < k)
