"""Layout of hubs, placement of other rows, and the edge-sampled local optimisation.

Hubs are few (``MAX_HUBS``) and laid out in numpy on the driver. Everything that
grows with the rows is a DataFrame. The local phase runs on the driver while the
edges fit ``DRIVER_EDGES`` and as joins beyond that; both follow one schedule
and one counter-based stream of negative samples, and give the same layout up to
the order of floating-point sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.operators import fuzzy, knn
from karst.session import discard, stored

MAX_HUBS, DRIVER_EDGES = 5_000, 4_000_000
#: Rows of ids and positions that are sent to every task.
BROADCAST_IDS = 500_000


def _squares(x: np.ndarray) -> np.ndarray:
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) if x.shape[0] * x.shape[0] * x.shape[1] < 5e7 else np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T)
    np.fill_diagonal(d, 0)
    return d


def _scaled(z: np.ndarray) -> np.ndarray:
    """Divided by the largest value, or the largest magnitude where no value is positive."""
    top = z.max() if z.max() > 0 else np.abs(z).max()
    return z / top if top > 0 else z


def init_hubs(x: np.ndarray, dims: int, kind: str | np.ndarray, seed: int = 42, k: int = 15) -> np.ndarray:
    if isinstance(kind, np.ndarray):
        return _scaled(kind.astype(float))
    if kind == "random":
        return _scaled(np.random.default_rng(seed).normal(0, 0.05, (len(x), dims)))
    if kind == "pca":
        _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        vt = vt[:dims] * np.sign(vt[np.arange(min(dims, len(vt))), np.abs(vt[:dims]).argmax(1)])[:, None]
        z = (x - x.mean(0)) @ vt.T
        return _scaled(np.pad(z, ((0, 0), (0, dims - z.shape[1]))))
    if kind == "spectral":
        d = _squares(x)
        near = np.argsort(d, axis=1, kind="stable")[:, 1 : min(k, len(x) - 1) + 1]
        a = np.zeros_like(d)
        np.put_along_axis(a, near, 1.0, 1)
        a = (a + a.T) / 2
        root = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
        _, v = np.linalg.eigh(np.eye(len(a)) - root[:, None] * a * root)
        v = v[:, 1 : dims + 1]
        return v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])]) * root[:, None]
    raise ValueError("init must be 'pca', 'random', 'spectral' or an array")


def optimise_hubs(p: np.ndarray, z: np.ndarray, a: float, b: float, rate: float, epochs: int) -> np.ndarray:
    """Gradient steps of the hub layout against their scaled distances p."""
    for _ in range(epochs):
        d = _squares(z)
        s = 1 / (0.001 + d)
        np.fill_diagonal(s, 0)
        q = (1 - p) @ s
        q = q / q.sum(1, keepdims=True)
        coef = 2 * a * b * p * (1e-12 + d) ** (b - 1) - 2 * b * q
        coef = coef / (1 + a * d**b)
        z = z - rate * (coef.sum(1)[:, None] * z - coef @ z)
    return z


def cross_entropy(p: np.ndarray, z: np.ndarray, a: float, b: float) -> float:
    """Loss of a hub layout (its rows scaled to unit sum of magnitudes)."""
    q = 1 / (1 + a * _squares(z / np.maximum(np.abs(z).sum(1, keepdims=True), 1e-12)) ** b)
    return float((-p * np.log(q + 0.001) - (1 - p) * np.log(1 - q + 0.001)).sum() / 1e5)


def hub_layout(hub_rows: DataFrame, dims: int, init, a: float, b: float, rate: float, epochs: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) of ``hub_rows(id, features)``."""
    table = hub_rows.select("id", "features").orderBy("id").toArrow()
    if table.num_rows > MAX_HUBS:
        raise ValueError(f"{table.num_rows} hubs; at most {MAX_HUBS}")
    ids = table.column("id").to_numpy()
    x = np.asarray(table.column("features").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
    p = np.sqrt(_squares(x))
    p = p / p.max() if p.max() > 0 else p
    if isinstance(init, DataFrame):
        init = np.array([r.init for r in init.join(F.broadcast(hub_rows.select("id")), "id").orderBy("id").select("init").collect()], float)
    return ids, optimise_hubs(p, init_hubs(x, dims, init, seed), a, b, rate, epochs)


def noise(seed: int, dims: int, scale: float, *keys: str) -> Column:
    """An array of normal values that depend on seed and keys alone."""
    def uniform(i):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *keys), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    return F.array(*[scale * F.sqrt(-2 * F.log(uniform(2 * c))) * F.cos(2 * np.pi * uniform(2 * c + 1)) for c in range(dims)])


def _fold(values: Column, dims: int, how=F.sum) -> list[Column]:
    return [how(values[c]).alias(f"c{c}") for c in range(dims)]


def init_from_hubs(df: DataFrame, hub_rows: DataFrame, positions: DataFrame, dims: int, most: int = 10, spread: float = 0.05, seed: int = 42) -> DataFrame:
    """``(id, pos)`` of rows that are no hubs: the layouts of the ``most`` nearest hubs and noise, summed and divided by one less than their number."""
    hubs = hub_rows.select(F.col("id").alias("hub"), F.col("features").alias("h")).join(positions.select(F.col("id").alias("hub"), "pos"), "hub")
    d = F.aggregate(F.zip_with("features", "h", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)
    others = df.join(hub_rows.select("id"), "id", "left_anti")
    near = Window.partitionBy("id").orderBy("d", "hub")
    kept = others.crossJoin(F.broadcast(hubs)).select("id", "hub", "pos", d.alias("d")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= most)  # at most MAX_HUBS hubs
    sums = kept.groupBy("id").agg(F.count("*").alias("n"), *_fold(F.col("pos"), dims))
    e = noise(seed, dims, spread, "id") if spread else F.array(*[F.lit(0.0)] * dims)
    return sums.select("id", F.array(*[(F.col(f"c{c}") + e[c]) / F.greatest(F.col("n") - 1, F.lit(1)) for c in range(dims)]).alias("pos"))


def init_from_graph(ids: DataFrame, graph: DataFrame, positions: DataFrame, dims: int, spread: float = 0.05, seed: int = 42) -> DataFrame:
    """As above from hubs among a row's own neighbours, weighted by inverse distance; without any, the mean of up to 10 hash-picked hubs."""
    near = graph.join(positions.select(F.col("id").alias("j"), "pos"), "j").withColumn("w", 1 / (F.col("d") + 1e-6))
    own = near.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col("pos")[c]).alias(f"c{c}") for c in range(dims)])
    some = positions.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(10).agg(*[F.avg(F.col("pos")[c]).alias(f"m{c}") for c in range(dims)])
    rows = ids.select("id").join(positions.select("id"), "id", "left_anti").join(own, "id", "left").crossJoin(F.broadcast(some))
    e = noise(seed, dims, spread, "id") if spread else F.array(*[F.lit(0.0)] * dims)
    return rows.select("id", F.array(*[F.coalesce(F.col(f"c{c}") / F.col("w"), F.col(f"m{c}")) + e[c] for c in range(dims)]).alias("pos"))


def minmax(positions: DataFrame, dims: int, top: float = 10.0) -> DataFrame:
    """Each dimension scaled to 0..top; a dimension without range becomes top / 2."""
    ends = positions.agg(*_fold(F.col("pos"), dims, F.min), *[F.max(F.col("pos")[c]).alias(f"h{c}") for c in range(dims)])
    value = lambda c: F.when(F.col(f"h{c}") > F.col(f"c{c}"), top * (F.col("pos")[c] - F.col(f"c{c}")) / (F.col(f"h{c}") - F.col(f"c{c}"))).otherwise(top / 2)
    return positions.crossJoin(F.broadcast(ends)).select("id", F.array(*[value(c) for c in range(dims)]).alias("pos"))


def nearest_gap(positions: DataFrame) -> float:
    """Mean distance of a row to its nearest other row in the layout."""
    near = knn.neighbours(positions.select("id", F.col("pos").alias("features")), 3)
    other = near.where("i <> j").groupBy("i").agg(F.min("d").alias("d"))
    return float(other.agg(F.avg("d")).first()[0] or 0)


def jittered(positions: DataFrame, dims: int, seed: int = 42) -> DataFrame:
    """Where rows share a position, all get noise of a thousandth of ``nearest_gap``."""
    if not positions.groupBy("pos").count().where("count > 1").limit(1).count():
        return positions
    e = noise(seed, dims, 0.001 * nearest_gap(stored(positions, "layout")), "id")
    return positions.select("id", F.zip_with("pos", e, lambda a, b: a + b).alias("pos"))


def principal_axes(df: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) of a whole table: products summed by partition, the eigenproblem on the driver; signs as in ``init_hubs``."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, 0.0, 0.0
        for b in it:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1)
                n, total, product = n + len(x), total + x.sum(0), product + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tolist()], "product": [product.ravel().tolist()]})

    parts = df.select("features").mapInArrow(partial, "n long, total array<double>, product array<double>").collect()  # d x d numbers a partition
    n = sum(r.n for r in parts)
    mean = np.sum([r.total for r in parts], axis=0) / n
    cov = np.sum([r.product for r in parts], axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)
    _, v = np.linalg.eigh(cov)
    v = v[:, ::-1][:, :dims].T
    return mean, v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def init_position(df: DataFrame, kind: str, dims: int = 2, spread: float = 0.1, seed: int = 42) -> DataFrame:
    """A layout of a whole table, less its mean and divided by its largest value: ``pca``, ``random``, or ``class`` (quadrants by label)."""
    if kind == "pca":
        mean, axes = principal_axes(df, dims)
        lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
        centred = F.zip_with("features", lit(mean), lambda x, m: x - m)
        pos = F.array(*[F.aggregate(F.zip_with(centred, lit(a), lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t) for a in axes])
    elif kind == "random":
        pos = noise(seed, dims, 0.05, "id")
    elif kind == "class":
        side = lambda first: F.when(F.pmod("label", F.lit(4)).isin(first), -1.5).otherwise(1.5) * F.col("label")
        e = noise(seed, 2, spread, "id") if spread else F.array(F.lit(0.0), F.lit(0.0))
        pos = F.array(side([0, 3]) + e[0], side([0, 1]) + e[1])
    else:
        raise ValueError("kind must be 'pca', 'random' or 'class'")
    rows = df.select("id", pos.alias("pos"))
    flat = rows.select(F.explode("pos").alias("v")).agg(F.avg("v").alias("mean"), F.max("v").alias("most"))
    return rows.crossJoin(F.broadcast(flat)).select("id", F.transform("pos", lambda v: (v - F.col("mean")) / F.col("most")).alias("pos"))


# local phase --------------------------------------------------------------------

_M = 2147483647


def draw(seed: int, head, tail, epoch, p, n):
    """The p-th negative of an edge at an epoch: an index below n. Small integer arithmetic, alike in numpy and in Spark."""
    h = (head % _M * 40014 + tail % _M * 40692 + epoch * 69621 + p * 16807 + seed % 1000003) % _M
    h = (h * 48271) % _M
    h = (h * 69621) % _M
    return (h * 39373) % _M % n


def rate_at(rate: float, epoch: int, epochs: int) -> float:
    """The full rate in epochs 0 and 1, then falling in a line."""
    return rate if epoch == 0 else rate * (1 - (epoch - 1) / epochs)


def optimise_rows(edges: tuple[np.ndarray, np.ndarray, np.ndarray], pos: np.ndarray, hub: np.ndarray, a: float, b: float, rate: float, epochs: int, negatives: float, gamma: float, batches: int, seed: int) -> np.ndarray:
    """edges: (head, tail, eps) as places in ``pos``. Sub-batches of an epoch see the moves of those before."""
    head, tail, eps = edges
    batch = draw(seed, head, tail, 0, 0, batches)
    for n in range(1, epochs):
        alpha = rate_at(rate, n, epochs)
        use = np.floor(n / eps) > np.floor((n - 1) / eps)
        count = np.floor(n / eps)
        until = lambda at: np.maximum(0, np.floor(at / (eps / negatives)) - 1)
        m = (until(n) - np.where(count <= 1, 0, until(np.ceil((count - 1) * eps)))).astype(int)
        for k in range(batches):
            e = np.flatnonzero(use & (batch == k))
            if not len(e):
                continue
            h, t = head[e], tail[e]
            diff = pos[h] - pos[t]
            s = (diff * diff).sum(1)
            with np.errstate(divide="ignore"):
                c = np.where(s > 0, -2 * a * b * np.power(np.where(s > 0, s, 1.0), b - 1) / (a * np.power(s, b) + 1), 0.0)
            g = np.clip(c[:, None] * diff, -10, 10) * alpha
            move = np.zeros_like(pos)
            np.add.at(move, h, g)
            np.add.at(move, t, -g * np.where(hub[t], gamma, 1.0)[:, None])
            i = np.repeat(np.arange(len(e)), m[e])
            p = np.arange(len(i)) - np.repeat(np.cumsum(m[e]) - m[e], m[e])
            other = draw(seed, h[i], t[i], n, p + 1, len(pos))
            diff = pos[h[i]] - pos[other]
            s = (diff * diff).sum(1)
            c = 2 * b / ((0.001 + s) * (a * np.power(s, b) + 1))
            g = np.where((s > 0)[:, None], np.clip(c[:, None] * diff, -10, 10), 10.0) * (other != h[i])[:, None]
            np.add.at(move, h[i], alpha * gamma * g)
            pos = pos + move
    return pos


def _epoch(edges: DataFrame, pos: DataFrame, dims: int, n: int, k: int, size: int, a: float, b: float, alpha: float, negatives: float, gamma: float, seed: int) -> DataFrame:
    """One sub-batch as joins: moves of heads, tails and the repelled heads, summed by row."""
    use = edges.where(fuzzy.fires(F.col("eps"), n) & (F.col("batch") == k))
    at = lambda name: pos.select(F.col("place").alias(name), F.col("pos").alias(f"{name}_pos"), F.col("hub").alias(f"{name}_hub"))
    clip = lambda c: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), c))
    square = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, t: s + t)
    near = use.join(at("head"), "head").join(at("tail"), "tail").withColumn("s", square("head_pos", "tail_pos"))
    c = F.when(F.col("s") > 0, -2 * a * b * F.pow("s", F.lit(b - 1)) / (a * F.pow("s", F.lit(b)) + 1)).otherwise(0.0)
    g = F.zip_with("head_pos", "tail_pos", lambda x, y: alpha * clip(F.col("c") * (x - y)))
    pulled = near.withColumn("c", c).withColumn("g", g)
    pull = pulled.select(F.col("head").alias("place"), "g")
    back = pulled.select(F.col("tail").alias("place"), F.transform("g", lambda x: -x * F.when(F.col("tail_hub"), gamma).otherwise(1.0)).alias("g"))
    m = fuzzy.negatives_at(F.col("eps"), n, negatives).cast("int")
    drawn = use.withColumn("m", m).where("m > 0").withColumn("p", F.explode(F.sequence(F.lit(1), F.col("m"))))
    drawn = drawn.withColumn("other", draw(seed, F.col("head").cast("long"), F.col("tail").cast("long"), F.lit(n).cast("long"), F.col("p").cast("long"), F.lit(size).cast("long"))).where("other <> head")
    far = drawn.join(at("head"), "head").join(at("other"), "other").withColumn("s", square("head_pos", "other_pos"))
    far = far.withColumn("c", 2 * b / ((0.001 + F.col("s")) * (a * F.pow("s", F.lit(b)) + 1)))
    push = far.select(F.col("head").alias("place"), F.zip_with("head_pos", "other_pos", lambda x, y: alpha * gamma * F.when(F.col("s") > 0, clip(F.col("c") * (x - y))).otherwise(10.0)).alias("g"))
    moves = pull.union(back).union(push).groupBy("place").agg(*_fold(F.col("g"), dims))
    moved = pos.join(moves, "place", "left")
    return moved.select("place", "id", "hub", F.array(*[F.col("pos")[c] + F.coalesce(F.col(f"c{c}"), F.lit(0.0)) for c in range(dims)]).alias("pos"))


def optimise_local(edges: DataFrame, positions: DataFrame, hubs: DataFrame, a: float, b: float, rate: float, epochs: int, negatives: float = 5, gamma: float = 0.1, mode: str = "deterministic", seed: int = 42, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """``(id, pos)`` after the local phase over ``edges(head, tail, weight)``; ``fast`` moves once an epoch, ``deterministic`` in eight sub-batches."""
    batches = 1 if mode == "fast" else 8
    dims = len(positions.first().pos)
    placed = stored(
        positions.join(hubs.select("id", F.lit(True).alias("hub")), "id", "left").select("id", "pos", F.coalesce("hub", F.lit(False)).alias("hub")).withColumn("place", F.row_number().over(Window.orderBy("id")) - 1)
        if positions.count() <= driver_edges
        else _dense_places(positions.join(hubs.select("id", F.lit(True).alias("hub")), "id", "left").select("id", "pos", F.coalesce("hub", F.lit(False)).alias("hub"))),
        "places",
    )
    place = placed.select("id", F.col("place").cast("long").alias("place"))
    named = fuzzy.epochs_per_sample(edges).join(place.withColumnsRenamed({"id": "head", "place": "h"}), "head").join(place.withColumnsRenamed({"id": "tail", "place": "t"}), "tail")
    named = stored(named.select(F.col("h").alias("head"), F.col("t").alias("tail"), "eps"), "edges")
    size = placed.count()
    if named.count() <= driver_edges:
        e = named.orderBy("head", "tail").toArrow()
        rows = placed.orderBy("place").select("id", "pos", "hub").toArrow()
        discard(named)
        discard(placed)
        pos = np.asarray(rows.column("pos").combine_chunks().flatten(), float).reshape(size, dims)
        pos = optimise_rows(tuple(c.to_numpy() for c in e.columns), pos, rows.column("hub").to_numpy(), a, b, rate, epochs, negatives, gamma, batches, seed)
        flat = pa.ListArray.from_arrays(np.arange(0, pos.size + 1, dims, dtype=np.int32), pos.ravel())
        return positions.sparkSession.createDataFrame(pa.table({"id": rows.column("id"), "pos": flat}), "id long, pos array<double>")
    first, named = named, stored(named.withColumn("batch", draw(seed, F.col("head"), F.col("tail"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(batches).cast("long"))), "edges")
    discard(first)
    now = placed.select(F.col("place").cast("long").alias("place"), "id", "hub", "pos")
    for n in range(1, epochs):
        for k in range(batches):
            before, now = now, stored(_epoch(named, now, dims, n, k, size, a, b, rate_at(rate, n, epochs), negatives, gamma, seed), "layout")
            discard(before)
    discard(named)
    return now.select("id", "pos")


def _dense_places(rows: DataFrame) -> DataFrame:
    """Places 0 .. n - 1 in id order by prefix sums over sorted partitions."""
    part = stored(rows.orderBy("id").withColumn("part", F.spark_partition_id()), "sorted")
    base = part.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return part.withColumn("inside", inside).join(F.broadcast(base), "part").select("id", "pos", "hub", (F.col("base") + F.col("inside") - 1).alias("place"))


# outliers -----------------------------------------------------------------------


def place_outliers(df: DataFrame, groups: DataFrame, role: DataFrame, positions: DataFrame, dims: int, k: int) -> DataFrame:
    """``(id, pos)`` of outliers: the mean layout of the at most k nearest members of their own group."""
    named = groups.select("id", "group_id").join(role, "id")
    named = named.join(named.where("role = 0").select("group_id").distinct(), "group_id", "left_semi").join(positions, "id", "left")
    named = stored(named.where("role = 0 or pos is not null").select("id", "group_id", "role", "pos"), "named")
    named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    rows = df.join(named.select("id", "group_id", "role"), "id")  # the vectors stay where they are
    near = knn.in_groups(rows.where("role > 0"), rows.where("role = 0"), k)
    kept = near.join(named.select(F.col("id").alias("j"), "pos"), "j")
    return kept.groupBy(F.col("i").alias("id")).agg(*_fold(F.col("pos"), dims, F.avg)).select("id", F.array(*[F.col(f"c{c}") for c in range(dims)]).alias("pos"))


def place_outliers_by_graph(graph: DataFrame, role: DataFrame, positions: DataFrame, dims: int, passes: int = 10, spread: float = 0.02, seed: int = 42) -> DataFrame:
    """As above over neighbour edges: passes of the mean of placed neighbours, the rest at the mean of all; noise added."""
    left = stored(role.where("role = 0").select("id"), "outliers")
    placed, new = positions, None
    for n in range(passes):
        means = graph.join(left.select(F.col("id").alias("i")), "i", "left_semi").join(placed.select(F.col("id").alias("j"), "pos"), "j").groupBy(F.col("i").alias("id")).agg(*_fold(F.col("pos"), dims, F.avg))
        e = noise(seed + n, dims, spread, "id") if spread else F.array(*[F.lit(0.0)] * dims)
        got = stored(means.select("id", F.array(*[F.col(f"c{c}") + e[c] for c in range(dims)]).alias("pos")), "outliers")
        if not got.limit(1).count():
            break
        new = got if new is None else new.union(got)
        placed = placed.union(got)
        left = stored(left.join(got.select("id"), "id", "left_anti"), "outliers")
    centre = placed.agg(*_fold(F.col("pos"), dims, F.avg))
    e = noise(seed + passes, dims, spread, "id") if spread else F.array(*[F.lit(0.0)] * dims)
    rest = left.crossJoin(F.broadcast(centre)).select("id", F.array(*[F.col(f"c{c}") + e[c] for c in range(dims)]).alias("pos"))
    return rest if new is None else new.union(rest)
