"""The fuzzy neighbourhood graph: row scales, memberships, union with the transpose, sampling schedule."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE, FLOOR, ROUNDS = 1e-5, 1e-3, 64


def smooth(graph: DataFrame, k: int, local_connectivity: float = 1.0, bandwidth: float = 1.0) -> DataFrame:
    """``(i, rho, sigma)`` of each row of ``graph(i, j, d, rank)``.

    rho is the distance (interpolated) of the ``local_connectivity``-th distinct
    neighbour; sigma makes the memberships of ranks 2 to k sum to log2(k) times
    ``bandwidth``, found by bisection inside one expression.
    """
    rows = graph.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "d"))).alias("near"), F.sum("d").alias("total"), F.count("*").alias("n"))  # k each
    rows = rows.crossJoin(F.broadcast(graph.agg(F.avg("d").alias("overall"))))
    whole = int(math.floor(local_connectivity))
    part = local_connectivity - whole
    rows = rows.withColumn("ds", F.expr("transform(near, z -> z.d)")).withColumn("nz", F.expr("array_sort(filter(ds, z -> z > 0))"))
    if whole > 0:
        rho = F.expr(f"nz[{whole - 1}]")
        if part > TOLERANCE:
            rho = rho + part * (F.expr(f"coalesce(get(nz, {whole}), nz[{whole - 1}]) - nz[{whole - 1}]"))
    else:
        rho = part * F.expr("nz[0]")
    enough = F.size("nz") >= local_connectivity
    rows = rows.withColumn("rho", F.when(enough & (F.size("nz") > 0), rho).when(F.size("nz") > 0, F.array_max("nz")).otherwise(0.0))
    target = math.log2(k) * bandwidth
    total = "aggregate(slice(ds, 2, greatest(size(ds) - 1, 1)), 0D, (s, z) -> s + if(z - rho > 0, exp(-(z - rho) / a.mid), 1D))"
    bisected = F.expr(
        f"""aggregate(sequence(1, {ROUNDS}), struct(0D as lo, double('Infinity') as hi, 1D as mid, false as done), (a, i) ->
            if(a.done, a, transform(array({total}), p -> case
                when abs(p - {target!r}D) < {TOLERANCE!r}D then struct(a.lo as lo, a.hi as hi, a.mid as mid, true as done)
                when p > {target!r}D then struct(a.lo as lo, a.mid as hi, (a.lo + a.mid) / 2 as mid, false as done)
                when a.hi = double('Infinity') then struct(a.mid as lo, a.hi as hi, a.mid * 2 as mid, false as done)
                else struct(a.mid as lo, a.hi as hi, (a.mid + a.hi) / 2 as mid, false as done) end)[0])).mid"""
    )
    rows = rows.withColumn("raw", bisected)
    least = F.when(F.col("rho") > 0, FLOOR * F.col("total") / F.col("n")).otherwise(FLOOR * F.col("overall"))
    return rows.select("i", "rho", F.greatest("raw", least).alias("sigma"))


def memberships(graph: DataFrame, scales: DataFrame) -> DataFrame:
    """``(head, tail, weight)``: 1 up to rho, then falling exponentially; a row itself has 0."""
    w = F.when(F.col("i") == F.col("j"), 0.0).when((F.col("d") <= F.col("rho")) | (F.col("sigma") == 0), 1.0).otherwise(F.exp(-(F.col("d") - F.col("rho")) / F.col("sigma")))
    return graph.join(scales, "i").select(F.col("i").alias("head"), F.col("j").alias("tail"), w.alias("weight"))


def union(directed: DataFrame, mix: float = 1.0) -> DataFrame:
    """Both directions of each edge combined: ``mix`` of the probabilistic union and the rest of the product; zeros are dropped."""
    some = directed.where("weight <> 0")
    back = some.select(F.col("tail").alias("head"), F.col("head").alias("tail"), F.col("weight").alias("other"))
    a, b = F.coalesce("weight", F.lit(0.0)), F.coalesce("other", F.lit(0.0))
    w = mix * (a + b - a * b) + (1 - mix) * a * b
    return some.join(back, ["head", "tail"], "full").select("head", "tail", w.alias("weight")).where("weight <> 0")


def fuzzy_graph(graph: DataFrame, k: int, mix: float = 1.0, local_connectivity: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The symmetric graph, and the row scales."""
    scales = smooth(graph, k, local_connectivity)
    return union(memberships(graph, scales), mix), scales


def intersect(target: DataFrame, left: DataFrame, right: DataFrame, mix: float = 0.5) -> DataFrame:
    """Weights of ``target`` edges from two graphs, floors for absent ones; ``mix`` tilts the geometric mean."""
    floor = lambda g: g.agg(F.greatest(F.min("weight") / 2, F.lit(1e-8)).alias("least"))
    l_, r_ = left.select("head", "tail", F.col("weight").alias("lw")), right.select("head", "tail", F.col("weight").alias("rw"))
    rows = target.select("head", "tail", "weight").join(l_, ["head", "tail"], "left").join(r_, ["head", "tail"], "left")
    rows = rows.crossJoin(F.broadcast(floor(left).withColumnRenamed("least", "ll"))).crossJoin(F.broadcast(floor(right).withColumnRenamed("least", "rl")))
    a, b = F.coalesce("lw", "ll"), F.coalesce("rw", "rl")
    value = a * F.pow(b, F.lit(mix / (1 - mix))) if mix < 0.5 else F.pow(a, F.lit((1 - mix) / mix)) * b
    changed = (a > F.col("ll")) | (b > F.col("rl"))
    return rows.select("head", "tail", F.when(changed, value).otherwise(F.col("weight")).alias("weight"))


def epochs_per_sample(edges: DataFrame) -> DataFrame:
    """Adds ``eps``: largest weight over own weight, -1 for weights not above 0."""
    top = edges.agg(F.max("weight").alias("__top"))
    return edges.crossJoin(F.broadcast(top)).withColumn("eps", F.when(F.col("weight") > 0, F.col("__top") / F.col("weight")).otherwise(-1.0)).drop("__top")


def fires(eps: Column, epoch: Column | int) -> Column:
    """Whether an edge is used in an epoch: its running count of uses steps up; never in epoch 0."""
    n = F.lit(epoch) if isinstance(epoch, int) else epoch
    return (eps > 0) & (n >= 1) & (F.floor(n / eps) > F.floor((n - 1) / eps))


def negatives_until(eps: Column, epoch: Column | int, rate: float) -> Column:
    """Negative samples drawn up to and with an epoch."""
    n = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.greatest(F.lit(0), F.floor(n / (eps / rate)) - 1)


def negatives_at(eps: Column, epoch: Column | int, rate: float) -> Column:
    """Negative samples that an edge draws at an epoch in which it fires: those since it fired before."""
    n = F.lit(epoch) if isinstance(epoch, int) else epoch
    before = F.ceil((F.floor(n / eps) - 1) * eps)  # the epoch of the use before; 0 if none
    return negatives_until(eps, n, rate) - F.when(F.floor(n / eps) <= 1, F.lit(0)).otherwise(negatives_until(eps, before, rate))


def reweighted(edges: DataFrame, hubs: DataFrame, n_epochs: int) -> DataFrame:
    """Edges into hubs get weight 1, then edges out of hubs 0; those too light to be used in ``n_epochs`` are dropped."""
    into, out = hubs.select(F.col("id").alias("tail"), F.lit(True).alias("__into")), hubs.select(F.col("id").alias("head"), F.lit(True).alias("__out"))
    w = F.when(F.col("__out"), 0.0).when(F.col("__into"), 1.0).otherwise(F.col("weight"))
    rows = edges.join(into, "tail", "left").join(out, "head", "left").select("head", "tail", w.alias("weight"))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("weight").alias("__top")))).where((F.col("weight") > 0) & (F.col("weight") >= F.col("__top") / n_epochs)).drop("__top")


def fit_ab(spread: float = 1.0, min_dist: float = 0.1, rounds: int = 200) -> tuple[float, float]:
    """a, b of 1 / (1 + a x^2b) nearest to 1 up to ``min_dist`` and an exponential fall after it (damped least squares)."""
    x = np.linspace(0, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    log_x = np.log(np.where(x > 0, x, 1.0))

    def parts(p):
        power = np.where(x > 0, np.exp(2 * p[1] * log_x), 0.0)
        f = 1 / (1 + p[0] * power)
        return f - y, np.stack([-power * f * f, -2 * p[0] * power * log_x * f * f], 1)

    p, damp = np.array([1.0, 1.0]), 1e-3
    r, jac = parts(p)
    for _ in range(rounds):
        a = jac.T @ jac
        move = np.linalg.solve(a + damp * np.diag(np.diag(a)), -jac.T @ r)
        r2, jac2 = parts(p + move)
        if r2 @ r2 < r @ r:
            done = np.abs(move).max() < 1e-12
            p, r, jac, damp = p + move, r2, jac2, damp / 5
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    return float(p[0]), float(p[1])
