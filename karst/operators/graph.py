"""Closure, roles, and selection of neighbour edges; all by equi-joins on ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.operators.knn import measured, top
from karst.session import stored

HUB, REACHED, OUTLIER = 2, 1, 0
#: Edges that are walked on the driver.
DRIVER_EDGES = 4_000_000
#: Rounds after which what is known is written as one table, so that plans stay short.
ROUNDS_KEPT = 16


def step(frontier: DataFrame, known: DataFrame, graph: DataFrame) -> DataFrame:
    """Ids one edge away from ``frontier(id)`` that are not in ``known(id)``."""
    return graph.join(frontier.select(F.col("id").alias("i")), "i", "left_semi").select(F.col("j").alias("id")).distinct().join(known, "id", "left_anti")


def _walk(start: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rounds) of what is reached from ``start`` along head -> tail."""
    ids, places = np.unique(np.concatenate([start, head, tail]), return_inverse=True)
    first, head, tail = np.split(places, [len(start), len(start) + len(head)])
    tail = tail[np.argsort(head, kind="stable")]
    n_out = np.bincount(head, minlength=len(ids))
    begin = np.cumsum(n_out) - n_out
    round_ = np.full(len(ids), -1, np.int32)
    round_[first] = n = 0
    frontier = np.unique(first)
    while len(frontier):
        n, many = n + 1, n_out[frontier]
        met = np.unique(tail[np.repeat(begin[frontier] - np.cumsum(many) + many, many) + np.arange(many.sum())])
        frontier = met[round_[met] < 0]
        round_[frontier] = n
    return ids[round_ >= 0], round_[round_ >= 0]


def closure(start: DataFrame, graph: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """``(id, round)``: all ids reachable from ``start(id)`` along i -> j, with the round that met them.

    Three neighbours a row take hundreds of rounds, so up to ``driver_edges`` edges
    are walked in numpy on the driver; beyond that a round joins only its frontier.
    """
    edges = graph.select("i", "j").where("i is not null and j is not null")
    if edges.count() <= driver_edges:
        pairs, first = edges.toArrow(), start.select("id").where("id is not null").toArrow().column(0)
        ids, rounds = _walk(first.to_numpy(), *(c.to_numpy() for c in pairs.columns))
        return start.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, first.type), "round": pa.array(rounds, pa.int32())}))
    known = frontier = stored(start.select("id", F.lit(0).alias("round")).distinct(), "closure")
    n = 0
    while True:
        n += 1
        frontier = stored(step(frontier, known.select("id"), graph).withColumn("round", F.lit(n)), "closure")
        if not frontier.limit(1).count():
            return known
        known = known.union(frontier)
        if n % ROUNDS_KEPT == 0:
            known = stored(known, "closure")


def roles(ids: DataFrame, hubs: DataFrame, reached: DataFrame) -> DataFrame:
    """``(id, role)``: 2 for hubs, 1 for other reached ids, 0 for the rest."""
    h, r = hubs.select("id", F.lit(True).alias("hub")), reached.select("id", F.lit(True).alias("met")).distinct()
    role = F.when(F.col("hub"), HUB).when(F.col("met"), REACHED).otherwise(OUTLIER)
    return ids.select("id").join(h, "id", "left").join(r, "id", "left").select("id", role.cast("byte").alias("role"))


def members(role: DataFrame) -> DataFrame:
    return role.where(F.col("role") > OUTLIER).select("id")


def select_edges(graph: DataFrame, member: DataFrame, k: int) -> DataFrame:
    """Edges between members, ranked anew, at most k of each."""
    kept = graph.join(member.select(F.col("id").alias("i")), "i", "left_semi").join(member.select(F.col("id").alias("j")), "j", "left_semi")
    by = Window.partitionBy("i").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("i", "j", "d", "rank")


def shortfall(edges: DataFrame, member: DataFrame, k: int) -> DataFrame:
    """Members with fewer than k edges: ``(id, have)``."""
    have = edges.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("have"))
    return member.select("id").join(have, "id", "left").select("id", F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < k)


def top_up(edges: DataFrame, member: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """Fills short rows with the nearest neighbours of their neighbours; rows that stay short raise."""
    short = shortfall(edges, member, k).select(F.col("id").alias("i"))
    mine = edges.join(short, "i", "left_semi")
    via = mine.select("i", F.col("j").alias("p")).join(edges.select(F.col("i").alias("p"), "j"), "p").select("i", "j").distinct()
    new = via.where("i <> j").join(mine.select("i", "j"), ["i", "j"], "left_anti")
    filled = stored(top(edges.select("i", "j", "d").union(measured(new, df, "euclidean")), k), "edges")
    if shortfall(filled, member, k).limit(1).count():
        raise ValueError("some rows have too few neighbours among neighbours of neighbours")
    return filled


def refill(edges: DataFrame, source: DataFrame, member: DataFrame, k: int) -> DataFrame:
    """Fills short rows from the full neighbour table in its order, whatever the role of the neighbour."""
    short = shortfall(edges, member, k).select(F.col("id").alias("i"))
    more = source.join(short, "i", "left_semi").join(edges.select("i", "j"), ["i", "j"], "left_anti")
    both = edges.select("i", "j", "d", "rank", F.lit(0).alias("late")).union(more.select("i", "j", "d", "rank", F.lit(1).alias("late")))
    by = Window.partitionBy("i").orderBy("late", "rank")
    kept = both.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k)
    return top(kept.select("i", "j", "d"), k)
