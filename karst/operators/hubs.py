"""In-degree order, disjoint groups of bounded size, and hubs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.session import stored

#: Bytes of vectors up to which groups are formed on the driver.
DRIVER_BYTES = 256 << 20


def indegree(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, degree)``: how often each id is a neighbour, itself included; 0 if never."""
    counts = graph.groupBy(F.col("j").alias("id")).agg(F.count("*").alias("degree"))
    return ids.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def missing(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that are nobody's neighbour."""
    return ids.select("id").join(graph.select(F.col("j").alias("id")), "id", "left_anti")


def order_keys(degrees: DataFrame) -> DataFrame:
    """Adds the sort keys of the in-degree order: most first and of equals the larger id first; unseen ids last, ascending."""
    seen = F.col("degree") > 0
    return degrees.select("id", "degree", (~seen).alias("unseen"), (-F.col("degree")).alias("by"), F.when(seen, -F.col("id")).otherwise(F.col("id")).alias("tie"))


def group_law(n: int, hub_num: int) -> tuple[int, int, int]:
    """(group size, full groups, all groups) for n rows: sizes are ceil(n / hub_num), the last group may be shorter."""
    size = -(-n // hub_num)
    return size, n // size, -(-n // size)


def greedy_groups(df: DataFrame, degrees: DataFrame, hub_num: int, driver_bytes: int = DRIVER_BYTES) -> DataFrame:
    """``(group_id, pos, id)``: the next unused id in order, with its nearest unused rows (squared euclidean).

    Each group depends on the earlier ones. Vectors within ``driver_bytes`` are
    grouped in numpy; beyond that each group is one distributed top-k over the
    rows left, at most ``hub_num`` of them.
    """
    n, dim = df.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    size, _, groups = group_law(n, hub_num)
    spark = df.sparkSession
    ordered = order_keys(degrees).orderBy("unseen", "by", "tie").select("id")
    if n * dim * 8 <= driver_bytes:
        order = ordered.toArrow().column(0).to_numpy()
        table = df.select("id", "features").orderBy("id").toArrow()
        ids = table.column("id").to_numpy()
        x = np.asarray(table.column("features").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        place = np.searchsorted(ids, order)
        free, members = np.ones(len(ids), bool), []
        for at in place:
            if not free[at]:
                continue
            free[at] = False
            left = np.flatnonzero(free)
            d = ((x[left] - x[at]) ** 2).sum(1)
            near = left[np.argsort(d, kind="stable")[: size - 1]]
            free[near] = False
            members.append(np.append(at, near))
        sizes = [len(m) for m in members]
        columns = [np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes] or [place]), ids[np.concatenate(members or [place])]]
        return spark.createDataFrame(pa.table(columns, ["group_id", "pos", "id"]), "group_id int, pos int, id long")
    left = stored(df.join(order_keys(degrees), "id").select("id", "features", "unseen", "by", "tie"), "ungrouped")
    taken = None
    for g in range(groups):
        head = left.orderBy("unseen", "by", "tie").select("id", "features").first()
        centre = F.array(*[F.lit(float(v)) for v in head.features])
        d = F.aggregate(F.zip_with("features", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)
        near = left.withColumn("d", F.when(F.col("id") == head.id, -1.0).otherwise(d)).orderBy("d", "id").limit(size)
        row = near.withColumn("pos", F.row_number().over(Window.orderBy("d", "id")) - 1)  # one group's rows
        group = stored(row.select(F.lit(g).alias("group_id"), F.col("pos").cast("int").alias("pos"), "id"), "group")
        taken = group if taken is None else taken.union(group)
        left = stored(left.join(group.select("id"), "id", "left_anti"), "ungrouped")
    return taken


def groups_from_graph(graph: DataFrame, degrees: DataFrame, hub_num: int) -> DataFrame:
    """As ``greedy_groups`` without vectors: a group is a breadth-first walk over neighbours, filled up in order."""
    spark = graph.sparkSession
    ids = [r.id for r in order_keys(degrees).orderBy("unseen", "by", "tie").select("id").collect()]
    size, _, _ = group_law(len(ids), hub_num)
    near: dict[int, list[int]] = {}
    for i, j in graph.orderBy("i", "rank").select("i", "j").toLocalIterator():
        near.setdefault(i, []).append(j)
    free, out = dict.fromkeys(ids), []
    g = 0
    while free:
        source = next(iter(free))
        queue, group = [source], [source]
        del free[source]
        while queue and len(group) < size:
            for j in near.get(queue.pop(0), ()):
                if j in free and len(group) < size:
                    del free[j]
                    group.append(j)
                    queue.append(j)
        for i in list(free)[: size - len(group)]:
            del free[i]
            group.append(i)
        out += [(g, p, i) for p, i in enumerate(group)]
        g += 1
    return spark.createDataFrame(out, "group_id int, pos int, id long")


def hubs(groups: DataFrame, popular: bool = True, seed: int = 42) -> DataFrame:
    """``(id, group_id)``: the first member of each group, or a hash-picked one."""
    if popular:
        return groups.where("pos = 0").select("id", "group_id")
    return groups.groupBy("group_id").agg(F.min_by("id", F.xxhash64(F.lit(seed), "id")).alias("id")).select("id", "group_id")


def distinct_rows(df: DataFrame) -> DataFrame:
    """``(features, first_id, n)`` of each distinct vector."""
    return df.groupBy("features").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
