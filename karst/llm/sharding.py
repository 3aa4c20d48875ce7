"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters whole records into buckets by a seeded hash; a bucket is sized
to fit in a task's memory and is one partition, whose number it is. Pass two
sorts a bucket by 128 bits of hash, a total order, and shuffles it by
Fisher-Yates (the built-in ``shuffle``, which draws from a stream of its own for
each partition number), so slots are a function of the rows and the seed: a task
that runs again, or a table read in other pieces, deals the same ones. Bucket
sizes are counted beforehand, and their running sum gives each bucket the global
rank of its first record, so record r of the permutation lands in shard
``r % n`` at slot ``r // n``: counts differ by at most one and slots have no
gaps, with no second shuffle.

Rows equal in every column would share a bucket. Where there are more than
``REPEATS`` of a row, they are counted before anything moves, dealt out anew in
pieces, and each copy's number goes into its hash, so copies scatter like any
other rows.

Defined cases: a null text has no bytes (size 16, crc32 0); null ids and repeated
rows are records like any other (which of equal rows gets which slot is not
observable); an empty table gives no rows; further columns, whatever their names
and types, are carried along inside one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.llm.common import documents, hashable

#: Buckets at most, each a task of the second pass.
MAX_BUCKETS = 1 << 18
#: Copies of a row that may share a bucket, and copies that a task deals out at once.
REPEATS, PIECE = 256, 1 << 14


def _tickets(df: DataFrame, seed: int) -> DataFrame:
    """``(record, ticket, twin)``: the row and 128 bits of its hash, with the copy's number for rows that repeat very often."""
    columns = hashable(df)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), F.xxhash64(F.lit(seed), *columns).alias("ticket"), F.xxhash64(F.lit(seed + 1), *columns).alias("twin"))
    often = rows.groupBy("ticket", "twin").agg(F.count("*").alias("n")).where(F.col("n") > REPEATS)
    if not often.limit(1).count():
        return rows
    mark = ["ticket", "twin"]
    few = rows.join(often.select(*mark), mark, "left_anti").select("record", *mark)
    copies = rows.join(often.select(*mark), mark, "left_semi").groupBy(*mark).agg(F.first("record").alias("record"), F.count("*").alias("n"))
    pieces = copies.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {PIECE})")).alias("piece")).repartition(*mark, "piece")
    dealt = pieces.select("record", *mark, F.explode(F.expr(f"sequence(piece * {PIECE}, least(n, (piece + 1) * {PIECE}) - 1)")).alias("copy"))
    return few.union(dealt.select("record", F.xxhash64("ticket", "copy").alias("ticket"), F.xxhash64("twin", "copy").alias("twin")))


def external_shuffle(df: DataFrame, n_shards: int, size: str = "1", seed: int = 42, bucket_bytes: int = 8 << 20) -> DataFrame:
    """``(record struct<all columns of df>, shard int, slot long)`` under the law ``rows``.

    ``size`` is a SQL expression over ``df`` for the bytes of a record.
    """
    total = df.agg(F.sum(F.expr(size).cast("long"))).first()[0] or 0
    n = max(1, min(MAX_BUCKETS, -(-total // bucket_bytes)))
    scattered = _tickets(df, seed).withColumn("bucket", F.pmod("ticket", F.lit(n)).cast("int"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    bases = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # MAX_BUCKETS rows at most
    return (
        scattered.repartitionById(n, "bucket")
        .sortWithinPartitions("ticket", "twin")
        .groupBy("bucket")
        .agg(F.collect_list("record").alias("records"))
        .select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
        .join(F.broadcast(bases), "bucket")
        .select("base", F.posexplode("records"))
        .select(
            F.col("col").alias("record"),
            F.expr(f"cast((base + pos) % {n_shards} as int)").alias("shard"),
            F.expr(f"(base + pos) div {n_shards}").alias("slot"),
        )
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder ``shard=k`` of Parquet files for each shard, each file in slot order."""
    shuffled.select("record.*", "shard", "slot").repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = external_shuffle(documents(spark, sf_dir), 40, "coalesce(octet_length(text), 0) + 16")
    return dealt.select(
        "record.doc_id",
        F.expr("cast(coalesce(octet_length(record.text), 0) + 16 as long)").alias("size"),
        F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
