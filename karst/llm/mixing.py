"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Documents fall into hash-permuted blocks, at most ``BLOCKS`` for each source. A
source whose target is e times its size and a remainder is drawn in e whole
passes and part of one more, which ends inside one block, at one document, at
an exact word. The (pass, block) pairs drawn of each source are its quota; a
binary tree over the output shards splits all quotas exactly, each node drawing
how many go left from the multivariate hypergeometric law. Ranges of the
permuted pairs then belong to shards, disjoint by construction, and each shard
is put in hash order. A document's words come from its block's draws alone.

The tree stands on ``STRATA`` strata of sources (sources by rank modulo that
number, so a source each as long as there are fewer): the pairs of a stratum are
permuted together, which gives its sources the same law as a leaf each. Only the
strata's quotas reach the driver, and the level of the water-filling, two
numbers a round. Sources and blocks are tables, joined by broadcast up to
``BROADCAST_ROWS`` rows and else by shuffle; documents are not shuffled until a
mixture is written out.

Defined cases: null and blank texts have size 0, are drawn as often as their
block and take 0 words; a source without words is drawn once; the null source is
a source of its own, sorted last; an empty table gives no rows; rows equal in
source, id and text are cut alike, each by an equal whole share, so the cut may
end up to a word short for each such copy. Results depend on rows and seed only.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.llm.common import WORD_PATTERN, documents, stored

#: Blocks of a source, finer parts of the block a cut lies in, and strata of the tree.
BLOCKS, PARTS, STRATA = 256, 4096, 1024
#: Rows of a table of sources or blocks, some hundred bytes each, up to which it is broadcast.
BROADCAST_ROWS = 100_000


def split_quotas(quotas: np.ndarray, shards: int, seed: int, node: int = 1) -> list[np.ndarray]:
    """Exact quotas for each shard; shards differ by at most one block for each level of the tree."""
    if shards == 1:
        return [quotas]
    left = shards // 2
    draw = np.random.default_rng([seed, node]).multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return split_quotas(draw, left, seed, 2 * node) + split_quotas(quotas - draw, shards - left, seed, 2 * node + 1)


def ranked(names: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of each row of distinct ``name`` by code point, null last, counted part by part."""
    parts = stored(
        names.repartitionByRange(F.col("name").asc_nulls_last())
        .sortWithinPartitions(F.col("name").asc_nulls_last())
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "mix-ranks",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))  # a row for each partition
    return parts.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.col("place")).drop("part", "place", "base")


def targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """``sources(source_size, weight, ...)`` with ``target``: shares of the total by weight; a share over ``cap`` times its size stops there, the excess goes to the others by weight."""
    level, open_ = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap * F.col("source_size")
        r = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("source_size"))).alias("stopped"), F.sum(F.when(~over, F.col("weight"))).alias("whole"), F.count(F.when(~over, 1)).alias("open")).first()
        if not r.open or r.open == open_:  # each round stops more sources or is the last
            break
        level, open_ = ((r.all or 0) - cap * (r.stopped or 0)) / r.whole, r.open
    return sources.withColumn("target", F.when(over, cap * F.col("source_size")).otherwise(F.lit(level) * F.col("weight")).cast("double"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def mixed(docs: DataFrame, shards: int = 16, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as ``record`` with ``ticket, size, source_size, target, taken`` and ``draws`` (array of pass, shard and words)."""
    ticket = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
        F.col(source_col).alias("name"),
        ticket.alias("ticket"),
        F.pmod(F.shiftright(ticket, 17), F.lit(BLOCKS)).cast("int").alias("block"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )
    blocks = stored(sized.groupBy("name", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    sources = ranked(blocks.groupBy("name").agg(F.sum("words").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    words = F.round("target").cast("long")
    sources = stored(
        targets(stored(sources.withColumn("weight", weight), "mix-sources"), cap)
        .withColumn("passes", F.expr("if(source_size > 0, cast(round(target) as bigint) div source_size, 1)"))
        .withColumn("room", F.when(F.col("source_size") > 0, words % F.col("source_size")).otherwise(F.lit(0)).cast("long"))
        .select(F.col("name").alias("s_name"), "source_size", "target", "passes", "room", (F.col("rank") % STRATA).cast("int").alias("stratum")),
        "mix-targets",
    )

    # the partial pass takes whole blocks, in hash order, and ends inside the next
    order = Window.partitionBy("name").orderBy(F.xxhash64(F.lit(seed), "name", "block"), "block")  # BLOCKS rows
    upto = F.sum("words").over(order)
    planned = (
        blocks.join(_small(sources), _same("name", "s_name"))
        .withColumn("upto", upto)
        .withColumn("part", F.expr("case when room > 0 and upto <= room then 1 when room > 0 and upto - words < room then 2 else 0 end"))
        .withColumn("left", F.expr("if(part = 2, room - upto + words, 0L)"))
        .drop("s_name", "upto", "room")
    )
    planned = stored(planned, "mix-plan")

    # quotas of the strata, split by the tree; pair p of a stratum goes to the shard whose range holds p
    pairs = planned.select("name", "block", "stratum", F.explode(F.expr("filter(sequence(0L, passes), p -> p < passes or part > 0)")).alias("pass"))
    quotas = np.zeros(STRATA, np.int64)
    for r in pairs.groupBy("stratum").count().collect():  # STRATA rows
        quotas[r.stratum] = r["count"]
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0).T
    ranges = F.from_json(F.lit(json.dumps(ends.tolist())), "array<array<bigint>>")
    place = Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed + 1), "name", "block", "pass"), "name", "block", "pass")
    dealt = (
        pairs.withColumn("place", F.row_number().over(place) - 1)
        .withColumn("ends", F.element_at(ranges, F.col("stratum") + 1))
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
        .where(F.col("shard") < shards)
        .groupBy(F.col("name").alias("d_name"), F.col("block").alias("d_block"))
        .agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("items"))
    )

    # where the partial pass ends: first among the parts of its block, then among the documents of that part
    cuts = planned.where("part = 2").select(F.col("name").alias("c_name"), F.col("block").alias("c_block"), "left")
    at_cut = sized.join(_small(cuts), _same("name", "c_name") & (F.col("block") == F.col("c_block"))).select("name", "ticket", "size", "left", F.shiftright("ticket", 64 - (PARTS - 1).bit_length()).alias("fine"))
    at_cut = stored(at_cut.groupBy("name", "ticket", "fine", "left").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-cuts")
    fine = Window.partitionBy("name").orderBy("fine")  # PARTS rows
    in_part = (
        at_cut.groupBy("name", "fine", "left").agg(F.sum("words").alias("words")).withColumn("upto", F.sum("words").over(fine)).where("upto > left and upto - words <= left")
        .select(F.col("name").alias("f_name"), F.col("fine").alias("f_fine"), F.expr("left - upto + words").alias("rest"))
    )
    run = Window.partitionBy("name").orderBy("ticket")
    ended = (
        at_cut.join(_small(in_part), _same("name", "f_name") & (F.col("fine") == F.col("f_fine")))
        .withColumn("upto", F.sum("words").over(run))
        .where("upto > rest and upto - words <= rest")
        .select(F.col("name").alias("e_name"), F.col("ticket").alias("cut_ticket"), F.expr("(rest - upto + words) div n").alias("cut_words"))
    )
    of_block = stored(
        planned.join(dealt, _same("name", "d_name") & (F.col("block") == F.col("d_block")), "left")
        .join(ended, _same("name", "e_name"), "left")
        .select(F.col("name").alias("p_name"), F.col("block").alias("p_block"), "source_size", "target", "passes", "part", F.coalesce("cut_ticket", F.lit(0).cast("long")).alias("cut_ticket"), F.coalesce("cut_words", F.lit(0).cast("long")).alias("cut_words"), F.coalesce("items", F.expr("cast(array() as array<struct<pass:bigint,shard:int>>)")).alias("items")),
        "mix-draws",
    )
    before_cut = (F.col("part") == 2) & (F.col("ticket") < F.col("cut_ticket"))
    at_end = (F.col("part") == 2) & (F.col("ticket") == F.col("cut_ticket")) & (F.col("cut_words") > 0)
    part_words = F.when((F.col("part") == 1) | before_cut, F.col("size")).when(at_end, F.least("cut_words", "size")).otherwise(F.lit(0).cast("long"))
    return (
        sized.join(_small(of_block), _same("name", "p_name") & (F.col("block") == F.col("p_block")))
        .withColumn("part_words", part_words)
        .withColumn("in_part", (F.col("part") == 1) | before_cut | at_end)
        .withColumn(
            "draws",
            F.transform(
                F.filter("items", lambda x: (x["pass"] < F.col("passes")) | F.col("in_part")),
                lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), F.when(x["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("part_words")).alias("words")),
            ),
        )
        .select("record", "ticket", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("taken"), "draws")
    )


def mixture(mix: DataFrame, text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row for each document drawn: the input's columns (a cut text ends at its last word taken), then ``shard`` and ``place``, the sort key of the local shuffle."""
    fields = mix.schema["record"].dataType.names
    text = F.col(f"record.`{text_col}`")
    cut = F.when(F.col("draw.words") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), F.col("draw.words").cast("int")), " ")).otherwise(text)
    return mix.withColumn("draw", F.explode("draws")).select(
        *[cut.alias(c) if c == text_col else F.col(f"record.`{c}`").alias(c) for c in fields],
        F.col("draw.shard").alias("mix_shard"),
        F.xxhash64(F.lit(seed), "ticket", "draw.pass").alias("mix_place"),
    )


def write_mixture(rows: DataFrame, path: str) -> None:
    rows.repartition("mix_shard", F.pmod("mix_place", F.lit(64))).sortWithinPartitions("mix_shard", "mix_place").write.partitionBy("mix_shard").parquet(path)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("record.doc_id", "size", "source_size", "target", "taken", "draws")
