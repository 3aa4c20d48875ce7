"""Feature tables: reading, checking, coercion, sampling, one-hot coding, fingerprints."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions import sparse

#: Sparse tables of at most so many cells are made dense.
DENSE_CELLS = 50_000_000


def features(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id long, features array<double>)``, the values rounded to single precision."""
    v = F.col(vec_col)
    if df.schema[vec_col].dataType.typeName() == "struct":
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("features"))
    return df.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("float").cast("double")).alias("features"))


def checked(df: DataFrame) -> DataFrame:
    """Raises for null ids or vectors, non-finite values, ragged lengths and repeated ids; one aggregate pass."""
    bad = F.expr("features is null or exists(features, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    r = df.agg(
        F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("no_id"), F.count_if(bad).alias("bad"),
        F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most"), F.count_distinct("id").alias("ids"),
    ).first()
    if r.no_id or r.ids != r.n:
        raise ValueError("ids must be unique and not null")
    if r.bad:
        raise ValueError("features contain null, NaN or infinity")
    if r.least != r.most:
        raise ValueError("feature vectors have different lengths")
    return df


def finite(v: Column) -> Column:
    """Null, NaN and infinities become 0."""
    return F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """A seeded sample of n rows, the same whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(n)


def subset(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def dense_if_small(df: DataFrame, n_features: int) -> DataFrame:
    """Sparse rows made dense if the table has at most ``DENSE_CELLS`` cells."""
    if df.schema["features"].dataType.typeName() != "struct" or df.count() * n_features > DENSE_CELLS:
        return df
    return df.select("id", sparse.densify(F.col("features"), n_features).alias("features"))


def fingerprint(df: DataFrame) -> int:
    """Order-free hash of a feature table."""
    return df.agg(F.bit_xor(F.xxhash64("id", "features")).alias("h")).first().h


def one_hot(df: DataFrame, categories: list[str], out: str = "features", rest: str | None = None) -> DataFrame:
    """Indicator values of each category column in code-point order, then the array column ``rest``; unknown later values give zeros."""
    parts = []
    for c in categories:
        levels = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()]  # the levels are the width of the result
        parts.append(F.array(*[F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0) for v in levels]))
    if rest:
        parts.append(F.transform(rest, lambda x: x.cast("double")))
    return df.withColumn(out, F.concat(*parts))


def load_npy(spark: SparkSession, data: str, label: str | None = None) -> DataFrame:
    """``(id, features[, label])`` of an array file: one dimension is a column, more than two are flattened."""
    x = np.load(data, mmap_mode="r")
    if x.ndim == 0:
        raise ValueError("a scalar is no table")
    x = np.asarray(x, np.float64).reshape(len(x), -1)
    columns = {"id": list(range(len(x))), "features": x.tolist()}
    schema = "id long, features array<double>"
    if label is not None:
        columns["label"] = np.load(label).ravel().astype(int).tolist()
        schema += ", label int"
    return spark.createDataFrame(list(zip(*columns.values())), schema)


def representatives(sizes: DataFrame, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """``sizes(name, n)``: the entries nearest to the quantiles of n, filled up by the smallest."""
    q = sizes.agg(F.percentile("n", F.array(*map(F.lit, quantiles))).alias("q"))
    near = sizes.join(F.broadcast(q)).select("name", "n", F.posexplode("q"))
    picked = near.groupBy("pos").agg(F.min_by("name", F.struct(F.abs(F.col("n") - F.col("col")), F.col("n"), F.col("name"))).alias("name"))
    marked = sizes.join(picked.select("name").distinct().withColumn("picked", F.lit(0)), "name", "left")
    return marked.orderBy(F.coalesce("picked", F.lit(1)), "n", "name").limit(len(quantiles)).select("name", "n")


def discover(root: str) -> list[tuple[str, tuple[int, ...]]]:
    """(name, shape) of each folder of ``root`` with readable ``data.npy`` and ``label.npy``; scalars are skipped."""
    found = []
    for name in sorted(os.listdir(root)):
        try:
            shapes = [np.load(os.path.join(root, name, f"{part}.npy"), mmap_mode="r").shape for part in ("data", "label")]
        except (OSError, ValueError):
            continue
        if all(shapes):
            found.append((name, shapes[0]))
    return found


def load_dense(spark: SparkSession, path: str, id_col: str | None = None, label_col: str | None = None) -> DataFrame:
    """``(id, label, features)`` from a Parquet folder or CSV files with a header: all other numeric columns, in order; nulls stay.

    Without ``id_col`` rows are numbered (not gapless); without ``label_col`` labels are null.
    """
    df = spark.read.csv(path, header=True, inferSchema=True) if ".csv" in path else spark.read.parquet(path)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")
    used = [c for c, kind in df.dtypes if kind.split("(")[0] in numeric and c not in (id_col, label_col)]
    return df.select(
        (F.col(f"`{id_col}`").cast("long") if id_col else F.monotonically_increasing_id()).alias("id"),
        (F.col(f"`{label_col}`").cast("string") if label_col else F.lit(None).cast("string")).alias("label"),
        F.array(*[F.col(f"`{c}`").cast("double") for c in used]).alias("features"),
    )


def load_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """``(id, label, features struct<indices, values>)`` from lines ``label index:value ...``; indices count from 1 in the file, from 0 here. Blank lines and comments are skipped."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    parts = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.split(line, r"\s+").alias("p")).where(F.col("p")[0] != "")
    pairs = F.array_sort(F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: F.struct((F.substring_index(x, ":", 1).cast("int") - 1).alias("i"), F.substring_index(x, ":", -1).cast("double").alias("v"))))
    return parts.select("id", F.col("p")[0].cast("double").alias("label"), pairs.alias("e")).select(
        "id", "label", F.struct(F.transform("e", lambda x: x["i"]).alias("indices"), F.transform("e", lambda x: x["v"]).alias("values")).alias("features")
    )


def save_embedding(embedding: DataFrame, path: str, id_col: str = "id", position: str = "position") -> None:
    """Writes positions in id order: Parquet, or CSV (a column for each coordinate) where the path says so."""
    ordered = embedding.orderBy(id_col)
    if ".csv" not in path:
        ordered.write.mode("overwrite").parquet(path)
        return
    width = embedding.agg(F.max(F.size(position))).first()[0] or 0
    ordered.select(id_col, *[F.col(position)[i].alias(f"x{i}") for i in range(width)]).write.mode("overwrite").csv(path, header=True)
