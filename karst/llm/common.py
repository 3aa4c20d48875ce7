"""Helpers shared by the corpus operators: shared storage, texts as bytes, held-out folds."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.session import shared_dir, stored

#: Words are runs of bytes other than the six ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Intermediate results of one operator in a folder of their own, for those that nothing lazy reads in the end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_path(spark, name)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back; names may repeat."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Removes the folder; to be called once what was made of it is stored elsewhere."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def id_remainder(doc_id: int | None, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes; null gives the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashable(df: DataFrame) -> list[Column]:
    """All columns, those that hold maps or variants as JSON: what ``xxhash64`` takes."""
    odd = lambda c: any(x in df.schema[c].dataType.simpleString() for x in ("map<", "variant"))
    return [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if odd(c) else F.col(f"`{c}`") for c in df.columns]


#: Bytes that make up words: all but the ASCII blanks, or letters, digits and non-ASCII alone.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_PART = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes so that every bit depends on every other (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xCA6B27F1A2D9C6E5)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(texts: list[bytes], solid: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every lower-cased word of the texts, and the number of words of each text.

    A polynomial prefix hash modulo 2**64 of the joined bytes, read off at word
    boundaries, in parts that bound the memory.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    raw = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)] if texts else np.zeros(0, np.uint8)
    inside = solid[raw]
    inside[ends - 1] = False
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # by parts of some bytes that end with a word
        j = max(i + 1, int(np.searchsorted(stop, start[i] + _PART, "right")))
        low, part = start[i], raw[start[i] : stop[j - 1]]
        up, down = _power_table(len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=prefix[1:])
        a, b = start[i:j] - low, stop[i:j] - low
        hashes[i:j] = mix64((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def chunks(texts: list[bytes], most: int = 4 << 20):
    """Index ranges of consecutive texts of about ``most`` bytes in all (a longer text stands alone)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def text_batches(it, arrays: int = 1):
    """For each Arrow batch and chunk of it: the chunk's leading columns (ids first) and its texts, the last column."""
    for b in it:
        texts = as_bytes(b.column(b.num_columns - 1))
        for i, j in chunks(texts):
            yield [b.column(c).slice(i, j - i) for c in range(arrays)], texts[i:j]


def lean(batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``batches`` for ``mapInArrow``, after which the worker gives back what it has freed: workers stay for the next stage, idle beside it if that has no Python."""

    def run(it: Iterator) -> Iterator:
        yield from batches(it)
        _powers.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], fold: int = 5, seed: int = 42) -> DataFrame:
    """``(doc_id, label, text, weight)`` of at most ``per_class[label]`` labelled rows of each class outside the held-out fold.

    Rows are picked by a seeded hash of their id; ``weight`` is how many labelled
    rows of its class a picked row stands for. Several labels of an id: the largest.
    """
    usable = labels.where(F.col(label).isNotNull() & (remainder(F.col("doc_id"), fold) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    picked = None
    for k, most in per_class.items():
        part = usable.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(max(1.0, counts.get(k, 0) / most)))
        picked = part if picked is None else picked.union(part)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "label", "weight", "text")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method; x has a column of ones. Used to calibrate scores."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
