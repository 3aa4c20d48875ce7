"""Quality scores from naive Bayes support vectors.

Texts are sets of n-grams (words, word pairs, byte triples, and 4-grams of "the
same word again or another", which tell texts of repeated words whatever those
are) and one indicator of length, hashed to 2**18 indicators. Each indicator is scaled by its class log-count ratio, rows are
scaled to unit length, and a linear hinge-loss model with class weights is fitted
to them by dual coordinate descent. A logistic curve fitted to cross-validated
margins turns margins into scores.

Labels are learnt from a sample of at most ``MAX_TRAIN`` rows outside the
held-out fold, half of each class where there are enough; weights undo the
balance when scores are calibrated. The fit is one task that holds 32 KB at most
for each of its texts, however long (a list of indicators or a bitmap of all);
scoring is one narrow pass over all texts.

Defined cases: a null or empty text has the bias alone and so the score of a text
without evidence; without labels of both classes every score is the share of the
class there is (0.5 without labels); null ids are held out or not as the empty
text's crc32 says; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import LOWER, as_bytes, chunks, documents, fit_logistic, labelled_sample, mix64, remainder, word_hashes

BITS = 18
#: Labelled rows that a fit takes at most.
MAX_TRAIN = 8_000


def indicators(texts: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """For each text the sorted indexes of its n-grams."""
    words, n = word_hashes(texts)
    pairs = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    shift, flags, out, at = np.uint64(64 - bits), np.zeros(1 << bits, bool), [], 0
    for text, m in zip(texts, n.tolist()):
        raw = LOWER[np.frombuffer(text, np.uint8)].astype(np.uint64)
        triples = mix64(raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16) | np.uint64(1 << 40)) if len(raw) > 2 else raw[:0]
        same = (words[at : at + m][1:] == words[at : at + m][:-1]).astype(np.uint64)
        runs = same[:-3] | same[1:-2] << np.uint64(1) | same[2:-1] << np.uint64(2) | same[3:] << np.uint64(3) if len(same) > 3 else same[:0]
        shape = mix64(np.append(np.unique(runs), np.uint64(16 + m.bit_length())) + np.uint64(1 << 50))
        for h in (words[at : at + m], pairs[at : at + max(m - 1, 0)], triples, shape):
            flags[h >> shift] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        out.append(found)
        at += m
    return out


def packed(found: np.ndarray, bits: int = BITS) -> bytes:
    """Sorted indexes as a list, or as a bitmap where that is shorter."""
    if 4 * len(found) <= (1 << bits) // 8:
        return b"\0" + found.astype("<i4").tobytes()
    flags = np.zeros(1 << bits, bool)
    flags[found] = True
    return b"\1" + np.packbits(flags).tobytes()


class Rows:
    """Packed index lists, unpacked one at a time."""

    def __init__(self, blobs: list[bytes]):
        self.blobs = blobs

    def __len__(self) -> int:
        return len(self.blobs)

    def __getitem__(self, i: int) -> np.ndarray:
        b = self.blobs[i]
        return np.frombuffer(b, "<i4", offset=1) if b[0] == 0 else np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, offset=1)))

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[i] for i in range(len(self)))

    def take(self, which: np.ndarray) -> Rows:
        return Rows([self.blobs[i] for i in which.tolist()])


def dual_coordinate_descent(rows: Rows | list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 42) -> np.ndarray:
    """Weights (bias last) of min 1/2 |w|^2 + sum cost * hinge, rows being scaled indicators of unit length."""
    w, alpha, rng = np.zeros(len(scale) + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    norms = [max(np.linalg.norm(scale[r]), 1e-12) for r in rows]
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = scale[r] / norms[i]
            g = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / (v @ v + 1), 0.0), cost[i])
            if (d := new - alpha[i]) != 0:
                w[r] += d * y[i] * v
                w[-1] += d * y[i]
                alpha[i] = new
                worst = max(worst, abs(d))
        if worst < 1e-3:
            break
    return w


def _fit(rows: Rows, label: np.ndarray, size: int, smooth: float = 1.0, cost: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    counts = np.full((2, size), smooth)
    for r, k in zip(rows, label.tolist()):
        counts[k][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    share = np.maximum(np.bincount(label, minlength=2) / len(label), 1e-9)
    return ratio, dual_coordinate_descent(rows, ratio, 2.0 * label - 1, cost / (2 * share[label]))


def margin(rows: Rows, ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A text without n-grams gets the bias."""
    return np.array([ratio[r] @ w[r] / max(np.linalg.norm(ratio[r]), 1e-12) + w[-1] for r in rows])


def fit(rows: Rows, label: np.ndarray, weight: np.ndarray, size: int = 1 << BITS, folds: int = 3) -> dict:
    """The model: ``ratio``, ``w`` and the calibration ``curve``, or a constant ``share`` if one class is missing."""
    if len(set(label.tolist())) < 2:
        return {"share": float(label[0]) if len(label) else 0.5}
    held = np.arange(len(rows)) % folds
    out = np.zeros(len(rows))
    for k in range(folds):
        train, test = np.flatnonzero(held != k), np.flatnonzero(held == k)
        if len(set(label[train].tolist())) < 2:
            train = np.arange(len(rows))
        ratio, w = _fit(rows.take(train), label[train], size)
        out[test] = margin(rows.take(test), ratio, w)
    curve = fit_logistic(np.c_[out, np.ones(len(out))], label, weight)
    ratio, w = _fit(rows, label, size)
    return {"scaled": (ratio * w[:-1]).astype(np.float32), "square": (ratio**2).astype(np.float32), "bias": float(w[-1]), "curve": curve}


def train(docs: DataFrame, labels: DataFrame, label: str, max_train: int = MAX_TRAIN) -> dict:
    """Fit on a bounded sample; n-grams are taken on the executors, whole texts never reach the driver."""
    sample = labelled_sample(docs, labels, label, {0: max_train // 2, 1: max_train // 2})

    def grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = as_bytes(b.column(3))
            for i, j in chunks(texts):
                found = [packed(x) for x in indicators(texts[i:j])]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(3)), pa.array(found, pa.binary())], names=["doc_id", "label", "weight", "grams"])

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((x for b in it for x in zip(*(c.to_pylist() for c in b.columns))), key=lambda x: (x[0] is None, x[0] or 0, x[3]))
        model = fit(Rows([x[3] for x in found]), np.array([x[1] for x in found], int), np.array([x[2] for x in found], float))
        yield pa.RecordBatch.from_pydict({k: [np.atleast_1d(v).astype("<f8").tobytes()] for k, v in ({"scaled": [], "square": [], "bias": [], "curve": [], "share": []} | model).items()})

    rows = sample.mapInArrow(grams, "doc_id long, label int, weight double, grams binary").repartition(1)  # MAX_TRAIN rows
    model = rows.mapInArrow(solve, "scaled binary, square binary, bias binary, curve binary, share binary").first()
    if model is None:
        return {"share": 0.5}
    if model.share:
        return {"share": float(np.frombuffer(model.share, "<f8")[0])}
    return {k: np.frombuffer(v, "<f8") for k, v in model.asDict().items()}


def _scorer(model: dict):
    """A function from texts to scores."""
    if "scaled" not in model:
        share = float(np.ravel(model["share"])[0])
        return lambda texts: [share] * len(texts)
    scaled, square, bias, curve = model["scaled"].astype(np.float32), model["square"].astype(np.float32), float(model["bias"][0]), model["curve"]

    def score(texts: list[bytes]) -> list[float]:
        out = []
        for i, j in chunks(texts):
            for r in indicators(texts[i:j]):
                m = scaled[r].sum(dtype=float) / max(np.sqrt(square[r].sum(dtype=float)), 1e-12) + bias
                out.append(float(1 / (1 + np.exp(-np.clip(curve[0] * m + curve[1], -30, 30)))))
        return out

    return score


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score)`` of whole texts."""
    scorer = _scorer(model)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(as_bytes(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def accepted(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more; one narrow pass."""
    scorer, at = _scorer(model), docs.columns.index("text")

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array([s >= least for s in scorer(as_bytes(b.column(at)))], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return scores(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
