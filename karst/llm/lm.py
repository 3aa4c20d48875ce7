"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Counts of all training words are gathered first (a row for each distinct word of
a task, then a sum by word). All words belong to the classes of the neural part,
whose number grows with the square root of the vocabulary: half are the
commonest words, one is the end of a text, and the other words, unseen ones too,
are dealt to the rest by hash. Classes stand by falling share in bands of equal
length. The vectors of the classes of the two tokens before are scaled by
position, added, and multiplied with output vectors: of the bands in one model,
of the classes in another. The training texts, as classes, are dealt by hash into parts of
some ``COPY_TOKENS`` tokens, in hash order; each part trains a copy of both on
all its tokens by noise-contrastive estimation, with noise drawn from the
counts, and the copies are averaged by their tokens, so the scores are a
function of the rows and not of how the table is partitioned. A class has the probability
of its band times its own inside the band, each normalised exactly for the
context at hand. A word of a shared class has the probability of the class times
its own share of it, (c + 1) / (n + v + 1) over the class, in which the unseen
words of the class share one place.

A word's count is looked up in a table of the commonest ``TABLE`` words; rarer
ones are joined by word as one row for each document and word. Words stand as
64-bit hashes throughout.

Defined cases: a null or empty text is its end alone; repeated rows and ids are
scored row by row; without training rows counts are 0 and the score is that of
one even class; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import documents, id_remainder, stored, text_batches, word_hashes

#: Classes at least, and how many for each unit of the square root of the vocabulary.
CLASSES, GROWTH = 512, 4
WIDTH, TABLE, SLAB = 16, 1 << 18, 1 << 13
#: Training tokens of a copy, as long as there are not more copies than ``MAX_COPIES``; tokens that a copy's batches are drawn from at once.
COPY_TOKENS, MAX_COPIES, DRAWN = 1 << 21, 1 << 16, 1 << 19
END = np.uint64(0)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the number of tokens of each."""
    h, n = word_hashes(texts)
    h[h == END] = 1
    return np.insert(h, np.cumsum(n), END), n + 1


def word_counts(docs: DataFrame, held: int, folds: int, flush: int = 1 << 21) -> DataFrame:
    """``(h, c)``: occurrences of each token in the training documents."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts):
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

        parts, size = [], 0
        for (ids,), texts in text_batches(it):
            h, n = tokens(texts)
            h = h[np.repeat([id_remainder(i, folds) != held for i in ids.to_pylist()], n)]
            parts.append(h)
            size += len(h)
            if size > flush:
                yield packed(parts)
                parts, size = [], 0
        if size:
            yield packed(parts)

    return docs.mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


HASH = (1 << 63) - 1


class Classes:
    """Token hashes to classes: the common words, shared classes by hash, the end; numbered by falling count."""

    def __init__(self, common: np.ndarray, shared: int):
        self.common, self.shared, self.size = np.sort(common), shared, len(common) + shared + 1
        self.number = np.arange(self.size, dtype=np.int32)
        self.is_shared = np.zeros(self.size, bool)
        self.is_shared[len(common) : -1] = True

    def sort(self, count: np.ndarray) -> np.ndarray:
        """Numbers the classes by falling count; the order they had."""
        order = np.argsort(-count, kind="stable")
        self.number[order] = np.arange(self.size)
        self.is_shared = self.is_shared[order]
        return order

    def of(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.common, h)
        at[at == len(self.common)] = 0
        known = self.common[at] == h if len(self.common) else np.zeros(len(h), bool)
        dealt = len(self.common) + ((h & np.uint64(HASH)) % np.uint64(self.shared)).astype(np.int64)
        return self.number[np.where(h == END, self.size - 1, np.where(known, at, dealt))]


def contexts(c: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before; the end stands before a text's start."""
    one, two = np.empty_like(c), np.empty_like(c)
    one[1:], two[2:] = c[:-1], c[:-2]
    start = np.cumsum(n) - n
    one[start] = two[start] = end
    two[start[n > 1] + 1] = end
    return one, two


class LogBilinear:
    def __init__(self, share: np.ndarray, width: int = WIDTH, seed: int = 42, inputs: int | None = None):
        rng = np.random.default_rng(seed)
        k = len(share)
        self.noise = share.astype(np.float32)
        self.parts = {
            "context": rng.normal(0, 0.1, (inputs or k, width)).astype(np.float32),
            "output": rng.normal(0, 0.1, (k, width)).astype(np.float32),
            "near": np.ones(width, np.float32),
            "far": np.full(width, 0.5, np.float32),
            "bias": np.log(share).astype(np.float32),  # begins as the noise law, so already normalised
        }
        self.squares = {name: np.ones_like(x) for name, x in self.parts.items()}

    def move(self, name: str, rows: np.ndarray | slice, grad: np.ndarray, rate: float) -> None:
        """An adaptive step of distinct rows, by the gradients summed over a batch."""
        self.squares[name][rows] += grad * grad
        self.parts[name][rows] += rate * grad / np.sqrt(self.squares[name][rows])

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        p = self.parts
        return p["context"][one] * p["near"] + p["context"][two] * p["far"]

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, rng: np.random.Generator, cumulative: np.ndarray, rate: float, draws: int) -> None:
        p = self.parts
        noise = np.searchsorted(cumulative, rng.random(draws)).clip(max=len(cumulative) - 1)
        ctx1, ctx2, own, other = p["context"][one], p["context"][two], p["output"][word], p["output"][noise]
        r = ctx1 * p["near"]
        r += ctx2 * p["far"]
        log_noise = np.log(draws * self.noise)
        offset = p["bias"] - log_noise
        up = np.einsum("ij,ij->i", r, own) + offset[word]
        up = 1 / (1 + np.exp(np.clip(up, -30, 30)))  # 1 - P(data)
        down = r @ -other.T
        down -= offset[noise]
        np.minimum(down, 30, out=down)
        np.exp(down, out=down)
        down += 1
        np.reciprocal(down, out=down)  # P(noise taken for data)
        grad_r = up[:, None] * own
        grad_r -= down @ other
        grads = {"output": [(word, up[:, None] * r), (noise, -(down.T @ r))], "context": [(one, grad_r * p["near"]), (two, grad_r * p["far"])]}
        self.move("near", slice(None), np.einsum("ij,ij->j", grad_r, ctx1), rate)
        self.move("far", slice(None), np.einsum("ij,ij->j", grad_r, ctx2), rate)
        grads["bias"] = [(word, up[:, None]), (noise, -down.sum(0)[:, None])]
        for name, terms in grads.items():
            rows, g = np.concatenate([t[0] for t in terms]), np.concatenate([t[1] for t in terms])
            order = np.argsort(rows.astype(np.uint16) if len(self.parts[name]) <= 1 << 16 else rows, kind="stable")  # short keys sort faster
            rows = rows[order]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            g = np.add.reduceat(g[order], first)
            self.move(name, rows[first], g[:, 0] if name == "bias" else g, rate)

    def log10_normalisers(self, rows: int = 4096) -> np.ndarray:
        """log10 of the sum over classes, for each pair of context classes (one * k + two)."""
        k = len(self.parts["bias"])
        out = np.empty(k * k, np.float32)
        for a in range(0, k * k, rows):
            i = np.arange(a, min(a + rows, k * k))
            s = self.predicted(i // k, i % k) @ self.parts["output"].T + self.parts["bias"]
            m = s.max(1)
            out[a : a + rows] = (m + np.log(np.exp(s - m[:, None]).sum(1))) / np.log(10)
        return out

    def pack(self) -> bytes:
        return b"".join(self.parts[k].astype("<f4").tobytes() for k in sorted(self.parts))

    def unpack(self, flat: np.ndarray) -> None:
        for k in sorted(self.parts):
            n = self.parts[k].size
            self.parts[k], flat = flat[:n].astype(np.float32).reshape(self.parts[k].shape), flat[n:]


class TwoLevel:
    """Bands of classes, and classes inside their band; both from the classes of the context."""

    def __init__(self, share: np.ndarray):
        self.length = math.isqrt(len(share) - 1) + 1
        bands = np.add.reduceat(share, np.arange(0, len(share), self.length))
        self.bands, self.classes = LogBilinear(bands, inputs=len(share)), LogBilinear(share)

    def step(self, one: np.ndarray, two: np.ndarray, c: np.ndarray, rng: np.random.Generator, cumulative: tuple[np.ndarray, np.ndarray], rate: float, draws: int) -> None:
        self.bands.step(one, two, c // self.length, rng, cumulative[0], rate, draws)
        self.classes.step(one, two, c, rng, cumulative[1], rate, draws)

    def log10_probability(self, one: np.ndarray, two: np.ndarray, c: np.ndarray) -> np.ndarray:
        def log_softmax(model: LogBilinear, r: np.ndarray, among: slice, word: np.ndarray) -> np.ndarray:
            s = r @ model.parts["output"][among].T
            s += model.parts["bias"][among]
            s -= s.max(1, keepdims=True)
            own = s[np.arange(len(s)), word]
            return own - np.log(np.exp(s, out=s).sum(1))

        band = c // self.length
        out = log_softmax(self.bands, self.bands.predicted(one, two), slice(None), band)
        r = self.classes.predicted(one, two)
        order = np.argsort(band.astype(np.uint16), kind="stable")
        cut = np.flatnonzero(np.diff(band[order], prepend=-1))
        for at in np.split(order, cut[1:]) if len(order) else ():
            b = int(band[at[0]]) * self.length
            out[at] += log_softmax(self.classes, r[at], slice(b, b + self.length), c[at] - b)
        return out / np.log(10)

    def pack(self) -> bytes:
        return self.bands.pack() + self.classes.pack()

    def unpack(self, flat: np.ndarray) -> None:
        n = sum(x.size for x in self.bands.parts.values())
        self.bands.unpack(flat[:n])
        self.classes.unpack(flat[n:])


def train(docs: DataFrame, classes: Classes, share: np.ndarray, held: int, folds: int, tokens_in_all: int, batch: int = 4096, draws: int = 48, rate: float = 0.07) -> TwoLevel:
    """One pass over all training tokens, in copies that are averaged in two steps."""
    copies = max(1, min(MAX_COPIES, tokens_in_all // COPY_TOKENS))
    heaps = math.isqrt(copies)
    width = "<u2" if classes.size <= 1 << 16 else "<u4"

    def coded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, part, order), texts in text_batches(it, 3):
            use = np.flatnonzero([id_remainder(i, folds) != held for i in ids.to_pylist()])
            h, n = tokens([texts[i] for i in use.tolist()])
            ends = np.cumsum(n)
            c = classes.of(h).astype(width)
            blobs = [c[x:y].tobytes() for x, y in zip((ends - n).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([part.take(pa.array(use)), order.take(pa.array(use)), pa.array(blobs, pa.binary())], names=["part", "place", "classes"])

    def fitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, list] = {}
        end, held_texts, size = int(classes.number[-1]), [], 0

        def learn(part: int) -> None:
            if part not in models:
                models[part] = [TwoLevel(share), np.random.default_rng([7, part]), 0]
            model, rng, seen = models[part]
            c = np.concatenate(held_texts).astype(np.int32)
            one, two = contexts(c, np.array([len(x) for x in held_texts]), end)
            use = rng.permutation(len(c))
            for a in range(0, len(use), batch):
                at = use[a : a + batch]
                model.step(one[at], two[at], c[at], rng, cumulative, rate / (1 + seen / 4e6), draws)
                seen += len(at)
            models[part][2] = seen

        def packed() -> Iterator[pa.RecordBatch]:
            for part, (model, _, seen) in models.items():
                yield pa.RecordBatch.from_pydict({"part": [part], "n": [float(seen)], "parts": pa.array([model.pack()], pa.binary())})
            models.clear()

        start = TwoLevel(share)
        cumulative = np.cumsum(start.bands.noise), np.cumsum(share)
        now = None
        for b in it:  # by part, in order
            for part, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if now is not None and (part != now or size >= DRAWN):
                    learn(now)
                    held_texts, size = [], 0
                    if part != now:
                        yield from packed()
                now = part
                held_texts.append(np.frombuffer(blob, width))
                size += len(held_texts[-1])
        if now is not None:
            learn(now)
            yield from packed()

    def averaged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in it:  # by heap, in order
            for part, n, parts in zip(*(b.column(c).to_pylist() for c in range(3))):
                total = found.setdefault(part % heaps, [0.0, 0.0])
                total[0] = total[0] + n * np.frombuffer(parts, "<f4").astype(np.float64)
                total[1] += n
        for heap, (total, n) in found.items():
            yield pa.RecordBatch.from_pydict({"part": [heap], "n": [n], "parts": pa.array([(total / n).astype("<f4").tobytes()], pa.binary())})

    model = TwoLevel(share)
    key = F.xxhash64(F.lit(7), "id", "text")
    dealt = docs.select("id", F.pmod(key, F.lit(copies)).alias("part"), F.xxhash64(F.lit(8), "id", "text").alias("place"), "text")
    trained = dealt.mapInArrow(coded, "part long, place long, classes binary").repartition(copies, "part").sortWithinPartitions("part", "place").mapInArrow(fitted, "part long, n double, parts binary")
    once = trained.repartition(heaps, F.pmod("part", F.lit(heaps))).sortWithinPartitions("part").mapInArrow(averaged, "part long, n double, parts binary")
    rows = once.repartition(1).sortWithinPartitions("part").mapInArrow(whole, "n double, parts binary").collect()  # one row
    if rows:
        model.unpack(np.frombuffer(rows[0].parts, "<f4"))
    return model


def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The average of averages: at most the square root of the copies."""
    total, weight = None, 0.0
    for b in it:
        for n, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            x = n * np.frombuffer(parts, "<f4").astype(np.float64)
            total, weight = x if total is None else total + x, weight + n
    if total is not None:
        yield pa.RecordBatch.from_pydict({"n": [weight], "parts": pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())})


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = 2, folds: int = 7) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = stored(word_counts(docs, held, folds), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()

    # the grade of count from which words are in the table; counts up to 64 have grades of their own
    grade = F.floor(F.log2("c") * 64)
    least, room = 1 << 20, TABLE
    for r in counts.where(F.col("h") != 0).groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect():  # 4096 rows at most
        room -= r["count"]
        if room < 0:
            break
        least = r.grade
    common = counts.where((grade >= least) | (F.col("h") == 0)).orderBy("h").toArrow()
    table = common.column("h").to_numpy().view(np.uint64)
    order = np.argsort(table)
    table, table_c = table[order], common.column("c").to_numpy()[order]
    words, words_c = table[table != END], table_c[table != END]
    size = max(CLASSES, math.ceil(GROWTH * math.sqrt(total.v)))
    top = np.lexsort((words, -words_c))[: size // 2 - 1]
    classes = Classes(words[top], size - size // 2)
    class_c, class_v = np.zeros(classes.size), np.zeros(classes.size)
    dealt = F.pmod(F.col("h").bitwiseAND(F.lit(HASH)), F.lit(classes.shared))
    for r in counts.where(F.col("h") != 0).groupBy(dealt.alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # a row for each shared class
        class_c[len(top) + r.g], class_v[len(top) + r.g] = r.c, r.v
    of = len(top) + ((words[top] & np.uint64(HASH)) % np.uint64(classes.shared)).astype(np.int64)
    np.subtract.at(class_c, of, words_c[top])
    np.subtract.at(class_v, of, 1)
    class_c[: len(top)] = words_c[top][np.argsort(words[top])]
    class_c[-1] = table_c[table == END].sum()
    order = classes.sort(class_c)
    class_c, class_v = class_c[order], class_v[order]
    share = (class_c + 1) / (class_c + 1).sum()
    model = train(docs, classes, share, held, folds, total.n)
    log_total = np.where(classes.is_shared, np.log10(class_c + class_v + 1), 0.0)
    shared = spark.sparkContext.broadcast((classes, model, log_total, table, np.log10(table_c + 1.0)))

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, model, log_total, table, table_log = shared.value
        row = TaskContext.get().partitionId() << 40
        for (ids,), texts in text_batches(it):
            h, n = tokens(texts)
            of, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
            c = classes.of(h)
            one, two = contexts(c, n, int(classes.number[-1]))
            log_p = np.empty(len(c))
            for a in range(0, len(c), SLAB):
                i = slice(a, a + SLAB)
                log_p[i] = model.log10_probability(one[i], two[i], c[i])
            at = np.searchsorted(table, h)
            at[at == len(table)] = 0
            inside = table[at] == h if len(table) else np.zeros(len(h), bool)
            logs = np.where(inside, table_log[at] if len(table) else 0.0, 0.0)
            other = classes.is_shared[c]
            rest = np.flatnonzero(~inside)
            key = np.empty(len(rest), [("d", "<i8"), ("h", "<u8")])
            key["d"], key["h"] = of[rest], h[rest]
            if len(rest):
                order = np.lexsort((key["h"], key["d"]))
                key = key[order]
                first = np.flatnonzero((np.diff(key["d"], prepend=-1) != 0) | (np.append(True, key["h"][1:] != key["h"][:-1])))
                tf, key = np.diff(np.append(first, len(key))), key[first]
            else:
                tf = np.zeros(0, np.int64)
            offsets = pa.array(np.searchsorted(key["d"], np.arange(len(n) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(len(n))), ids, pa.array(n), pa.array(add(inside.astype(np.int64))), pa.array(add(logs)), pa.array(add(log_p + np.where(other, logs, 0.0) - log_total[c])),
                    pa.ListArray.from_arrays(offsets, pa.array(key["h"].view(np.int64).copy())), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
                ],
                names=["row", "id", "n", "known", "logs", "score", "hs", "tfs"],
            )
            row += len(n)

    per_doc = stored(docs.mapInArrow(scored, "row long, id long, n long, known long, logs double, score double, hs array<long>, tfs array<int>"), "scored")
    rare = per_doc.select("row", F.explode(F.arrays_zip("hs", "tfs")).alias("w")).select("row", F.col("w.hs").alias("h"), F.col("w.tfs").alias("tf"))
    met = rare.join(counts.where(grade < least), "h").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return per_doc.drop("hs", "tfs").join(met, "row", "left").select(
        F.col("id").alias(id_col),
        (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % folds == held).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n") * F.lit(float(np.log10(total.n + total.v + 1)))).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))

