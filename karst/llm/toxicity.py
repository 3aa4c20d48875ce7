"""Toxicity from the nearest labelled examples.

Examples are labelled texts outside the held-out fold, at most ``EXAMPLES`` of
each class. A text is the vector of (1 + log tf) * idf over all its alphanumeric
words, scaled to unit length, idf being counted over all documents; words that
do not tell the classes apart (chi-square over the examples) count ``PLAIN``
times. The examples most alike by exact cosine are found with an inverted index
in blocks: for each word and block the index keeps the block's largest weight,
whose products with the query bound the block's best cosine. Blocks are visited
by falling bound until the bound drops below the k-th best found, so results
equal those of a full scan, which is what is done where blocks hold few postings
of a word each. Votes weighted by distance are calibrated by a
logistic curve over leave-one-out votes of the examples, weighted back to the
labelled population.

The index (bounded by the examples' texts) and the idf of the ``TABLE`` commonest
words go to every task. Rarer words that no example has only lengthen a text's
vector: they leave the nearest examples as they are and scale its cosines, so
they are joined with their counts as one row for each document and word.

Defined cases: texts without any word of an example (null and empty ones too)
have no neighbours and get the share of toxic rows among such examples; without
labels the score is 0; equal cosines are ordered by doc_id; repeated rows score
alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import ALPHANUMERIC, documents, fit_logistic, labelled_sample, mix64, remainder, stored, text_batches, word_hashes

#: Examples of each class that an index holds at most, and the commonest words whose idf every task has.
EXAMPLES = {0: 3_000, 1: 2_000}
TABLE = 1 << 18
#: Weight of words that do not tell the classes apart; those that do have 1.
PLAIN = 0.2
BLOCK = 64


def word_bags(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct words of each text, as sorted hashes, and their counts."""
    h, n = word_hashes(texts, ALPHANUMERIC)
    ends = np.cumsum(n)
    for a, b in zip(ends - n, ends):
        yield np.unique(h[a:b], return_counts=True)


def places_of(words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into sorted ``known``, and which of the words are there."""
    at = np.searchsorted(known, words)
    at[at == len(known)] = 0
    return at, known[at] == words if len(known) else np.zeros(len(words), bool)


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = stop - start
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


class BlockMaxIndex:
    """Exact top-k by cosine over unit vectors, pruned by block maxima."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, idf: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.idf = idf
        vectors = [self.unit(*c) for c in counts]
        # examples with the same strongest term stand in the same blocks
        order = sorted(range(len(ids)), key=lambda i: (vectors[i][0][np.argmax(vectors[i][1])] if len(vectors[i][0]) else -1, ids[i]))
        self.ids, self.labels = ids[order], labels[order]
        self.blocks = -(-len(order) // BLOCK) or 1
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, int)]).astype(np.int64)
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        value = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        by = np.lexsort((place, term))
        term, self.place, self.value = term[by], place[by], value[by]
        # an entry is the postings of a term in a block
        key = term * self.blocks + self.place // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.first = np.append(first, len(key)).astype(np.int32)
        self.block = (key[first] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.ptr = np.searchsorted(term[first], np.arange(len(idf) + 1)).astype(np.int32)
        # where entries hold few postings, bounds cost about what they could save
        self.bounded = len(key) > 4 * len(first)

    def unit(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(count)) * self.idf[term]
        return term, v / max(np.sqrt((v * v).sum()), 1e-12)

    def search(self, term: np.ndarray, count: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k most alike, nearest first; only cosines over 0 count."""
        if not len(term):
            return np.zeros(0, int), np.zeros(0)
        term, q = self.unit(term, count)
        if not self.bounded:
            return self.scan(term, q, k, skip)
        start, stop = self.ptr[term], self.ptr[term + 1]
        entry, weight = ranges(start, stop), np.repeat(q, stop - start)
        block = self.block[entry]
        bound = np.bincount(block, weight * self.most[entry], minlength=self.blocks)
        places, cosines, least = np.zeros(0, int), np.zeros(0), 0.0
        order = np.argsort(-bound, kind="stable")
        at, size = 0, 4
        while at < len(order):
            some = order[at:]
            some = some[(bound[some] > 0) & (bound[some] >= least - 1e-12)]
            if not len(some):
                break
            if at and len(some) > self.blocks // 8:  # bounds that tell little: all at once, from the start
                at, places, cosines = len(order), np.zeros(0, int), np.zeros(0)
                start, stop, factor = self.first[self.ptr[term]], self.first[self.ptr[term + 1]], q
            else:
                visit = np.zeros(self.blocks, bool)
                visit[some[:size]] = True
                use = np.flatnonzero(visit[block])
                start, stop, factor = self.first[entry[use]], self.first[entry[use] + 1], weight[use]
                at, size = at + size, 2 * size
            post = ranges(start, stop)
            found = np.bincount(self.place[post], np.repeat(factor, stop - start) * self.value[post], minlength=len(self.ids))
            where = np.flatnonzero(found > max(least - 1e-12, 0))
            if skip is not None:
                where = where[where != skip]
            places, cosines = np.concatenate((places, where)), np.concatenate((cosines, found[where]))
            if len(places) > k:
                best = np.lexsort((self.ids[places], -np.round(cosines, 12)))[:k]
                places, cosines = places[best], cosines[best]
                least = cosines[-1]
        best = np.lexsort((self.ids[places], -np.round(cosines, 12)))[:k]
        return places[best], cosines[best]

    def scan(self, term: np.ndarray, q: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """What ``search`` finds, by all postings of the terms."""
        start, stop = self.first[self.ptr[term]], self.first[self.ptr[term + 1]]
        post = ranges(start, stop)
        found = np.bincount(self.place[post], np.repeat(q, stop - start) * self.value[post], minlength=len(self.ids))
        if skip is not None:
            found[skip] = 0
        least = np.partition(found, -k)[-k] if len(found) > k else 0.0
        places = np.flatnonzero(found > max(least - 2e-12, 0))
        best = np.lexsort((self.ids[places], -np.round(found[places], 12)))[:k]
        return places[best], found[places[best]]

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours, each weighted by the inverse of its distance."""
        w = 1 / (1.05 - np.minimum(cosines, 1))
        return float((w @ self.labels[places] + 0.5) / (w.sum() + 1))


def distinct_examples(hashes: list[np.ndarray], draws: int = 6, alike: int = 3) -> list[int]:
    """Examples without the near copies of earlier ones (half of their min-hashes agree), whose rare words would pass for evidence."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, h in enumerate(hashes):
        if not len(h):
            continue
        keys = [(d, int(mix64(h ^ np.uint64(d * 0x9E3779B97F4A7C15 % (1 << 64))).min())) for d in range(draws)]
        met = Counter(j for k in keys for j in seen.get(k, ()))
        if max(met.values(), default=0) < alike:
            kept.append(i)
            for k in keys:
                seen.setdefault(k, []).append(i)
    return kept


def choose_terms(hashes: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words whose presence depends on the class (chi-square over 20)."""
    kept = distinct_examples(hashes)
    hashes, label = [hashes[i] for i in kept], label[kept]
    words, at = np.unique(np.concatenate([np.unique(h) for h in hashes] or [np.zeros(0, np.uint64)]), return_inverse=True)
    row = np.repeat(np.arange(len(hashes)), [len(np.unique(h)) for h in hashes])
    n = np.maximum(np.bincount(label, minlength=2), 1)
    a = np.bincount(at, weights=label[row] == 1, minlength=len(words)) if len(at) else np.zeros(0)
    c = np.bincount(at, weights=label[row] == 0, minlength=len(words)) if len(at) else np.zeros(0)
    total, df = n.sum(), a + c
    chi = total * (a * (n[0] - c) - c * (n[1] - a)) ** 2 / np.maximum(n[0] * n[1] * df * (total - df), 1e-9)
    return words[(chi > 20) & (df >= 5)]


def document_frequencies(docs: DataFrame, flush: int = 1 << 20) -> DataFrame:
    """``(h, n)``: documents with each word, over the whole table."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts):
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        parts, size = [], 0
        for _, texts in text_batches(it):
            for words, _ in word_bags(texts):
                parts.append(words)
                size += len(words)
                if size > flush:
                    yield packed(parts)
                    parts, size = [], 0
        if size:
            yield packed(parts)

    return docs.select("doc_id", "text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: dict[int, int] | None = None, k: int = 15) -> dict:
    sample = labelled_sample(docs, labels, label, examples or EXAMPLES)

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, texts in text_batches(it, 3):
            bags = list(word_bags(texts))
            out = [pa.array([w.view(np.int64) for w, _ in bags], pa.list_(pa.int64())), pa.array([c for _, c in bags], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, *out], names=["doc_id", "label", "weight", "words", "counts"])

    sample = stored(sample.mapInArrow(hashed, "doc_id long, label int, weight double, words array<long>, counts array<long>"), "examples")
    rows = sample.toArrow()  # EXAMPLES rows
    if not rows.num_rows:
        return {"share": 0.0}
    flat = [rows.column(c).combine_chunks() for c in ("words", "counts")]
    cut = np.cumsum(flat[0].value_lengths().to_numpy())[:-1]
    words, counts = (np.split(x.flatten().to_numpy(), cut) for x in flat)
    rows = [(-1 if i is None else i, y, w, h.view(np.uint64), c) for i, y, w, h, c in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "label", "weight")), words, counts)]
    rows.sort(key=lambda r: (r[0], r[3].tobytes()))
    n = docs.count()
    frequencies = stored(document_frequencies(docs), "frequencies")
    # the grade of count from which words are in the table; counts up to 64 have grades of their own
    grade, least, room = F.floor(F.log2("n") * 64), 1 << 20, TABLE
    for r in frequencies.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect():  # 4096 rows at most
        room -= r["count"]
        if room < 0:
            break
        least = r.grade
    own = sample.select(F.explode("words").alias("h")).distinct()
    table = frequencies.where(grade >= least).union(frequencies.where(grade < least).join(own, "h", "left_semi")).toArrow()
    known, df = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(known)
    known, df = known[order], df[order]
    terms = choose_terms([r[3] for r in rows], np.array([r[1] for r in rows], int))
    scale = np.full(len(known), PLAIN)
    scale[places_of(terms, known)[0]] = 1
    counts = [(places_of(r[3], known)[0], r[4]) for r in rows]
    ids, label_, weight = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    index = BlockMaxIndex(ids, label_, scale * (np.log((n + 1) / (df + 1)) + 1e-3), counts)
    place = {i: p for p, i in enumerate(index.ids.tolist())}
    found = [index.search(*c, k, skip=place[int(i)]) for c, i in zip(counts, ids)]
    has = np.array([len(p) > 0 for p, _ in found])
    share = float((weight * label_)[~has].sum() / max(weight[~has].sum(), 1e-9)) if (~has).any() else float((weight * label_).sum() / weight.sum())
    votes = np.array([index.vote(*f) for f in found if len(f[0])])
    odds = np.log(votes / (1 - votes))
    curve = fit_logistic(np.c_[odds, np.ones(len(odds))], label_[has], weight[has]) if has.any() else np.zeros(2)
    return {"index": index, "known": known, "terms": terms, "documents": n, "curve": curve, "share": share, "k": k, "frequencies": frequencies}


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score, evidence)``; evidence lists the neighbours' ids, labels and cosines."""
    if "index" not in model:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(model["share"]).alias("score"), F.expr("cast(array() as array<struct<example:long, label:int, cosine:double>>)").alias("evidence"))
    held = docs.sparkSession.sparkContext.broadcast((model["index"], model["known"], model["k"]))
    kind = pa.list_(pa.struct([("example", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def searched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, k = held.value
        row = TaskContext.get().partitionId() << 40
        for (ids,), texts in text_batches(it):
            square, evidence, rest, tfs = [], [], [], []
            for words, count in word_bags(texts):
                at, inside = places_of(words, known)
                at, tf = at[inside], count[inside]
                places, cosines = index.search(at, tf, k)
                square.append(float((((1 + np.log(tf)) * index.idf[at]) ** 2).sum()))
                evidence.append([{"example": int(index.ids[p]), "label": int(index.labels[p]), "cosine": float(s)} for p, s in zip(places, cosines)])
                rest.append(words[~inside].view(np.int64) if len(places) else np.zeros(0, np.int64))
                tfs.append(count[~inside] if len(places) else np.zeros(0, np.int64))
            columns = [pa.array(row + np.arange(len(texts))), ids, pa.array(square, pa.float64()), pa.array(evidence, kind), pa.array(rest, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "square", "evidence", "hs", "tfs"])
            row += len(texts)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    per_doc = stored(narrow.mapInArrow(searched, "row long, doc_id long, square double, evidence array<struct<example:long, label:int, cosine:double>>, hs array<long>, tfs array<long>"), "searched")
    # the words of no table lengthen the vectors: cosines shrink by known length over whole length
    rare = per_doc.select("row", F.explode(F.arrays_zip("hs", "tfs")).alias("w")).select("row", F.col("w.hs").alias("h"), F.col("w.tfs").alias("tf"))
    idf = F.log(F.lit(model["documents"] + 1.0) / (F.coalesce("n", F.lit(0)) + 1)) + 1e-3
    longer = rare.join(model["frequencies"], "h", "left").groupBy("row").agg(F.round(F.sum(F.pow(PLAIN * (1 + F.log("tf")) * idf, F.lit(2))), 9).alias("more"))
    shrink = F.sqrt(F.col("square") / (F.col("square") + F.coalesce("more", F.lit(0.0))))
    scaled = per_doc.drop("hs", "tfs").join(longer, "row", "left").withColumn("shrink", shrink)
    scaled = scaled.withColumn("evidence", F.transform("evidence", lambda e: F.struct(e["example"].alias("example"), e["label"].alias("label"), (e["cosine"] * F.col("shrink")).alias("cosine"))))
    near = lambda e: 1 / (1.05 - F.least(e["cosine"], F.lit(1.0)))
    total = F.aggregate("evidence", F.lit(0.0), lambda s, e: s + near(e))
    toxic = F.aggregate("evidence", F.lit(0.0), lambda s, e: s + near(e) * e["label"])
    vote = (toxic + 0.5) / (total + 1)
    curve = [float(x) for x in model["curve"]]
    odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), curve[0] * F.log(vote / (1 - vote)) + curve[1]))
    return scaled.select("doc_id", F.when(F.size("evidence") > 0, 1 / (1 + F.exp(-odds))).otherwise(F.lit(model["share"])).alias("score"), "evidence")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scores(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
