"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each document gets a 64-bit fingerprint of its word shingles. Two fingerprints
that differ in at most ``2 r`` bits share a point within ``r`` bits of both, so
every distinct fingerprint emits all points of its ball of radius ``r`` and
fingerprints that meet in a point are linked. All fingerprints that meet in a
point are within ``2 r`` of one another, so linking neighbours in the sorted
bucket keeps every connection without writing out its pairs, and a bucket never
holds more fingerprints than the ball has points (65 for r = 1), whatever the
data.

``similar_representatives`` serves another rule, Jaccard similarity of sets of
five-word shingles, and is exact (up to equal 32-bit hashes): under one order of all
shingles two sets of similarity t share one of the first ``n - ceil(t n) + 1`` of each
(prefix filter), so texts that meet in such a shingle are all candidates there are.
Shingles frequent in a share of the texts stand last in the order, which costs or saves
comparisons and changes no result; the share is fixed, so that what counts as rare does
not grow with the table. First each text is compared with the predecessors it shares
most with, which joins copies in chains; where texts meet they stand in the order of
minimal hashes, another in each of eight kinds of points, so that like texts follow one
another. Then come all pairs that meet and are still in different groups, less those
that sizes, places or parities of the sets rule out: what stands before the first
shingle in common differs; 512 cells where the texts meet and 2,048 if both are long,
then cells that grow with the sets, since long sets fill any fixed number. Sets of shingles move for the pairs that are left.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle give one shingle of the whole sequence; a null
id takes part in a group but is never its smallest id; an empty table gives no
rows. Of other columns, of any type, only a hash of the whole row is taken, to
tell rows of equal ids apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.llm.common import Scratch, as_bytes, documents, hashable, lean, mix64, stored, text_batches, word_hashes
from karst.llm.components import connected_components

_FINGERPRINTS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint: bit j is set if it is set in over half the shingle hashes."""
    words = text.lower().split()  # bytes: ASCII case and ASCII blanks only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
    ends = ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 15):  # bounds the unpacked bits of a very long text
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    set_bits = np.flatnonzero(2 * counts > len(starts)).tolist()
    return sum(1 << j for j in set_bits)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, row, fp)``: row is a hash of all columns, fp the fingerprint as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([simhash(t, shingle, seed) for t in as_bytes(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], schema=_FINGERPRINTS)

    return docs.select(F.col(id_col).cast("long").alias("id"), _row(docs).alias("row"), F.col(text_col).alias("text")).mapInArrow(batches, "id long, row long, fp long")


def _row(docs: DataFrame) -> Column:
    return F.xxhash64(*hashable(docs))


def _ball(radius: int, bits: int) -> Column:
    """All masks of at most ``radius`` of ``bits`` bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << j) for m in masks for j in range(bits)}
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in sorted(masks)])


def ball_links(fps: DataFrame, radius: int = 1) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints of ``fps.fp`` at most ``2 * radius`` bits apart.

    Links are enough to connect all that are that near; not every pair is listed.
    """
    meet = Window.partitionBy("point").orderBy("fp")
    return (
        fps.select("fp", F.explode(F.transform(_ball(radius, 64), lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
        .select(F.col("fp").alias("a"), F.lag("fp").over(meet).alias("b"))
        .where(F.col("b").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * radius))
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 1, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id_col, fp, component_id)``: one row per row of ``docs``; component_id is the smallest id reachable."""
    marked, classes = _classes(docs, id_col, text_col, radius, shingle, seed)
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 1, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group the one of smallest id (of equal ids any one, null ids last)."""
    marked, classes = _classes(docs, id_col, text_col, radius, shingle, seed)
    first = marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
    stays = first.join(classes, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("__id"), F.col("first.row").alias("__row"))
    return _keep(docs, stays, id_col)


def _keep(docs: DataFrame, stays: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``(__id, __row)``, of equal ones one; joined by the row's hash alone, so that texts move once."""
    rows = docs.withColumns({"__key": F.col(id_col).cast("long"), "__hash": _row(docs)})
    same_id = F.expr("coalesce((__key ^ __id) = 0, __key is null and __id is null)")  # not a join key, or dropping repeated rows would move texts again
    kept = rows.join(stays.hint("merge"), (F.col("__hash") == F.col("__row")) & same_id, "left_semi")
    return kept.dropDuplicates(["__hash", "__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int, shingle: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(id, row, fp)`` of each row and ``(fp, root, component_id)`` of each distinct fingerprint."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fps")
    parts = connected_components(ball_links(distinct, radius), "a", "b")
    rooted = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, stored(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-classes")


_SKETCH = pa.schema(
    [("id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("minima", pa.int64()), ("parity", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64())), ("fine", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int32()))]
)
_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int32()))])
_PARITY = 8  # words of 64 bits
_LONG, _WIDE = 1_000, 32  # shingles of a set of which parities in more such words are kept as well
_PREDECESSORS = 4  # of a text, compared before all others
_SAMPLE, _SHARE, _FREQUENT = 4_000, 1 / 8, 100_000  # texts at least, of all texts, shingles; for the order alone
_SHUFFLES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], np.uint32)  # odd multipliers
_STEP = np.uint64(0x9FB21C651E98DF25)  # odd multiplier of the shingle's polynomial


def _shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text's word hashes, sorted; fewer words: the one of all."""
    n = min(shingle, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _STEP + words[k : len(words) - n + 1 + k]
    return np.unique(mix64(h))


def _short(shingles: np.ndarray) -> np.ndarray:
    """The set by 32-bit hashes, sorted."""
    return np.unique((shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32)


def _parity(shingles: np.ndarray, words: int = _PARITY) -> np.ndarray:
    """For each of 64 * ``words`` cells whether it holds an odd number of shingles: two sets differ in at least as many shingles as cells."""
    odd = np.bincount(shingles.view(np.uint32) % np.uint32(64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _fine(shingles: np.ndarray) -> np.ndarray:
    """Parities in two to four cells a shingle, their number a power of two; a set of few shingles needs no more than ``_parity`` has."""
    words = 1 << max(0, int(np.ceil(np.log2(max(1, len(shingles)) / 32))))
    return _parity(shingles, words) if words > _PARITY else np.zeros(0, np.int64)


def _minima(shingles: np.ndarray) -> int:
    """A byte of the minimal shingle in each of eight orders: the likelier equal the more two sets have in common."""
    least = np.array([(shingles.view(np.uint32) * m).min() for m in _SHUFFLES]) if len(shingles) else np.zeros(8, np.uint32)
    return int(((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).view(np.int64)[0])


def _prefix(shingles: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first ``n - ceil(similarity n) + 1`` shingles in the common order: frequent ones last, rarer first, then by hash."""
    names, counts = frequent
    rank = np.zeros(len(shingles), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
        rank = np.where(names[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))[: len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1]]


def _sets(texts: list[bytes], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(node, shingles)`` of each text; node is a hash of the words, led by 16 bits of the least shingle hash."""
    words, counts = word_hashes(texts)
    for part in np.split(words, np.cumsum(counts)[:-1]):
        s = _shingle_set(part, shingle)
        lead = int(s[0]) >> 48 if len(s) else 0
        node = lead << 48 | xxhash.xxh3_64_intdigest(part.tobytes()) >> 16
        yield node - (node >> 63 << 64), s


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(id, row, node, size, minima, parity, wide, fine, prefix)`` of each row; no prefix without words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, rows), texts in text_batches(it, 2):
            node, size, minima, parity, wide, fine, prefix = [], [], [], [], [], [], []
            for n, s in _sets(texts, shingle):
                s = _short(s)
                node.append(n)
                size.append(len(s))
                minima.append(_minima(s))
                parity.append(_parity(s))
                wide.append(_parity(s, _WIDE) if len(s) > _LONG else None)
                fine.append(_fine(s))
                prefix.append(_prefix(s, similarity, frequent) if len(s) else s)
            longs = [pa.array(x, pa.list_(pa.int64())) for x in (parity, wide, fine)]
            plain = [pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(minima, pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, rows, *plain, *longs, pa.array(prefix, pa.list_(pa.int32()))], schema=_SKETCH)

    return docs.select(F.col(id_col).cast("long").alias("id"), _row(docs).alias("row"), F.col(text_col).alias("text")).mapInArrow(
        lean(batches), "id long, row long, node long, size int, minima long, parity array<long>, wide array<long>, fine array<long>, prefix array<int>"
    )


def _frequent(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, numbers of texts) of those that several of the texts picked by hash share."""
    share = min(1.0, max(_SHARE, _SAMPLE / max(1, docs.count())))
    some = docs.where(F.pmod(_row(docs), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sets = shingle_sets(some, text_col, shingle).dropDuplicates(["node"])
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(_FREQUENT)
    names, n = (c.to_numpy() for c in counts.toArrow().combine_chunks().columns)
    order = np.argsort(names)
    return names[order], n[order]


def shingle_sets(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``(node, shingles)`` of each row: the set of its shingles by 32-bit hashes, made anew from the text rather than kept."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(it, 0):
            node, sets = [], []
            for n, s in _sets(texts, shingle):
                node.append(n)
                sets.append(_short(s))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int32()))], schema=_SETS)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(batches), "node long, shingles array<int>")


def _sets_of(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The sets of shingles of the nodes of the pairs ``(a, b)``, each once."""
    wanted = scratch.stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    return scratch.stored(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose sets of shingles have the Jaccard similarity or more."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"of_{n}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    total, common = F.size("of_a") + F.size("of_b"), F.size(F.array_intersect("of_a", "of_b"))
    near = F.least(F.size("of_a"), F.size("of_b")) >= similarity * F.greatest(F.size("of_a"), F.size("of_b"))
    return both.where(near & (common >= similarity * (total - common) - 1e-9)).select("a", "b")


def _joined(pairs: DataFrame, links: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch, few: int, rounds: int = 4) -> DataFrame:
    """``links`` and those of the pairs ``(a, b, differ)`` that are similar, less some whose texts are in one group by others.

    While there are more than ``few``, every group verifies its likeliest pair with
    another one, and pairs inside the groups this makes need no sets to be moved;
    after some rounds all that are left are verified.
    """
    for _ in range(rounds):
        if pairs.count() <= few:
            break
        part = scratch.stored(connected_components(links, "a", "b"), "parts")
        side = lambda n: part.select(F.col("node").alias(n), F.col("component").alias(f"in_{n}"))
        parted = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "differ", F.coalesce("in_a", "a").alias("part_a"), F.coalesce("in_b", "b").alias("part_b"))
        parted = scratch.stored(parted.where("part_a <> part_b"), "parted")
        each = parted.select("a", "b", "differ", F.explode(F.array("part_a", "part_b")).alias("part"))
        best = scratch.stored(each.groupBy("part").agg(F.min(F.struct("differ", "a", "b")).alias("best")).select("best.a", "best.b").distinct(), "best")
        links = scratch.stored(links.union(_verified(best, sets, similarity)), "links")
        pairs = scratch.stored(parted.join(best, ["a", "b"], "left_anti").select("a", "b", "differ"), "pairs")
    return links.union(_verified(pairs, sets, similarity))


def _possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``(a, b, size_a, size_b, parity_a, parity_b, wide_a, wide_b)`` that sizes and parities do not rule out; wide ones are null for sets that are not long."""
    near = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9
    differ = sum((F.bit_count(F.col("parity_a")[w].bitwiseXOR(F.col("parity_b")[w])) for w in range(_PARITY)), F.lit(0))
    each = F.zip_with("wide_a", "wide_b", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    of_long = F.coalesce(F.aggregate(each, F.lit(0), lambda n, x: n + x), F.lit(0))
    return pairs.where(near & (differ <= _apart(similarity)) & (of_long <= _apart(similarity)))


def _early(pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs that may be similar if the shingle at ``place_a`` and ``place_b`` is the first in common, which it is where a similar pair meets first."""
    common = similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b"))
    return pairs.where(F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= common - 1e-6)


def _apart(similarity: float) -> Column:
    """In how many shingles sets of ``size_a`` and ``size_b`` may differ at most."""
    return (1 - similarity) / (1 + similarity) * (F.col("size_a") + F.col("size_b")) + 1e-6


def _sharper(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, differ)`` of those of the pairs ``(a, b)`` of near sizes that fine parities do not rule out either; the longer array is folded to the shorter."""
    side = lambda n: distinct.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.when(F.size("fine") > 0, F.col("fine")).otherwise(F.col("parity")).alias(f"fine_{n}"))
    n = F.least(F.size("fine_a"), F.size("fine_b"))
    word = lambda c, w: F.get(c, w).bitwiseXOR(F.coalesce(F.get(c, w + n), F.lit(0).cast("long")))
    differ = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, w: s + F.bit_count(word("fine_a", w).bitwiseXOR(word("fine_b", w))))
    within = F.greatest(F.size("fine_a"), F.size("fine_b")) <= 2 * n  # always, for similarities over a half
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("differ", F.when(within, differ).otherwise(0))
    return both.where(F.col("differ") <= _apart(similarity)).select("a", "b", (F.col("differ") / (F.col("size_a") + F.col("size_b"))).alias("differ"))


def similar_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group the one of smallest id (of equal ids any one, null ids last).

    Groups are chains of texts whose sets of word shingles have a Jaccard
    similarity of ``similarity`` or more; texts of the same words are one, those
    without words too. No link between different groups is missed: every pair that
    shares a shingle of its prefixes is compared unless its texts are in one group
    already. The sets of shingles are made anew, twice and only for texts to be
    verified, and what is stored is removed before the texts move.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    sets = shingle_sets(docs, text_col, shingle)
    marked = scratch.stored(sketches(docs, id_col, text_col, shingle, similarity, _frequent(docs, text_col, shingle)), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    distinct = scratch.stored(marked.groupBy("node").agg(first, *[F.min(c).alias(c) for c in ("size", "minima", "parity", "wide", "fine", "prefix")]), "nodes")
    turned = F.expr("shiftleft(minima, 8 * pmod(point, 8)) | shiftrightunsigned(minima, 64 - 8 * pmod(point, 8))")
    meet = Window.partitionBy("point").orderBy("turned", "node")
    met = distinct.select("node", "size", "minima", F.posexplode("prefix").alias("place", "point")).select("point", "node", "size", "place", turned.alias("turned"))
    met = met.select("point", "node", "place", *[f(c).over(meet).alias(f"{c}_{name}") for f, name, c in ((F.lag, "b", "node"), (F.lag, "b", "size"), (F.lead, "after", "node"))], "size")
    near = F.least("size", "size_b") >= similarity * F.greatest("size", "size_b") - 1e-9
    met = scratch.stored(met.where("node_b is not null or node_after is not null").select("point", "node", "place", F.when(near, F.col("node_b")).alias("before")), "met")
    pairs = met.where("before is not null").groupBy(F.col("node").alias("a"), F.col("before").alias("b")).agg(F.count("*").alias("meets"))
    most = Window.partitionBy("a").orderBy(F.desc("meets"), "b")
    pairs = pairs.withColumn("r", F.row_number().over(most)).where(F.col("r") <= _PREDECESSORS).select("a", "b")
    first_pairs = scratch.stored(_sharper(pairs, distinct, similarity), "first")
    links = scratch.stored(_verified(first_pairs, _sets_of(first_pairs, sets, scratch), similarity), "links")
    part = scratch.stored(connected_components(links, "a", "b"), "parts")
    parted = scratch.stored(met.join(part, "node", "left").select("point", "node", "place", F.coalesce("component", "node").alias("part")), "parted")
    mixed = parted.groupBy("point").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("point")
    parted = parted.join(mixed, "point", "left_semi").join(distinct.select("node", "size", "parity", "wide"), "node")
    side = lambda x: parted.select("point", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "part", "place", "size", "parity", "wide")])
    apart = side("a").join(side("b"), "point").where("node_a > node_b and part_a <> part_b")
    rest = _possible(_early(apart, similarity), similarity).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    rest = scratch.stored(_sharper(rest, distinct, similarity).join(first_pairs, ["a", "b"], "left_anti"), "rest")
    links = scratch.stored(_joined(rest, links, _sets_of(rest, sets, scratch), similarity, scratch, distinct.count()), "links")
    part = connected_components(links, "a", "b")
    rooted = distinct.join(part, "node", "left").groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("first").alias("first"))
    stays = stored(rooted.select(F.col("first.id").alias("__id"), F.col("first.row").alias("__row")), "simhash-stays")
    scratch.clear()
    return _keep(docs, stays, id_col)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
