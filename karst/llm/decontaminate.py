"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's k-grams of words are hashed and the smallest hash of every ``w``
consecutive k-grams is kept, with ``w + k - 1 = window``. Any shared span of
``window`` words then contains one whole run of w k-grams, so documents and
benchmark keep a common hash in it: nothing that counts can be missed. Kept
hashes are joined, and each hit is extended to the windows around it, whose
words are compared as text with the benchmark's windows.

Items shorter than a window are one window of their own length; winnowing
guarantees nothing for them, so the documents' word grams of each such length
(there are at most window - 1 of them) join the kept hashes.

One scan splits each text into words once, hashes them, meets the benchmark's
hashes, counts the words and cuts out the words around each hit. What it writes
is a row for each document and one for each hit; texts are never shuffled. The
benchmark's hashes are fixed-width rows and are broadcast in parts of at most
``BROADCAST_ROWS``, with a scan for each part, so a benchmark of any size is
met in bounded memory. A passage in very many documents is a skewed key with
few benchmark rows against it: the hits grow as its occurrences do. Benchmark
windows are made distinct before joining, so copies of an item do not multiply
hits.

Defined cases: null, empty or wordless texts have no words and are clean;
wordless items match nothing; a null item_id counts as one item named by the
empty string; repeated ids and rows are judged row by row; empty tables give
clean rows or no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import ascii_lower, documents, stored

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark hashes (a long and an int) that are broadcast at once.
BROADCAST_ROWS = 500_000
#: Low bits of a packed hash that hold the position, modulo their range.
_POS_BITS = 20
_MASK = (1 << _POS_BITS) - 1


def words(text: Column) -> Column:
    return F.array_remove(F.coalesce(F.split(ascii_lower(text), BETWEEN), F.array().cast("array<string>")), "")


def _shifted(array: str, by: int, step: str) -> str:
    """``step`` of each element ``a`` and the one ``by`` places on, ``b``; as many as there are such pairs."""
    return f"zip_with(slice({array}, 1, greatest(size({array}) - {by}, 0)), slice({array}, {by + 1}, greatest(size({array}) - {by}, 0)), (a, b) -> {step})"


def _with_grams(hashed: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``g1, g2, g4...`` and ``g<n>`` for each length: hashes of the n words from each position of ``g1`` on."""
    top = max([1, *lengths])
    n = 1
    while 2 * n <= top:
        hashed = hashed.withColumn(f"g{2 * n}", F.expr(_shifted(f"g{n}", n, "xxhash64(a, b)")))
        n *= 2
    for length in lengths:
        n = 1 << (length.bit_length() - 1)
        if n < length:  # the first n words and the last n overlap
            hashed = hashed.withColumn(f"g{length}", F.expr(_shifted(f"g{n}", length - n, f"xxhash64(a, b, {length})")))
    return hashed


def marks(texts: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """``texts(..., words)`` with ``kept``: winnowed k-gram hashes and the hashes of the short lengths, low bits replaced by positions."""
    width = window - k + 1
    out = _with_grams(texts.withColumn("g1", F.expr("transform(words, x -> xxhash64(x))")), sorted({k, *short}))
    out = out.withColumn("m1", F.expr(f"if(size(words) >= {window}, transform(g{k}, (g, i) -> (g & ~{_MASK}L) | (i & {_MASK})), cast(array() as array<bigint>))"))
    n = 1
    while 2 * n <= width:
        out = out.withColumn(f"m{2 * n}", F.expr(_shifted(f"m{n}", n, "least(a, b)")))
        n *= 2
    least = _shifted(f"m{n}", width - n, "least(a, b)") if n < width else f"m{n}"
    kept = [f"array_distinct({least})", *[f"transform(g{n}, (g, i) -> (xxhash64(g, {n}) & ~{_MASK}L) | (i & {_MASK}))" for n in short]]
    return out.withColumn("kept", F.expr(f"concat({', '.join(kept)})"))


def _each_kept() -> Column:
    """A null, and each kept hash. (Without the null the optimiser asks for non-empty arrays and so computes all of this twice.)"""
    return F.explode(F.concat(F.array(F.lit(None).cast("long")), "kept")).alias("v")


def benchmark_windows(bench: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """``bench(item, text)`` to ``(item, gram, len)`` of each window, ``(fp, len)`` of the hashes to meet, and the short lengths."""
    items = stored(bench.select("item", words(F.col("text")).alias("words")).where(F.size("words") > 0), "bench")
    short = sorted(r.n for r in items.where(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect())  # window - 1 at most
    cut = F.expr(f"transform(sequence(0, greatest(size(words) - {window}, 0)), i -> array_join(slice(words, i + 1, {window}), ' '))")
    grams = stored(items.select("item", F.explode(cut).alias("gram"), F.least(F.size("words"), F.lit(window)).alias("len")).distinct(), "bench-grams")
    whole = marks(items, window, k, []).select(_each_kept(), F.lit(window).alias("len"))
    for n in short:
        one = marks(items.where(F.size("words") == n), window, k, [n])
        whole = whole.union(one.select(_each_kept(), F.lit(n).alias("len")))
    return grams, stored(whole.where("v is not null").select(F.shiftright("v", _POS_BITS).alias("fp"), "len").distinct(), "bench-fps"), short


def scanned(docs: DataFrame, met: DataFrame, window: int, k: int, short: list[int], counted: bool = True) -> DataFrame:
    """``docs(row, id, text)`` and broadcast ``met(fp, len)`` to ``(row, id, n, near)``.

    Each hit is a row whose ``near`` has the windows to compare around it, each
    with its first word's position; each document is, if ``counted``, a row more
    with null for them.
    """
    found = marks(docs.select("row", "id", words(F.col("text")).alias("words")).withColumn("n", F.size("words")), window, k, short)
    rows = found.select("row", "id", "n", "words", _each_kept())
    hit = rows.withColumn("fp", F.shiftright("v", _POS_BITS)).join(F.broadcast(met), "fp", "left").where(F.col("len").isNotNull() | (F.col("v").isNull() & F.lit(counted)))
    starts = (  # of long texts, at every position that the low bits can mean
        f"flatten(transform(sequence(cast(v & {_MASK} as int), n - 1, {1 << _POS_BITS}), p -> "
        f"if(len < {window}, array(p), sequence(greatest(p - {window - k}, 0), greatest(least(p, n - {window}), 0)))))"
    )
    near = F.expr(f"if(len is null, null, transform(filter({starts}, s -> s + len <= n), s -> struct(s as start, array_join(slice(words, s + 1, len), ' ') as gram)))")
    return hit.select("row", "id", "n", "len", near.alias("near"))


def hits(docs: DataFrame, bench: DataFrame, window: int = 13, k: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs(id, text)``, ``bench(item, text)`` to ``(row, id, n)`` of each document, ``(row, start, len, gram)`` of each occurrence of a distinct benchmark window, and ``(item, gram, len)``."""
    grams, met, short = benchmark_windows(bench, window, k)
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    parts = max(1, -(-met.count() // BROADCAST_ROWS))
    part = F.pmod(F.xxhash64("fp", "len"), F.lit(parts))
    if parts > 1:  # several scans must agree on the numbers
        numbered = stored(numbered, "numbered")
    found = stored(reduce(DataFrame.union, [scanned(numbered, met.where(part == p), window, k, short, p == 0) for p in range(parts)]), "scanned")
    near = found.where("near is not null").select("row", "len", F.explode("near").alias("w")).select("row", "w.start", "len", "w.gram").distinct()
    sure = near.join(grams.select("gram", "len").distinct(), ["gram", "len"], "left_semi").select("row", "start", "len", "gram")
    return found.where("near is null").select("row", "id", "n"), stored(sure, "hits"), grams


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, k: int = 6) -> DataFrame:
    """``(id_col, n_words, n_hit, n_items, items, spans, contaminated)`` for each row of ``docs``.

    ``spans`` are the merged hit runs (first word, number of words); a document
    is contaminated if it has hits and they are at least a twentieth of its words.
    """
    return _judged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), bench, item_col, item_text_col, window, k).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, k: int = 6) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    Equal texts are judged alike, so rows are told by 128 bits of their text's
    hash; the hashes are broadcast up to ``BROADCAST_ROWS`` rows and joined beyond.
    """
    text = F.col(f"`{text_col}`")
    mark = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    judged = _judged(docs.select(mark.alias("id"), text.alias("text")), bench, item_col, item_text_col, window, k)
    bad = stored(judged.where("contaminated").select(F.col("id.a").alias("__a"), F.col("id.b").alias("__b")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, (mark["a"] == F.col("__a")) & (mark["b"] == F.col("__b")), "left_anti")


def _judged(docs: DataFrame, bench: DataFrame, item_col: str, item_text_col: str, window: int, k: int) -> DataFrame:
    """``docs(id, text)`` to ``(id, n_words, n_hit, n_items, items, spans, contaminated)``."""
    rows, found, grams = hits(docs, bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")), window, k)
    runs = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop")))).alias("runs"))
    merged = runs.select(
        "row",
        F.expr(
            "aggregate(runs, cast(array() as array<struct<start:int,stop:int>>), (a, r) -> "
            "if(size(a) > 0 and r.start <= a[size(a) - 1].stop, "
            "concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start as start, greatest(a[size(a) - 1].stop, r.stop) as stop))), "
            "concat(a, array(r))))"
        ).alias("spans"),
    )
    named = found.select("row", "gram", "len").distinct().join(grams, ["gram", "len"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.expr("aggregate(coalesce(spans, array()), 0L, (n, s) -> n + s.stop - s.start)")
    return (
        rows.join(merged.join(named, "row"), "row", "left")
        .select("id", F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.expr("transform(coalesce(spans, array()), s -> struct(s.start as start, s.stop - s.start as n))").alias("spans"))
        .select("id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item, least(13, len(ws)) AS n, unnest([array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') FOR i IN range(1, greatest(len(ws) - 12, 1) + 1)]) AS g FROM b WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, lens.n, unnest(range(1, len(ws) - lens.n + 2)) AS i, unnest([array_to_string(ws[i:i + lens.n - 1], ' ') FOR i IN range(1, len(ws) - lens.n + 2)]) AS g FROM w, lens WHERE len(ws) >= lens.n),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""
