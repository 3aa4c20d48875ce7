"""Removal of long repeated byte strings with families of suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier.
What has to be decided is, for each window of that many bytes, whether an equal
window starts earlier; the removed bytes are the union of the windows that do.

**Sampling.** Of each window the ``gram`` with the smallest hash is its anchor.
Equal windows have the same anchor at the same place, so only windows of equal
anchors need comparing. Windows that follow one another and share an anchor form
a run (some 25 windows). A task gathers some megabytes of text and settles runs
of the same bytes where it reads them, so a passage in very many documents
crosses the network once for each such gathering. Of the rest only the anchors'
hashes travel; anchors met once end there.

**Suffix arrays.** Runs whose anchor is met again are dealt to shards by anchor,
with their bytes. A shard takes runs of the same bytes as one: all but the
earliest repeat it as a whole. Where an anchor has several runs left, these
differ somewhere around it, and each of their windows must be compared: they are
filed in a logarithmic family of suffix arrays. Runs come in batches in document
order, a batch's suffixes are sorted (to the length that matters), scanned
against every level by merging, and those not met before become a level of their
own; levels of like size merge, so there are few. Hashes choose what meets;
whether strings are equal is decided by their bytes alone.

An anchor of very many different runs would fill one task. Anchors that have more
than their share of ``hot`` runs in a sample of the documents are not gathered by
hash at all: their windows are dealt one by one, by their own bytes, after
dropping those a batch holds twice. The sample decides routes, not results.

Texts move twice: to cut out the runs to compare, and to cut out what goes.
Anchors and spans travel as packed arrays. Shards are sized by the bytes of the
table; memory is bounded by chunk and shard.

Defined cases: a null text is empty; equal ids are ordered by a hash of their
text and then arbitrarily, and a null id comes first (such tables are written
out once with row numbers); texts shorter than ``length`` have no windows; very
long texts are read in overlapping pieces; an empty table gives no rows; further
columns are ignored. Removed bytes may cut UTF-8 characters: kept bytes are binary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import _power_table, as_bytes, documents, mix64, stored

PIECE = 1 << 20
#: Runs that a task gathers before it deals them out.
GATHERED = 400_000
#: Shards of a table at most; beyond that they grow with it.
MAX_BUCKETS = 200_000
#: Hot anchors that a list holds at most.
MAX_HOT = 1 << 18
ANCHORS = (("h", "<u8"), ("d", "<i8"), ("lo", "<i4"), ("n", "<i2"))
SPANS = (("d", "<i8"), ("lo", "<i8"), ("n", "<i8"))
ASKED = (("h", "<u8"), ("d", "<i8"), ("lo", "<i4"), ("n", "<i2"), ("hot", "<i1"))


#: Runs as they are dealt to shards; their bytes follow.
RUNS = (("h", "<u8"), ("d", "<i8"), ("lo", "<i4"), ("size", "<i4"), ("one", "<i1"))
#: Packed bytes from which they are compressed.
LEAST = 256


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if len(raw) >= LEAST else raw)


def widened(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], size, "zstd", asbytes=True) if size >= LEAST else blob[8:]


def pack(columns: dict[str, np.ndarray], layout: tuple, rows: np.ndarray | slice = slice(None), tail: bytes = b"") -> bytes:
    """Columns one after the other, ids and starts as differences, then ``tail``; compressed."""
    parts = []
    for name, kind in layout:
        v = columns[name][rows].astype(kind)
        parts.append((np.diff(v, prepend=v.dtype.type(0)) if name in ("d", "lo") else v).tobytes())
    return squeezed(len(v).to_bytes(8, "little") + b"".join(parts) + tail)


def _columns(raw: bytes, layout: tuple) -> tuple[dict[str, np.ndarray], int]:
    n, at, out = int.from_bytes(raw[:8], "little"), 8, {}
    for name, kind in layout:
        v = np.frombuffer(raw, kind, n, at)
        out[name] = np.cumsum(v, dtype=v.dtype) if name in ("d", "lo") else v
        at += v.nbytes
    return out, at


def unpack(blobs: list[bytes], layout: tuple) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {name: [np.zeros(0, kind)] for name, kind in layout}
    for b in blobs:
        for name, v in _columns(widened(b), layout)[0].items():
            parts[name].append(v)
    return {name: np.concatenate(x) for name, x in parts.items()}


def dealt(columns: dict[str, np.ndarray], layout: tuple, kind: int, by: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows for each bucket of a hash of column ``by``."""
    if not len(columns[by]):
        return
    bucket = (mix64(columns[by].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
    which = bucket[order[cut[:-1]]]
    blobs = [pack(columns, layout, order[a:b]) for a, b in zip(cut, cut[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.full(len(which), kind, np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


PACKED = "bucket int, kind int, blob binary"


def pieces(ids: list[int], texts: list[bytes], length: int, most: int = PIECE) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (id, offset, bytes) of about ``most`` bytes that together hold each window once."""
    out, size = [], 0
    for i, t in zip(ids, texts):
        for a in range(0, max(len(t) - length + 1, 0), most):
            piece = t[a : a + most + length - 1]
            if out and size + len(piece) > most + length:
                yield out
                out, size = [], 0
            out.append((i, a, piece))
            size += len(piece)
    if out:
        yield out


def runs(part: list[tuple[int, int, bytes]], length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor: anchor hash ``h``, content hash ``r``, id ``d``, first start ``lo``, windows ``n``, and ``at``, the first start among the bytes of all pieces."""
    raw = np.frombuffer(b"".join(t for *_, t in part), np.uint8)
    up, down = _power_table(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=prefix[1:])
    hashes = mix64((prefix[gram:] - prefix[:-gram]) * down[: len(raw) - gram + 1])
    bits = np.uint64(max(1, int(len(raw)).bit_length()))
    least = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)  # the leftmost of equal hashes
    span, wide = length - gram + 1, 1
    whole = len(raw) - length + 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[:whole], least[span - wide : span - wide + whole])
    sizes = np.array([len(t) for *_, t in part])
    first = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(part)), windows)
    start = np.arange(len(of)) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    anchor = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    lo, n, of = start[cut], np.diff(np.append(cut, len(start))), of[cut]
    at, hi = anchor[cut], lo + n + length - 1
    shape = ((at - lo).astype(np.uint64) << np.uint64(20)) + n.astype(np.uint64)
    content = mix64(mix64((prefix[hi] - prefix[lo]) * down[lo]) + shape)
    ids, offsets = np.array([p[0] for p in part], np.int64), np.array([p[1] for p in part], np.int64)
    return {"h": hashes[at], "r": content, "d": ids[of], "lo": lo - first[of] + offsets[of], "n": n, "at": lo}


def joined_spans(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ranges of window starts, sorted and merged where they meet."""
    order = np.lexsort((s["lo"], s["d"]))
    d, lo, hi = s["d"][order], s["lo"][order], (s["lo"] + s["n"])[order]
    if not len(d):
        return {"d": d, "lo": lo, "n": hi}
    # within a document the end reached so far, which a common offset keeps apart from other documents
    base = np.cumsum(np.diff(d, prepend=d[0]) != 0) * (hi.max() + 2)
    reach = np.maximum.accumulate(hi + base)
    first = np.flatnonzero(np.append(True, lo[1:] + base[1:] > reach[:-1]))
    return {"d": d[first], "lo": lo[first], "n": reach[np.append(first[1:], len(d)) - 1] - base[first] - lo[first]}


def repeats(a: dict[str, np.ndarray], raw: bytes, length: int) -> tuple[dict, dict]:
    """The earliest of the runs of equal bytes in ``raw``, and the spans of the others."""
    order = np.lexsort((a["lo"], a["d"], a["r"], a["h"]))
    a = {k: v[order] for k, v in a.items()}
    new = (np.diff(a["h"], prepend=~a["h"][:1]) != 0) | (np.diff(a["r"], prepend=~a["r"][:1]) != 0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = np.flatnonzero(~new)
    ends = a["at"] + a["n"] + length - 1
    for i, x, x_end, y, y_end in zip(again.tolist(), *(v.tolist() for v in (a["at"][again], ends[again], a["at"][first[again]], ends[first[again]]))):
        if raw[x:x_end] != raw[y:y_end]:  # equal hashes of unequal bytes: goes on as a run of its own
            new[i] = True
    return {k: v[new] for k, v in a.items()}, {k: a[k][~new].astype(np.int64) for k, _ in SPANS}


class SuffixFamily:
    """Sorted suffixes, cut at ``length`` bytes, in levels of geometrically growing size."""

    def __init__(self, length: int):
        self.kind, self.levels = f"S{length}", []

    def seen(self, suffixes: np.ndarray) -> np.ndarray:
        """Files a batch (rows of bytes, earliest first); says of each row whether an equal one came before."""
        keys = np.ascontiguousarray(suffixes).view(self.kind).ravel()
        order = np.argsort(keys, kind="stable")
        array = keys[order]
        met = np.append(False, array[1:] == array[:-1])
        for level in self.levels:
            at = np.searchsorted(level, array)
            at[at == len(level)] = 0
            met |= level[at] == array
        if len(new := array[~met]):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(np.sort(np.concatenate((a, b)), kind="stable"))  # merges two sorted runs
        out = np.empty(len(keys), bool)
        out[order] = met
        return out


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(uid, id, text)``, uid ordering the documents; the id itself where it can."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not base.groupBy("id").count().where("count > 1 or id is null").limit(1).count():
        return base.select(F.col("id").alias("uid"), "id", "text")
    return stored(base.withColumn("tie", F.xxhash64("text")).orderBy(F.asc_nulls_first("id"), "tie").withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "text"), "numbered")


def repeated_windows(rows: DataFrame, buckets: int, length: int = 100, gram: int = 48, hot: int = 100_000, batch: int = 1 << 15) -> DataFrame:
    """``rows(uid, text)`` to ``(uid, spans)``: packed ranges of the starts of windows that occur earlier; only texts that have some."""

    def gathered(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
        held, raw, size = [], [], 0
        for b in it:
            for part in pieces(b.column(0).to_pylist(), as_bytes(b.column(1)), length):
                found = runs(part, length, gram)
                found["at"] = found["at"] + size
                held.append(found)
                raw += [t for *_, t in part]
                size += sum(len(t) for *_, t in part)
                if sum(len(a["h"]) for a in held) >= GATHERED:
                    yield repeats({k: np.concatenate([a[k] for a in held]) for k in held[0]}, b"".join(raw), length)
                    held, raw, size = [], [], 0
        if held:
            yield repeats({k: np.concatenate([a[k] for a in held]) for k in held[0]}, b"".join(raw), length)

    def sampled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for firsts, _ in gathered(it):
            h, n = np.unique(firsts["h"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    share = max(1, min(64, hot // 1000))
    sample = rows.where(F.pmod(F.xxhash64("uid"), F.lit(share)) == 0).select("uid", "text").mapInArrow(sampled, "h long, n long")
    listed = sample.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > hot // share).orderBy(F.desc("n"), "h").limit(MAX_HOT).select("h").toArrow()
    busy = np.sort(listed.column(0).to_numpy().view(np.uint64))

    def anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for firsts, spans in gathered(it):
            one_by_one = np.isin(firsts["h"], busy)
            yield from dealt({k: v[~one_by_one] for k, v in firsts.items()}, ANCHORS, 0, "h", buckets)
            yield from dealt({k: v[one_by_one] for k, v in firsts.items()} | {"hot": np.ones(one_by_one.sum(), np.int8)}, ASKED, 2, "d", buckets)
            yield from dealt(joined_spans(spans), SPANS, 1, "d", buckets)

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for b in it:
            own = pa.array([k == 0 for k in b.column(1).to_pylist()], pa.bool_())
            blobs += b.filter(own).column(2).to_pylist()
            yield b.filter(pc.invert(own))
        a = unpack(blobs, ANCHORS)
        order = np.argsort(a["h"], kind="stable")
        new = np.diff(a["h"][order], prepend=~a["h"][order][:1]) != 0
        asked = order[~(new & np.append(new[1:], True))]  # anchors met again
        yield from dealt({k: v[asked] for k, v in a.items()} | {"hot": np.zeros(len(asked), np.int8)}, ASKED, 2, "d", buckets)

    matched = stored(rows.select("uid", "text").mapInArrow(anchors, PACKED).repartition(buckets, "bucket").mapInArrow(settle, PACKED), "matched")

    def by_text(layout: tuple):
        def grouped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = unpack([x for b in it for x in b.column(2).to_pylist()], layout)
            if layout == SPANS:
                a = joined_spans(a)
            order = np.argsort(a["d"], kind="stable")
            a = {k: v[order] for k, v in a.items()}
            cut = np.append(np.flatnonzero(np.diff(a["d"], prepend=~a["d"][:1])), len(a["d"]))
            for k in range(0, len(cut) - 1, 4096):
                c = cut[k : k + 4097]
                yield pa.RecordBatch.from_arrays([pa.array(a["d"][c[:-1]]), pa.array([pack(a, layout, slice(x, y)) for x, y in zip(c, c[1:])], pa.binary())], names=["uid", "packed"])

        return grouped

    def cut_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            hs, ds, los, text, one = [], [], [], [], []
            held: dict[bytes, int] = {}
            again: list[tuple[int, int, int]] = []
            for _, t, blob in sorted(zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist())):
                a = unpack([blob], ASKED)
                for h, d, lo, n, one_by_one in zip(*(a[k].tolist() for k, _ in ASKED)):
                    if not one_by_one:
                        hs.append(h)
                        los.append(lo)
                        text.append(t[lo : lo + n + length - 1])
                        ds.append(d)
                        one.append(False)
                        continue
                    for p in range(lo, lo + n):
                        w = t[p : p + length]
                        if w in held:
                            again.append((held[w], d, p))
                        else:
                            held[w] = len(text)
                            hs.append(int(mix64(np.frombuffer(w[: length // 8 * 8], "<u8") * np.arange(1, 2 * (length // 8), 2, dtype=np.uint64)).sum()))
                            one.append(True)
                            los.append(p)
                            text.append(w)
                            ds.append(d)
            # of equal windows of a batch the earliest goes on, the others repeat it
            repeat_d, repeat_lo = [], []
            for at, d, p in again:
                if (d, p) < (ds[at], los[at]):
                    d, p, ds[at], los[at] = ds[at], los[at], d, p
                repeat_d.append(d)
                repeat_lo.append(p)
            hs += [d % (1 << 64) for d in repeat_d]
            text += [b""] * len(repeat_d)
            columns = {"h": np.array(hs, np.uint64), "d": np.array(ds + repeat_d, np.int64), "lo": np.array(los + repeat_lo, np.int64), "size": np.array([len(t) for t in text], np.int64), "one": np.array(one + [True] * len(repeat_d), np.int8)}
            bucket = (mix64(columns["h"].copy()) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
            for x, y in zip(cut, cut[1:]):
                own = order[x:y]
                blob = pack(columns, RUNS, own, b"".join(text[i] for i in own.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([bucket[own[0]]], pa.int32()), pa.array([3], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for blob in (x for b in it for x in b.column(2).to_pylist()):
            raw = widened(blob)
            a, at = _columns(raw, RUNS)
            ends = at + np.cumsum(a["size"], dtype=np.int64)
            found += [(d, lo, raw[x:y], h, one) for h, d, lo, one, x, y in zip(*(a[k].tolist() for k in ("h", "d", "lo", "one")), (ends - a["size"]).tolist(), ends.tolist())]
        found.sort()
        family, spans = SuffixFamily(length), {"d": [], "lo": [], "n": []}

        def repeated(d: np.ndarray, lo: np.ndarray, n: np.ndarray) -> None:
            for k, v in zip(spans, (d, lo, n)):
                spans[k].append(v)

        # of runs of the same bytes the earliest stands for all; one that is empty is known to repeat
        met: set[bytes] = {b""}
        left, again, left_of = [], [], Counter()
        for x in found:
            if x[2] in met:
                again.append((x[0], x[1], max(1, len(x[2]) - length + 1)))
            else:
                met.add(x[2])
                if not x[4]:
                    left.append(x)
                    left_of[x[3]] += 1
        if again:
            repeated(*np.array(again, np.int64).T)

        def file(some: list) -> None:
            raw = np.frombuffer(b"".join(x[2] for x in some), np.uint8)
            sizes = np.array([len(x[2]) for x in some])
            windows = sizes - length + 1
            inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            at = inside + np.repeat(np.cumsum(sizes) - sizes, windows)
            seen = family.seen(np.lib.stride_tricks.sliding_window_view(raw, length)[at])
            repeated(np.repeat([x[0] for x in some], windows)[seen], (inside + np.repeat([x[1] for x in some], windows))[seen], np.ones(seen.sum(), np.int64))

        some, size = [], 0
        for x in left:
            if left_of[x[3]] > 1:
                some.append(x)
                size += len(x[2]) - length + 1
            if size >= batch:
                file(some)
                some, size = [], 0
        if some:
            file(some)
        if spans["d"]:
            yield from dealt(joined_spans({k: np.concatenate(v).astype(np.int64) for k, v in spans.items()}), SPANS, 1, "d", buckets)

    asked = matched.where("kind = 2").repartition(buckets, "bucket").mapInArrow(by_text(ASKED), "uid long, packed binary")
    cut = rows.select("uid", "text").join(asked.hint("merge"), "uid").select("uid", "text", "packed").mapInArrow(cut_out, PACKED)
    scanned = cut.repartition(buckets, "bucket").mapInArrow(scan, PACKED)
    spans = matched.where("kind = 1").union(scanned).repartition(buckets, "bucket")
    return spans.mapInArrow(by_text(SPANS), "uid long, packed binary").withColumnRenamed("packed", "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 48, hot: int = 100_000, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``(id_col, n_bytes, removed array<struct<start, size>>, kept binary)`` for each row of ``docs``."""
    rows = _numbered(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(MAX_BUCKETS, -(-total // bucket_bytes)))
    spans = repeated_windows(rows, buckets, length, gram, hot)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size, removed, kept = [], [], []
            for t, blob in zip(as_bytes(b.column(1)), b.column(2).to_pylist()):
                gone, out, at = [], [], 0
                if blob:
                    s = unpack([blob], SPANS)
                    s["n"] = s["n"] + length - 1
                    s = joined_spans(s)
                    for lo, n in zip(s["lo"].tolist(), s["n"].tolist()):
                        gone.append({"start": lo, "size": n})
                        out.append(t[at:lo])
                        at = lo + n
                out.append(t[at:])
                size.append(len(t))
                removed.append(gone)
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])

    joined = rows.join(spans.hint("merge"), "uid", "left").select("id", "text", "spans")
    return joined.mapInArrow(cut, "id long, n_bytes long, removed array<struct<start:long,size:long>>, kept binary").withColumnRenamed("id", id_col)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (n, r) -> n + r.size)").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(b[p:p + 99]) AS s FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS fresh FROM r)),
s AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM g GROUP BY doc_id, island),
o AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo) AS gone, count(*) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN spans IS NULL THEN b ELSE list_reduce([b[(CASE WHEN i = 1 THEN 1 ELSE his[i - 1] END):(CASE WHEN i > spans THEN n ELSE los[i] - 1 END)] FOR i IN range(1, spans + 2)], lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""
