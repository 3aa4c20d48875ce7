"""Token ids as flat binary files.

A part holds three files: ``.bin`` (little-endian unsigned ids, 16 bits where the
vocabulary allows and else 32), ``.off`` (n + 1 64-bit offsets in ids from the
part's start) and ``.doc`` (64-bit document ids). Documents are range-partitioned
and sorted by id, each partition streams one part, and the parts' bases are the
prefix sums of their lengths, kept in ``index.json``. A part is written under a
temporary name and moved when whole, so a repeated or lost task leaves either
nothing or the same files.

Words are encoded once for each worker and looked up after that, where the
tokenizer's pieces never reach across ASCII blanks, nor from a letter to
punctuation, so that a text's ids are its words' ids in turn. The cache is
bounded and refills; results don't depend on it. For other tokenizers (those
whose pieces hold blanks, say) whole texts are encoded.

Defined cases: a null text is empty and gets the end id alone; a null id sorts
first and is stored as the least 64-bit integer (read back as null); repeated
ids stand side by side, ordered by a hash of their text; an empty table gives no
parts and no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import as_bytes, chunks, documents, new_path

NULL_ID = -(1 << 63)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~")] = True
_PUNCTUATION[ord("|")] = False  # part of the names of special tokens
#: Ends a text among the words of several; no UTF-8 text has this byte.
_END = b"\xff"


#: The pattern of pieces, all else removed, of a splitter that drops blanks and parts letters from punctuation.
WORD_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(tokenizer) -> bool:
    """Whether the tokenizer is known to drop blanks and to part letters from punctuation."""
    step = json.loads(tokenizer.to_str()).get("pre_tokenizer") or {}
    step = step["pretokenizers"][0] if step.get("type") == "Sequence" else step
    split = step.get("type") == "Split" and step.get("pattern") == {"Regex": WORD_PIECES} and step.get("behavior") == "Removed" and step.get("invert")
    return bool(split or step.get("type") in ("Whitespace", "BertPreTokenizer"))


class WordEncoder:
    """Encodes whole texts, where the tokenizer allows it through a bounded table of encoded words.

    Besides blanks, a word ends between an ASCII letter and ASCII punctuation
    other than an apostrophe: the tokenizer always starts a new piece there.
    """

    def __init__(self, file: str, end_id: int | None, max_words: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.max_words = Tokenizer.from_file(file), end_id, max_words
        self.by_words = by_words(self.tokenizer)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {_END: 0}
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0
        if self.end_id is not None:
            self.flat[0], self.size[0], self.used = self.end_id, 1, 1

    def learn(self, new: list[bytes]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.index), int(sizes.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.start) < n + len(new):
            self.start, self.size = np.concatenate((self.start, np.zeros_like(self.start))), np.concatenate((self.size, np.zeros_like(self.size)))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.start[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(new)] = sizes
        self.used += total
        self.index.update(zip(new, range(n, n + len(new))))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_words:
            end = [] if self.end_id is None else [self.end_id]
            each = [e.ids + end for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        if len(self.index) > self.max_words:
            self.clear()
        raw = np.frombuffer(b" \xff ".join(texts) + b" \xff", np.uint8)
        breaks = np.flatnonzero(_LETTER[raw[:-1]] & _PUNCTUATION[raw[1:]]) + 1
        words = np.insert(raw, breaks, 32).tobytes().split()
        if new := sorted(set(words).difference(self.index)):
            self.learn(new)
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes, starts = self.size[codes], self.start[codes]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[codes == 0], prepend=0)


_encoders: dict[tuple, WordEncoder] = {}


def encoder(file: str, end_id: int | None) -> WordEncoder:
    """One encoder for each Python worker."""
    if (file, end_id) not in _encoders:
        _encoders[file, end_id] = WordEncoder(file, end_id)
    return _encoders[file, end_id]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write ``docs`` in ascending id order; returns the index (also at ``path/index.json``)."""
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer_file).get_vocab_size(True), (end_id or 0) + 1) <= 1 << 16 else 4
    store, root = _store(path)
    store.create_dir(root, recursive=True)

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        k, tag = TaskContext.get().partitionId(), uuid.uuid4().hex
        enc, files, n_docs, n_ids = encoder(tokenizer_file, end_id), {}, 0, 0
        for b in it:
            texts = as_bytes(b.column(1))
            for i, j in chunks(texts):
                if not files:
                    files = {x: store.open_output_stream(f"{root}/.{tag}.{x}") for x in ("bin", "off", "doc")}
                    files["off"].write(np.zeros(1, "<i8").tobytes())
                ids, sizes = enc.encode(texts[i:j])
                files["bin"].write(ids.astype(f"<u{width}").tobytes())
                files["off"].write((n_ids + np.cumsum(sizes)).astype("<i8").tobytes())
                files["doc"].write(b.column(0).slice(i, j - i).fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
                n_docs, n_ids = n_docs + j - i, n_ids + int(sizes.sum())
        for x, f in files.items():
            f.close()
            store.move(f"{root}/.{tag}.{x}", f"{root}/part-{k:06d}.{x}")
        if files:
            yield pa.RecordBatch.from_pydict({"part": [k], "n_docs": [n_docs], "n_ids": [n_ids]})

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("id", "tie")
        .sortWithinPartitions("id", "tie")
        .select("id", "text")
    )
    parts, base = [], 0
    for r in sorted(ordered.mapInArrow(part, "part long, n_docs long, n_ids long").collect()):  # a row for each partition
        parts.append({"part": r.part, "base": base, "n_docs": r.n_docs, "n_ids": r.n_ids})
        base += r.n_ids
    index = {"width": width, "parts": parts, "n_ids": base}
    with store.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps(index).encode())
    return index


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``, and ``ids`` if asked, from the files at ``path``."""
    store, root = _store(path)
    with store.open_input_file(f"{root}/index.json") as f:
        index = json.loads(f.read())
    parts, dtype = index["parts"], f"<u{index['width']}"

    def opened(store: pafs.FileSystem, name: str, kind: str) -> np.ndarray:
        if isinstance(store, pafs.LocalFileSystem):
            return np.memmap(name, kind, "r") if os.path.getsize(name) else np.zeros(0, kind)
        with store.open_input_file(name) as f:
            return np.frombuffer(f.read_buffer(), kind)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for k in chain.from_iterable(b.column(0).to_pylist() for b in it):
            p = parts[k]
            ids, off, doc = (opened(store, f"{root}/part-{p['part']:06d}.{x}", kind) for x, kind in (("bin", dtype), ("off", "<i8"), ("doc", "<i8")))
            for a in range(0, len(doc), 4096):
                o = off[a : a + 4097].tolist()
                each = [ids[x:y].astype("<u4") for x, y in zip(o, o[1:])]
                n = len(each)
                out = {"doc_id": [None if d == NULL_ID else d for d in doc[a : a + n].tolist()], "start": [p["base"] + x for x in o[:-1]], "n_tokens": [y - x for x, y in zip(o, o[1:])], "ids_crc32": [zlib.crc32(x.tobytes()) for x in each]}
                arrays = [pa.array(v, pa.int64()) for v in out.values()]
                if with_ids:
                    arrays.append(pa.array([x.tolist() for x in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*out, *["ids"] * with_ids])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, tokenizer_file or word_bpe())
    return read_tokens(spark, path)
