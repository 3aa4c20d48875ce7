import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.llm import suffixes
from tests.llm.conftest import ODD, SF


def brute(docs, length):
    """docs in order; (n_bytes, n_removed, n_spans, sha256) of each."""
    seen, out = set(), []
    for t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if (w := t[p : p + length]) in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def digest(found):
    return found.select("n_bytes", F.expr("aggregate(removed, 0L, (n, r) -> n + r.size)"), F.size("removed").cast("long"), F.sha2("kept", 256))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = [(d.doc_id, *x) for d, x in zip(docs, brute([d.text.encode() for d in docs], 100))]
    got = sorted(tuple(r) for r in suffixes.op2_suffix_dedup(spark, sf).collect())
    assert got == want and any(x[2] for x in want)


@pytest.mark.parametrize("hot,piece", [(100_000, 4 << 20), (0, 4 << 20), (2, 97)])
def test_random_texts(spark, monkeypatch, hot, piece):
    """Few letters, shared passages, periodic texts; every anchor split up, and texts read in small pieces."""
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes.pieces, "__defaults__", (piece,))
    rng = random.Random(hot + piece)
    passage = [bytes(rng.choices(b"abcd", k=rng.randrange(5, 60))) for _ in range(6)]
    docs = []
    for _ in range(120):
        parts = [rng.choice(passage) if rng.random() < 0.6 else bytes(rng.choices(b"ab", k=rng.randrange(1, 12))) for _ in range(rng.randrange(0, 12))]
        docs.append(b"".join(parts) * rng.choice([1, 1, 1, 3]))
    docs += [b"a" * 300, b"ab" * 100, b"a" * 11, b"", b"abc" * 40 + b"\x00" * 40, b"\x00" * 50]
    rows = [(i * 7 - 50, d.decode()) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "text")
    found = suffixes.without_repeats(df, length=20, gram=9, hot=hot, bucket_bytes=2000)
    got = {r.doc_id: tuple(r)[1:] for r in found.select("doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (n, r) -> n + r.size)"), F.size("removed").cast("long"), F.sha2("kept", 256)).collect()}
    assert [got[i] for i, _ in rows] == brute(docs, 20)


def test_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    family, seen = suffixes.SuffixFamily(8), set()
    for _ in range(60):
        batch = rng.integers(0, 3, (50, 8), np.uint8)
        want = []
        for row in batch:
            want.append(row.tobytes() in seen)
            seen.add(row.tobytes())
        assert family.seen(batch).tolist() == want
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_odd_rows(odd, empty, clashing):
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    want = sorted(brute([(t or "").encode() for _, t, *_ in order], 100))
    for df in (odd, clashing):
        assert sorted(tuple(r) for r in digest(suffixes.without_repeats(df)).collect()) == want
    assert suffixes.without_repeats(empty).count() == 0


def test_query_against_its_sql(spark, duck):
    got = suffixes.op2_suffix_dedup(spark, SF)
    assert sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == sorted(duck(SF, suffixes.ORACLE_SQL))


def test_equal_hashes_of_unequal_bytes(spark, monkeypatch):
    """Whatever the hashes say, bytes decide: here all anchors and all contents hash alike."""
    whole = suffixes.runs

    def alike(*args):
        found = whole(*args)
        return found | {"h": found["h"] * np.uint64(0) + np.uint64(7), "r": found["r"] * np.uint64(0)}

    monkeypatch.setattr(suffixes, "runs", alike)
    rng = random.Random(3)
    passage = "".join(rng.choices("abcd", k=200))
    docs = ["".join(rng.choices("abcd", k=300)) + (passage if i % 3 == 0 else "") for i in range(12)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(2)
    got = sorted(tuple(r) for r in suffixes.without_repeats(df).select("doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (n, r) -> n + r.size)"), F.size("removed").cast("long"), F.sha2("kept", 256)).collect())
    assert got == [(i, *x) for i, x in enumerate(brute([d.encode() for d in docs], 100))]
