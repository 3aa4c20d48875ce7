import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from karst.llm import simhash
from tests.llm.conftest import SF


def brute_fingerprint(text):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(fps):
    group = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2 and group[i] != group[j]:
                group = [group[i] if g == group[j] else g for g in group]
    return group


def brute_shingles(text, shingle=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    n = min(shingle, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def brute_similar(texts):
    """Group of each text: chains of a Jaccard similarity of 0.8 or more of sets of five-word shingles."""
    sets, group = [brute_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if group[i] != group[j] and 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                group = [group[i] if g == group[j] else g for g in group]
    return group


def check_similar(docs):
    rows = docs.collect()
    least = {}
    for r, g in zip(rows, brute_similar([r.text for r in rows])):
        key = (r.doc_id is None, r.doc_id or 0)
        least[g] = min(least.get(g, key), key)
    got = simhash.similar_representatives(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(least.values())
    assert all(r in rows for r in kept)


def test_similar_documents_against_brute_force(spark, odd, empty, clashing):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd, empty, clashing):
        check_similar(docs)


def test_similar_copies_with_few_words_changed(spark):
    """Single edits, a chain whose ends are far apart, and texts that share half their words and stay."""
    rng = np.random.default_rng(3)
    texts = []
    for n in (60, 120, 400):
        base = [f"w{x}" for x in rng.integers(0, 5_000, n)]
        texts.append(base)
        for k in range(8):  # one word changed, at different places
            texts.append(base[: 6 * k + 3] + [f"new{n}x{k}"] + base[6 * k + 4 :])
        for k in range(4):
            texts.append(base[: n // 2] + [f"other{x}" for x in rng.integers(0, 5_000, n // 2)])
        step = list(base[::-1])
        for k in range(0, n, 20):
            step = [*step[:k], f"s{n}x{k}", *step[k + 1 :]]
            texts.append(step)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    check_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_similar_in_a_large_family(spark):
    """Hundreds of near copies of one text are one group, found with fewer comparisons than pairs."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 9_000, 200)]
    rows = [(i, " ".join([*base[:i % 190], f"v{i}", *base[i % 190 + 1 :]])) for i in range(600)]
    kept = simhash.similar_representatives(spark.createDataFrame([*rows, (9_999, "alone in this table")], "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9_999]


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in simhash.op1_simhash_near_dedup(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    group = brute_components(fps)
    for d, f, g in zip(docs, fps, group):
        assert got[d.doc_id].fingerprint == f"{f:016x}"
        assert got[d.doc_id].component_id == min(x.doc_id for x, y in zip(docs, group) if y == g)
    assert len(got) == len(docs)


def test_chains_connect_over_many_steps(spark):
    """Fingerprints in a chain two bits apart are one component, three bits apart are not."""
    rng = np.random.default_rng(1)
    fps, x = [], 0
    for b in rng.permutation(64)[:60].reshape(-1, 2):
        x ^= (1 << int(b[0])) | (1 << int(b[1]))
        fps.append(x)
    lone = x ^ 0b111 if all((x ^ 0b111 ^ f).bit_count() > 2 for f in fps) else x ^ 0xFFFF
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in [*fps, lone]]
    links = simhash.ball_links(spark.createDataFrame(rows, "fp long"))
    from karst.llm.components import connected_components

    parts = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    assert {parts[r[0]] for r in rows[:-1]} == {min(r[0] for r in rows[:-1])}
    assert rows[-1][0] not in parts


def test_odd_rows(odd, empty, clashing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[1].fp == 0
    assert {by[i].component_id for i in (4, 5)} == {4}
    assert {by[i].component_id for i in (7, 8)} == {7}
    assert by[None].component_id is None
    assert simhash.near_duplicates(empty).count() == 0
    assert sorted(map(str, simhash.near_duplicates(clashing).collect())) == sorted(map(str, rows))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 40_000])
def test_lengths(n):
    text = " ".join(f"W{i * i % 991}" for i in range(n))
    assert simhash.simhash(text.encode()) == brute_fingerprint(text)
