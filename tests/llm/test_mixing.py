import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from karst.llm import mixing
from tests.llm.conftest import ODD, SF


def brute_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = sum(size.values()) - sum(fixed.values())
        rest = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * size[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * size[s] for s in over}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_meets_targets(spark, sf):
    rows = mixing.op8_mix(spark, sf).collect()
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    count = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) for i, d in docs.items()}
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == count[r.doc_id] and 0 <= r.taken <= 3 * r.size
        size[docs[r.doc_id].source] += r.size
        taken[docs[r.doc_id].source] += r.taken
    want = brute_targets(size)
    assert len(rows) == len(docs)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
    for s in size:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(rows) == sorted(mixing.op8_mix(spark, sf).collect())


def test_tree_is_exact():
    q = np.array([7, 0, 1000, 31])
    parts = mixing.split_quotas(q, 16, 3)
    assert np.array_equal(sum(parts), q) and all((p >= 0).all() for p in parts)
    assert max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 4


def test_draws_cover_what_is_taken(spark, real):
    mix = mixing.mixed(real, shards=8)
    kept = mix.collect()
    assert all(sum(d.words for d in r.draws) == r.taken for r in kept)
    assert all(len({d["pass"] for d in r.draws}) == len(r.draws) for r in kept)
    out = mixing.mixture(mix).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in kept)
    per_shard = Counter(r.mix_shard for r in out)
    assert set(per_shard) <= set(range(8))


def test_odd_rows(odd, empty, clashing):
    rows = mixing.mixed(odd).select("record.*", "size", "taken", "source_size").collect()
    assert len(rows) == len(ODD)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    again = mixing.mixed(clashing).select("record.doc_id", "size", "taken", "source_size").collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in rows) == sorted((str(r.doc_id), r.size, r.taken) for r in again)
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixture(mixing.mixed(empty)).count() == 0


def test_words_come_through_the_tree(spark, real, monkeypatch):
    whole = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, *a: [np.zeros_like(x) for x in whole(q, n, *a)])
    assert not any(r.taken for r in mixing.mixed(real).collect())


@pytest.mark.parametrize("limit", [0, 100_000])
def test_more_sources_than_strata(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    docs = spark.range(6_000).selectExpr("id as doc_id", "repeat('a ', cast(1 + id % 7 as int)) as text", "concat('s', id % 2500) as source")
    rows = mixing.mixed(docs).select("record.source", "size", "taken", "target").collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    want = brute_targets(size)
    assert len(rows) == 6_000 and all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1 for s in size)
