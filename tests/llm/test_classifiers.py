"""Held-out accuracy, exactness of the pruned index, and odd rows of both text classifiers."""

import math
from collections import Counter

import numpy as np
import pytest

from karst.llm import quality, toxicity
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def held_out(spark, query, label, sf):
    label_of = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)
    return [(label_of[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in label_of]


def test_quality_held_out(spark):
    rows = held_out(spark, quality.op6_quality, "quality", "/root/testdata/sf0.1")
    assert np.mean([y == p for y, _, p in rows]) > 0.97
    assert all(p == (s >= 0.3) for _, s, p in rows)


def test_toxicity_held_out(spark):
    rows = held_out(spark, toxicity.op4_toxicity, "toxic", "/root/testdata/sf0.1")
    assert np.mean([p for y, _, p in rows if y]) > 0.8
    assert np.mean([p for y, _, p in rows if not y]) < 0.03


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    terms, n = 40, 500
    counts = []
    for _ in range(n):
        t = np.unique(rng.integers(0, terms, rng.integers(0, 8)))
        counts.append((t, rng.integers(1, 5, len(t))))
    index = toxicity.BlockMaxIndex(np.arange(n), rng.integers(0, 2, n).astype(float), rng.random(terms) + 0.1, counts)
    dense = np.zeros((n, terms))
    for i, c in enumerate(counts):
        t, v = index.unit(*c)
        dense[i, t] = v
    dense = dense[index.ids]
    for c in counts[:200]:
        q = np.zeros(terms)
        t, v = index.unit(*c)
        q[t] = v
        s = dense @ q
        want = sorted((-round(x, 9), int(i)) for x, i in zip(s, index.ids) if x > 1e-12)[:15]
        places, cosines = index.search(*c, 15)
        assert [(-round(x, 9), int(index.ids[p])) for p, x in zip(places, cosines)] == want


def test_blocks_of_few_postings_are_scanned_without_bounds():
    """As the bounded search finds, ties, fewer than k and the text itself left out included; bounds are not even made."""
    rng = np.random.default_rng(1)
    n, terms = 400, 30_000
    counts = [(np.unique(rng.integers(0, terms, rng.integers(0, 60)) ** 2 // terms), None) for _ in range(n)]
    counts = [(t, rng.integers(1, 4, len(t))) for t, _ in counts]
    counts[7:12] = [counts[7]] * 5
    index = toxicity.BlockMaxIndex(np.arange(n), rng.integers(0, 2, n).astype(float), rng.random(terms) + 0.1, counts)
    assert not index.bounded
    place = np.argsort(index.ids)
    for k in (1, 15, 500):
        for i, c in enumerate(counts[:60]):
            found = []
            for index.bounded in (True, False):
                found += [index.search(*c, k), index.search(*c, k, skip=int(place[i]))]
            for a, b in zip(found[:2], found[2:]):
                assert a[0].tolist() == b[0].tolist() and np.allclose(a[1], b[1], atol=1e-12)


@pytest.mark.parametrize("table", [0, 1 << 18])
def test_toxicity_cosines_cover_all_words(spark, monkeypatch, table):
    """Evidence equals that of full vectors, words of no example included; only texts that share no word with an example have none."""
    monkeypatch.setattr(toxicity, "TABLE", table)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bags = {r.doc_id: dict(zip(*(x.tolist() for x in next(toxicity.word_bags([(r.text or "").encode()]))))) for r in docs.collect()}
    df = Counter(w for b in bags.values() for w in b)
    telling = set(model["terms"].tolist())
    weight = {w: (1 if w in telling else 0.2) * (math.log((len(bags) + 1) / (n + 1)) + 1e-3) for w, n in df.items()}
    vectors = {i: {w: (1 + math.log(c)) * weight[w] for w, c in b.items()} for i, b in bags.items()}
    length = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    examples = [i for i in model["index"].ids.tolist() if vectors[i]]
    assert 0 < len(telling) < len(df) / 100
    for r in toxicity.scores(docs, model).collect()[::5]:
        v = vectors[r.doc_id]
        dots = {i: sum(x * v[w] for w, x in vectors[i].items() if w in v) for i in examples}
        want = sorted((-round(d / length[i] / length[r.doc_id], 9), i) for i, d in dots.items() if d > 0)[:15]
        assert [-round(e.cosine, 9) for e in r.evidence] == pytest.approx([c for c, _ in want], abs=1e-8)
        assert all(dots[e.example] / length[e.example] / length[r.doc_id] == pytest.approx(e.cosine, abs=1e-8) for e in r.evidence)


def test_descent_reaches_the_margin():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(2, 50, 5), y)) for y in rng.integers(0, 2, 200)]
    y = np.array([-1.0 if r[0] == 0 else 1.0 for r in rows])
    w = quality.dual_coordinate_descent(rows, np.ones(50), y, np.full(200, 10.0), epochs=200)
    m = np.array([w[r].sum() / np.sqrt(len(r)) + w[-1] for r in rows])
    assert (m * y > 0.9).all()


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, odd, empty, clashing, module, label):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, 1, 0), (8, 0, 1), (9, 1, 0), (9, 1, 0), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")
    for df in (odd, clashing):
        model = module.train(df, labels, label)
        rows = module.scores(df, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 4}) == 1
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert module.scores(empty, model).count() == 0
    for none in (labels.limit(0), labels.where("doc_id = 4")):
        model = module.train(odd, none, label)
        assert all(0 <= r.score <= 1 for r in module.scores(odd, model).collect())
    assert module.train(empty, labels, label) is not None
