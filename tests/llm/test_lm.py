import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from karst.llm import lm
from tests.llm.conftest import ODD, SF


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def brute(docs):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in docs if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        w = toks(t)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", [64, 1 << 18])
def test_counts_and_base_against_brute_force(spark, monkeypatch, table):
    monkeypatch.setattr(lm, "TABLE", table)
    monkeypatch.setattr(lm, "CLASSES", 32)
    got = sorted((tuple(r) for r in lm.op9_lm_scores(spark, SF).collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 0


def test_model_beats_base_on_held_out_texts(spark):
    rows = [r for r in lm.op9_lm_scores(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one():
    m = lm.LogBilinear(np.full(9, 1 / 9))
    rng = np.random.default_rng(0)
    for _ in range(20):
        m.step(*rng.integers(0, 9, (3, 50)), rng, np.cumsum(m.noise), 0.1, 8)
    i = np.arange(81)
    s = m.predicted(i // 9, i % 9) @ m.parts["output"].T + m.parts["bias"]
    p = 10 ** (s / np.log(10) - m.log10_normalisers()[:, None])
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_model_learns_a_cycle():
    """After one class always comes the next."""
    m, rng = lm.LogBilinear(np.full(6, 1 / 6)), np.random.default_rng(0)
    c = np.arange(60_000) % 6
    for a in range(2, len(c) - 500, 500):
        m.step(c[a - 1 : a + 499], c[a - 2 : a + 498], c[a : a + 500], rng, np.cumsum(m.noise), 0.1, 48)
    i = np.arange(6)
    s = m.predicted((i + 5) % 6, (i + 4) % 6) @ m.parts["output"].T + m.parts["bias"]
    assert (s.argmax(1) == i).all()


def test_classes_grow_with_the_vocabulary():
    """Words beyond the commonest differ as targets and as contexts; probabilities sum to one over the classes."""
    words = np.random.default_rng(1).integers(1, 1 << 63, 4_000, dtype=np.uint64)
    classes = lm.Classes(words[:300], 300)
    c = classes.of(words[300:])
    assert classes.is_shared[c].all() and len(np.unique(c)) == 300
    model, rng = lm.TwoLevel(np.full(601, 1 / 601)), np.random.default_rng(0)
    cumulative = np.cumsum(model.bands.noise), np.cumsum(model.classes.noise)
    one = rng.permutation(601).astype(np.int32)
    for _ in range(30):
        model.step(one, one, (one + 1) % 601, rng, cumulative, 0.1, 48)
    every = np.arange(601, dtype=np.int32)
    p = np.array([10 ** model.log10_probability(np.full(601, x), np.full(601, x), every) for x in c[:5]])
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    assert len(np.unique(c[:5])) > 1 and np.ptp(p, axis=0).max() > 0


def test_all_words_have_neural_probabilities(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "CLASSES", 8)
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda docs, classes, share, *a: seen.append((classes, share)) or train(docs, classes, share, *a))
    v = []
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        lm.lm_scores(docs)
        v.append(len({w for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in toks(r.text)}))
    for (classes, share), n in zip(seen, v):
        assert 4 * math.sqrt(n) <= classes.size <= 4 * math.sqrt(n) + 2 and share.sum() == pytest.approx(1)
    assert seen[1][0].size > seen[0][0].size


def test_odd_rows(odd, empty, clashing):
    want = brute([(i, t) for i, t, *_ in ODD])
    for df in (odd, clashing):
        got = sorted((tuple(r) for r in lm.lm_scores(df).collect()), key=str)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and math.isfinite(g[6])
    assert lm.lm_scores(empty).count() == 0
    alone = lm.lm_scores(odd.where("doc_id = 0")).collect()
    assert alone == []


def test_scores_do_not_depend_on_partitions(spark, real, monkeypatch):
    monkeypatch.setattr(lm, "COPY_TOKENS", 1 << 14)  # several copies
    scores = [{r.doc_id: r.score for r in lm.lm_scores(real.repartition(n)).collect()} for n in (1, 8)]
    assert len(scores[0]) == real.count()
    assert all(abs(scores[0][i] - scores[1][i]) <= 1e-6 * (1 + abs(scores[0][i])) for i in scores[0])
