import hashlib
import random
import re

import pytest

from karst.llm import decontaminate
from tests.llm.conftest import ODD, SF


def brute(docs, items):
    def toks(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = {}
    for i, t in items:
        w = toks(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = toks(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(docs, bench):
    from pyspark.sql import functions as F

    out = decontaminate.contamination(docs, bench)
    return sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()), key=str)


def test_query_against_its_sql(spark, duck):
    got = decontaminate.op10_decontaminate(spark, "/root/testdata/sf0.01")
    rows = sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect())
    assert rows == sorted(duck("/root/testdata/sf0.01", decontaminate.ORACLE_SQL))
    assert any(r[0] for r in rows)


@pytest.mark.parametrize("limit", [60, 500_000])
def test_random_texts_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)  # several scans and one
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "Q7", "é", "x_y", "d-e"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 5, 12, 13, 14, 20, 30, 30])] + [(None, "zz yy xx"), (11, None), (3, "odd one out")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(100 + i, " ".join([word() for _ in range(9)] + [t or ""] + [word() for _ in range(k)])) for k in (0, 4, 300) for i, (_, t) in enumerate(items)]
    docs += [(None, None), (5, ""), (5, "zz yy xx"), (5, "zz yy xx")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert run(d, b) == brute(docs, items)
    assert run(d.limit(0), b) == [] and run(d, b.limit(0)) == brute(docs, [])


def test_odd_rows(spark, odd, clashing):
    items = [(1, "same text here twice over and over again"), (2, ODD[8][1][:400])]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(i, t) for i, t, *_ in ODD], items)
    assert run(odd, b) == want and run(clashing, b) == want
