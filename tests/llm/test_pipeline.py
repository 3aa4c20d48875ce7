import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from karst.llm import quality, tokens
from karst.llm.common import documents, stored
from tests.llm.conftest import ODD, SF
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_similar
from tests.llm.test_tokens import direct


def check_stages(spark, docs, sf_dir):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        after = stored(stage(spark, docs, sf_dir), "t")
        rows = after.collect()
        if name == "quality classifier":
            model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
            score = quality._scorer(model)
            want = [r for r in before if score([(r.text or "").encode()])[0] >= 0.3]
            assert Counter(rows) == Counter(want)
        elif name == "SimHash near-dedup":
            group = brute_similar([r.text for r in before])
            of = defaultdict(list)
            for r, g in zip(before, group):
                of[g].append((r.doc_id is None, r.doc_id or 0))
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted(min(x) for x in of.values())
            assert all(r in before for r in rows)
        elif name == "benchmark decontamination":
            bad = Counter(x[0] for x in brute_hits([(r.doc_id, r.text) for r in before], bench) if x[5])
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before) - bad
        elif name == "mixing sources to target weights":
            count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            size, got = defaultdict(int), defaultdict(int)
            for r in before:
                size[r.source] += count(r.text)
            for r in rows:
                got[r.source] += count(r.text)
            for s, t in brute_targets(size).items():
                assert abs(got[s] - t) <= 3
            whole = {(r.doc_id, r.text) for r in before}
            cut = [r for r in rows if (r.doc_id, r.text) not in whole]
            assert all(n == 1 for n in Counter(r.source for r in cut).values())
        else:
            want = sorted(direct(r.text)[:2] for r in before)
            assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == want
            at = 0
            for r in sorted(rows, key=lambda r: r.start):
                assert r.start == at
                at += r.n_tokens
        if name != "token files":
            assert after.columns == docs.columns
        docs = after
    return docs


def test_every_stage_against_a_plain_version(spark):
    assert check_stages(spark, documents(spark, SF), SF).count() > 50


def test_odd_rows_pass_every_stage(spark, odd):
    check_stages(spark, odd, SF)


def test_empty_table_and_clashing_columns(spark, empty, clashing):
    for df in (empty, clashing):
        for _, stage in corpus_pipeline.STAGES:
            df = stored(stage(spark, df, SF), "t")
        assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 50
