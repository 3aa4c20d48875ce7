import zlib
from collections import Counter

from karst.llm import sharding
from karst.llm.common import new_path
from tests.llm.conftest import ODD, SF


def test_query_keeps_every_record_under_the_law(spark):
    rows = sharding.op5_shard(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((d.doc_id, len(d.text.encode()) + 16, zlib.crc32(d.text.encode())) for d in docs)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    by_id = [r.shard * 1000 + r.slot for r in sorted(rows, key=lambda r: r.doc_id)]
    assert abs(sum(x < y for x, y in zip(by_id, by_id[1:])) - len(by_id) / 2) < 40  # not in id order


def test_many_small_buckets_and_odd_rows(spark, odd, empty, clashing):
    for df in (odd, clashing):
        out = sharding.external_shuffle(df, 4, "coalesce(octet_length(text), 0) + 16", bucket_bytes=5_000)
        rows = out.select("record.doc_id", "record.text", "shard", "slot").collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(i), str(t)) for i, t, *_ in ODD)
        assert sorted((r.slot, r.shard) for r in rows) == [(i // 4, i % 4) for i in range(len(ODD))]
    assert sharding.external_shuffle(empty, 4).count() == 0


def test_written_shards(spark, real):
    path = new_path(spark, "shards")
    sharding.write_shards(sharding.external_shuffle(real, 5), path)
    back = spark.read.parquet(path)
    assert back.count() == real.count() and sorted(back.columns) == sorted([*real.columns, "shard", "slot"])


def test_slots_are_a_function_of_the_rows(spark, real):
    def dealt(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = sharding.external_shuffle(real.repartition(parts), 4, "octet_length(text)", bucket_bytes=20_000)
        return {r.doc_id: (r.shard, r.slot) for r in out.select("record.doc_id", "shard", "slot").collect()}

    try:
        assert dealt(3) == dealt(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_record_many_times(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 1000)
    same = spark.range(9_000).selectExpr("0L as id", "'x' as t", "map('k', 1) as m")
    rows = same.union(spark.range(1, 3_001).selectExpr("id", "'y'", "map('k', 2)"))
    out = sharding.external_shuffle(rows, 3, "100", bucket_bytes=60_000).selectExpr("record.id", "record.m['k'] as m", "shard", "slot").collect()
    assert Counter((r.id == 0, r.m) for r in out) == {(True, 1): 9_000, (False, 2): 3_000}
    assert sorted((r.slot, r.shard) for r in out) == [(i // 3, i % 3) for i in range(12_000)]
    tenths = Counter(r.slot // 400 for r in out if r.id == 0)
    assert len(tenths) == 10 and max(tenths.values()) < 1_100  # the copies lie among all others
