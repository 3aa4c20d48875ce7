"""The near-duplicate stage finds every pair at the similarity, however texts meet."""

import numpy as np
import pyarrow as pa

from karst.llm import common, simhash
from tests.llm.test_simhash import check_similar


def test_every_pair_at_the_limit(spark):
    """Hundreds of pairs at 0.8 and a little more, of which rows that share a line are between; fewer would be met by luck."""
    rng = np.random.default_rng(7)
    line = [f"line{x}" for x in range(12)]
    rows = []
    for n in range(220):
        base = [f"w{x}" for x in rng.integers(0, 90_000, 50 + n % 40)]
        cut = len(base) // 9  # words in a row that differ at the end: (n - 4 - cut) of (n - 4 + cut) shingles are common
        cut -= 5 * (len(base) - 4 - cut) < 4 * (len(base) - 4 + cut)
        copy = [*base[: len(base) - cut], *[f"new{n}x{k}" for k in range(cut)]]
        other = [f"v{x}" for x in rng.integers(0, 90_000, 60)]
        rows += [base, copy, [*line, *other]]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    check_similar(docs)


def test_long_texts_that_meet_are_ruled_out_before_their_sets_move(spark, monkeypatch):
    """Unlike texts of 1,600 words, any two of which share a line of their own: more pairs than texts meet, none needs its sets."""
    rng = np.random.default_rng(8)
    n, plain, moved = 50, simhash._verified, []

    def counted(pairs, *rest):
        moved.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    rows = [[f"w{x}" for x in rng.integers(0, 900_000, 900)] + [f"l{min(i, j)}x{max(i, j)}y{k}" for j in range(n) if j != i for k in range(14)] for i in range(n)]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    assert simhash.similar_representatives(docs).count() == n
    assert sum(moved) <= n // 10


def test_rounds_join_what_pairs_join(spark):
    """A family of which all pairs are given, and pairs that are not similar: groups as by all pairs, with and without rounds."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 30, 60)
    sets = [[*base[:58].tolist(), int(5e9 + 2 * i) % (1 << 31), int(5e9 + 2 * i + 1) % (1 << 31)] for i in range(24)]
    sets += [[*s[:50], *rng.integers(0, 1 << 30, 10).tolist()] for s in sets[:3]]  # 50 of 70 in common
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "node long, shingles array<int>")
    pairs = [(i, j, float(abs(i - j) % 5)) for i in range(len(sets)) for j in range(i)]
    links = spark.createDataFrame([(1, 0)], "a long, b long")
    for few, rounds in ((0, 3), (10_000, 3)):
        scratch = simhash.Scratch(spark, "rounds")
        found = simhash._joined(spark.createDataFrame(pairs, "a long, b long, differ double"), links, table, 0.8, scratch, few, rounds)
        groups = simhash.connected_components(found, "a", "b").collect()
        assert sorted(r.node for r in groups) == list(range(24)) and {r.component for r in groups} == {0}


def test_fine_parities_of_sets_of_different_numbers_of_cells(spark):
    """Sets on both sides of a power of two are folded; what fine parities rule out is not similar, what is similar stays."""
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(-(1 << 31), 1 << 31, m).astype(np.int32)) for m in (1000, 1100, 2100, 30, 250, 270)]
    sets += [np.unique(np.concatenate((s[: len(s) * 9 // 10], rng.integers(-(1 << 31), 1 << 31, len(s) // 20).astype(np.int32)))) for s in sets]
    sets += [np.concatenate((s, rng.integers(-(1 << 31), 1 << 31, len(s) // 5).astype(np.int32))) for s in sets[:6]]
    rows = [(i, len(s), simhash._parity(s).tolist(), simhash._fine(s).tolist()) for i, s in enumerate(sets)]
    distinct = spark.createDataFrame(rows, "node long, size int, parity array<long>, fine array<long>")
    for similarity in (0.8, 0.4):
        near = [(i, j) for i in range(len(sets)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= similarity * max(len(sets[i]), len(sets[j]))]
        pairs = spark.createDataFrame(near, "a long, b long")
        kept = {(r.a, r.b) for r in simhash._sharper(pairs, distinct, similarity).collect()}
        alike = {(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= similarity * len(np.union1d(sets[i], sets[j]))}
        assert len(alike) >= 6 and alike <= kept
        assert similarity < 0.5 or len(kept) <= len(alike) + 3


def test_pairs_that_meet_stay_few(spark, monkeypatch):
    """Near copies at the limit, and texts any forty of which share a line that a small sample misses: groups as by all pairs, of which few are made."""
    rng = np.random.default_rng(11)
    base = [f"b{x}" for x in rng.integers(0, 90_000, 200)]
    rows = []
    for n in range(150):  # 176 of 216 shingles in common after two and two edits, fewer after three
        copy = list(base)
        for k in rng.choice(40, 2 + n % 2, replace=False):
            copy[5 * k] = f"e{n}x{k}"
        rows.append(copy)
    lines = [[f"line{i}x{k}" for k in range(9)] for i in range(60)]
    for n in range(400):
        shared = [w for i in rng.choice(60, 6, replace=False) for w in lines[i]]
        rows.append([*shared, *[f"v{x}" for x in rng.integers(0, 900_000, 200)]])
    plain, made = simhash._possible, []

    def counted(pairs, *rest):
        made.append(plain(pairs, *rest).count())
        return plain(pairs, *rest)

    monkeypatch.setattr(simhash, "_possible", counted)
    monkeypatch.setattr(simhash, "_SAMPLE", 10)
    check_similar(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3))
    assert sum(made) <= 8_000  # 32,617 with the order by some texts and without places


def test_long_sets_are_ruled_out_where_they_meet(spark):
    """Unlike sets that fill 512 cells; what is similar stays, whether both are long or one."""
    rng = np.random.default_rng(12)
    new = lambda m: rng.integers(-(1 << 31), 1 << 31, m).astype(np.int32)
    sets = [np.unique(new(m)) for m in (1500, 1600, 1950, 1030, 1010, 950)]
    sets += [np.unique(np.concatenate((s[: len(s) * 19 // 20], new(len(s) // 20)))) for s in sets]
    sets += [sets[3][: len(sets[3]) * 9 // 10]]  # not long, of one that is
    rows = [(i, len(s), simhash._parity(s).tolist(), simhash._parity(s, simhash._WIDE).tolist() if len(s) > simhash._LONG else None) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "node long, size int, parity array<long>, wide array<long>")
    side = lambda x: table.select(*[table[c].alias(f"{c}_{x}") for c in table.columns])
    kept = {(r.node_a, r.node_b) for r in simhash._possible(side("a").join(side("b")).where("node_a > node_b"), 0.8).collect()}
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    both_long = {(i, j) for i, j in kept if min(len(sets[i]), len(sets[j])) > simhash._LONG}
    assert len(alike) >= 7 and alike <= kept and both_long <= alike


def test_places_rule_out_late_meetings_alone(spark):
    """At the first shingle in common no similar pair is ruled out; unlike pairs are, where much stands before it."""
    rng = np.random.default_rng(13)
    none = (np.zeros(0, np.int32), np.zeros(0, np.int64))
    rows, alike = [], 0
    for n in range(300):
        a = np.unique(rng.integers(-(1 << 31), 1 << 31, 20 + n).astype(np.int32))
        b = np.unique(np.concatenate((rng.permutation(a)[: int(len(a) * rng.uniform(0.85, 1))], rng.integers(-(1 << 31), 1 << 31, int(len(a) * rng.uniform(0, 0.1))).astype(np.int32))))
        similar = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        pa, pb = (simhash._prefix(x, 0.8, none) for x in (a, b))
        first = np.intersect1d(pa, pb)[:1]  # the order is by hash here
        if similar:
            assert len(first)
            alike += 1
            rows.append((n, len(a), len(b), int(np.flatnonzero(pa == first)[0]), int(np.flatnonzero(pb == first)[0])))
    pairs = spark.createDataFrame([*rows, (-1, 100, 100, 12, 12), (-2, 100, 80, 0, 1)], "n int, size_a int, size_b int, place_a int, place_b int")
    assert alike >= 100 and {r.n for r in simhash._early(pairs, 0.8).collect()} == {r[0] for r in rows}


def test_workers_give_back_what_they_freed():
    """The rows are those of the plain function; afterwards neither tables of powers nor freed texts stay with the worker."""
    texts = pa.array([" ".join(f"w{i}x{k}" for k in range(300)) for i in range(3_000)])
    got = []

    def batches(it):
        for b in it:
            words, counts = common.word_hashes(common.as_bytes(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(counts)], ["n"])

    source = lambda: iter([pa.RecordBatch.from_arrays([texts], ["text"])] * 3)
    want = [b.column(0).to_pylist() for b in batches(source())]
    assert common._powers
    for b in common.lean(batches)(source()):
        got.append(b.column(0).to_pylist())
    assert got == want and got[0] == [300] * 3_000 and not common._powers
