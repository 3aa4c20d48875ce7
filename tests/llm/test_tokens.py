import functools
import zlib

import numpy as np

from karst.llm import tokens
from karst.llm.common import new_path
from tests.llm.conftest import ODD, SF


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_bpe())


def direct(text):
    from tokenizers import Tokenizer

    ids = tokenizer().encode(text or "", add_special_tokens=False).ids + [1]
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids


def test_query_against_the_library(spark):
    got = tokens.op3_token_files(spark, SF).orderBy("start").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    at = 0
    assert len(got) == len(docs)
    for g, d in zip(got, docs):
        n, crc, _ = direct(d.text)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d.doc_id, at, n, crc)
        at += n


def test_odd_rows_and_round_trip(spark, odd, empty, clashing):
    want = sorted((i is not None, i or 0, direct(t)[2]) for i, t, *_ in ODD)
    for df in (odd, clashing):
        path = new_path(spark, "t")
        index = tokens.write_tokens(df, path, tokens.word_bpe())
        rows = tokens.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in rows) == want
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
        assert rows[-1].start + rows[-1].n_tokens == index["n_ids"]
    path = new_path(spark, "t")
    assert tokens.write_tokens(empty, path, tokens.word_bpe())["n_ids"] == 0
    assert tokens.read_tokens(spark, path).count() == 0


def test_small_cache_gives_the_same_ids():
    texts = [(t or "").encode() for _, t, *_ in ODD] * 3
    small, large = tokens.WordEncoder(tokens.word_bpe(), 1, max_words=5), tokens.WordEncoder(tokens.word_bpe(), 1)
    for t in texts:
        a, b = small.encode([t]), large.encode([t])
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert large.encode([])[0].tolist() == []


def test_words_end_only_where_pieces_do():
    rng = np.random.default_rng(3)
    parts = ["a", "Z", "don't", "'s", "’s", ".", ",,", "!", "|", "<|endoftext|>", "é", "é", "́", "ß", "İ", "Σ", "ς", "7", "½", " ", "  ", "\n", " ", "\x1c", "\x85", "-", "_", "中", "🙂", "‍", "#", "\\", "`", "ﬁ", "Å"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    ids, n = tokens.WordEncoder(tokens.word_bpe(), 1).encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [direct(t)[2] for t in texts]


def test_tokenizer_whose_pieces_hold_blanks(spark):
    """Not to be split into words: whole texts are encoded."""
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["The quick brown  fox, jumps.\nOver", "", " a", None]
    path = new_path(spark, "tokens")
    tokens.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, file)
    plain = Tokenizer.from_file(file)
    rows = {r.doc_id: list(r.ids) for r in tokens.read_tokens(spark, path, with_ids=True).collect()}
    assert rows == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert tokens.by_words(Tokenizer.from_file(tokens.word_bpe())) and not tokens.by_words(plain)
