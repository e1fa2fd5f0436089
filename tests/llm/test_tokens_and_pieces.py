"""Token counts and pieces against the libraries."""

import random
import struct

import public_tokenizers as PT
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm import pieces, queries, token_counts
from rows import ODD

BPE = PT.path("byte_bpe_50k.json")
PIECES = PT.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.load(BPE)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Model.load(PIECES))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pre_tokens_are_the_librarys(tokenizer):
    pre = token_counts.PreTokens(BPE, tokenizer)
    cut = lambda s: [s[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(s)]
    for c in range(0x300):
        ch = chr(c)
        for s in (f"a{ch}b 1{ch}2 .{ch}. {ch} {ch}{ch}x", f" {ch}a {ch}1 {ch}.", f"\n{ch} \n x{ch}", f"it's{ch}'ll '{ch}"):
            assert pre.split(s) == cut(s), (c, s)


def test_counts(spark, odd, none, tokenizer):
    want = sorted((str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD)
    for size in (0, 64):  # the table may not change a count
        got = token_counts.token_counts(odd, BPE, table_size=size)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got.collect())
    assert token_counts.token_counts(none, BPE).count() == 0


def test_token_query(spark, small, tokenizer):
    rows = {r.doc_id: r for r in queries.op1_token_counts(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs) and all(rows[d.doc_id].n_tokens == len(tokenizer.encode(d.text, add_special_tokens=False).ids) for d in docs)


def test_worker_cache_is_bounded(tokenizer):
    t = token_counts.TwoTier({" the": 1}, tokenizer, cache_size=10)
    words = [f" w{i}" for i in range(50)]
    assert t.count(words) == sum(len(tokenizer.encode(w, add_special_tokens=False).ids) for w in words) and len(t) <= 11


def test_pieces_equal_the_librarys(encoder, library):
    rng = random.Random(5)
    letters = " ab\n\t▁é日本語и🙂<>0x1​\x00 eetthheeiinngg"
    for k in range(1500):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        if k % 3 == 0:
            s = " ".join(rng.choice(encoder.model.pieces[259:]).replace("▁", rng.choice(["", " "])) for _ in range(6))
        assert encoder.encode(s) == library.encode(s), s
        assert encoder.decode(encoder.encode(s)) == library.decode(library.encode(s)), s


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(encoder, text):
    text = text.replace("▁", "")
    assert encoder.decode(encoder.encode(text)) == text


def test_piece_frames(spark, odd, none, library):
    got = pieces.encode(odd, PIECES)
    assert sorted((str(r.doc_id), str(r.ids)) for r in got.collect()) == sorted((str(i), str(library.encode(t or ""))) for i, t, *_ in ODD)
    assert all(r.roundtrip for r in got.collect())
    back = pieces.decode(got, PIECES)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t, *_ in ODD)
    assert pieces.encode(none, PIECES).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PIECES).collect() == [(1, None), (2, "")]


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _message(*fields):
    out = b""
    for n, v in fields:
        if isinstance(v, bytes):
            out += _varint(n << 3 | 2) + _varint(len(v)) + v
        elif isinstance(v, float):
            out += _varint(n << 3 | 5) + struct.pack("<f", v)
        else:
            out += _varint(n << 3) + _varint(v)
    return out


def unigram(scores):
    found = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(p, s, 1) for p, s in scores.items()]]
    body = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in found)
    return body + _message((2, _message((3, 1)))) + _message((3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


def test_unigram_viterbi_is_the_librarys_and_optimal():
    import sentencepiece

    rng = random.Random(3)
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "ba": -4.0, "▁a": -3.6, "aab": -5.2, "▁ab": -4.05, "abab": -6.3, "bb": -4.4}
    data = unigram(scores)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    encoder = pieces.Encoder(pieces.Model(data))
    for _ in range(300):
        s = "".join(rng.choice("aabb ") for _ in range(rng.randint(1, 12)))
        ids = encoder.encode(s)
        total = sum(encoder.score[i] for i in ids)
        best = [0.0] + [-1e9] * (len(s) + 1)
        text = "▁" + s.replace(" ", "▁")
        for end in range(1, len(text) + 1):
            best[end] = max(best[a] + scores[text[a:end]] for a in range(end) if text[a:end] in scores)
        assert abs(total - best[-1]) < 1e-4
        assert abs(total - sum(encoder.score[i] for i in library.encode(s))) < 1e-4
    assert encoder.decode(encoder.encode("abab ba")) == "abab ba"
    assert encoder.encode("aza") == library.encode("aza")
