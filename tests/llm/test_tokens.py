"""Token counts and the piece codec against the libraries themselves."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frametriage.llm.common import tokenizer_file
from frametriage.llm.piece_codec import codec, piece_digests, piece_ids, piece_texts
from frametriage.llm.token_counts import pretokenizer, token_counts, units

WORD, PIECE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")
TEXTS = ["", None, " ", "\n", "  two  blanks ", "It's they'LL 'S don't", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "Ünïcödé é ΟΔΟΣ İstanbul ǅ", "x y\tz\r\n1234 ½ ²", "日本語 テキスト 🎉🎉", "\x00\x01\x1f", "<s> </s> <0x0A> <unk>", "▁▁ ▁", "word " * 3000, "same", "same", "no" + "o" * 5000]


def rows(spark, texts):
    return spark.createDataFrame([(i if i % 5 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, n int")


def token_totals(texts):
    t = pretokenizer(WORD).tokenizer
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_token_counts_match_library(spark, hot):
    got = sorted(map(tuple, token_counts(rows(spark, TEXTS), WORD, hot=hot, limit=100).collect()), key=str)
    want = sorted(((i if i % 5 else None, len((t or "").encode()), n, n > 100) for (i, t), n in zip(enumerate(TEXTS), token_totals(TEXTS), strict=True)), key=str)
    assert got == want


def test_empty_tables(spark):
    none = rows(spark, TEXTS).limit(0)
    assert token_counts(none, WORD).count() == 0
    assert piece_digests(none, PIECE).count() == 0


MIX = st.text(st.one_of(st.sampled_from("abeinst THE'.<|>\n ▁é日½12"), st.characters(exclude_categories=["Cs"])), max_size=60)


LATIN = st.text(st.one_of(st.sampled_from("aé'ß½²ªº0ŉİıſ.\xad\xa0 sS"), st.characters(min_codepoint=0x21, max_codepoint=0x260), st.just("\u0301")), max_size=12)


@settings(max_examples=1500, deadline=None)
@given(LATIN)
def test_latin_units_split_as_in_the_library(text):
    p = pretokenizer(WORD)
    want = [x for x, _ in p.tokenizer.pre_tokenizer.pre_tokenize_str(p.tokenizer.normalizer.normalize_str(text))]
    assert [x for u in units(text) for x in p.plain(u)] == want


@settings(max_examples=400, deadline=None)
@given(MIX)
def test_units_match_library(text):
    p = pretokenizer(WORD)
    assert sum(p.pieces(x) for u in units(text) for x in p.unit(u)) == len(p.tokenizer.encode(text, add_special_tokens=False))


@settings(max_examples=600, deadline=None)
@given(MIX)
def test_codec_matches_library(text):
    c = codec(PIECE)
    ids = np.frombuffer(c.encode(text), "<u4").tolist()
    assert ids == c.library.encode(text, add_bos=True, add_eos=True)
    assert c.decode(c.encode(text)) == c.library.decode(ids)


def test_digests(spark):
    lib = codec(PIECE).library
    got = {tuple(r) for r in piece_digests(rows(spark, TEXTS), PIECE).collect()}
    want = set()
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.add((i if i % 5 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == want


def test_ids_round_trip(spark):
    docs = rows(spark, TEXTS).where("doc_id is not null")
    back = {r.doc_id: r.text for r in piece_texts(piece_ids(docs, PIECE), PIECE).collect()}
    lib = codec(PIECE).library
    assert back == {i: lib.decode(lib.encode(t or "")) for i, t in enumerate(TEXTS) if i % 5}
