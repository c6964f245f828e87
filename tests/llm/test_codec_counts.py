"""Encoding against the library, and token counts against brute force."""
import hashlib
import random
import struct

import pytest
import sentencepiece

from quire.llm import piece_codec, token_counts

from .helpers import awkward, crowded, documents, empty


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())


@pytest.fixture(scope="module")
def codec():
    return piece_codec.codec(piece_codec.default_model())


ALPHABETS = ["ab et hin▁ \n\té😀ßthe,.!|", "  \n▁a", "etaoin shrdlu", "ABCDE!! .,;'\"()[]{}<>/*_-\r\n",
             "日本語한국어 العربية ελ", "0123456789 .,x²µ", "éèñçüß̈́ a"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_texts_encode_and_decode_as_the_library(codec, library, alphabet):
    r = random.Random(alphabet)
    for _ in range(2500):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        got, decoded = codec.round_trip(text)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids, text
        assert decoded == library.decode(ids) == codec.decode(ids), text


def test_long_words_and_runs(codec, library):
    r = random.Random(4)
    for text in (" " * 1000, "x" * 3000, "ab" * 2000, "the" * 1500 + " " * 37 + "end", "a\n" * 500,
                 "".join(r.choice("abcdefghij") for _ in range(5000))):
        assert codec.encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_decode_of_broken_bytes(codec, library):
    by = codec.byte_id
    for ids in ([by[0xC3]], [by[0xC3], by[0xA9]], [by[0xE2], by[0x82], 300], [by[0xFF], by[0xFE]], [codec.unk, 300]):
        assert codec.decode(ids) == library.decode(ids)


def test_operator_on_awkward_rows(spark, library):
    rows = awkward()
    got = piece_codec.encode_decode(crowded(documents(spark, rows)), keep_ids=True).collect()
    want = []
    for d, t in ((r[0], r[1] or "") for r in rows):
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids))
    key = lambda x: (x[0] or 0, x[2])
    assert sorted([tuple(x)[:5] for x in got], key=key) == sorted(want, key=key)
    assert piece_codec.encode_decode(empty(spark)).count() == 0


def test_token_counts_equal_brute_force(spark):
    rows = awkward()
    enc = token_counts._encoder(token_counts.default_ranks())
    lengths = [len(enc.encode_ordinary(r[1] or "")) for r in rows]
    assert max(lengths) > 3 * token_counts.STRETCH
    sums = token_counts.token_counts(crowded(documents(spark, rows))).cache()
    got = {x.length: x for x in sums.collect()}
    assert set(got) == set(lengths)
    for n, x in got.items():
        assert x.n_docs == lengths.count(n)
        assert x.docs_upto == sum(k <= n for k in lengths) and x.docs_over == sum(k > n for k in lengths)
        assert x.tokens_over == sum(k for k in lengths if k > n) and x.tokens_upto == sum(k for k in lengths if k <= n)
        assert x.truncated_tokens == sum(min(k, n) for k in lengths)
        assert x.cut_tokens == sum(lengths) - x.truncated_tokens
        assert (x.total_docs, x.total_tokens) == (len(lengths), sum(lengths))
    limits = [0, 1, 7, 512, 2048, 10**6]
    for x in token_counts.at_limits(sums, limits).collect():
        assert x.truncated_tokens == sum(min(k, x.context_limit) for k in lengths), x
        assert x.docs_over == sum(k > x.context_limit for k in lengths)
    ordered = sorted(lengths)
    for x in token_counts.quantiles(sums, [0.01, 0.5, 0.9, 1.0]).collect():
        assert x.length == next(v for v in ordered if sum(k <= v for k in lengths) >= x.share * len(lengths))
    none = token_counts.token_counts(empty(spark))
    assert none.count() == 0
    assert [(x.truncated_tokens, x.total_docs) for x in token_counts.at_limits(none, [5]).collect()] == [(0, 0)]
