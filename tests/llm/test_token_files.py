"""Sequences of token ids in Arrow files: against the library, document by document and sequence by sequence."""
import os
import random
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import token_files

from .helpers import awkward, crowded, documents, empty


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(token_files.default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["<|endoftext|> a<|startoftext|>b", "é Å ²½ ﬁ x y\u0085z\x1cq", "İI ΟΔΟΣ ΟΔΟΣ. ßẞ", "a\tb\r\n\x0bc\x0cd  e",
       " ́x", "x ́", "'s it's 12'LL  'll", "日本語 テキスト のテスト。", "\x00\x01 ퟿", "👩‍👩‍👧 a‍b"]


def encoded(enc, texts):
    """Ids of each text, end id included."""
    ids, n = enc.encode(pa.array(texts, pa.string()))
    assert n.sum() == len(ids) and len(n) == len(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_words_encoded_alone_equal_whole_texts(library):
    enc = token_files.Encoder(token_files.default_tokenizer(), 2)
    assert enc.by_word and enc.code == "H"
    texts = ODD + [r[1] for r in awkward()]
    want = [ids_of(library, t) for t in texts]
    for _ in range(2):      # the second time from the memo
        assert encoded(enc, texts) == want
    enc.older, enc.memo = enc.memo, {b"": b""}
    assert encoded(enc, texts) == want
    assert encoded(enc, [None]) == [[2]] and encoded(enc, ["<|endoftext|>"]) == [ids_of(library, "<|endoftext|>")]
    enc.by_word = False
    assert encoded(enc, texts) == want


def test_random_texts(library):
    r = random.Random(4)
    marks = list(" \t\n.,;:!?'\"()#<|>-_~^`\\/²½ªº́̈ßİıſΣςŉǅ日ア①ⅷ٣\u00a0\u2028\x1f\x85")
    words = ["word", "Word", "O'Neil", "it's", "IT'S", "'re", "x1y22", "é", "É", "Straße", "<|endoftext|>", "<|EndOfText|>", "ﬁn"]
    texts = ["".join(r.choice(words) if r.random() < 0.4 else r.choice(marks) for _ in range(60)) for _ in range(400)]
    enc = token_files.Encoder(token_files.default_tokenizer(), 2)
    assert encoded(enc, texts) == [ids_of(library, t) for t in texts]


def test_other_tokenizers_are_given_whole_texts():
    import public_tokenizers
    enc = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 50256)
    assert not enc.by_word
    want = enc.library.encode("two  words here", add_special_tokens=False).ids
    assert encoded(enc, ["two  words here"]) == [want + [50256]]


@pytest.mark.parametrize("length,rows", [(1024, 256), (7, 3), (1, 1)])
def test_round_trip_of_awkward_rows(spark, library, length, rows):
    given = awkward() + [(100 + i, t, "odd") for i, t in enumerate(ODD)]
    df = crowded(documents(spark, given)).withColumn("start", F.lit("x"))
    folder = tempfile.mkdtemp(prefix="quire-seq-") + "/out"
    m = token_files.write_sequences(df.repartition(3), folder, length=length, rows=rows)
    got = sorted(token_files.read_documents(m, keep_ids=True).collect(), key=lambda r: r.start)
    assert len(got) == len(given)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(g[0]), ids_of(library, g[1])) for g in given)
    # the same ids sequence by sequence, as views on the files
    seqs = token_files.Sequences([r.file for r in m.orderBy("part").collect()])
    flat = []
    for i in range(len(seqs)):
        ids, mask = seqs[i]
        assert len(ids) == len(mask) == length and not ids.flags.owndata
        keep = mask.to_numpy(zero_copy_only=False)
        assert keep.any() and not (np.diff(keep.astype(int)) > 0).any() and not ids[~keep].any()
        flat += ids[keep].tolist()
    assert flat == [i for r in got for i in r.ids]
    with pytest.raises(IndexError):
        seqs[len(seqs)]


def test_files_no_manifest_row_names_play_no_part(spark):
    folder = tempfile.mkdtemp(prefix="quire-seq-") + "/out"
    m = token_files.write_sequences(documents(spark, awkward()), folder)
    before = sorted(map(tuple, token_files.read_documents(m).collect()), key=repr)
    with open(os.path.join(folder, "data", "part-000000-lost.arrow"), "wb") as f:
        f.write(b"half a file")
    again = token_files.read_manifest(spark, folder)
    assert sorted(map(tuple, token_files.read_documents(again).collect()), key=repr) == before


def test_empty_table(spark):
    m = token_files.write_sequences(empty(spark), tempfile.mkdtemp(prefix="quire-seq-") + "/out")
    assert m.count() == 0 and token_files.read_documents(m).count() == 0
    assert len(token_files.Sequences([])) == 0


def test_registered_query(spark, library):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(E.queries()["op12_arrow_sequences"](spark, sf).collect())
    at = 0
    assert [g.doc_id for g in got] == sorted(texts)
    for g in got:
        ids = ids_of(library, texts[g.doc_id])
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
