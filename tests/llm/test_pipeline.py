"""The pipeline against a brute-force version of each stage."""
import hashlib
import struct

import sentencepiece

import __spark_entry__ as E
import corpus_pipeline as P
from quire.llm import mixing, piece_codec, toxicity

from .helpers import shingle_set
from .test_dedup import lines_reference, near_reference

SF = "/root/testdata/sf0.001"


def test_stages_in_order_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    ids = sorted(rows)
    hit = model.score([rows[i].text for i in ids])[1][1]
    clean = [i for i, h in zip(ids, hit) if not h]
    text = {k[0]: v for k, v in lines_reference([(i, rows[i].text) for i in clean]).items()}
    sizes, comp = near_reference(list(text.items()))
    kept = [i for i in clean if comp[i] == i]
    frame = spark.createDataFrame([(i, text[i], rows[i].lang, rows[i].source, len(text[i])) for i in kept],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    times = {x.doc_id: x.times for x in mixing.mix(frame).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    want = []
    for i in kept:
        out = sp.encode(text[i], add_bos=True, add_eos=True)
        want += [(i, len(out), hashlib.sha256(struct.pack(f"<{len(out)}I", *out)).hexdigest(), out)] * times[i]
    got = [(x.doc_id, x.n_tokens, x.ids_sha256, x.ids) for x in E.queries()["pipeline"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert 0 < len(kept) < len(rows) and all(shingle_set(text[i]) is not None for i in kept)


def test_stages_keep_the_columns_and_take_awkward_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0),
                                 (2, "some words that stand here", "en", "s", 26),
                                 (2, "some words that stand here", "en", "s", 26)], docs.schema)
    assert [n for n, _ in P.STAGES][0] == "toxicity" and len(P.STAGES) == 5
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert stage(spark, odd, SF).columns == docs.columns
    assert P.drop_near_copies(spark, odd, SF).count() == 3
    assert P.encode(spark, odd, SF).count() == 5
