"""A corpus pipeline over ``documents``: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next one's docs; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import line_dedup, minhash_dedup, mixing, piece_codec, toxicity
from quire.llm.common import materialize, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None       # the classifier, the sketches and the encoder have no SQL form


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic."""
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs.select(*COLUMNS), model).where("not toxic").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals; n_chars follows."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    found = minhash_dedup.near_duplicates(docs.select("doc_id", "text"))
    stays = found.where("kept").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.select(*COLUMNS).join(stays, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # rows that repeat an id and its text are copies too
    return kept.withColumn("_t", F.xxhash64("text")).dropDuplicates(["doc_id", "_t"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or several times."""
    prepare(spark)
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with digests of the ids and of the text they decode to."""
    return piece_codec.encode_decode(docs.select("doc_id", "text"), keep_ids=True).drop("decoded")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("MinHash near-dedup", drop_near_copies),
          ("mixing sources to target weights", mix_sources), ("SentencePiece encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read back but the last."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
