"""Token counts from an exact length histogram.

Documents are counted by encoded length (combined before the shuffle), and suffix sums over the
histogram give, for every context limit, the documents over the limit, the tokens kept and cut,
and quantiles: no question about limits needs another pass over the texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, register, table

STRETCH = 1024      # lengths summed as one in the upper level of the suffix sums
_ENCODERS: dict[str, object] = {}


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens={})
    return _ENCODERS[path]


def encoded_lengths(docs: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """doc_id, length: tokens of each whole text (null: 0), counted in tasks, Arrow batch by batch."""
    prepare(docs.sparkSession)
    path = ranks_file or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            texts = batch.column(1)
            n = [len(enc.encode_ordinary(texts[i].as_py() or "")) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """length, n_docs over the rows of ``lengths``; one row per length that occurs."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """What each length, taken as a context limit, means for the corpus; one row per length.

    docs_upto / docs_over: documents at most / above the limit; tokens_upto / tokens_over: their
    tokens; truncated_tokens: tokens left when every document is cut at the limit; cut_tokens: tokens
    lost; total_docs, total_tokens: of all. Suffixes are summed within stretches of 1024
    lengths and over the totals of the stretches, so no task sees the whole histogram.
    """
    h = hist.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn(
        "_s", F.expr(f"length div {STRETCH}"))
    later = Window.orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    stretches = h.groupBy("_s").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "_s", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("_d"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("_t"),
        F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    above = Window.partitionBy("_s").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = (h.withColumn("_od", F.coalesce(F.sum("n_docs").over(above), F.lit(0)))
          .withColumn("_ot", F.coalesce(F.sum("tokens").over(above), F.lit(0))))
    h = h.join(stretches, "_s")
    over_d, over_t = F.col("_od") + F.col("_d"), F.col("_ot") + F.col("_t")
    kept = F.col("total_tokens") - over_t + F.col("length") * over_d
    return h.select("length", "n_docs", (F.col("total_docs") - over_d).alias("docs_upto"), over_d.alias("docs_over"),
                    (F.col("total_tokens") - over_t).alias("tokens_upto"), over_t.alias("tokens_over"),
                    kept.alias("truncated_tokens"), (F.col("total_tokens") - kept).alias("cut_tokens"),
                    "total_docs", "total_tokens")


def at_limits(sums: DataFrame, limits: Iterable[int]) -> DataFrame:
    """context_limit, docs_over, truncated_tokens, total_docs, total_tokens for any limits, also those that are
    no document's length: the row of the greatest length not above the limit answers for it."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    one = sums.agg(*[F.max_by(F.struct("length", "docs_over", "tokens_upto", "total_docs", "total_tokens"),
                              F.when(F.col("length") <= x, F.col("length"))).alias(f"l{x}")
                     for x in limits], F.max("total_docs").alias("_d"), F.max("total_tokens").alias("_t"))
    case = F.coalesce(*[F.when(F.col("context_limit") == x, F.col(f"l{x}")) for x in limits])
    got = asked.join(F.broadcast(one)).withColumn("_r", case)      # one row on the right
    over = F.coalesce("_r.docs_over", "_d", F.lit(0))
    return got.select("context_limit", over.alias("docs_over"),
                      (F.coalesce("_r.tokens_upto", F.lit(0)) + F.col("context_limit") * over).alias("truncated_tokens"),
                      F.coalesce("_d", F.lit(0)).alias("total_docs"), F.coalesce("_t", F.lit(0)).alias("total_tokens"))


def quantiles(sums: DataFrame, shares: Iterable[float]) -> DataFrame:
    """share, length: the smallest length that at least that share of the documents does not exceed."""
    one = sums.agg(*[F.min(F.when(F.col("docs_upto") >= F.col("total_docs") * q, F.col("length"))).alias(f"q{i}")
                     for i, q in enumerate(shares)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length"))
                                          for i, q in enumerate(shares)])).alias("r")).select("r.*")


def token_counts(docs: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """Suffix sums of the exact length histogram of ``docs`` (doc_id, text, ...).

    Defined cases: null and empty texts have length 0; repeated rows count each time; an empty
    table gives no rows; other columns play no part.
    """
    hist = materialize(length_histogram(encoded_lengths(docs, ranks_file)), "lengths")   # read twice, made once
    return suffix_sums(hist)


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every length of an encoded document as a context limit: documents over it, tokens kept and cut."""
    return token_counts(table(spark, sf_dir, "documents"))
