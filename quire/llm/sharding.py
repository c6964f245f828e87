"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash; a row's fractional rank is its place in
its source over the source's size. In the order of fractional ranks every stretch holds each
source in proportion, so equal cuts give shards that all match the mixture and differ by one row
at most. Ranks come from counts by hash bucket plus a place within the bucket: no window spans
more than one bucket of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, register, table

ROWS_A_BUCKET = 400
MAX_BITS = 20


def _place(df: DataFrame, group: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``, the 1-based place of each row in its group under (bucket, order), and ``name``_of,
    the group's size. Buckets are in the order of the rows, and small."""
    keys = [*group, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*group).orderBy(bucket)
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           (F.sum("_n").over(run) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(Window.partitionBy(*group)).alias(f"{name}_of"))
    placed = df.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (placed.join(counts, same).withColumn(name, F.col("_before") + F.col("_in"))
            .drop("_in", "_before", *[f"_k{i}" for i in range(len(keys))]))


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 11) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32, law 'rows', shard, slot, grown_shard (null) of each row.

    Shards hold counts at most one apart and every source in proportion; slots run gapless from
    0 in each shard. Defined cases: a null text has no bytes and the checksum of the empty text;
    a null source is a source of its own; rows that repeat doc_id and text are interchangeable
    and take neighbouring places; with fewer rows than shards some shards stay empty; an empty
    table gives no rows. Other columns play no part.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"),
                       F.crc32(text).cast("long").alias("text_crc32"), "source")
    base = base.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    base = materialize(base, "shard")
    n = base.count()
    bits = min(MAX_BITS, max(0, (n // ROWS_A_BUCKET).bit_length()))
    ranked = _place(base.withColumn("_b", F.shiftright("_h", 64 - bits) if bits else F.lit(0).cast("long")),
                    ["source"], "_b", ["_h", "doc_id", "text_crc32", "size"], "_rank")
    ranked = ranked.withColumn("_f", (F.col("_rank") - 0.5) / F.col("_rank_of"))
    ranked = ranked.withColumn("_g", F.lit(0)).withColumn("_fb", F.floor(F.col("_f") * (1 << bits)))
    ranked = materialize(ranked.drop("_b", "_rank", "_rank_of"), "shard-ranked")
    placed = _place(ranked, ["_g"], "_fb", ["_f", "source", "_h"], "_pos")
    pos = F.col("_pos") - 1
    sh = F.expr(f"((_pos - 1) * {n_shards}) div {max(n, 1)}")
    first = F.expr(f"(_shard * {n} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("_shard", sh).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (pos - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@register("op9_shard_interleaved")
def op9_shard_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards that each match the mixture of sources."""
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
