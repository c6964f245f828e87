"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document gets a fixed 60-bit hash. A source's words are summed by hash bucket; where the
running sum passes the source's budget lies one boundary bucket, and only that bucket is summed
again on the next bits, level by level, until one hash value is left. Documents below the
threshold are taken; nothing is sorted and no source is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, register, table, word_count

WEIGHTS = (5, 2, 1)
DIGITS = 3          # hash digits (hex) a level: 4096 buckets
LEVELS = 5          # 15 hex digits: 60 bits
CAP = 3             # a target stops at this many times its source's size


def _targets(sizes: DataFrame, weights) -> DataFrame:
    """source, source_size -> target: weights share all words, none above CAP times its source.

    Capping and resharing until nothing is above has a closed form: with sources ordered by
    cap/weight, the first c of them are capped, where c is the smallest count whose remaining
    share per weight stays below the next source's cap/weight. One row per source.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
                      % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * CAP)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("left_weight", F.sum("weight").over(everything)
                     - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("share", F.col("left_words") / F.col("left_weight")))
    rate = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("cap_rank", "share")))
    s = s.withColumn("cap_rank", F.row_number().over(order))
    s = s.withColumn("rate", rate.over(everything))
    return s.select("source", "source_size",
                    F.when(F.col("cap_rank") < F.col("rate.cap_rank"), F.col("cap").cast("double"))
                    .otherwise(F.col("rate.share") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, seed: int = 7) -> DataFrame:
    """Add ``size`` (words), ``source_size``, ``target`` (of the source), ``times`` (how often the document is
    taken) and ``taken`` (words taken, repeats counted) to ``docs`` (doc_id, text, source, ...); columns
    of those names are replaced.

    A source takes each document floor(target / source_size) times, and once more those whose
    hash lies below the threshold that brings the sum nearest to the target. Defined cases: a
    null text has size 0 and takes 0; a null source is a source of its own, last in order; rows
    that repeat doc_id and text share one decision; a source of empty texts has target 0; an
    empty table gives no rows. The choice depends on the rows and ``seed`` alone, so reruns agree.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "times", "taken")]
    h = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                                      F.md5(F.coalesce("text", F.lit(""))))), 1, DIGITS * LEVELS)
    base = docs.select(*names, word_count(F.col("text")).alias("size"), h.alias("_q_h"),
                       F.substring(h, 1, DIGITS).alias("_q_b"))
    narrow = materialize(base.select("source", "size", "_q_h"), "mix")
    # level 1: words by source and bucket; the totals follow from it
    hist = materialize(narrow.groupBy("source", F.substring("_q_h", 1, DIGITS).alias("_q_b"))
                       .agg(F.sum("size").alias("words")), "mix-hist")
    targets = _targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0,
                                                  F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    targets = targets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).checkpoint()
    # refine: state holds, per source, the boundary prefix so far and the words below it
    state = targets.select("source", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"))
    rows = narrow
    for level in range(1, LEVELS + 1):
        n = DIGITS * level
        buckets = (hist.withColumnRenamed("_q_b", "prefix") if level == 1 else
                   rows.groupBy("source", F.substring("_q_h", 1, n).alias("prefix")).agg(F.sum("size").alias("words")))
        buckets = _join_source(buckets, state.drop("prefix", "words"))
        run = Window.partitionBy("source").orderBy("prefix")
        buckets = buckets.withColumn("upto", F.col("below") + F.sum("words").over(run))
        over = buckets.where(F.col("upto") > F.col("rest")).groupBy("source").agg(
            F.min_by(F.struct("prefix", (F.col("upto") - F.col("words")).alias("below"), "rest", "words"),
                     "prefix").alias("s"))
        state = over.select("source", "s.*").checkpoint()
        if level < LEVELS:
            rows = rows.withColumn("prefix", F.substring("_q_h", 1, n))
            rows = rows.join(state.select(F.col("source").alias("_q_s"), F.col("prefix").alias("_q_p")),
                             F.col("source").eqNullSafe(F.col("_q_s")) & (F.col("prefix") == F.col("_q_p"))
                             ).select("source", "size", "_q_h").checkpoint()
    # nearest: the last hash value is taken too if that leaves the sum nearer to the budget
    cut = state.select("source", F.col("prefix").alias("cut"),
                       (F.col("below") * 2 + F.col("words") <= F.col("rest") * 2).alias("closed"))
    rules = _join_source(_join_source(hist.select("source", "_q_b"), targets), cut, "left")
    rules = rules.select(F.col("source").alias("_q_s"), F.col("_q_b").alias("_q_rb"),
                         "source_size", "target", "passes", "cut", "closed")
    # rules go by (source, bucket), so that a hot source is spread over its 4096 buckets
    out = base.join(rules, F.col("source").eqNullSafe(F.col("_q_s")) & (F.col("_q_b") == F.col("_q_rb")))
    extra = (F.col("_q_h") < F.col("cut")) | ((F.col("_q_h") == F.col("cut")) & F.col("closed"))
    times = F.col("passes") + F.coalesce(extra, F.lit(False)).cast("long")
    return out.select(*names, "size", "source_size", "target", times.cast("int").alias("times"),
                      (F.col("size") * times).alias("taken"))


def _join_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source where null equals null; b has one row per source."""
    b = b.withColumnRenamed("source", "_q_s")
    return a.join(b, F.col("source").eqNullSafe(F.col("_q_s")), how).drop("_q_s")


@register("op3_mix_to_weights", sql="""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         substr(md5('7|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))), 1, 15) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             3 * source_size AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k,
             (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
               / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS share
      FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS k, arg_min(share, k) AS share FROM r WHERE share * weight <= cap),
t AS (SELECT r.source, r.source_size, CASE WHEN r.k < f.k THEN r.cap::DOUBLE ELSE f.share * r.weight END AS target
      FROM r, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
c AS (SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS same
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN source_size > 0 AND 2 * (upto - same) + same <= 2 * rest THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM c
""")
def op3_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1: what the mix takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
