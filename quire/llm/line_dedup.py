"""Line dedup by a deletion-neighbourhood join (DataFrame functions only).

A line goes if an earlier line (by document, then place) is equal or one edit away (a character
inserted, deleted or replaced). Two lines one edit apart share a deletion variant: replaced
characters leave the same rest at the same place, and deleting the extra character of the longer
line gives the shorter one. Variants are hashed and joined on equality; what joins is verified by
edit distance. Within a group of equal variants only the earliest line matters, so no pairs are listed.

Emitting a variant for every character of every line would be far more than the input, so lines
that cannot have a partner are ruled out first, without loss: if one edit lies in some window of a
line, everything outside that window is equal. That outside is hashed, for windows of half a line
over all lines and then for windows of 128 characters over the lines that were left; only windows
whose outside occurs in another line emit their variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, register, table

MIN_CHARS = 1       # empty lines alone are left as they are
WINDOW = 128
_ID = ["h1", "h2"]


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """First-place struct and text of each line that takes part; one row per line of each document."""
    e = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    e = e.where(F.char_length("line") >= min_chars)
    return e.select(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "pos").alias("at"), "line")


def _half_keys(line: Column) -> Column:
    """Hashes of what lies outside either half, for partners as long, one longer and one shorter."""
    n = F.char_length(line)
    keys = []
    for role in (0, 1):         # 1: this line is the longer one of a pair
        short = n - role
        half = F.ceil(short / 2).cast("int")
        keys.append(F.xxhash64(short, F.lit(0), F.substring(line, half + 1 + role, n)))
        keys.append(F.xxhash64(short, F.lit(1), F.substring(line, F.lit(1), half)))
    return F.array(*keys)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once."""
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    return rows.join(twice, key, "left_semi")


def _windows(lines: DataFrame, size: int) -> DataFrame:
    """A row per line, role and window: the hash of what lies outside, and the window's text."""
    n = F.char_length("line")
    w = lines.withColumn("role", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("short", n - F.col("role"))
    w = w.where("short > 0")        # no partner is empty
    w = w.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("short") - 1) / size).cast("int"))))
    lo, hi = F.col("j") * size, (F.col("j") + 1) * size + F.col("role")
    return w.select("at", "role",
                    F.xxhash64("short", "j", F.substring("line", F.lit(1), lo), F.lit("|"),
                               F.substring("line", hi + 1, n)).alias("outside"),
                    F.substring("line", lo + 1, F.col("role") + size).alias("win"))


def _variants(windows: DataFrame) -> DataFrame:
    """Hashed deletion variants. kind s: same-length partners meet here; a: this line is the longer;
    b: this line, whole, is the shorter one."""
    at = F.sequence(F.lit(0), F.char_length("win") - 1)
    # the text without character p; for replaced characters the place counts as well
    less = F.transform(at, lambda p: F.xxhash64(
        "outside", F.when(F.col("role") == 0, p).otherwise(F.lit(-1)),
        F.concat(F.substring(F.col("win"), F.lit(1), p), F.substring(F.col("win"), p + 2, F.char_length("win")))))
    minus = windows.select("at", F.when(F.col("role") == 0, "s").otherwise("a").alias("kind"),
                           F.explode(less).alias("v"))
    whole = windows.where("role = 0").select("at", F.lit("b").alias("kind"),
                                             F.xxhash64("outside", F.lit(-1), "win").alias("v"))
    return minus.union(whole)


def near_copies(distinct: DataFrame, docs: DataFrame, min_chars: int) -> DataFrame:
    """Places (at) of distinct lines that have an earlier line one edit away."""
    keyed = distinct.select("at", F.explode("keys").alias("key"))
    cand = _shared(keyed, "key").select("at").distinct()
    texts = materialize(_lines(docs, min_chars).join(cand, "at").dropDuplicates(["at"]), "line-texts")
    windows = _shared(_windows(texts, WINDOW), "outside")
    variants = materialize(_shared(_variants(windows), "v"), "line-variants")
    first = variants.groupBy("v").agg(F.min(F.when(F.col("kind") != "a", F.col("at"))).alias("own"),
                                      F.min(F.when(F.col("kind") == "a", F.col("at"))).alias("longer"))
    links = variants.join(first, "v").select(
        "at", F.when(F.col("kind") == "b", F.col("longer")).otherwise(F.col("own")).alias("earlier"))
    links = links.where("earlier < at").distinct()
    both = links.join(texts, "at").withColumnRenamed("line", "_a")
    both = both.join(texts.select(F.col("at").alias("earlier"), F.col("line").alias("_b")), "earlier")
    return both.where(F.levenshtein("_a", "_b", 1) >= 0).select("at").distinct()


def dedup_lines(docs: DataFrame, bound: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` cut down to its kept lines, and ``n_lines``, ``n_kept`` (replaced
    if present). ``bound``: edits allowed, 0 or 1.

    Lines end at a newline; the earliest line stays, in order of doc_id (null last), then a hash of
    the whole text, then place. Defined cases: lines under ``min_chars`` characters stay and drop nothing;
    a null text stays null with 0 lines; an empty text stays with its one empty line; rows that
    repeat doc_id and text are one document and are cut alike; a document may lose every line
    (empty text); an empty table gives no rows; other columns pass through.
    """
    if bound not in (0, 1):
        raise ValueError("bound must be 0 or 1")
    names = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    occ = _lines(docs, min_chars)
    # equal lines: the earliest place (two hashes: 128 bits stand for a line; combined before the shuffle)
    occ = occ.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "at",
                     (_half_keys(F.col("line")) if bound else F.array().cast("array<bigint>")).alias("keys"))
    distinct = materialize(occ.groupBy(*_ID).agg(F.min("at").alias("at"), F.first("keys").alias("keys")), "lines")
    kept = distinct.select("at")
    if bound:
        kept = kept.join(near_copies(distinct, docs, min_chars), "at", "left_anti")
    kept = kept.groupBy(F.col("at.doc_id").alias("_q_id"), F.col("at.th").alias("_q_th")).agg(
        F.collect_list("at.pos").alias("_q_pos"))
    out = docs.select(*names).withColumn("_q_h", F.xxhash64("text")).join(
        kept, F.col("doc_id").eqNullSafe(F.col("_q_id")) & (F.col("_q_h") == F.col("_q_th")), "left")
    out = out.withColumn("_q_lines", _split(F.col("text")))
    short = F.filter(F.transform("_q_lines", lambda x, i: F.when(F.char_length(x) < min_chars, i)),
                     lambda i: i.isNotNull())
    keep = F.array_sort(F.concat(F.coalesce("_q_pos", F.array().cast("array<int>")), short))
    out = out.withColumn("_q_keep", keep)
    text = F.array_join(F.transform("_q_keep", lambda i: F.get(F.col("_q_lines"), i)), "\n")
    return out.withColumn("_q_text", F.when(F.col("text").isNotNull(), text)).select(
        *[F.col("_q_text").alias("text") if c == "text" else F.col(c) for c in names],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_q_lines")).alias("n_lines"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_q_keep")).alias("n_kept"))


@register("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier line equals or nearly equals."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_kept").cast("long").alias("n_kept"),
                      F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
