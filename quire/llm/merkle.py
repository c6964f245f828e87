"""Merkle manifest of a dataset: a digest a row, a tree of digests a group, one root over the groups.

Rows are numbered by their key within their group, and a node's place in the tree follows from that
number alone. Blocks of consecutive rows, whole subtrees, are one window partition each: per level
``lag`` and ``lead`` at fixed offsets, masked by a node's slot and by the length of its run, supply
its siblings, and the first child of each run hashes the parent. A block's top node is a row of the
next, far smaller round, so no window is longer than a block, however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, register, table

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = 1024        # rows of a window at most


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, joined without a separator."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value as ``<UTF-8 bytes>:<value>``, null as ``-``: no two rows of values give the same text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return digest(*[field(c) for c in columns])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def proof_of(path: Column) -> Column:
    """Digest of the siblings on a path, bottom up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _numbered(nodes: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add _pos, the 0-based place of a row within its group _g, and _n, the group's rows.

    Rows are dealt by range, sorted in their partition and written; counts by partition give the places.
    """
    m = F.monotonically_increasing_id()
    keys = ["_g", *order]
    ranged = nodes.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in keys])
    ranged = materialize(ranged.withColumn("_m", m), name).withColumn("_part", F.shiftright("_m", 33))
    stretch = ranged.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_m0"))
    group = Window.partitionBy("_g")
    run = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.select("_g", "_part", (F.coalesce(F.sum("_c").over(run), F.lit(0)) - F.col("_m0")).alias("_shift"),
                             F.sum("_c").over(group).alias("_n"))
    return ranged.join(stretch, ["_g", "_part"]).withColumn("_pos", F.col("_m") + F.col("_shift")).drop(
        "_m", "_part", "_shift")


def _in_block(nodes: DataFrame, arity: int, block: int) -> DataFrame:
    """Add _blk, _path (siblings level by level within the block) and _top (the block's node) to rows
    of _g, _pos, _n, _h."""
    w = Window.partitionBy("_g", "_blk").orderBy("_pos")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = nodes.withColumn("_blk", F.expr(f"_pos div {block}L")).withColumn("_h0", F.col("_h"))
    step, level, found = 1, 0, []
    while step < block:
        h = F.col(f"_h{level}")
        for d in range(1, arity):
            df = df.withColumns({f"_lag{d}": F.lag(h, d * step).over(w), f"_lead{d}": F.lead(h, d * step).over(w)})
        live = F.col("_pos") % step == 0                        # the first leaf under a node stands for it
        slot = F.expr(f"_pos div {step}L") % arity
        run = F.least(F.lit(arity), F.ceil(F.col("_n") / step) - F.expr(f"_pos div {step}L") + slot)
        before = F.concat(*[F.when(slot >= d, F.col(f"_lag{d}")).otherwise("") for d in range(arity - 1, 0, -1)])
        after = F.concat(*[F.when(slot + d < run, F.col(f"_lead{d}")).otherwise("") for d in range(1, arity)])
        parent = F.when(live & (slot == 0), F.when(F.col("_n") > step, digest(h, after)).otherwise(h))
        df = df.withColumns({f"_s{level}": F.when(live, F.struct(before.alias("before"), after.alias("after"))),
                             f"_h{level + 1}": parent}).drop(*[f"_{k}{d}" for k in ("lag", "lead")
                                                               for d in range(1, arity)])
        # every leaf takes over what the first leaf under its ancestor found
        found.append(F.when(F.col("_n") > step, F.last(f"_s{level}", ignorenulls=True).over(upto) if level else
                            F.col("_s0")))
        step, level = step * arity, level + 1
    df = df.withColumns({"_path": F.array_compact(F.array(*found)), "_top": F.first(f"_h{level}").over(upto)})
    return df.drop(*[f"_h{i}" for i in range(level + 1)], *[f"_s{i}" for i in range(level)])


def _blocks(nodes: DataFrame, arity: int, block: int) -> DataFrame:
    """_g, _pos, _n, _h of the top nodes of the blocks of ``nodes``, written: the next round's rows."""
    tops = _in_block(nodes, arity, block).where(F.col("_pos") % block == 0)
    return materialize(tops.select("_g", F.col("_blk").alias("_pos"), F.expr(f"(_n + {block - 1}) div {block}L").alias("_n"),
                                   F.col("_top").alias("_h")), "merkle-blocks")


def _size(nodes: DataFrame, arity: int, block: int) -> int:
    """Rows a block: a power of ``arity``, the largest up to ``block`` or what holds the largest group."""
    size, most = arity, nodes.agg(F.max("_n")).first()[0] or 1
    while size * arity <= block and size < most:
        size *= arity
    return size if most > 1 else 1


def _climb(nodes: DataFrame, arity: int, block: int) -> DataFrame:
    """_g, _pos, _path (all siblings up to the group's root) and _top (that root) of rows _g, _pos, _n, _h."""
    size = _size(nodes, arity, block)
    if size == 1:
        empty = F.array().cast("array<struct<before:string,after:string>>")
        return nodes.select("_g", "_pos", empty.alias("_path"), F.col("_h").alias("_top"))
    above = _climb(_blocks(nodes, arity, size), arity, block)
    return _joined(_in_block(nodes, arity, size), above).drop("_n", "_h")


def _joined(rows: DataFrame, above: DataFrame) -> DataFrame:
    """Rows of blocks with the path of their block appended to their own, and what that path leads to."""
    up = above.select("_g", F.col("_pos").alias("_blk"), F.col("_path").alias("_up"),
                      *[c for c in above.columns if c not in ("_g", "_pos", "_path")])
    return rows.drop("_top").join(up, ["_g", "_blk"]).withColumn("_path", F.concat("_path", "_up")).drop("_up", "_blk")


def merkle(leaves: DataFrame, arity: int = 2, block: int = BLOCK) -> DataFrame:
    """Proof paths of all rows of ``leaves`` (group, key, leaf, other columns): adds subroot (of the row's
    group), root (over the groups' subroots, null first, then by bytes) and path, an array of (before, after)
    siblings from the leaf to the root; ``fold(leaf, path)`` equals root.

    ``leaf`` is a hex digest. In a group rows ascend by key; every ``arity`` consecutive nodes become their
    digest until one is left. Rows of a key (also null, which comes first) follow each other by leaf and then by
    the other columns; a lone leaf is its group's subroot, a lone group's subroot the root. An empty table
    gives no rows.
    """
    if arity < 2:
        raise ValueError("a node needs two children at least")
    rest = [c for c in leaves.columns if c not in ("group", "key", "leaf")]
    group = F.coalesce(F.concat(F.lit("1"), F.col("group")), F.lit("0"))          # null first, and never null
    given = materialize(leaves.select(group.alias("_g"), F.col("key").alias("_key"), F.col("leaf").alias("_h"),
                                      *[F.col(c).alias(f"c_{c}") for c in rest]), "merkle-leaves")
    nodes = _numbered(given, ["_key", "_h", *[f"c_{c}" for c in rest]], "merkle-rows")
    size = max(arity, _size(nodes, arity, block))
    blocks = materialize(_climb(_blocks(nodes, arity, size), arity, block), "merkle-upper")
    roots = blocks.where("_pos = 0").select(F.lit("all").alias("_g"), F.col("_g").alias("_key"), F.col("_top").alias("_h"))
    roots = _numbered(roots, ["_key"], "merkle-groups").select("_g", "_pos", "_n", "_h", "_key")
    names = roots.select("_pos", F.col("_key").alias("_of"))
    roots = _climb(roots.drop("_key"), arity, block).join(names, "_pos")
    roots = roots.select(F.col("_of").alias("_g"), F.col("_path").alias("_end"), F.col("_top").alias("_root"))
    above = blocks.join(materialize(roots, "merkle-roots"), "_g").withColumn("_path", F.concat("_path", "_end")).drop("_end")
    out = _joined(_in_block(nodes, arity, size), above)
    return out.select(F.expr("case when _g like '1%' then substring(_g, 2) end").alias("group"),
                      F.col("_key").alias("key"), F.col("_h").alias("leaf"), *[F.col(f"c_{c}").alias(c) for c in rest],
                      F.col("_top").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))


def manifest(docs: DataFrame, arity: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, path of each row: what a holder of one document and the root needs
    to prove that it belongs to the dataset.

    Defined cases: null fields are ``-`` in the leaf, empty texts ``0:``; a null lang is a group of its own, a
    null doc_id comes first; repeated rows are leaves of their own; an empty table gives no rows; columns other
    than those of documents play no part.
    """
    prepare(docs.sparkSession)
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"),
                         leaf_of(*[F.col(c) for c in COLUMNS]).alias("leaf"))
    return merkle(leaves, arity, block).select(F.col("key").alias("doc_id"), F.col("group").alias("lang"), "leaf",
                                               "subroot", "root", "path")


# The same tree level by level in SQL: nodes by recursion, then each document's way up through them.
_SQL = """
WITH RECURSIVE crc(doc_id, s, i, v) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE v END AS b FROM crc)
  WHERE i < 8 * length(s)
), hit AS (
  SELECT doc_id FROM crc WHERE i = 8 * length(s) AND xor(v, 4294967295) % 7 = 0
), base AS (
  SELECT d.*, coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body, h.doc_id IS NOT NULL AS hit
  FROM documents d LEFT JOIN hit h ON d.doc_id = h.doc_id
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || body) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + CAST(hit AS INTEGER) AS VARCHAR)) || ':'
                                 || (n_chars + CAST(hit AS INTEGER)), '-') || body) AS given,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM base
), tree AS (
  SELECT 0 AS lvl, lang, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lvl + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1
  GROUP BY lvl, lang, pos // 2, n
), subs AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1
), crown AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1
  GROUP BY lvl, pos // 2, n
), walk AS (
  SELECT 0 AS lvl, lang, pos AS leaf_pos, pos, n, given AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.lvl + 1, w.lang, leaf_pos, w.pos // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.pos % 2 = 1 THEN t.h || w.h ELSE w.h || coalesce(t.h, '') END), proof || coalesce(t.h, '')
  FROM walk w LEFT JOIN tree t ON t.lvl = w.lvl AND t.lang IS NOT DISTINCT FROM w.lang AND t.pos = xor(w.pos, 1)
  WHERE w.n > 1
), climb AS (
  SELECT 0 AS lvl, w.lang, leaf_pos, s.pos, s.n, w.h, proof
  FROM walk w JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.lvl + 1, lang, leaf_pos, w.pos // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.pos % 2 = 1 THEN t.h || w.h ELSE w.h || coalesce(t.h, '') END), proof || coalesce(t.h, '')
  FROM climb w LEFT JOIN crown t ON t.lvl = w.lvl AND t.pos = xor(w.pos, 1) WHERE w.n > 1
)
SELECT l.doc_id, l.leaf, s.subroot, c.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = c.h AS verified
FROM leaves l JOIN climb w ON w.n = 1 AND w.lang IS NOT DISTINCT FROM l.lang AND w.leaf_pos = l.pos
JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN crown c ON c.n = 1
"""


@register("op11_merkle_manifest", _SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof, and whether a copy with some lengths altered still proves it."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    altered = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 7 == 0), F.lit(False))
    seen = [F.col("n_chars") + altered.cast("int") if c == "n_chars" else F.col(c) for c in COLUMNS]
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"),
                         leaf_of(*[F.col(c) for c in COLUMNS]).alias("leaf"),
                         F.when(altered, leaf_of(*seen)).alias("altered"))
    got = merkle(leaves).withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path")))
    return got.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
