"""Registered queries for format detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..session import scratch_dir
from ..sources import csv as CSV
from ..sources import json as JS
from ..sources import markdown as MD
from ..sources import xml as XML
from .catalog import register, table


def _text_corpus(spark, sf_dir):
    """Text payloads derived from the tables: web pages, documents, JSON props, XML and CSV snippets."""
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"),
                                                 F.col("html").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("source"), F.col("doc_id").alias("id"), "text")
    ev = table(spark, sf_dir, "events").select(F.lit("event").alias("source"), F.col("event_id").alias("id"),
                                               F.col("props").alias("text"))
    nx = table(spark, sf_dir, "nation").select(
        F.lit("nation").alias("source"), F.col("n_nationkey").cast("long").alias("id"),
        F.concat(F.lit("<nation><name>"), "n_name", F.lit("</name></nation>")).alias("text"))
    sc = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"),
        F.concat(F.lit("name,nation,flag\n"), "s_name", F.lit(","), F.col("s_nationkey").cast("string"),
                 F.lit(",x")).alias("text"))
    return pages.unionByName(docs).unionByName(ev).unionByName(nx).unionByName(sc)


_CORPUS_SQL = """
  SELECT 'page' AS source, page_id AS id, html AS text FROM pages
  UNION ALL SELECT 'doc', doc_id, text FROM documents
  UNION ALL SELECT 'event', event_id, props FROM events
  UNION ALL SELECT 'nation', n_nationkey, '<nation><name>' || n_name || '</name></nation>' FROM nation
  UNION ALL SELECT 'supplier', s_suppkey, 'name,nation,flag' || chr(10) || s_name || ',' || s_nationkey || ',x'
    FROM supplier
"""


def _sql_content(t: str) -> str:
    """Oracle spelling of T2 over an expression ``t`` that is already the trimmed 1 KB sample."""
    md = " + ".join(f"CASE WHEN regexp_matches({t}, '{p}') THEN 1 ELSE 0 END" for p in D.MARKDOWN_PATTERNS)
    lines = rf"list_filter(string_split({t}, chr(10)), lambda l: length(regexp_replace(l, '^\s+|\s+$', '', 'g')) > 0)"
    csv = " OR ".join(
        f"(len(string_split({lines}[1], {d})) > 1 AND len(string_split({lines}[1], {d})) = "
        f"len(string_split({lines}[2], {d})))"
        for d in ("','", "';'", "chr(9)", "'|'"))
    json = (f"((starts_with({t}, '{{') OR starts_with({t}, '[')) AND (json_valid({t}) OR "
            f"(contains({t}, '\"') AND (contains({t}, ':') OR contains({t}, ',')))))")
    xml = (f"(starts_with({t}, '<') AND (regexp_matches({t}, '{D.XML_DECLARATION_RE}') OR "
           f"regexp_matches({t}, '{D.XML_ELEMENT_RE}')))")
    return (f"CASE WHEN {json} THEN 'json' WHEN {xml} THEN 'xml' WHEN ({md}) >= 2 THEN 'md' "
            f"WHEN len({lines}) >= 2 AND ({csv}) THEN 'csv' END")


# the registered queries apply the content rules to whole texts (sample_chars=None)
_SAMPLE = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


@register("t2_detect_content", f"""
SELECT source, id, fmt AS format,
       CAST(CASE fmt WHEN 'json' THEN 0.9 WHEN 'xml' THEN 0.9 WHEN 'md' THEN 0.7 WHEN 'csv' THEN 0.6 END AS DOUBLE)
         AS confidence
FROM (SELECT source, id, {_sql_content('s')} AS fmt FROM (SELECT source, id, {_SAMPLE} AS s FROM ({_CORPUS_SQL})))
""")
def t2_detect_content(spark, sf_dir):
    """Content-based format of pages, documents, JSON props, XML and CSV snippets."""
    c = D.with_content_format(_text_corpus(spark, sf_dir), "text", "d", sample_chars=None)
    return c.select("source", "id", "d.format", "d.confidence")


def _sql_ext(e: str) -> str:
    return "CASE " + " ".join(f"WHEN {e} = '{x}' THEN '{f}'" for x, f in D.EXTENSION_FORMATS) + " END"


_SUGGEST_PATHS = "SELECT doc_id, 'file_' || doc_id || '.' || substr(lang, 1, 1) AS path FROM documents"


@register("t4_format_suggestions", f"""
SELECT doc_id, CAST(to_json(CASE WHEN len(sim) > 0 THEN list_transform(sim, lambda e: {_sql_ext('e')})
                          ELSE ['csv', 'xlsx', 'json', 'xml', 'md'] END) AS VARCHAR) AS suggested
FROM (SELECT doc_id, list_filter([{", ".join(f"'{e}'" for e, _ in D.EXTENSION_FORMATS)}],
        lambda e: contains(e, substr(ext, 2)) OR contains(ext, substr(e, 2))) AS sim
      FROM (SELECT doc_id, lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) AS ext FROM ({_SUGGEST_PATHS})))
""")
def t4_format_suggestions(spark, sf_dir):
    """Formats suggested for paths with unknown extensions (T4)."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit("."), F.substring("lang", 1, 1))
        .alias("path"))
    return d.select("doc_id", F.to_json(D.format_suggestions(F.col("path"))).alias("suggested"))


def _sql_pairs(s: str, t: str) -> str:
    w = [f"CASE WHEN {s} NOT IN ('csv','xlsx','json','xml','md') THEN 'Source format ''' || {s} || ''' is not supported' END",
         f"CASE WHEN {t} NOT IN ('csv','xlsx','json','xml','md') THEN 'Target format ''' || {t} || ''' is not supported' END",
         f"CASE WHEN {s} = 'xlsx' AND {t} = 'csv' THEN 'Converting from Excel to CSV may lose formatting and multiple sheets' END",
         f"CASE WHEN {s} = 'xml' AND {t} = 'csv' THEN 'Converting from XML to CSV may lose hierarchical structure' END",
         f"CASE WHEN {s} = 'json' AND {t} = 'csv' THEN 'Converting from JSON to CSV may lose nested object structure' END",
         f"CASE WHEN {t} = 'md' AND {s} NOT IN ('csv', 'json') THEN 'Converting to Markdown works best with tabular data' END"]
    return "list_filter([" + ", ".join(w) + "], lambda x: x IS NOT NULL)"


@register("t5_pair_warnings", f"""
SELECT source_format, target_format, CAST(to_json({_sql_pairs('source_format', 'target_format')}) AS VARCHAR) AS warnings,
       count(*) AS documents
FROM (SELECT coalesce({_sql_content('s')}, 'unknown') AS source_format, unnest(['csv','xlsx','json','xml','md'])
        AS target_format FROM (SELECT {_SAMPLE} AS s FROM ({_CORPUS_SQL})))
GROUP BY ALL
""")
def t5_pair_warnings(spark, sf_dir):
    """Loss warnings for converting every payload (format detected from content) to each format."""
    c = D.with_content_format(_text_corpus(spark, sf_dir), "text", "d", sample_chars=None).select(
        F.coalesce(F.col("d.format"), F.lit("unknown")).alias("source_format"),
        F.explode(F.array(*[F.lit(f) for f in D.SUPPORTED_FORMATS])).alias("target_format"))
    return c.groupBy("source_format", "target_format").agg(F.count(F.lit(1)).alias("documents")).select(
        "source_format", "target_format",
        F.to_json(D.pair_warnings(F.col("source_format"), F.col("target_format"))).alias("warnings"), "documents")


def write_format_corpus(spark, sf_dir) -> str:
    """Write nation/region/part in every text format (and an unknown one) under one folder."""
    base = scratch_dir(spark, "corpus")
    n, r, p = (table(spark, sf_dir, t) for t in ("nation", "region", "part"))
    CSV.write_csv(n, f"{base}/csv")
    JS.write_json(r, f"{base}/json", layout="array")
    XML.write_xml(n, f"{base}/xml")
    MD.write_markdown_table(p, f"{base}/md", extension=".md")
    p.select(F.concat_ws(" ", "p_name", "p_brand").alias("value")).write.text(f"{base}/txt")
    return base


@register("t3_detect_files")
def t3_detect_files(spark, sf_dir):
    """T1 + T3 over a folder of files written from the tables: per extension, detected format."""
    base = write_format_corpus(spark, sf_dir)
    det = D.detect_files(spark, base, sample_chars=None)
    return det.groupBy(D.extension_of(F.col("path")).alias("extension"), "format", "confidence", "method", "error") \
        .agg(F.count(F.lit(1)).alias("files"))


@register("t1_detect_extension")
def t1_detect_extension(spark, sf_dir):
    """Extension-only detection over a folder written from the tables."""
    base = write_format_corpus(spark, sf_dir)
    det = D.detect_files(spark, base, analyze_content=False)
    return det.groupBy(D.extension_of(F.col("path")).alias("extension"), "format", "confidence", "error") \
        .agg(F.count(F.lit(1)).alias("files"))


# Paths and their expected answers are written out apart from the operator's own tables.
_PATHS_SQL = """
WITH x(i, name, fmt, err) AS (VALUES
  (0, '/in/a.csv', 'csv', NULL), (1, '/in/b.CSV', 'csv', NULL), (2, '/in/c.xls', 'xlsx', NULL), (3, '/in/d.xlsx', 'xlsx', NULL),
  (4, '/in/e.json', 'json', NULL), (5, '/in/f.xml', 'xml', NULL), (6, '/in/g.md', 'md', NULL),
  (7, '/in/h.markdown', 'md', NULL), (8, '/in/i.tar.gz', NULL, 'Unsupported format: .gz'),
  (9, '/in.d/plain', NULL, 'Unsupported format: unknown'))
"""
_PATHS = ("/in/a.csv", "/in/b.CSV", "/in/c.xls", "/in/d.xlsx", "/in/e.json", "/in/f.xml", "/in/g.md", "/in/h.markdown",
          "/in/i.tar.gz", "/in.d/plain")


def _event_paths(spark, sf_dir):
    paths = F.array(*[F.lit(p) for p in _PATHS])
    return table(spark, sf_dir, "events").select(
        "event_id", "props", F.element_at(paths, (F.col("event_id") % 10 + 1).cast("int")).alias("path"))


@register("t1_extension_of_paths", _PATHS_SQL + """
SELECT event_id, name AS path, fmt AS format, CASE WHEN fmt IS NOT NULL THEN 0.8 END::DOUBLE AS confidence,
       'extension' AS "method", err AS error
FROM events JOIN x ON event_id % 10 = i
""")
def t1_extension_of_paths(spark, sf_dir):
    """Format by extension of one path per event."""
    d = _event_paths(spark, sf_dir).withColumn("d", D.detect_by_extension(F.col("path")))
    return d.select("event_id", "path", "d.*")


@register("t3_hybrid_of_payloads", _PATHS_SQL + """
SELECT event_id, name AS path, CASE WHEN fmt IS NOT NULL THEN 'json' END AS format,
       CASE WHEN fmt = 'json' THEN 0.95 WHEN fmt IS NOT NULL THEN 0.9 END::DOUBLE AS confidence,
       'hybrid' AS "method", err AS error
FROM events JOIN x ON event_id % 10 = i
""")
def t3_hybrid_of_payloads(spark, sf_dir):
    """Extension and content together: the JSON payload of each event under paths of every kind."""
    d = D.with_content_format(_event_paths(spark, sf_dir), "props", "c", sample_chars=None)
    d = d.withColumn("d", D.combine(D.detect_by_extension(F.col("path")), F.col("c")))
    return d.select("event_id", "path", "d.*")
