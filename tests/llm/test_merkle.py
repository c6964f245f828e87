"""Merkle manifests against a tree built row by row."""
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle

from .helpers import DOC_SCHEMA, awkward, crowded, documents, empty


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    parts = [doc_id, source, lang, n_chars, text]
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def climb(nodes, arity):
    """(root, per leaf the list of (before, after) siblings)."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, wide = [], []
        for i in range(0, len(nodes), arity):
            run = nodes[i:i + arity]
            for j in range(len(run)):
                for k in spans[i + j]:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(h("".join(run)))
            wide.append([k for s in spans[i:i + arity] for k in s])
        nodes, spans = up, wide
    return nodes[0], paths


def tree(rows, arity=2):
    """{(doc_id, leaf): [(subroot, root, path)]} of (doc_id, text, lang, source, n_chars) rows."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    subs, kept = [], []
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(*r)) for r in rows if r[2] == lang))
        sub, paths = climb([m[2] for m in mine], arity)
        subs.append(sub)
        kept.append((mine, paths))
    root, over = climb(subs, arity)
    out = {}
    for (mine, paths), sub, end in zip(kept, subs, over):
        for (known, i, lf), path in zip(mine, paths):
            out.setdefault((i if known else None, lf), []).append((sub, root, path + end))
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, [(s.before, s.after) for s in r.path]))
    return out


def in_order(d):
    return {k: sorted(v) for k, v in d.items()}


def rows_of(n):
    langs = ["en", "de", None, "", "é", "zz"]
    return [(i * 7 % (n + 3), f"text {i}", langs[0] if i % 3 else langs[i % 6], "s" if i % 5 else None, i if i % 4 else None)
            for i in range(n)]


@pytest.mark.parametrize("arity,block", [(2, 8), (3, 9)])
def test_paths_equal_the_tree(spark, arity, block):
    rows = rows_of(150)     # blocks of 8 make rounds over rounds
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    got = merkle.manifest(df, arity, block)
    assert in_order(found(got)) == in_order(tree(rows, arity))
    bad = got.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root"))
    assert bad.count() == 0
    assert got.where(merkle.fold(F.reverse("leaf"), F.col("path")) == F.col("root")).count() == 0


def test_awkward_rows_clashing_columns_and_empty_table(spark):
    df = documents(spark, awkward())
    rows = [tuple(r) for r in df.collect()]
    want = in_order(tree(rows))
    assert in_order(found(merkle.manifest(df))) == want
    more = crowded(df).withColumn("group", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("_pos", F.lit(2))
    assert in_order(found(merkle.manifest(more))) == want
    assert merkle.manifest(empty(spark)).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None)], DOC_SCHEMA)
    r = merkle.manifest(one).first()
    assert (r.leaf, r.subroot, r.root, r.path) == (h("-----"),) * 3 + ([],)


def test_registered_query(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    want = tree(rows)
    got = E.queries()["op11_merkle_manifest"](spark, sf).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for g in got:
        (sub, root, path), = want[g.doc_id, g.leaf]
        hit = zlib.crc32(str(g.doc_id).encode()) % 7 == 0 and by_id[g.doc_id][4] is not None
        folded = leaf(*by_id[g.doc_id][:4], by_id[g.doc_id][4] + 1) if hit else g.leaf
        for a, b in path:
            folded = h(a + folded + b)
        assert (g.subroot, g.root, g.folded_root, g.verified) == (sub, root, folded, not hit)
        assert g.proof_sha256 == h("".join(a + b for a, b in path))
