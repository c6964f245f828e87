"""Embedding near-dedup and nearest neighbours against brute force."""
import numpy as np

from quire.llm import ann, embedding_dedup

from .helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=400, dim=32):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    for k in range(0, n // 2, 4):           # near copies at cosines around the threshold
        for j in range(1, 4):
            x[k + j] = x[k] + r.standard_normal(dim) * r.choice([0.05, 0.2, 0.3, 0.34])
    x[n // 2 + 1] = 3 * x[n // 2]           # a scaled copy
    for k in range(10):
        x[n - 1 - k] = x[n - 11]            # equal vectors
    return x.astype(np.float32)


def frame(spark, x, bad=True):
    rows = [(i, [float(v) for v in row], i % 5) for i, row in enumerate(x)]
    if bad:
        n, d = x.shape
        rows += [(n, None, 0), (n + 1, [0.0] * d, 0), (n + 2, [float("nan")] + [1.0] * (d - 1), 0),
                 (n + 3, [None] + [1.0] * (d - 1), 0), (n + 4, [float("inf")] * d, 0), (n + 5, [], 0),
                 (n + 6, [1.0, 2.0], 0), (None, [1.0] * d, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def cosine(x):
    x = x.astype(float)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x @ x.T


def test_near_duplicates_equal_brute_force(spark):
    x = vectors()
    c = cosine(x)
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(c >= 0.95, 1)))]
    comp = components(range(len(x)), links)
    # a block of 64 makes many tiles
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(frame(spark, x), block=64).collect()}
    assert len(got) == len(x) + 8
    near_line = np.abs(c - 0.95).min()
    assert near_line > 1e-9
    for i in range(len(x)):
        assert got[i].n_links == (c[i] >= 0.95).sum() - 1, i
        assert got[i].component_id == comp[i] and got[i].kept == (comp[i] == i)
    for i in range(len(x), len(x) + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)


def test_near_duplicates_hot_group_and_empty(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal(16)
    x = np.vstack([np.repeat(base[None], 700, 0), base + r.standard_normal((300, 16)) * 0.01]).astype(np.float32)
    got = embedding_dedup.near_duplicate_vectors(frame(spark, x, bad=False), block=128).collect()
    assert {(g.n_links, g.component_id) for g in got} == {(999, 0)}
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quantisation_bound_holds():
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 48)) * np.exp(r.standard_normal((300, 1)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e, length = embedding_dedup.quantise(x)
    est = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(est - x @ x.T) <= e[:, None] + length[:, None] * e[None, :] + 1e-12).all()


def brute_nearest(x, ids, queries, k=5):
    c, out = cosine(x), {}
    for q in queries:
        order = sorted((-c[q, j], ids[j]) for j in range(len(ids)) if j != q)[:k]
        out[ids[q]] = order
    return out


def test_neighbours_recall_and_order(spark):
    x = vectors(3, 3000, 64)
    df = frame(spark, x)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), block=700).collect():
        got.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    want = brute_nearest(x, list(range(len(x))), range(0, len(x), 50))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        assert sorted(rows) == [1, 2, 3, 4, 5]
        found = [rows[i] for i in range(1, 6)]
        assert found == sorted(found) and q not in [v for _, v in found]
        kth = want[q][-1][0]
        hits += sum(s <= kth + 1e-12 for s, _ in found)
        assert all(abs(-s - cosine(x[[q, v]])[0, 1]) < 1e-12 for s, v in found)
    assert hits / (5 * len(want)) >= 0.9


def test_neighbours_few_candidates_and_ties(spark):
    x = np.array([[1, 0], [1, 0], [2, 0], [0, 1]], np.float32)
    df = frame(spark, x, bad=False)
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df.where("vec_id = 0")).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none, none).count() == 0
    assert ann.nearest(df, none).count() == 0
    # repeated rows count once, extra columns with names of the operator's own play no part
    from pyspark.sql import functions as F
    twice = df.union(df).withColumn("dim", F.lit("x")).withColumn("blk", F.lit("y")).withColumn("near", F.lit(1))
    assert sorted((r.rank, r.vec_id) for r in ann.nearest(twice, df.where("vec_id = 3")).collect()) == [
        (1, 0), (2, 1), (3, 2)]


def test_equal_and_scaled_vectors_tie_by_id(spark):
    r = np.random.default_rng(9)
    base = r.standard_normal(64)
    x = np.vstack([base * s for s in [1.0, 2.0, 0.5] * 150] + [base + 0.4 * r.standard_normal(64) for _ in range(250)])
    x = x[r.permutation(len(x))]
    x[r.permutation(len(x))[:100]] = x[0]           # copies of one vector, in all blocks
    df = frame(spark, x.astype(np.float32), bad=False)
    y = x.astype(np.float32).astype(float)
    norm = np.sqrt((y * y).sum(axis=1))
    for exact in (False, True):
        got = {}
        for g in ann.nearest(df, df.where("vec_id % 50 = 0"), block=128, exact=exact).collect():
            got.setdefault(g.query_id, {})[g.rank] = (g.vec_id, g.score)
        assert set(got) == set(range(0, len(x), 50))
        for q, rows in got.items():
            found = [rows[i] for i in range(1, 6)]
            assert found == sorted(found, key=lambda f: (-f[1], f[0]))
            score = (y * y[q]).sum(axis=1) / (norm * norm[q])
            assert all(abs(score[v] - s) < 1e-15 for v, s in found)
            same = [v for v in range(len(x)) if v != q and (y[v] == y[found[0][0]]).all()]
            if len(same) >= 5 and all((y[v] == y[same[0]]).all() for v, _ in found):
                assert [v for v, _ in found] == same[:5]


def test_registered_query_recall(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(t.embedding.to_numpy()), t.vec_id.tolist()
    want = brute_nearest(x, ids, [i for i, v in enumerate(ids) if v % 50 == 0])
    got = {}
    for r in E.queries()["op10_collision_ann"](spark, sf).collect():
        got.setdefault(r.query_id, []).append(-r.score)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(s <= want[q][-1][0] + 1e-12 for q, v in got.items() for s in v) / (5 * len(want)) >= 0.9
