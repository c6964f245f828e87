"""Vector codes against rounds that compute every distance."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{(vec_id, components): (code, error, label_error)} and the digest; Python integers throughout."""
    x = [(i, [int(np.floor(float(v) * scale)) for v in e], lab) for i, e, lab in rows]
    x.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(x[0][1]) // parts
    books = [[r[1][p * w:(p + 1) * w] for r in x[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for r in x:
                held.setdefault(nearest(r[1][p * w:(p + 1) * w], books[p])[1], []).append(r[1][p * w:(p + 1) * w])
            for j, vs in held.items():
                books[p][j] = [sum(c) // len(vs) for c in zip(*vs)]
    out, by_label = [], {}
    for r in x:
        got = [nearest(r[1][p * w:(p + 1) * w], books[p]) for p in range(parts)]
        err = sum(g[0] for g in got)
        by_label[r[2]] = by_label.get(r[2], 0) + err
        out.append((r[0], r[2], "".join(f"{g[1]:02x}" for g in got), err))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, code, err, by_label[lab]) for i, lab, code, err in out], key=repr), digest


def clustered(n, dim, seed=0, spread=0.1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dim))
    return (centres[r.integers(0, 12, n)] + spread * r.standard_normal((n, dim))).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if v is None else float(v) for v in e], lab)
                                  for i, e, lab in rows], SCHEMA)


def result(df, **kw):
    codes, books = vector_codes.compress(df, **kw)
    rows = [tuple(r) for r in vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error").collect()]
    return sorted(rows, key=repr), books


@pytest.mark.parametrize("entries,parts,dim", [(256, 4, 16), (20, 4, 16), (5, 2, 6), (1, 1, 3)])
def test_codes_equal_brute_force(spark, entries, parts, dim):
    x = clustered(330, dim, seed=dim)
    rows = [(i * 3 % 331, v, None if i % 7 == 0 else f"l{i % 3}") for i, v in enumerate(x)]
    rows += rows[:5] + [(1000 + i, x[0], "copies") for i in range(40)] + [(None, x[1], "hot")] * 3
    got, books = result(frame(spark, rows).repartition(5), entries=entries, parts=parts)
    want, digest = brute(rows, entries=entries, parts=parts)
    assert got == want and books.sha256() == digest


def test_ties_go_to_the_lower_index_and_unused_entries_stay(spark):
    # entries 0 and 2 are equal, entry 1 is as far from 0.5 as entry 0
    rows = [(0, [0.0] * 4, "a"), (1, [1.0] * 4, "a"), (2, [0.0] * 4, "a"), (3, [0.5] * 4, "a"), (4, [-0.25] * 4, None)]
    got, books = result(frame(spark, rows), entries=3)
    want, digest = brute(rows, entries=3)
    assert got == want and books.sha256() == digest
    once = vector_codes.compress(frame(spark, rows), entries=3, rounds=1)[1]
    assert (once.final[:, 2] == 0).all() and (once.final[:, 0] == 64).all()     # entry 2 had no parts: it stays


def test_odd_vectors_have_defined_results(spark):
    x = clustered(60, 8, seed=3)
    rows = [(i, v, "a") for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    dropped = [(100, None, "a"), (101, [nan] + [1.0] * 7, "a"), (102, [None] + [1.0] * 7, "a"), (103, [-inf] * 8, None)]
    other = [(200, [1.0, 2.0], "a"), (201, [], "b")]
    df = frame(spark, rows + dropped + other)
    for name in ("code", "error", "ints", "bound", "_p", "_l", "part", "n"):
        df = df.withColumn(name, F.lit("x"))
    got, books = result(df)
    want, digest = brute(rows)
    total = sum(w[2] for w in want)
    assert [g for g in got if g[0] < 100] == want and books.sha256() == digest
    assert [g for g in got if g[0] >= 100] == [(200, None, None, total), (201, None, None, None)]
    v = books.decode(want[0][1])
    assert v.shape == (8,)
    empty, none = result(frame(spark, []))
    assert empty == [] and none is None
    assert result(frame(spark, [(1, [], "a")]))[0] == [(1, None, None, None)]
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, [(1, [1.0] * 6, "a")]))
    with pytest.raises(OverflowError):
        vector_codes.compress(frame(spark, [(1, [1e30] * 8, "a")]))


def test_large_components_stay_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.standard_normal(8) * 60_000).astype(np.float32), "a") for i in range(80)]    # beyond 2^53 squared
    got, books = result(frame(spark, rows), entries=30)
    assert books.kind is np.int64
    want, digest = brute(rows, entries=30)
    assert got == want and books.sha256() == digest


def test_bounds_never_exceed_the_distances_they_stand_for():
    x = np.floor(clustered(500, 16, seed=8, spread=0.6) * 1024).astype(np.float64)
    books = vector_codes.Codebooks(x[:256].astype(np.int64).reshape(1, 256, 16), 1024, int(np.abs(x).max()))
    code = bound = stamp = None
    share = []
    for _ in range(6):
        code, d2, bound, stamp, seen = vector_codes.assign(x, books, 0, code, bound, stamp)
        true = ((x[:, None] - books.final[0][None]) ** 2).sum(axis=2)
        assert (d2 == true.min(axis=1)).all() and (code == true.argmin(axis=1)).all()
        dist = np.sqrt(true)
        dist[np.arange(len(x)), code] = np.inf
        held = bound - books.lost(0)[stamp, np.arange(books.groups)]
        for g, (a, b) in enumerate(books.spans):
            assert (held[:, g] <= dist[:, a:b].min(axis=1)).all()
        share.append(seen.mean() / 256)
        new = books.final.copy()
        for j in range(256):
            if (code == j).any():
                new[0, j] = x[code == j].astype(np.int64).sum(axis=0) // (code == j).sum()
        books.history.append(new)
    assert share[0] == 1 and share[-1] < 0.5        # most groups are skipped once entries settle


def test_registered_query(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = brute(rows)
    got = E.queries()["op13_vector_codes"](spark, sf).collect()
    assert {g.codebooks_sha256 for g in got} == {digest}
    assert sorted([(g.vec_id, g.code, g.error, g.label_error) for g in got], key=repr) == want
