"""Approximate nearest neighbours by collision counting.

The index holds, for each of M random unit directions, the vectors' projections in sorted order.
A query opens a window around its own projection in every sorted array; a vector collides once
for each window that holds it. Windows widen step by step (virtual rehashing: no bucket is built
twice, only the new ends of each window are counted), and a vector whose collisions reach the
threshold is verified by its exact cosine. A query stops when its k-th best verified neighbour
is closer than the radius that the windows stand for, and not before; the widest windows hold everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, register, table
from .vectors import cosines, matrix, unit, usable

K = 5
DIRECTIONS = 64     # M
COLLIDE = 0.62      # share of the directions in which a vector must collide to be verified
START, STEP = 0.6, 1.08     # first radius (distance of unit vectors) and its growth
BLOCK = 8192
QUERIES = 512


def directions(dim: int, m: int = DIRECTIONS, seed: int = 5) -> np.ndarray:
    """m unit directions in groups of orthogonal ones (dim x m)."""
    r = np.random.default_rng(seed)
    parts = [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-m // dim))]
    return np.hstack(parts)[:, :m]


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows -> (sorted projections, row numbers in that order), one line per direction."""
    p = (x @ directions(x.shape[1])).T
    order = np.argsort(p, axis=1, kind="stable")
    return np.take_along_axis(p, order, axis=1), order.astype(np.int32)


def search(q: np.ndarray, x: np.ndarray, proj: np.ndarray, order: np.ndarray,
           k: int, exact: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each unit query: (its number, rows of x that were verified, their cosines up to rounding)."""
    m, n = proj.shape
    if exact:
        for t in range(len(q)):
            yield t, np.arange(n), x @ q[t]
        return
    scale = np.sqrt(q.shape[1])
    radii = START * STEP ** np.arange(int(np.ceil(np.log(4 * scale / START) / np.log(STEP))) + 1)
    need = int(np.ceil(COLLIDE * m))
    qp = q @ directions(q.shape[1])
    # window ends in each sorted array for every query and radius; a vector at a distance equal to
    # the radius collides in about 68 of 100 directions
    low, high = np.empty((m, len(q), len(radii)), np.int32), np.empty((m, len(q), len(radii)), np.int32)
    for j in range(m):
        low[j] = np.searchsorted(proj[j], qp[:, j, None] - radii / scale, "left")
        high[j] = np.searchsorted(proj[j], qp[:, j, None] + radii / scale, "right")
    base = (np.arange(m, dtype=np.int64) * n)[:, None]
    flat = order.ravel()
    for t in range(len(q)):
        count, done = np.zeros(n, np.int64), np.zeros(n, bool)
        rows, cos = np.empty(0, np.int64), np.empty(0)
        for r, radius in enumerate(radii):
            lo, hi = low[:, t, r:r + 1] + base, high[:, t, r:r + 1] + base
            if r:       # only the new ends of each window
                ends = np.hstack((lo, low[:, t, r - 1:r] + base, high[:, t, r - 1:r] + base, hi)).reshape(-1, 2)
            else:
                ends = np.hstack((lo, hi))
            new = [flat[a:b] for a, b in ends.tolist() if a < b]
            if new:
                count += np.bincount(np.concatenate(new), minlength=n)
            last = r == len(radii) - 1
            fresh = np.flatnonzero(~done if last else (count >= need) & ~done)
            if len(fresh):
                done[fresh] = True
                rows = np.concatenate((rows, fresh))
                cos = np.concatenate((cos, x[fresh] @ q[t]))
            if len(rows) > k and np.partition(cos, len(cos) - k - 1)[len(cos) - k - 1] >= 1 - radius * radius / 2:
                break
        yield t, rows, cos


def _blob(a: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())


def _index(t: pa.Table) -> pa.Table:
    x = matrix(t.column("embedding"))
    proj, order = build(unit(x))
    return pa.table({"dim": t.column("dim").slice(0, 1), "blk": t.column("blk").slice(0, 1),
                     "ids": _blob(t.column("vec_id").to_numpy()), "raw": _blob(x), "proj": _blob(proj),
                     "ord": _blob(order)})


def _queries(t: pa.Table) -> pa.Table:
    x = matrix(t.column("embedding"))
    return pa.table({"dim": t.column("dim").slice(0, 1), "qblk": t.column("qblk").slice(0, 1),
                     "qids": _blob(t.column("vec_id").to_numpy()), "qraw": _blob(x)})


def _search_tiles(k: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: v[0] for c, v in batch.slice(r, 1).to_pydict().items()}
                d = row["dim"]
                ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["qids"], np.int64)
                raw, qraw = (np.frombuffer(row[c], float).reshape(-1, d) for c in ("raw", "qraw"))
                x, q = unit(raw), unit(qraw)
                proj = np.frombuffer(row["proj"], float).reshape(-1, len(ids))
                order = np.frombuffer(row["ord"], np.int32).reshape(-1, len(ids))
                out_q, out_v, out_s = [], [], []
                for t, rows, cos in search(q, x, proj, order, k, exact):
                    other = ids[rows] != qids[t]
                    rows, cos = rows[other], cos[other]
                    if len(rows) > k:       # what may be among the first k, whatever the products were rounded to
                        rows = rows[cos >= np.partition(cos, len(cos) - k)[len(cos) - k] - 1e-9]
                    # the score is a row's own, wherever it stands: equal vectors have equal scores
                    cos = cosines(raw[rows], np.broadcast_to(qraw[t], (len(rows), d)))
                    best = np.lexsort((ids[rows], -cos))[:k]
                    out_q.append(np.full(len(best), qids[t]))
                    out_v.append(ids[rows[best]])
                    out_s.append(cos[best])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)),
                                                      pa.array(np.concatenate(out_s))], ["query_id", "vec_id", "near"])
    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` its ``k`` nearest vectors of ``df``
    that were found, by largest cosine in double precision, ties to the smaller vec_id; itself excluded.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null vec_id, take no part on either side; only vectors of a query's length are its
    candidates; with fewer than ``k`` candidates all are returned; a vec_id that repeats counts
    once (its nearest vector); empty tables give no rows; other columns play no part. ``exact`` verifies every
    vector instead of those that collide.
    """
    prepare(df.sparkSession)
    good = usable(df).withColumn("dim", F.size("embedding"))
    asked = usable(queries).withColumn("dim", F.size("embedding")).dropDuplicates(["vec_id"])
    n, nq = good.count(), asked.count()
    nb, nqb = max(1, -(-n // block), min(6, n // 512)), max(1, -(-nq // QUERIES))
    index = materialize(good.withColumn("blk", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(nb)).cast("int"))
                        .groupBy("dim", "blk").applyInArrow(
        _index, "dim int, blk int, ids binary, raw binary, proj binary, ord binary"), "ann-index")
    qs = asked.withColumn("qblk", F.pmod(F.xxhash64("vec_id"), F.lit(nqb)).cast("int")).groupBy("dim", "qblk").applyInArrow(
        _queries, "dim int, qblk int, qids binary, qraw binary")
    # every block of queries meets every block of the index: joined on the pair of block numbers
    left = index.withColumn("qblk", F.explode(F.sequence(F.lit(0), F.lit(nqb - 1))))
    right = qs.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    tiles = left.join(right.hint("shuffle_hash"), ["dim", "blk", "qblk"]).repartition(min(2000, nb * nqb), "blk", "qblk")
    found = tiles.mapInArrow(_search_tiles(k, exact), "query_id long, vec_id long, near double")
    best = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("near").alias("score"))


@register("op10_collision_ann")
def op10_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th embedding."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
