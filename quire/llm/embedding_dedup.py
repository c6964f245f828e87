"""Near-duplicate embeddings by int8 tile products with error bounds.

Every unit vector x is stored as int8 values q and a scale s, with the exact length e of what
rounding lost: x = s q + d, |d| = e. For two vectors |x.y - s t q.r| <= e_x + |s q| e_y, so a tile of
the int8 products (exact in floating point, run by matrix multiplication) rules out every pair
whose product plus bound stays below the threshold. Only the other pairs are computed again, in
double precision on the original vectors. A tile returns sums and a spanning forest of its
links, not the links, so groups of copies do not grow with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, prepare, register, table
from .vectors import cosines, matrix, unit, usable

THRESHOLD = 0.95
BLOCK = 8192        # vectors a block, about
STRIP = 512         # rows of a tile at a time
PAIRS = 100_000     # pairs computed again at a time


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 values, scales, lengths of the rounding error, lengths of the rounded rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    err = np.sqrt(((x - back) ** 2).sum(axis=1)) + 1e-9      # covers the arithmetic of the bound itself
    return q.astype(np.int8), scale, err, np.sqrt((back ** 2).sum(axis=1)) + 1e-9


def _pack(table_: pa.Table) -> pa.Table:
    """The vectors of one block as one row."""
    x = matrix(table_.column("embedding"))
    q, scale, err, length = quantise(unit(x))
    blob = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    return pa.table({"dim": table_.column("dim").slice(0, 1), "blk": table_.column("blk").slice(0, 1),
                     "ids": blob(table_.column("rep").to_numpy()), "copies": blob(table_.column("copies").to_numpy()),
                     "raw": blob(x.astype(np.float32) if (x.astype(np.float32) == x).all() else x),
                     "q": blob(q), "scale": blob(scale), "err": blob(err), "length": blob(length)})


_BLOCK_FIELDS = ("ids", "copies", "raw", "q", "scale", "err", "length")


def _unpack(row: dict, side: str, dim: int) -> dict:
    kinds = {"ids": np.int64, "copies": np.int64, "q": np.int8, "scale": float, "err": float, "length": float}
    out = {k: np.frombuffer(row[f"{k}_{side}"], t) for k, t in kinds.items()}
    n = len(out["ids"])
    out["q"] = out["q"].reshape(n, dim)
    raw = row[f"raw_{side}"]
    out["raw"] = np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim)
    return out


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest label over the links (i, j), by hooking and pointer jumping until nothing changes."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def tile_links(a: dict, b: dict, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (row of a, row of b) of a tile, strip by strip."""
    kind = np.float32 if a["q"].shape[1] <= 1024 else np.float64      # exact: sums stay below 2^24
    qb = b["q"].astype(kind).T
    tb = b["scale"].astype(np.float32)
    eb = float(b["err"].max())
    for lo in range(0, len(a["ids"]), STRIP):
        hi = min(lo + STRIP, len(a["ids"]))
        est = (a["q"][lo:hi].astype(kind) @ qb) * tb
        est *= a["scale"][lo:hi, None].astype(np.float32)
        slack = 1e-4 + a["err"][lo:hi].max() + eb * a["length"][lo:hi].max()      # 1e-4: single precision scales
        i, j = np.nonzero(est >= threshold - slack)
        value = est[i, j]
        i += lo
        near = value >= threshold - (1e-4 + a["err"][i] + a["length"][i] * b["err"][j])
        if same:
            near &= i < j
        i, j = i[near], j[near]
        found_i, found_j = [], []
        for k in range(0, len(i), PAIRS):
            x, y = i[k:k + PAIRS], j[k:k + PAIRS]
            ok = cosines(a["raw"][x].astype(np.float64), b["raw"][y].astype(np.float64)) >= threshold
            found_i.append(x[ok])
            found_j.append(y[ok])
        if found_i:
            yield np.concatenate(found_i), np.concatenate(found_j)


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(r, 1).to_pydict().items()}
                same = row["i"] == row["j"]
                a, b = _unpack(row, "a", row["dim"]), _unpack(row, "b", row["dim"])
                n, m = len(a["ids"]), len(b["ids"])
                shift = 0 if same else n
                links, label = np.zeros(shift + m, np.int64), np.arange(shift + m)
                for i, j in tile_links(a, b, same, threshold):
                    links += np.bincount(i, b["copies"][j], minlength=shift + m).astype(np.int64)
                    links += np.bincount(j + shift, a["copies"][i], minlength=shift + m).astype(np.int64)
                    label = _join_labels(label, i, j + shift)
                ids = a["ids"] if same else np.concatenate((a["ids"], b["ids"]))
                hit = np.flatnonzero(links)
                root = label[hit]
                while (label[root] != root).any():
                    root = label[root]
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[root]), pa.array(links[hit])],
                                                 ["a", "b", "n"])
    return run


def near_duplicate_vectors(df: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``df`` (vec_id, embedding, ...).

    Two vectors are linked from cosine ``threshold`` on. Equal vectors are compared once and
    count as many times as they occur. Defined cases: vectors that are null, empty, zero or hold
    null or non-finite components, and rows with a null vec_id, link with nothing (0 links, own
    component, kept); vectors of different length are not linked; a row that repeats a vec_id with the
    same vector counts as another vector; an empty table gives no rows; other columns play no part.
    """
    spark = df.sparkSession
    prepare(spark)
    good = usable(df).select("vec_id", "embedding", F.size("embedding").alias("dim"),
                             F.xxhash64("embedding").alias("h"))
    # equal vectors: one representative; the hash comes first so that the vectors are compared last
    reps = materialize(good.groupBy("h", "embedding").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim")), "vectors")
    n = reps.count()
    blocks_wanted = max(1, -(-n // block), min(8, n // 512))
    packed = reps.select("rep", "copies", "embedding", "dim",
                         F.pmod(F.xxhash64("rep"), F.lit(blocks_wanted)).cast("int").alias("blk"))
    packed = materialize(packed.groupBy("dim", "blk").applyInArrow(
        _pack, "dim int, blk int, " + ", ".join(f"{k} binary" for k in _BLOCK_FIELDS)), "vector-blocks")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks_wanted - 1))).alias("o")
    side = lambda s: [F.col(k).alias(f"{k}_{s}") for k in _BLOCK_FIELDS]
    left = packed.select("dim", F.col("blk").alias("i"), others, *side("a")).where("i <= o").withColumnRenamed("o", "j")
    right = packed.select("dim", F.col("blk").alias("j"), others, *side("b")).where("o <= j").withColumnRenamed("o", "i")
    tiles = left.join(right.hint("shuffle_hash"), ["dim", "i", "j"]).repartition(
        max(1, min(2000, blocks_wanted * (blocks_wanted + 1) // 2)), "i", "j")
    found = materialize(tiles.mapInArrow(_tiles(threshold), "a long, b long, n long"), "vector-links")
    sums = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep")
    classes = reps.select("h", "embedding", "rep", "copies").join(sums, "rep", "left").join(comp, "rep", "left")
    classes = classes.select("h", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("component", "rep").alias("component_id"))
    known = good.join(classes, ["h", "embedding"]).select("vec_id", "h", "n_links", "component_id")
    known = known.groupBy("vec_id", "h").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"),
                     F.xxhash64(F.col("embedding").cast("array<double>")).alias("h"))
    out = rows.join(known, ["vec_id", "h"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


@register("op6_embedding_near_dedup")
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whatever their labels, by cosine 0.95."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
