"""Vector code compression: a codebook for each part of a vector, fitted in integers, a byte a part.

Every round assigns parts to their nearest entry and moves the entries to the floor of their parts'
mean; all arithmetic is exact, so results do not depend on how rows are dealt. Most distances are
never computed: for each part and group of entries a row keeps a lower bound on the distance to the
group's other entries, with the round in which it was exact. The codebooks of all rounds are kept, so
what a bound has lost since is the largest net way of the group's entries from that round's codebook
to this one, the norm of the sum of their steps, never more than the sum of the norms. Groups whose
bound still exceeds the distance to the assigned entry are skipped, the others rescanned exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import discard, materialize, prepare, register, table

GROUPS = 8          # groups of entries with a bound of their own, a part
SALT = 16           # pieces that the rows of one label are dealt to
ROWS = 4096         # rows whose distances are in memory at once


def finite(df: DataFrame, label: str = "label") -> DataFrame:
    """vec_id, embedding (array<double>), label of the rows whose vector is not null and all finite."""
    e = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                  F.col(label).alias("label"))
    return e.where("embedding is not null").where(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


class Codebooks:
    """Codebooks of all rounds: ``history[round][part, entry]`` is an entry's integer components."""

    def __init__(self, first: np.ndarray, scale: int, largest: int):
        self.history, self.scale = [first], scale
        self.parts, self.entries, self.width = first.shape
        span = self.parts * self.width * (2 * max(largest, 1)) ** 2
        if span >= 1 << 63:
            raise OverflowError("squared distances of these components do not fit into 64 bits")
        self.kind = np.float64 if span < 1 << 53 else np.int64       # either holds every distance exactly
        self.groups = min(GROUPS, max(self.entries, 1))
        edges = np.linspace(0, self.entries, self.groups + 1).astype(int)
        self.spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        self.group_of = np.repeat(np.arange(self.groups), np.diff(edges))

    @property
    def final(self) -> np.ndarray:
        return self.history[-1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.final.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for, in the scale of the original ones."""
        return np.concatenate([self.final[p, int(code[2 * p:2 * p + 2], 16)] for p in range(self.parts)]) / self.scale

    def lost(self, part: int) -> np.ndarray:
        """[round, group]: the largest net way of a group's entries from that round's codebook to the last."""
        way = np.array([np.sqrt(((self.final[part] - old[part]).astype(np.float64) ** 2).sum(axis=1))
                        for old in self.history])
        return np.array([[w[a:b].max() for a, b in self.spans] for w in way]) * (1 + 1e-9)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[row, entry] squared distances, exact."""
    if x.dtype == np.float64:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in c], axis=1)


def _below(d: np.ndarray) -> np.ndarray:
    """Distances as single floats that are no larger than the given ones."""
    return np.nextafter(d.astype(np.float32), np.float32(-np.inf))


def assign(x: np.ndarray, books: Codebooks, part: int, code: np.ndarray | None = None, bound: np.ndarray | None = None,
           stamp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index) of each row of ``x``: (code, squared distance, bound, stamp, number of
    distances computed besides the one to the assigned entry). ``bound[:, g]`` is no larger than the distance to any
    entry of group g but the assigned one in the round ``stamp[:, g]``."""
    c, now, n = books.final[part].astype(x.dtype), len(books.history) - 1, len(x)
    far = x.dtype.type(np.inf if x.dtype == np.float64 else np.iinfo(np.int64).max)
    if code is None:
        old, old2 = np.zeros(n, np.int64), np.full(n, far)
        bound, stamp = np.zeros((n, books.groups), np.float32), np.zeros((n, books.groups), np.uint8)
        held, need = bound, np.ones((n, books.groups), bool)
    else:
        old = code.astype(np.int64)
        old2 = ((x - c[old]) ** 2).sum(axis=1)
        held = bound - books.lost(part)[stamp, np.arange(books.groups)]
        need = held <= (np.sqrt(old2.astype(np.float64)) * (1 + 1e-9))[:, None]
        bound, stamp = bound.copy(), stamp.copy()
    best, best2, scans = old.copy(), old2.copy(), []
    for g, (a, b) in enumerate(books.spans):
        rows = np.flatnonzero(need[:, g])
        if len(rows):
            d = squared(x[rows], c[a:b])
            j = d.argmin(axis=1)
            low = d[np.arange(len(rows)), j]
            better = (low < best2[rows]) | ((low == best2[rows]) & (j + a < best[rows]))
            best[rows[better]], best2[rows[better]] = (j + a)[better], low[better]
            scans.append((g, rows, d, j, low))
    for g, rows, d, j, low in scans:
        own = np.flatnonzero(j + books.spans[g][0] == best[rows])
        d[own, j[own]] = far                        # the bound is on the others
        low[own] = d[own].min(axis=1)
        bound[rows, g] = _below(np.sqrt(low.astype(np.float64)))
        stamp[rows, g] = now
    if code is not None:
        moved = np.flatnonzero(best != old)         # the entry that a row left counts among the others of its group
        g = books.group_of[old[moved]]
        kept = ~need[moved, g]
        rows, g = moved[kept], g[kept]
        bound[rows, g] = _below(np.minimum(held[rows, g], np.sqrt(old2[rows].astype(np.float64))))
        stamp[rows, g] = now
    return best, best2, bound, stamp, need @ np.diff(books.spans, axis=1).ravel()


def _rows_of(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize * x.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _assigned(rows: DataFrame, books: Codebooks, label_type: str) -> DataFrame:
    """One round: ``rows`` (vec_id, label, embedding or ints with the state of the round before) with their codes,
    bounds and stamps, the squared distance over all parts, and the distances computed."""
    first = "embedding" in rows.columns
    parts, width, groups = books.parts, books.width, books.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                n, col = b.num_rows, {name: b.column(i) for i, name in enumerate(b.schema.names)}
                if first:
                    flat = np.asarray(col["embedding"].flatten(), np.float64)
                    ints = np.floor(flat.reshape(n, parts * width) * books.scale).astype(np.int32)
                else:
                    ints = _rows_of(col["ints"], np.int32, parts * width)
                    code = _rows_of(col["code"], np.uint8, parts)
                    bound = _rows_of(col["bound"], np.float32, parts * groups).reshape(n, parts, groups)
                    stamp = _rows_of(col["stamp"], np.uint8, parts * groups).reshape(n, parts, groups)
                x = ints.reshape(n, parts, width).astype(books.kind)
                got = [assign(x[:, p], books, p, *(() if first else (code[:, p], bound[:, p], stamp[:, p])))
                       for p in range(parts)]
                new = [np.stack([g[i] for g in got], axis=1) for i in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [col["vec_id"], col["label"], _binary(ints), _binary(new[0].astype(np.uint8)),
                     _binary(new[2].reshape(n, -1)), _binary(new[3].reshape(n, -1)),
                     pa.array(new[1].astype(np.int64).sum(axis=1)), pa.array(new[4].sum(axis=1).astype(np.int64))],
                    ["vec_id", "label", "ints", "code", "bound", "stamp", "error", "distances"])

    return rows.mapInArrow(run, f"vec_id long, label {label_type}, ints binary, code binary, bound binary, stamp binary, "
                                "error long, distances long")


def _moved(state: DataFrame, books: Codebooks) -> np.ndarray:
    """The next codebook: the floor of the mean of each entry's parts; entries without parts stay. Tasks add up their
    rows by entry; a row an entry, as many as the codebook has whatever the table's size, reaches the driver."""
    parts, entries, width = books.parts, books.entries, books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _rows_of(b.column(0), np.int32, parts * width).reshape(-1, parts, width)
            code = _rows_of(b.column(1), np.uint8, parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                which, start = np.unique(code[order, p], return_index=True)
                if len(which):
                    total[p, which] += np.add.reduceat(x[order, p].astype(np.int64), start, axis=0)
                count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[p, e].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)),
                                          pa.array(count[p, e]), sums], ["part", "entry", "n", "sums"])

    sums = state.select("ints", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"),
                                             F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    new = books.final.copy()
    for r in sums.collect():
        new[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    return new


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
             label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """Fit the codebooks on all finite vectors and encode them: (rows of vec_id, label, code, error and distances,
    the codebooks).

    Components become floor(scale * x); a part's codebook starts with that part of the vectors of the smallest ids
    (null ids last, then by components), as many as there are. ``code`` is two hex digits a part, ``error`` the squared
    distance to the entries. Defined cases: vectors that are null or hold null or non-finite components are dropped;
    of vectors of different lengths those of the commonest (then greater) length are fitted, and the others
    have null code and error; repeated rows count each time; an empty table gives no rows and no codebooks; other columns
    play no part. Raises where the length has no equal parts, or where squared distances do not fit into 64 bits.
    """
    spark = vectors.sparkSession
    prepare(spark)
    if not 0 < entries <= 256 or rounds > 255:
        raise ValueError("a code is one byte a part, a stamp one byte a bound")
    rows = finite(vectors, label)
    label_type = rows.schema["label"].dataType.simpleString()
    largest = F.max(F.array_max(F.transform("embedding", F.abs)))
    found = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), largest.alias("top")).orderBy(
        F.col("n").desc(), F.col("d").desc()).first()
    out = "vec_id long, code string, error long, distances long"
    if found is None or not found.d:
        blank = rows.select("vec_id", "label", *[F.lit(None).cast(t).alias(c) for c, t in
                                                 (x.split() for x in out.split(", ")[1:])])
        return blank, None
    if found.d % parts:
        raise ValueError(f"vectors of {found.d} components have no {parts} equal parts")
    top = found.top * scale + 1
    if top >= 1 << 31:
        raise OverflowError("components times scale do not fit into 32 bits")
    fit = rows.where(F.size("embedding") == found.d)
    seeds = fit.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    seeds = seeds.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    first = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    books, state, before = Codebooks(first, scale, int(top)), fit, None
    for r in range(rounds):
        path = scratch_dir(spark, f"codes-{r}")
        step = _assigned(state, books, label_type)
        step.write.parquet(path)
        state = spark.read.schema(step.schema).parquet(path)
        books.history.append(_moved(state, books))
        discard(spark, before)
        before = path
    last = _assigned(state, books, label_type).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error",
                                                      "distances")
    others = rows.where(F.size("embedding") != found.d).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"),
        F.lit(None).cast("long").alias("distances"))
    return last.union(others), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add label_error, the error summed over the rows of a label (nulls are one), which may hold most of the table:
    sums are combined before the shuffle, and the rows of a label meet theirs in several pieces."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("_l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_p"))
    dealt = codes.withColumn("_q", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALT)).cast("int"))
    return dealt.join(sums, (F.col("_q") == F.col("_p")) & F.col("label").eqNullSafe(F.col("_l"))).drop("_q", "_p", "_l")


def _sql(rounds: int = 4) -> str:
    """The same rounds in SQL, every distance computed: components are rows, a minimum of distance and index decides."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d * 256 + entry) AS m FROM (
    SELECT c.vec_id, c.part, b.entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d
    FROM comp c JOIN book{r} b ON b.part = c.part AND b.pos = c.pos GROUP BY c.vec_id, c.part, b.entry)
  GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x
  FROM book{r} b LEFT JOIN (
    SELECT c.part, n.m % 256 AS entry, c.pos, CAST(sum(c.x) AS BIGINT) AS s, count(*) AS n
    FROM comp c JOIN near{r} n ON n.vec_id = c.vec_id AND n.part = c.part GROUP BY c.part, n.m % 256, c.pos) t
  ON t.part = b.part AND t.entry = b.entry AND t.pos = b.pos)""")
    rest = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(embedding) AS x) WHERE x IS NULL OR NOT isfinite(x))
), comp AS MATERIALIZED (
  SELECT vec_id, i // w AS part, i % w AS pos, CAST(floor(1024 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, embedding, len(embedding) // 4 AS w, unnest(range(len(embedding))) AS i FROM kept)
), seed AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256
), book0 AS MATERIALIZED (
  SELECT part, entry, pos, x FROM comp JOIN seed USING (vec_id)
), {rest}, codes AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY part) AS code,
         CAST(sum(m // 256) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM codes c JOIN kept k USING (vec_id)
"""


@register("op13_vector_codes", _sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finite vectors as codes of four bytes, with their errors and the digest of the codebooks."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = with_label_error(materialize(codes, "codes"))       # read twice, made once
    digest = F.lit(books.sha256() if books else None).cast("string")
    return codes.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
