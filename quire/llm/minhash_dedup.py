"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i every shingle is hashed to one bin and leaves a value there;
values of later rounds are larger, so a bin keeps the smallest value of the first round that
reached it. After T rounds without a fill, round T + j sends every shingle to bin j, so every
bin is filled for sure. Two sketches agree in a coordinate with probability J, and their number of
agreements is as concentrated as with T independent permutations, at O(n + T log T) instead of n T.

Exact copies (equal shingle sets) are folded into one representative first. Band keys that at
least two representatives share give stars: each member against the smallest one. Members of a
band that are still in different components after the stars are compared in blocks, all with all,
by the exact intersections of their full sets; a block returns a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _MUL, connected_components, materialize, mix64, prepare, register, table, word_hashes, words_of

K = 5               # words a shingle
T = 128             # sketch coordinates
ROWS = 4            # coordinates a band: T / ROWS bands
NUM, DEN = 75, 100  # similarity threshold
ELEMENTS, MEMBERS = 400_000, 1024   # shingles and members of a block of a band, about
COLUMNS = 4096      # shingles multiplied at a time


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles (fewer words: the whole sequence)."""
    buf = np.frombuffer((text or "").encode(), np.uint8)
    start, end = words_of(buf)
    h = word_hashes(buf, start, end)
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(min(k, len(h))))
    for j in range(min(k, len(h))):
        out = mix64(out * _MUL + h[j:j + n])
    return np.unique(out)


_SEEDS = mix64(np.arange(1, 2 * T + 1, dtype=np.uint64) * _MUL)


def sketch(s: np.ndarray, t: int = T) -> np.ndarray:
    """The sketch (t values of 32 bits) of a non-empty shingle set."""
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * t):
        h = mix64(s ^ _SEEDS[i])
        value = (np.uint64(i) << np.uint64(32)) | (h >> np.uint64(32))
        if i < t:
            bins = (h & np.uint64(0xFFFFFFFF)) % np.uint64(t)
            order = np.lexsort((value, bins))
            b, first = np.unique(bins[order], return_index=True)
            b = b.astype(np.int64)
            best[b] = np.minimum(best[b], value[order][first])
        else:
            best[i - t] = min(best[i - t], value.min())
        if best.max() != np.iinfo(np.uint64).max:
            break
    return (mix64(best) >> np.uint64(32)).astype(np.uint32)


def _band_keys(sk: np.ndarray) -> np.ndarray:
    rows = sk.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(len(rows), dtype=np.uint64) * _MUL
    for j in range(ROWS):
        key = mix64(key ^ rows[:, j])
    return key.view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> n_shingles, two hashes of the shingle set and its band keys."""
    for batch in batches:
        texts = batch.column("text")
        n, s1, s2, keys = [], [], [], []
        for i in range(batch.num_rows):
            s = shingles(texts[i].as_py())
            n.append(len(s))
            if len(s):
                s1.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mix64(s ^ _MUL).sum(dtype=np.uint64).view(np.int64)))
                keys.append(_band_keys(sketch(s)))
            else:
                s1.append(None)
                s2.append(None)
                keys.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
             pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "s1", "s2", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        sets = [shingles(texts[i].as_py()).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "set"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose full sets reach the threshold."""
    for batch in batches:
        a, b = batch.column("set_a"), batch.column("set_b")
        ok = []
        for i in range(batch.num_rows):
            x = np.frombuffer(a[i].as_buffer(), np.uint64)
            y = np.frombuffer(b[i].as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok.append(DEN * common >= NUM * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def common_counts(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of sorted sets (of ``sets_a`` with itself if ``sets_b`` is None), by
    products of 0/1 matrices over the elements that occur on both sides, some columns at a time."""
    def flat(sets):
        rows = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        e = np.concatenate(sets)
        order = np.argsort(e, kind="stable")
        return e[order], rows[order]

    ea, ra = flat(sets_a)
    eb, rb = (ea, ra) if sets_b is None else flat(sets_b)
    if sets_b is None:
        values, n = np.unique(ea, return_counts=True)
        shared = values[n > 1]
    else:
        shared = np.intersect1d(ea, eb)
    out = np.zeros((len(sets_a), len(sets_a if sets_b is None else sets_b)), np.float32)
    for lo in range(0, len(shared), COLUMNS):
        part = shared[lo:lo + COLUMNS]

        def dense(e, r, n):
            i, j = np.searchsorted(e, part[0], "left"), np.searchsorted(e, part[-1], "right")
            col = np.searchsorted(part, e[i:j])
            hit = part[col] == e[i:j]
            m = np.zeros((n, len(part)), np.float32)
            m[r[i:j][hit], col[hit]] = 1
            return m

        x = dense(ea, ra, out.shape[0])
        out += x @ (x if sets_b is None else dense(eb, rb, out.shape[1])).T
    return out


def _tile(t: pa.Table) -> pa.Table:
    """The members of two blocks of a band (or of one) -> a spanning forest of their links between
    different components, from exact intersections."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    blk, ids, comp, n = (t.column(c).to_numpy() for c in ("blk", "rep", "comp", "n_shingles"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
    left = np.flatnonzero(blk == i)
    right = left if i == j else np.flatnonzero(blk == j)
    out_a, out_b = [], []
    if len(left) and len(right):
        common = common_counts([sets[k] for k in left], None if i == j else [sets[k] for k in right])
        # shared / united >= NUM / DEN, in whole numbers
        x, y = np.nonzero((DEN + NUM) * common.astype(np.int64) >= NUM * (n[left][:, None] + n[right][None, :]))
        x, y = left[x], right[y]
        apart = comp[x] != comp[y]
        names, label = np.unique(comp, return_inverse=True)
        label = np.arange(len(names))[label]
        root = np.arange(len(names))
        for a, b in zip(x[apart], y[apart]):
            ra, rb = label[a], label[b]
            while root[ra] != ra:
                ra = root[ra]
            while root[rb] != rb:
                rb = root[rb]
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out_a.append(ids[a])
                out_b.append(ids[b])
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives -> those that reach the threshold on full sets."""
    p = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    p = p.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    return p.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, exact_id (smallest doc_id with the same shingle set).

    Documents with 75 shared of 100 united 5-word shingles or more are linked; a component is
    what links reach, its id the smallest doc_id, and that document is kept. Defined cases: null,
    empty or word-less texts have no shingles and are linked with nothing (kept); fewer than
    five words make one shingle; rows that repeat a doc_id are one document if their texts
    agree, else their links are those of both, and each row is returned; rows with a null doc_id
    are returned unlinked with a null component (kept); an empty table gives no rows; other columns
    play no part.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prof = materialize(base.mapInArrow(_profile, "doc_id long, n_shingles long, s1 long, s2 long, "
                                                 "keys array<long>"), "minhash")
    full = prof.where("n_shingles > 0 and doc_id is not null")
    # equal sets: one representative, the smallest id (combined before the shuffle)
    classes = materialize(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "minhash-reps")
    member = full.join(classes, ["s1", "s2", "n_shingles"]).select("doc_id", "rep").distinct()
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"]).dropDuplicates(
        ["doc_id", "s1"]).select(F.col("doc_id").alias("rep"), "n_shingles", "keys")
    bands = reps.select("rep", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("_top"))
    shared = materialize(shared.where("lead != _top").select("key", "lead"), "minhash-shared")
    hits = materialize(bands.join(shared, "key").select("key", "lead", "rep"), "minhash-hits")
    # full sets of the representatives that share a band with another
    wanted = hits.select("rep").distinct()
    texts = base.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id").withColumn(
        "_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"])
    sets = materialize(texts.select(F.col("doc_id").alias("rep"), "text").mapInArrow(_sets, "rep long, set binary"),
                       "minhash-sets")
    stars = hits.where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(_verified(stars, sets), "minhash-stars")
    comp = connected_components(links)
    # band mates in different components: all of them against each other, block by block
    tagged = hits.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("comp"))
    tagged = tagged.join(reps.select("rep", "n_shingles"), "rep")
    mixed = tagged.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"),
                                      F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_e"))
    mixed = mixed.where("_lo != _hi and _n > 2").select("key", F.ceil(F.greatest(
        F.col("_e") / ELEMENTS, F.col("_n") / MEMBERS)).cast("int").alias("_k"))
    members = tagged.join(mixed, "key").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int"))
    members = members.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    tiles = members.select("key", F.least("blk", "_o").alias("i"), F.greatest("blk", "_o").alias("j"), "blk", "rep",
                           "comp", "n_shingles").join(sets, "rep")
    more = materialize(tiles.groupBy("key", "i", "j").applyInArrow(_tile, "a long, b long").distinct(), "minhash-rest")
    comp = connected_components(links.union(more)) if more.limit(1).count() else comp
    final = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id"), F.min("rep").alias("exact_id"))
    out = prof.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
                      F.coalesce("exact_id", "doc_id").alias("exact_id"))


@register("op2_minhash_near_dedup")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on whole texts."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
