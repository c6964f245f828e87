"""Token ids in Arrow files: sequences of equal length with masks, read in place.

Documents in ascending doc_id order are encoded, ended by an id of their own and laid end to end;
every ``length`` ids are one sequence, one row of a fixed-size list. Files are in Arrow's IPC file
format, a stream of batches with a footer of their places, and all batches of a file but the last
hold the same number of rows: sequence i is row ``i % rows`` of batch ``i // rows``, and a memory
map gives it as a view on the file. Beside each file of sequences lies one of its documents.

Texts are dealt by range of doc_id; each task streams its part to files of its own, under a name
that no other attempt uses, and reports them in one row. That table, the manifest, is what counts:
files of lost or repeated attempts are in no row of it.
"""

from __future__ import annotations

import bisect
import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import prepare, register, table

LENGTH = 1024        # ids a sequence
ROWS = 256           # sequences a batch
MEMO = 500_000       # words kept by one Python worker, twice: a full memo becomes the older one
CHUNK = 4 << 20      # bytes of text encoded at once, one text at least
MANIFEST = "part int, file string, docs string, n_docs long, n_tokens long"

# The steps of a tokenizer that never joins what white space parts.
BLANK_SAFE_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BLANK_SAFE_NORMAL = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                     {"type": "Lowercase"})
# Marks that such a tokenizer parts from a letter or digit beside them (not the apostrophe: it may begin a token).
EDGE_MARKS = b'.,!?#;:")(*-_/\\|[]{}<>=+&%$@~^`'


class Encoder:
    """Packed ids of whole texts by a tokenizers file, without special tokens added.

    Where the file's steps cannot see past a blank, and lower-case everything, each lower-cased word is encoded
    once and kept; else whole texts are.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        top = max(self.library.get_vocab_size(with_added_tokens=True) - 1, end_id)
        self.code = "H" if top < 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _blank_safe(spec)
        self.added = [t["content"].lower() for t in spec.get("added_tokens", [])]
        self.plain, suffix = None, spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(top + 1, bool)                 # does an id end a run of letters?
        if self.by_word and suffix:
            for token, i in spec["model"]["vocab"].items():
                self.last[i] = token.endswith(suffix)
            # lower-case ASCII letters pass all steps before the model unchanged: the same model without them
            self.plain = Tokenizer.from_str(json.dumps(
                spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Encode words into the memo: those of which it is clear how many runs they are, letters or the marks beside
        them, many at a time, told apart by the ends of the runs."""
        odd: list[bytes] = []
        clear: dict[tuple[bool, int], list[bytes]] = {(True, 1): [], (False, 1): [], (False, 2): [], (False, 3): []}
        for w in words:
            if w.isalpha():
                clear[True, 1].append(w)
            elif not w.isascii():
                (clear[False, 1] if w.decode().isalpha() else odd).append(w)
            elif w.strip(EDGE_MARKS).isalpha():
                clear[False, 3 - w[:1].isalpha() - w[-1:].isalpha()].append(w)
            else:
                odd.append(w)
        width = self.dtype.itemsize
        for (bare, n), known in clear.items():
            if self.plain is None:
                odd += known
                continue
            some = [known[at:at + 200] for at in range(0, len(known), 200)]
            tool = self.plain if bare else self.library
            for run, got in zip(some, tool.encode_batch_fast([b" ".join(r).decode() for r in some], add_special_tokens=False)):
                ids = np.array(got.ids)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != n * len(run):
                    odd += run
                    continue
                packed, a = ids.astype(self.dtype).tobytes(), 0
                for w, e in zip(run, (ends[n - 1::n] * width).tolist()):
                    self.memo[w], a = packed[a:e], e
        self.memo.update(zip(odd, self._library([w.decode() for w in odd])))

    def _know(self, words: list[bytes]) -> None:
        if len(self.memo) >= MEMO:
            self.memo, self.older = {b"": b""}, self.memo
        fresh = set(words).difference(self.memo)
        for w in fresh & self.older.keys():
            self.memo[w] = self.older[w]
        self._learn(list(fresh.difference(self.memo)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, each ended by the end id; how many of them are each text's)."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            runs = [b + self.end for b in self._library(texts.to_pylist())]
            return np.frombuffer(b"".join(runs), self.dtype), np.array([len(b) for b in runs]) // self.dtype.itemsize
        lower = pc.ascii_lower(texts)
        whole = np.zeros(len(texts), bool)
        for t in self.added:                                # these are looked for before any other step
            whole |= pc.match_substring(lower, t).to_numpy(zero_copy_only=False)
        if whole.any():
            lower = pc.if_else(pa.array(whole), "", lower)
        parts = pc.ascii_split_whitespace(lower)
        words = parts.flatten().dictionary_encode()
        known = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self._know(known)
        runs = [self.memo[w] for w in known]
        # a text is its words, or itself, and then the end
        place = words.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(parts).to_numpy())
        at = np.flatnonzero(whole)
        place = np.insert(place, np.concatenate((ends[at], ends)),
                          np.concatenate((len(runs) + 1 + np.arange(len(at)), np.full(len(ends), len(runs)))))
        runs += [self.end, *self._library([texts[i].as_py() for i in at.tolist()])]
        size = np.fromiter(map(len, runs), np.int64, len(runs)) // self.dtype.itemsize
        first, n = np.cumsum(size) - size, size[place]
        total = np.cumsum(n)
        ids = np.frombuffer(b"".join(runs), self.dtype)[np.repeat(first[place] - (total - n), n) + np.arange(total[-1])]
        upto = total[np.cumsum(np.diff(ends, prepend=0) + 1 + whole) - 1]
        return ids, np.diff(upto, prepend=0)


def _blank_safe(spec: dict) -> bool:
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    first = split.get("pretokenizers", [split])[0]
    return (steps == list(BLANK_SAFE_NORMAL) and first.get("type") == "Split"
            and first.get("pattern") == {"Regex": BLANK_SAFE_SPLIT} and first.get("behavior") == "Removed"
            and first.get("invert") is True and spec.get("post_processor") is None
            and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
            and not any(t["content"].split() != [t["content"]] or t["lstrip"] or t["rstrip"] or t["single_word"]
                        for t in spec.get("added_tokens", [])))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder a Python process, file and end id."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _place(path: str):
    """(file system, path in it) of a qualified path."""
    import pyarrow.fs as pafs
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark itself would read it by."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


class _SequenceFile:
    """Cuts a run of ids into rows of one length and writes them in batches of equal size."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.dtype, self.length, self.rows = dtype, length, rows
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))],
                                metadata={"rows": str(rows)})
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.pending: list[bytes] = []
        self.waiting = 0

    def add(self, ids: bytes) -> None:
        self.pending.append(ids)
        self.waiting += len(ids)
        batch = self.rows * self.length * self.dtype.itemsize
        if self.waiting >= batch:
            run = b"".join(self.pending)
            whole = len(run) // batch * batch
            for at in range(0, whole, batch):
                self._write(np.frombuffer(run, self.dtype, batch // self.dtype.itemsize, at))
            self.pending, self.waiting = [run[whole:]], len(run) - whole

    def _write(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.length) * self.length
        mask = np.arange(n) < len(ids)
        flat = pa.array(np.concatenate((ids, np.zeros(n - len(ids), self.dtype))) if n > len(ids) else ids)
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(flat, self.length),
                                                 pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)],
                                                schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.pending), self.dtype)
        if len(rest):
            self._write(rest)
        self.writer.close()


def write_sequences(docs: DataFrame, folder: str, tokenizer_file: str | None = None, end_id: int = 2,
                    length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them as sequences below ``folder``; the manifest, also written
    there: part, file, docs (their paths), n_docs, n_tokens, start (ids of all parts before it).

    Defined cases: a null or empty text is its end id alone; a null doc_id comes first; rows of one doc_id follow
    each other by a hash of their texts, repeated rows are written each time; an empty table gives an empty
    manifest and no file; other columns play no part. ``folder`` must be shared by all executors.
    """
    spark = docs.sparkSession
    prepare(spark)
    path, folder = tokenizer_file or default_tokenizer(), _qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = None, TaskContext.get().partitionId()
        name = f"{folder}/data/part-{part:06d}-{uuid.uuid4().hex}"
        start = n_docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if enc is None:
                enc = encoder(path, end_id)
                fs, inner = _place(name)
                fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                sink, index = fs.open_output_stream(inner + ".arrow"), fs.open_output_stream(inner + ".docs.arrow")
                seqs = _SequenceFile(sink, enc.dtype, length, rows)
                table_of = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
                entries = pa.ipc.new_file(index, table_of)
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            cut = np.flatnonzero(np.diff(size // CHUNK, prepend=0)).tolist()        # some texts at a time
            for at, to in zip([0, *cut], [*cut, batch.num_rows]):
                if to > at:
                    ids, n = enc.encode(batch.column(1).slice(at, to - at))
                    seqs.add(ids.tobytes())
                    entries.write_batch(pa.record_batch([batch.column(0).slice(at, to - at),
                                                         pa.array(start + np.cumsum(n) - n), pa.array(n)], schema=table_of))
                    start += len(ids)
                    n_docs += len(n)
        if enc is None:
            return
        seqs.close()
        entries.close()
        sink.close()
        index.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name + ".arrow", "docs": name + ".docs.arrow",
                                           "n_docs": n_docs, "n_tokens": start}],
                                         pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.string()),
                                                    ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    key = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    ordered = ordered.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a written folder, with the place of each part; a row a file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest").withColumn(
        "start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _open(path: str):
    """A reader of an Arrow file: on a memory map where the file is local, so that batches are views on it."""
    import pyarrow.fs as pafs
    fs, inner = _place(path)
    return pa.ipc.open_file(pa.memory_map(inner) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner))


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of a batch's rows, one after the other, not copied."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=True)


class Sequences:
    """Random access to all sequences of some files, in order: ``seqs[i]`` is (ids, mask), views on the file."""

    def __init__(self, files: Sequence[str]):
        self.readers = [_open(f) for f in files]
        self.rows = [int(r.schema.metadata[b"rows"]) for r in self.readers]
        sizes = [(r.num_record_batches - 1) * k + r.get_batch(r.num_record_batches - 1).num_rows
                 for r, k in zip(self.readers, self.rows)]
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(int).tolist()

    def __len__(self) -> int:
        return self.first[-1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = bisect.bisect_right(self.first, i) - 1
        b, row = divmod(i - self.first[k], self.rows[k])
        batch = self.readers[k].get_batch(b)
        length = batch.schema.field("ids").type.list_size
        return _flat(batch)[row * length:(row + 1) * length], batch.column(1).flatten().slice(row * length, length)


class _Cursor:
    """Reads spans of ids in ascending order; one batch is looked at at a time."""

    def __init__(self, reader: pa.ipc.RecordBatchFileReader):
        self.reader, self.batch, self.at, self.flat, self.known = reader, -1, 0, (), 0

    def next(self) -> bool:
        if self.batch + 1 >= self.reader.num_record_batches:
            return False
        self.batch, self.at = self.batch + 1, self.at + len(self.flat)
        batch = self.reader.get_batch(self.batch)
        self.flat = _flat(batch)
        self.known += batch.column(1).flatten().true_count
        return True

    def take(self, start: int, n: int) -> list[np.ndarray]:
        """The views that hold ids start to start + n, batch by batch."""
        out = []
        while n:
            while start >= self.at + len(self.flat):
                if not self.next():
                    raise ValueError("the file ends before its documents")
            out.append(self.flat[start - self.at:start - self.at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out


def read_documents(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), with ``keep_ids`` also ids, of each document, from the files of a manifest; a task a file.

    A file whose mask does not hold as many ids as its documents raises.
    """
    prepare(manifest.sparkSession)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, docs, before in (r.values() for batch in batches for r in batch.to_pylist()):
            cursor, index, total = _Cursor(_open(file)), _open(docs), 0
            for b in range(index.num_record_batches):
                entries = index.get_batch(b)
                crcs, ids = [], []
                for start, n in zip(entries.column(1).to_pylist(), entries.column(2).to_pylist()):
                    views, crc = cursor.take(start, n), 0
                    for v in views:
                        crc = zlib.crc32(v.astype("<u4").tobytes(), crc)
                    crcs.append(crc)
                    total += n
                    if keep_ids:
                        ids.append(np.concatenate(views).astype(np.int64))
                starts = pa.array(entries.column(1).to_numpy() + before)
                cols = [entries.column(0), starts, entries.column(2), pa.array(crcs, pa.int64())]
                cols += [pa.array(ids, pa.list_(pa.int64()))] if keep_ids else []
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])
            if cursor.next() or cursor.known != total:
                raise ValueError(f"{file}: the mask holds {cursor.known} ids, the documents {total}")

    files = manifest.select("file", "docs", "start",
                            (F.row_number().over(Window.orderBy("part")) - 1).alias("_k"))
    return files.repartitionById(max(1, manifest.count()), F.col("_k")).drop("_k").mapInArrow(run, schema)


@register("op12_arrow_sequences")
def op12_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as sequences of 1,024 ids with masks, and read back document by document."""
    prepare(spark)
    return read_documents(write_sequences(table(spark, sf_dir, "documents"), scratch_dir(spark, "sequences")))
