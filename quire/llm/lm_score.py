"""Scoring texts with a hierarchical Pitman-Yor language model.

The context of a word is the word before it (none at a text's start). Each context is a restaurant
whose customers are the words seen there; its tables are customers of the restaurant of the previous
word's last character, and that one's tables are customers of one shared root, whose base is uniform
over the known words and one unknown word. The numbers of tables are sampled by Gibbs: all tables of one word in one restaurant are drawn
from their exact conditional, given everything else, with generalised Stirling numbers (the
customers after the 64th are seated one after another in blocks). A text's score uses predictive
probabilities averaged over the samples after the burn-in.

Plan. A first pass counts the training words; their hashes, in order, number them. A second pass cuts
the texts into chunks of bounded size where they lie and scores the base; a chunk sends, packed and split
by word hash, its distinct (word, previous word) entries with the documents of their tokens to word blocks. Texts
themselves are never moved. A block holds all contexts of its words, so seating in all restaurants runs without
moving entries; only totals per restaurant (one number a known word, summed in tasks) go through the driver
between rounds. A block's state is a function of its counts, the totals so far and a seed, so each round replays
the rounds before it and nothing but totals is kept: a lost executor costs its tasks alone. Blocks then
add up each document's tokens, and the sums of all blocks are added by chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOW, materialize, prepare, register, table, word_hashes, words_of

CHUNK_BYTES = 8 << 20       # text of a chunk, about
CHUNK_DOCS = 1 << 16        # and its documents at most
TASK_WORDS = 1 << 20        # distinct words that a task counts before it sends them
TASK_SUMS = 1 << 22         # documents' sums that a task keeps before it sends them
KEY_BITS = 63               # of a signed number
BLOCK_BYTES = 8 << 20       # input text per word block, about
BURN_IN, SAMPLES = 1, 3
STRENGTH = 1.0
EXACT = 64                  # customers seated by the exact conditional
SEED = 17
END = np.uint64(0x5BF03635DEADBEEF)     # the end token's hash


# --- tokens -------------------------------------------------------------------------------------

def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes and the end token, hashes of the words before, last characters of the words before):
    the last byte, or the last two bytes if that is not an ASCII character. 0 at the start."""
    buf = np.frombuffer(text.encode(), np.uint8)
    start, end = words_of(buf)
    h = np.append(word_hashes(buf, start, end), END)
    prev = np.append(np.uint64(0), h[:-1])
    ctx = np.zeros(len(h), np.uint16)
    if len(start):
        last = _LOW[buf[end - 1]].astype(np.uint16)
        ctx[1:] = np.where(last < 128, last, buf[np.maximum(end - 2, 0)].astype(np.uint16) << 8 | last)
    return h, prev, ctx


def _portions(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(doc_id, held_out, text) of a task's rows, in lists of bounded size."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "held_out", "text"))):
            rows.append(row)
            size += len(row[2])
            if size >= CHUNK_BYTES or len(rows) == CHUNK_DOCS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


# --- packed integers ----------------------------------------------------------------------------

def _squeeze(v: np.ndarray) -> bytes:
    """Integers from 0, in their narrowest type, all lowest bytes first, compressed."""
    width = next(w for w in (1, 2, 4, 8) if int(v.max(initial=0)) >> 8 * w == 0)
    planes = np.ascontiguousarray(v.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(v).to_bytes(8, "little") + (
        pa.Codec("zstd", 1).compress(planes, asbytes=True) if len(v) else b"")


def _loose(b: bytes) -> np.ndarray:
    """What ``_squeeze`` was given, in its narrowest type."""
    width, n = b[0], int.from_bytes(b[1:9], "little")
    if not n:
        return np.zeros(0, np.uint8)
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(b)[9:], n * width), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}")[:, 0]


def _steps(v: np.ndarray) -> np.ndarray:
    """Rising numbers as the first and the steps between them."""
    return np.diff(v, prepend=v.dtype.type(0))


def _firsts(v: np.ndarray) -> np.ndarray:
    """Where stretches of equal values begin."""
    return np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)


_ENTRIES = ("word", "run", "prev")


def _pack(word: np.ndarray, prev: np.ndarray) -> dict:
    """Entries in order of their word and previous word."""
    first = _firsts(word)
    step = _steps(prev)
    step[first] = prev[first]
    return dict(zip(_ENTRIES, map(_squeeze, (_steps(word[first]), np.diff(np.append(first, len(word))), step))))


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(word, previous word) of each entry."""
    words, run, step = (_loose(row[k]).astype(np.int64) for k in _ENTRIES)
    first = np.cumsum(run) - run
    prev = np.cumsum(step)
    return np.repeat(np.cumsum(words), run), prev - np.repeat(prev[first] - step[first], run)


# --- words and entries --------------------------------------------------------------------------

_WORDS_SCHEMA = pa.schema([("part", pa.int32())] + [(k, pa.binary()) for k in ("hash", "count", "last")])
_WORDS_DDL = "part int, hash binary, count binary, last binary"


def _added(word: np.ndarray, count: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in order, with the sums of their counts."""
    words, first, of = np.unique(word, return_index=True, return_inverse=True)
    return words, np.bincount(of, count, minlength=len(words)).astype(np.int64), last[first]


def _train_words(bits: int):
    """Training words of a task by part: hash, count, last character."""
    def sent(word: np.ndarray, count: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        part = (word >> np.uint64(64 - bits)).astype(np.int64)
        at = np.append(_firsts(part), len(part))
        return pa.RecordBatch.from_pylist(
            [{"part": int(part[i]), "hash": word[i:j].tobytes(), "count": _squeeze(count[i:j]), "last": _squeeze(last[i:j])}
             for i, j in zip(at[:-1], at[1:])], _WORDS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        have = none
        for rows in _portions(batches):
            parts = [tokens(t) for _, held, t in rows if not held]
            if not parts:
                continue
            found = pa.array(np.concatenate([h for h, _, _ in parts])).dictionary_encode()
            of, words = found.indices.to_numpy(), found.dictionary.to_numpy()
            last = np.zeros(len(words), np.uint16)
            last[of] = np.concatenate([np.append(c[1:], np.uint16(0)) for _, _, c in parts])
            have = _added(*map(np.concatenate, zip(have, (words, np.bincount(of, minlength=len(words)), last))))
            if len(have[0]) > TASK_WORDS:
                yield sent(*have)
                have = none
        if len(have[0]):
            yield sent(*have)
    return run


def _add_words(t: pa.Table) -> pa.Table:
    """The words of a part, each once."""
    word = np.frombuffer(b"".join(t.column("hash").to_pylist()), np.uint64)
    count, last = (np.concatenate([_loose(b) for b in t.column(k).to_pylist()]) for k in ("count", "last"))
    word, count, last = _added(word, count, last)
    return pa.Table.from_pylist([{"part": t.column("part")[0].as_py(), "hash": word.tobytes(),
                                  "count": _squeeze(count), "last": _squeeze(last)}], _WORDS_SCHEMA)


_REQUEST = [("block", pa.int32()), ("chunk", pa.int64()), ("docs", pa.int32()), ("train", pa.int32())] + [
    (k, pa.binary()) for k in (*_ENTRIES, "times", "doc", "about")]
_REQUEST_DDL = ("block int, chunk long, docs int, train int, word binary, run binary, prev binary, times binary, "
                "doc binary, about binary")
_ABOUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("base_score", pa.float64())])


def _request(vocab, model, bits: int, total: int):
    """A chunk's requests to the blocks, and under a number below 0 what is known of its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, count = vocab.value, _loose(model.value["count"])
        task = TaskContext.get().partitionId()
        for number, rows in enumerate(_portions(batches)):
            for row in _chunk(sorted(rows, key=lambda r: r[1]), hashes, count, bits, total):
                # notes go by a number below 0 of their own, so that they do not gather in one group
                chunk = task << 32 | number
                block = row.get("block", -1 - ((task << 10 | number & 1023) & 0x7FFFFFFE))
                yield pa.RecordBatch.from_pylist([row | {"chunk": chunk, "block": block}], pa.schema(_REQUEST))
    return run


def _chunk(rows: list[tuple], hashes: np.ndarray, count: np.ndarray, bits: int, total: int) -> Iterator[dict]:
    """Rows of ``_REQUEST`` of some documents, those for training first. Words are their places among the known
    ones, all unknown ones the place after those. Previous words are 0 at a text's start, then come the known
    ones, then the unknown ones by last character, which is all that the model takes from them."""
    known = len(hashes)
    parts = [tokens(t) for _, _, t in rows]
    sizes = np.array([len(h) for h, _, _ in parts], np.int64)
    first = np.cumsum(sizes) - sizes
    found = pa.array(np.concatenate([h for h, _, _ in parts])).dictionary_encode()
    ctx = np.concatenate([c for _, _, c in parts]).astype(np.int64)
    of, words = found.indices.to_numpy(), found.dictionary.to_numpy()
    place = np.searchsorted(hashes, words)
    place = np.where(np.append(hashes, np.uint64(0))[place] == words, place, known)
    n = np.append(count, count.dtype.type(0)).astype(np.int64)[place]
    n_known = np.add.reduceat((place < known).astype(np.int64)[of], first)
    base = np.add.reduceat(np.log10((n + 1) / (total + known + 1))[of], first)
    about = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "held_out": pa.array([r[1] for r in rows]),
                      "n_tokens": sizes, "n_known": n_known, "base_score": base}, _ABOUT)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ABOUT) as out:
        out.write_table(about)
    yield {"about": sink.getvalue().to_pybytes()}

    prev = np.append(0, place[of[:-1]] + 1)
    prev = np.where(prev <= known, prev, known + 1 + ctx)
    prev[first] = 0
    # in order of the blocks and, in a block, of the words' hashes; a block's unknown words are one
    shift = known.bit_length()
    kinds, rank = np.unique((words >> np.uint64(64 - bits)) << np.uint64(shift) | place.astype(np.uint64), return_inverse=True)
    word, doc = rank[of].astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    low, mid = len(rows).bit_length(), (known + 1 + 0xFFFF).bit_length()
    if low + mid + len(kinds).bit_length() <= KEY_BITS:     # one number a token, sorted
        key = np.sort(word << low + mid | prev << low | doc)
        word, prev, doc = key >> low + mid, key >> low & (1 << mid) - 1, key & (1 << low) - 1
    else:
        order = np.lexsort((doc, prev, word))
        word, prev, doc = word[order], prev[order], doc[order]
    new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (prev[1:] != prev[:-1])))
    times = np.diff(np.append(new, len(word)))
    kind, prev = kinds[word[new]], prev[new]
    block, word = (kind >> np.uint64(shift)).astype(np.int64), (kind & np.uint64((1 << shift) - 1)).astype(np.int64)
    at, new = np.append(_firsts(block), len(block)), np.append(new, len(doc))
    train = sum(not r[1] for r in rows)
    for i, j in zip(at[:-1], at[1:]):
        yield {"block": int(block[i]), "docs": len(rows), "train": train, **_pack(word[i:j], prev[i:j]),
               "times": _squeeze(times[i:j]), "doc": _squeeze(doc[new[i]:new[j]])}


_ASKED = pa.struct([("chunk", pa.int64()), ("docs", pa.int32()), ("entry", pa.binary()), ("times", pa.binary()),
                    ("doc", pa.binary())])
_BLOCK = pa.schema([("block", pa.int32())] + [(k, pa.binary()) for k in (*_ENTRIES, "n")]
                   + [("asked", pa.list_(_ASKED)), ("chunk", pa.int64()), ("about", pa.binary())])
_BLOCK_DDL = ("block int, word binary, run binary, prev binary, n binary, asked array<struct<chunk: long, docs: int, "
              "entry: binary, times: binary, doc: binary>>, chunk long, about binary")


def _build(t: pa.Table) -> pa.Table:
    """All requests of a block -> its distinct entries, by word and previous word, with training counts, and
    the places of each request's entries among them. Notes on documents go through."""
    rows = t.to_pylist()
    if rows[0]["about"] is not None:
        return pa.Table.from_pylist([{k: r[k] for k in ("block", "chunk", "about")} for r in rows], _BLOCK)
    keys, counts = [], []
    for r in rows:
        word, prev = _unpack(r)
        times = _loose(r["times"]).astype(np.int64)
        keys.append(word << 32 | prev)
        counts.append(np.add.reduceat((_loose(r["doc"]) < r["train"]).astype(np.int64), np.cumsum(times) - times))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(place, np.concatenate(counts), minlength=len(key)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    asked = [{k: r[k] for k in ("chunk", "docs", "times", "doc")} | {"entry": _squeeze(_steps(place[e - len(k):e]))}
             for r, k, e in zip(rows, keys, ends)]
    return pa.Table.from_pylist([{"block": rows[0]["block"], "n": _squeeze(n), "asked": asked}
                                 | _pack(key >> 32, key & 0xFFFFFFFF)], _BLOCK)


# --- the model ----------------------------------------------------------------------------------

def log_stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log S(c, t): the weight of all seatings of c customers at t tables with discount d."""
    s = np.full((n + 1, n + 2), -np.inf)
    s[0, 0] = 0
    for c in range(n):
        t = np.arange(1, n + 2)
        stay = np.full(n + 1, -np.inf)
        able = (t <= c) & (c - d * t > 0)
        stay[able] = np.log(c - d * t[able]) + s[c, 1:][able]
        s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay)
    return s


def draw_tables(rng, c: np.ndarray, logp: np.ndarray, others: np.ndarray, d: float, strength: float,
                stirling: np.ndarray) -> np.ndarray:
    """Tables of each (restaurant, word) with c customers, given log parent probabilities and the
    restaurant's other tables. Zero customers have none."""
    t = np.minimum(c, 1)
    head = np.minimum(c, EXACT)
    many = np.flatnonzero(c >= 2)
    if len(many):
        by = many[np.argsort(head[many], kind="stable")]
        ends = np.append(np.flatnonzero(np.append(True, np.diff(head[by]) > 0)), len(by))
        for a, b in zip(ends[:-1], ends[1:]):
            for lo in range(a, b, 20_000):
                i = by[lo:min(b, lo + 20_000)]
                k = int(head[i[0]])
                j = np.arange(k)
                grow = np.cumsum(np.log(strength + d * (others[i, None] + j)), axis=1)
                logit = stirling[k, 1:k + 1] + (j + 1) * logp[i, None] + grow
                t[i] = 1 + np.argmax(logit + rng.gumbel(size=logit.shape), axis=1)
    left = np.flatnonzero(c > EXACT)
    seated = np.full(len(left), EXACT, np.int64)
    while len(left):
        step = np.minimum(np.maximum(seated // 8, 8), c[left] - seated)
        fresh = (strength + d * (others[left] + t[left])) * np.exp(logp[left])
        t[left] += rng.binomial(step, np.clip(fresh / (fresh + seated - d * t[left]), 0, 1))
        seated = seated + step
        more = seated < c[left]
        left, seated = left[more], seated[more]
    return t


class Block:
    """The seating of one block of words in the last characters' restaurants and in the root."""

    def __init__(self, number: int, word: np.ndarray, ctx: np.ndarray, n: np.ndarray, model: dict):
        self.number, self.ctx, self.n, self.model = number, ctx.astype(np.int64), n, model
        new = np.append(True, word[1:] != word[:-1])
        self.of = np.cumsum(new) - 1                        # entry -> word
        self.words = int(self.of[-1]) + 1
        self.total = np.bincount(self.of, n, minlength=self.words).astype(np.int64)
        self.t = np.minimum(n, 1)                           # tables per entry; at first one each
        self.c0 = self._parents()                           # customers of the parent restaurant
        self.t0 = np.minimum(self.c0, 1)

    def _parents(self) -> np.ndarray:
        return np.bincount(self.of, self.t, minlength=self.words).astype(np.int64)

    def parent(self, k: dict) -> np.ndarray:
        """Parent probability of each word, given the totals of the same state."""
        m = self.model
        top = (STRENGTH + m["d0"] * k["t0"]) / (m["known"] + 1)
        return np.maximum(self.c0 - m["d0"] * self.t0 + top, 1e-300) / (k["c0"] + STRENGTH)

    def predict(self, k: dict) -> np.ndarray:
        m, p = self.model, self.parent(k)[self.of]
        customers = k["customers"] if "customers" in k else m["customers"]
        c, t = customers[self.ctx], k["tables"][self.ctx]
        return (self.n - m["d1"] * self.t + (STRENGTH + m["d1"] * t) * p) / (c + STRENGTH)

    def sweep(self, number: int, k: dict) -> None:
        """One round of Gibbs given the totals of the state before it."""
        m = self.model
        rng = np.random.default_rng([SEED, self.number, number])
        logp = np.log(self.parent(k))[self.of]
        others = np.maximum(k["tables"][self.ctx] - self.t, 0)
        self.t = draw_tables(rng, self.n, logp, others, m["d1"], STRENGTH, m["s1"])
        self.c0 = self._parents()
        base = np.full(self.words, -np.log(m["known"] + 1))
        self.t0 = draw_tables(rng, self.c0, base, np.maximum(k["t0"] - self.t0, 0), m["d0"], STRENGTH, m["s0"])


class Words:
    """The seating of one block of words in all restaurants, replayed from its counts. The tables of the
    previous words' restaurants are the customers of the block above."""

    def __init__(self, number: int, word: np.ndarray, prev: np.ndarray, ctx: np.ndarray, n: np.ndarray, model: dict):
        self.number, self.n, self.model = number, n, model
        self.at = _places(prev.astype(np.int64), model["known"])
        of = np.cumsum(np.append(True, word[1:] != word[:-1])) - 1
        pairs, self.pair = np.unique(of << 16 | ctx, return_inverse=True)
        self.t = np.minimum(n, 1)
        self.many = np.flatnonzero(n > 1)                   # elsewhere the number of tables is certain
        self.above = Block(number, pairs >> 16, (pairs & 0xFFFF).astype(np.uint16), self._seated(len(pairs)), model)
        self.sum, self.samples = np.zeros(len(n)), 0

    def _seated(self, pairs: int) -> np.ndarray:
        return np.bincount(self.pair, self.t, minlength=pairs).astype(np.int64)

    def predict(self, k: dict) -> np.ndarray:
        m, p = self.model, self.above.predict(k)[self.pair]
        c, t = m["seen"][self.at], k["seats"][self.at]
        return (self.n - m["d2"] * self.t + (STRENGTH + m["d2"] * t) * p) / (c + STRENGTH)

    def sweep(self, number: int, k: dict) -> None:
        """One round of Gibbs given the totals of the state before it."""
        m, i = self.model, self.many
        rng = np.random.default_rng([SEED, self.number, number, 2])
        logp = np.log(self.above.predict(k))[self.pair[i]]
        others = np.maximum(k["seats"][self.at[i]].astype(np.int64) - self.t[i], 0)
        self.t[i] = draw_tables(rng, self.n[i], logp, others, m["d2"], STRENGTH, m["s2"])
        self.above.n = self._seated(len(self.above.n))
        self.above.sweep(number, k)

    def replay(self, history: list[dict], predict: bool = False) -> None:
        """Run the rounds whose totals are known, adding predictions after the burn-in if they are wanted."""
        for r, k in enumerate(history):
            if predict and r > BURN_IN:
                self.sum += self.predict(k)
                self.samples += 1
            if r < BURN_IN + SAMPLES:
                self.sweep(r, k)

    def totals(self, first: bool = True) -> dict:
        """What this block adds to the totals: kind -> (places, values). After the first time, the seats
        are those beyond one for each entry that has customers."""
        a, i = self.above, np.flatnonzero(self.t if first else self.t > 1)
        at, of = np.unique(self.at[i], return_inverse=True)
        return {"seats": (at, np.bincount(of, self.t[i] - (not first), minlength=len(at))),
                "customers": _sparse(np.bincount(a.ctx, a.n)), "tables": _sparse(np.bincount(a.ctx, a.t)),
                "c0": ([0], [a.c0.sum()]), "t0": ([0], [a.t0.sum()])}


def _places(prev: np.ndarray, known: int) -> np.ndarray:
    """Places of previous words: known words, then unknown ones together, then the start."""
    return np.where(prev == 0, known + 1, np.minimum(prev - 1, known))


def _words_of(row: dict, model: dict) -> Words:
    word, prev = _unpack(row)
    known = model["known"]
    ctx = np.append(model["last"], model["last"].dtype.type(0))[np.clip(prev - 1, 0, known)].astype(np.int64)
    ctx = np.where(prev == 0, 0, np.where(prev > known, prev - known - 1, ctx))
    return Words(row["block"], word, prev, ctx, _loose(row["n"]).astype(np.int64), model)


def _sparse(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(v)
    return at, v[at]


def _counts_of_ones(w: Words) -> dict:
    """What the discounts need: how many counts are one and two, by level."""
    a = w.above
    seen1 = np.bincount(w.pair, w.n > 0, minlength=len(a.n))        # previous words of each (word, last character)
    seen0 = np.bincount(a.of, seen1 > 0)                            # last characters of each word
    return {f"{name}{level}": ([0], [(v == times).sum()]) for level, v in enumerate((seen0, seen1, w.n))
            for name, times in (("ones", 1), ("twos", 2))}


_TOTALS_SCHEMA = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("at", pa.binary()), ("value", pa.binary())])
_TOTALS_DDL = "kind string, part int, at binary, value binary"


def _totals(values: dict) -> pa.RecordBatch:
    """Rows (kind, part, places, values); a part has 65,536 places."""
    rows = []
    for kind, (at, v) in values.items():
        at, v = np.asarray(at, np.int64), np.asarray(v).astype(np.int64)
        cut = np.append(_firsts(at >> 16), len(at))
        rows += [{"kind": kind, "part": int(at[i] >> 16), "at": _squeeze(_steps(at[i:j] & 0xFFFF)), "value": _squeeze(v[i:j])}
                 for i, j in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_pylist(rows, _TOTALS_SCHEMA)


def _add(t: pa.Table) -> pa.Table:
    """The rows of a kind and part as one row of sums."""
    value = np.zeros(1 << 16, np.int64)
    for r in t.to_pylist():
        value[np.cumsum(_loose(r["at"]), dtype=np.int64)] += _loose(r["value"]).astype(np.int64)
    at, value = _sparse(value)
    return pa.Table.from_pylist([{"kind": t.column("kind")[0].as_py(), "part": t.column("part")[0].as_py(),
                                  "at": _squeeze(_steps(at)), "value": _squeeze(value)}], _TOTALS_SCHEMA)


def _opened(model) -> dict:
    """A broadcast model or state, its arrays unpacked."""
    return {k: _loose(v) if isinstance(v, bytes) else v for k, v in model.value.items()}


def _round_totals(model, history: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, past = _opened(model), [_opened(k) for k in history]
        for batch in batches:
            for row in batch.to_pylist():
                w = _words_of(row, m)
                w.replay(past)
                yield _totals(w.totals(not past) | ({} if past else _counts_of_ones(w)))
    return run


def _gather(rows: DataFrame) -> dict:
    """Sums by kind: (places, values) in order of the places. One number a known word at most reaches the driver."""
    out: dict = {}
    for r in rows.groupBy("kind", "part").applyInArrow(_add, _TOTALS_DDL).toLocalIterator():
        out.setdefault(r.kind, []).append((np.cumsum(_loose(r.at), dtype=np.int64) + (r.part << 16), _loose(r.value)))
    for kind, parts in out.items():
        at, value = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(at)
        out[kind] = at[order], value[order]
    return out


def _dense(found: dict, kind: str, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    if kind in found:
        out[found[kind][0].astype(np.int64)] = found[kind][1]
    return out


def _state(found: dict, words: int) -> dict:
    return {"seats": _dense(found, "seats", words + 2), "customers": _dense(found, "customers", 1 << 16),
            "tables": _dense(found, "tables", 1 << 16), "c0": int(_dense(found, "c0", 1)[0]),
            "t0": int(_dense(found, "t0", 1)[0])}


def _packed(state: dict) -> dict:
    """A state or model to broadcast: counts as packed integers."""
    return {k: _squeeze(v) if isinstance(v, np.ndarray) and v.dtype.kind in "iu" else v for k, v in state.items()}


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5


def _answer(model, history: list):
    """The blocks of a task -> for each chunk, the sums of its documents' averaged log10 probabilities."""
    def sent(sums: dict) -> pa.RecordBatch:
        return pa.record_batch({"chunk": pa.array(sums, pa.int64()),
                                "score": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, past, sums, kept = _opened(model), [_opened(k) for k in history], {}, 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                w = _words_of(row, m)
                w.replay(past, predict=True)
                logp = np.log10(np.maximum(w.sum / max(w.samples, 1), 1e-300)).astype(np.float32).astype(float)
                for q in row["asked"]:
                    each = np.repeat(logp[np.cumsum(_loose(q["entry"]), dtype=np.int64)], _loose(q["times"]))
                    if q["chunk"] not in sums:
                        sums[q["chunk"]] = np.zeros(q["docs"])
                        kept += q["docs"]
                    sums[q["chunk"]] += np.bincount(_loose(q["doc"]), each, minlength=q["docs"])
                if kept > TASK_SUMS:
                    yield sent(sums)
                    sums, kept = {}, 0
        if sums:
            yield sent(sums)
    return run


def _score(total: int):
    def run(notes: pa.Table, sums: pa.Table) -> pa.Table:
        out = [pa.ipc.open_stream(b).read_all() for b in notes.column("about").to_pylist()]
        if not out:
            return pa.table({k: pa.array([], t) for k, t in _OUT.items()})
        score = sum(np.frombuffer(b, float) for b in sums.column("score").to_pylist())
        t = out[0].append_column("train_tokens", pa.array(np.full(out[0].num_rows, total, np.int64)))
        return t.append_column("score", pa.array(score)).select(list(_OUT))
    return run


_OUT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
        "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
_OUT_DDL = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
            "score double")


def score_texts(docs: DataFrame, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Learns from the rows whose crc32(doc_id as text) modulo ``folds`` is not ``held_fold``. Defined cases:
    a null text is an empty one (its end token alone); a null doc_id trains; repeated rows train and
    score each time; with no training row every word is unknown (probability from the uniform
    base); an empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(
        F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_fold, F.lit(False)).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(4, min(16, (size // BLOCK_BYTES).bit_length()))
    # the known words in order of their hashes: a few bytes for each reach the driver and the tasks
    parts = {r.part: r for r in base.mapInArrow(_train_words(bits), _WORDS_DDL).groupBy("part").applyInArrow(
        _add_words, _WORDS_DDL).toLocalIterator()}
    parts = [parts[p] for p in sorted(parts)]
    vocab = np.frombuffer(b"".join(r["hash"] for r in parts), np.uint64)
    count, last = (np.concatenate([_loose(r[k]) for r in parts] or [np.zeros(0, np.uint8)]) for k in ("count", "last"))
    known, total = len(vocab), int(count.sum(dtype=np.int64))
    # every training word is the context of the one after it; each training text has one end, and one start
    starts = int(count[vocab == END].sum(dtype=np.int64))
    broadcast = spark.sparkContext.broadcast
    hashes, counts = broadcast(vocab), broadcast(_packed({"count": count}))
    blocks = materialize(base.mapInArrow(_request(hashes, counts, bits, total), _REQUEST_DDL).groupBy(
        "block").applyInArrow(_build, _BLOCK_DDL), "lm-blocks")
    hashes.destroy()
    entries = blocks.where("block >= 0").select("block", *_ENTRIES, "n")
    base_model = {"known": known, "last": last, "seen": np.concatenate((count.astype(np.int64), [0, starts]))}
    found = _gather(entries.mapInArrow(_round_totals(broadcast(_packed(base_model)), []), _TOTALS_DDL))
    d0, d1, d2 = (_discount(*(int(_dense(found, f"{name}{level}", 1)[0]) for name in ("ones", "twos"))) for level in range(3))
    # a packed number per known word, and tables of 64 x 64
    model = broadcast(_packed(base_model | {"d0": d0, "d1": d1, "d2": d2, "s0": log_stirling(d0),
                                            "s1": log_stirling(d1), "s2": log_stirling(d2)}))
    state = _state(found, known)
    first, history = state["seats"], [broadcast(_packed(state))]
    for _ in range(BURN_IN + SAMPLES):
        state = _state(_gather(entries.mapInArrow(_round_totals(model, list(history)), _TOTALS_DDL)), known)
        history.append(broadcast(_packed(state | {"seats": first + state["seats"]})))
    sums = blocks.where("block >= 0").select("block", *_ENTRIES, "n", "asked").mapInArrow(
        _answer(model, history), "chunk long, score binary")
    return blocks.where("block < 0").select("chunk", "about").groupBy("chunk").cogroup(
        sums.groupBy("chunk")).applyInArrow(_score(total), _OUT_DDL)


@register("op5_pitman_yor_score")
def op5_pitman_yor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model learnt from the training documents."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
