"""SentencePiece (merge-type) encoding by backtracking, and decoding.

Merging the best-ranked pair again and again gives a piece sequence in which any two neighbours,
re-merged from their characters, come out as the same two pieces; and only that sequence has the
property. So a text is encoded left to right: take the longest vocabulary match (all matches come
from one Aho-Corasick pass), accept it if it is compatible with the piece before it, else try
shorter matches, else step back; a bit per position remembers where no sequence can go on.

Where the vocabulary has no piece that runs past the end of a word (a white-space mark is only ever
at a piece's start), words are encoded one by one, and each task keeps a bounded memo of recent words.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, register, table

MARK = "▁"
MEMO = 150_000       # words kept by one Python worker, twice: a full memo becomes the older one
MEMO_LENGTH = 40     # longer words are encoded each time
PAIRS = 250_000      # piece pairs whose compatibility is kept
# Where a text may be cut without a piece being cut, by what the vocabulary allows: before a mark;
# also after a Latin letter that another kind of character follows, and around line feeds and tabs.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_PART = re.compile(f"[\\n\\t]+|{MARK}*[^{MARK}\\n\\t{_LATIN}]*[{_LATIN}]*")
_JOINED = re.compile(f"[{_LATIN}][^{MARK}{_LATIN}]|[\\n\\t].|.[\\n\\t]", re.S)


class PieceCodec:
    """Encoder and decoder over the pieces and scores of a merge-type SentencePiece model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        plain = [i for i in range(n) if i not in self.special and i not in self.byte_of]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.packed = {p: struct.pack("<I", i) for p, i in self.id_of.items()}
        self.surface = {p: p.replace(MARK, " ") for p in self.id_of}
        # only pieces that merging can produce take part
        self.valid = {p for p in self.id_of if len(p) == 1 or self.merge(p) == [p]}
        self.unit = None
        if not any(MARK in p.lstrip(MARK) for p in self.valid):
            self.unit = _WORD if any(_JOINED.search(p) for p in self.valid) else _PART
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.valid or k == 1), None)
                        for p in self.valid}
        self.automaton = ahocorasick.Automaton()
        for p in self.valid:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Merge by score, ties to the left, from single characters (used on short strings only)."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return ok

    def split(self, text: str) -> list[str]:
        """The merge result of ``text`` by backtracking. A character outside the vocabulary stands alone."""
        n = len(text)
        if n == 0:
            return []
        longest = [1] * n
        for end, k in self.automaton.iter(text):
            longest[end - k + 1] = k           # ends ascend, so the last is the longest
        if longest[0] == n:
            return [text]
        out: list[str] = []
        dead = None                            # one bit per position, made at the first failure
        pairs = self.pairs
        pos, piece, last = 0, text[:longest[0]], None
        while True:
            end = pos + len(piece)
            if dead is None or not dead[end >> 3] >> (end & 7) & 1:
                ok = True if last is None else pairs.get((last, piece))
                if ok or ok is None and self.compatible(last, piece):
                    out.append(piece)
                    pos, last = end, piece
                    if pos == n:
                        return out
                    piece = text[pos:pos + longest[pos]]
                    continue
            piece = self.shorter.get(piece)
            while piece is None:
                if not out:
                    raise ValueError("no compatible sequence of pieces")
                if dead is None:
                    dead = bytearray(n // 8 + 1)
                dead[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= len(piece)
                last = out[-1] if out else None
                piece = self.shorter.get(piece)

    def _ids(self, parts: list[str]) -> list[int]:
        ids: list[int] = []
        for p in parts:
            i = self.id_of.get(p)
            if i is not None:
                ids.append(i)
            else:
                ids.extend(self.byte_id.get(b, self.unk) for b in p.encode())
        return ids

    def decode(self, ids) -> str:
        """The text of ids: bytes joined to characters, marks to spaces, without the leading one."""
        text = self._surface(ids)
        first = next((i for i in ids if i not in self.special or i == self.unk), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text

    def _surface(self, ids) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.special:
                out.append(self.pieces[i].replace(MARK, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def _word(self, word: str) -> tuple[bytes, str]:
        got = self.older.get(word)
        if got is None:
            parts = self.split(word)
            try:
                packed, surface = self.packed, self.surface
                got = b"".join([packed[p] for p in parts]), "".join([surface[p] for p in parts])
            except KeyError:        # a character outside the vocabulary
                ids = self._ids(parts)
                got = struct.pack(f"<{len(ids)}I", *ids), self._surface(ids)
        if len(word) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[word] = got
        return got

    def round_trip(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers with begin and end, decoded text)."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        units = self.unit.findall(marked) if self.unit else [marked]
        find, word = self.memo.get, self._word
        got = [find(u) or word(u) for u in units]
        ids = struct.pack("<I", self.bos) + b"".join([g[0] for g in got]) + struct.pack("<I", self.eos)
        decoded = "".join([g[1] for g in got])
        return ids, decoded[1:] if decoded.startswith(" ") else decoded

    def encode(self, text: str | None) -> list[int]:
        return list(struct.unpack(f"<{len(b := self.round_trip(text)[0]) // 4}I", b))


def _utf8(run: bytearray) -> str:
    """Bytes as UTF-8; each byte that does not fit gives one replacement character."""
    data, out = bytes(run), []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[:e.start].decode() + "�")
            data = data[e.start + 1:]
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec a Python process and model file."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, model_file: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens (with begin and end), ids_sha256 and decoded_sha256 of every row; with
    ``keep_ids`` also ids (array<int>) and decoded.

    One narrow pass without a shuffle. Defined cases: a null or empty text has the begin and end
    ids alone and decodes to the empty string; repeated rows give repeated results; an empty table
    gives no rows; other columns play no part.
    """
    prepare(docs.sparkSession)
    path = model_file or default_model()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = batch.column(1)
            n_out, a, b, all_ids, decoded = [], [], [], [], []
            for i in range(batch.num_rows):
                ids, text = c.round_trip(texts[i].as_py())
                n_out.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
                    decoded.append(text)
            cols = [batch.column(0), pa.array(n_out, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = np.concatenate(([0], np.cumsum(n_out))).astype(np.int32)
                flat = np.frombuffer(b"".join(all_ids), "<i4")
                cols += [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


@register("op8_piece_encode_decode")
def op8_piece_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; lengths and digests."""
    return encode_decode(table(spark, sf_dir, "documents"))
