"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Merges are taken from an agenda, best piece first and leftmost among equals. Under dropout a candidate
merge is skipped when a hash keyed by the seed, the document, the chunk and the candidate's two spans
falls below the rate. A pair of spans can meet only once, so a skipped candidate stays skipped; the
result depends on nothing but text, id, seed and rate. Without dropout the ids are SentencePiece's own.

No piece of such a model crosses from text into a following blank, so a text is a row of independent
chunks: blanks, then what is no blank. The chunks of many texts go through their agendas side by side
in arrays, one merge a chunk and step; chunks of over LONG characters have an agenda of their own.
Characters without a piece become byte pieces, and so does a literal U+2581, which would else be read
back as a blank: decoding gives every text back.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import trimmed
from strandline.llm.textkernel import mix

BLANK = 0x2581
LONG = 96
_NONE = np.int64(0x7FFFFFFFFFFFFFFF)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHARE, _MASK = float(1 << 64), (1 << 64) - 1


class PieceModel:
    """Pieces, pair table and byte pieces of a SentencePiece BPE model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError(f"{path} has a normaliser other than the plain one with a blank in front")
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == p.NORMAL}
        if any("▁" in piece.lstrip("▁") for piece in normal):
            raise ValueError(f"{path} has pieces that cross from text into a blank")
        self.size = len(spec.pieces)
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes = [b""] * self.size
        for i, p in enumerate(spec.pieces):
            if p.type == p.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif p.type == p.NORMAL:
                self.bytes[i] = p.piece.replace("▁", " ").encode()
        order = sorted(normal.values(), key=lambda i: (-spec.pieces[i].score, i))
        self.rank = np.zeros(self.size, np.int64)
        self.rank[order] = np.arange(len(order))
        self.ranks = self.rank.tolist()
        self.char = np.arange(0x110000, dtype=np.int64) + self.size  # no piece: the code point above all ids
        pairs = {}
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
            for cut in range(1, len(piece)):
                a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.pairs = pairs
        self.mask = (1 << 20) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.merged = np.zeros(self.mask + 1, np.int64)
        self.probes = 1
        for key, i in pairs.items():
            at = self._slot(np.array([key]))[0]
            n = 1
            while self.keys[at] >= 0:
                at, n = (at + 1) & self.mask, n + 1
            self.keys[at], self.merged[at], self.probes = key, i, max(self.probes, n)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _A) >> np.uint64(44)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, or -1."""
        out = np.full(len(left), -1, np.int64)
        todo = np.flatnonzero((left < self.size) & (right < self.size))
        key = left[todo] * self.size + right[todo]
        at = self._slot(key)
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == key
            out[todo[hit]] = self.merged[at[hit]]
            more = ~hit & (found >= 0)
            if not more.any():
                break
            todo, key, at = todo[more], key[more], (at[more] + 1) & self.mask
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols: pieces as they are, other characters as byte pieces."""
        if not (symbols >= self.size).any():
            return symbols
        out = []
        for s in symbols.tolist():
            out += [s] if s < self.size else self.byte_ids[list(chr(s - self.size).encode("utf-8", "surrogatepass"))].tolist()
        return np.array(out, np.int64)

    def decode(self, ids) -> str:
        text = b"".join([self.bytes[i] for i in ids]).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


def _skip(key: np.ndarray, left: np.ndarray, middle: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """If a candidate is skipped: left and middle are its spans' first characters in the chunk, piece gives their end."""
    if rate <= 0:
        return np.zeros(len(left), bool)
    h = mix(key + left.astype(np.uint64) * _A + middle.astype(np.uint64) * _B + piece.astype(np.uint64) * _C)
    return h < np.uint64(min(rate * _SHARE, _SHARE - 2048))


def _mix_one(x: int) -> int:
    """mix of one value, in plain integers."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def agenda(model: PieceModel, points: list[int], key: int, rate: float) -> list[tuple[int, int]]:
    """(first character, symbol) of the pieces of one chunk by an agenda of its own."""
    symbol = model.char[points].tolist()
    rank, pairs, width = model.ranks, model.pairs, model.size
    border = int(np.uint64(min(rate * _SHARE, _SHARE - 2048))) if rate > 0 else 0
    a, b, c = int(_A), int(_B), int(_C)
    n = len(symbol)
    before, after, size = list(range(-1, n - 1)), [*range(1, n), -1], [1] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j >= 0:
            piece = pairs.get(symbol[i] * width + symbol[j]) if symbol[i] < width and symbol[j] < width else None
            if piece is not None and (not border or _mix_one((key + i * a + j * b + piece * c) & _MASK) >= border):
                heapq.heappush(heap, (rank[piece], i, j, size[i] + size[j], piece))

    for i in range(n):
        push(i)
    while heap:
        _, i, j, length, piece = heapq.heappop(heap)
        if after[i] != j or not size[i] or not size[j] or size[i] + size[j] != length or pairs.get(symbol[i] * width + symbol[j]) != piece:
            continue
        symbol[i], size[i], size[j] = piece, length, 0
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [(i, symbol[i]) for i in range(n) if size[i]]


def encode_many(model: PieceModel, texts: list[str], keys: np.ndarray, rate: float = 0.0) -> list[np.ndarray]:
    """Ids of each text. keys: a 64-bit key of each text that its merges' hashes start from."""
    chars, sizes = [], []
    for text in texts:
        raw = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32) if text else np.zeros(0, np.uint32)
        chars.append(raw)
        sizes.append(len(raw))
    points = np.concatenate(chars).astype(np.int64) if chars else np.zeros(0, np.int64)
    if not len(points):
        return [np.zeros(0, np.int64) for _ in texts]
    sizes = np.array(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    symbol = model.char[points]
    symbol[points == BLANK] = model.size + BLANK
    blank = points == 0x20
    symbol[blank] = model.char[BLANK]
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    opens[begins[sizes > 0]] = True
    chunk = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    text_of = np.searchsorted(ends, first, "right")
    key = mix(keys[text_of] + (first - begins[text_of]).astype(np.uint64) * _B)
    length = np.diff(np.append(first, len(points)))

    out = np.full(len(points), -1, np.int64)  # a symbol stands at its first character
    for c in np.flatnonzero(length > LONG):
        own = points[first[c] : first[c] + length[c]].copy()
        own[own == BLANK] = 0x10FFFF  # not a piece; put right below
        own[own == 0x20] = BLANK
        for i, s in agenda(model, own.tolist(), int(key[c]), rate):
            out[first[c] + i] = model.size + BLANK if s == model.size + 0x10FFFF and points[first[c] + i] == BLANK else s
    at = np.flatnonzero((length <= LONG)[chunk])
    s, c = symbol[at], chunk[at]
    pos = at - first[c]
    prio = _priorities(model, s, c, pos, key, rate, None, None)
    while len(s):
        heads = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        best = np.minimum.reduceat(prio, heads)
        open_ = best != _NONE
        counts = np.diff(np.append(heads, len(s)))
        if not open_.all():
            done = np.repeat(~open_, counts)
            out[at[done]] = s[done]
            keep = np.flatnonzero(~done)
            shift = np.cumsum(~done) - 1
            s, c, at, pos, prio = s[keep], c[keep], at[keep], pos[keep], prio[keep]
            if not len(s):
                break
            at_best = shift[_index(prio, best[open_], np.flatnonzero(np.append(True, c[1:] != c[:-1])), counts[open_], keep)]
        else:
            at_best = _index(prio, best, heads, counts, None)
        s[at_best] = model.merge(s[at_best], s[at_best + 1])
        stay = np.ones(len(s), bool)
        stay[at_best + 1] = False
        moved = (np.cumsum(stay) - 1)[at_best]
        s, c, at, pos, prio = s[stay], c[stay], at[stay], pos[stay], prio[stay]
        changed = np.concatenate([moved, moved[moved > 0] - 1])
        _priorities(model, s, c, pos, key, rate, prio, changed)
    found = [out[b:e] for b, e in zip(begins, ends, strict=True)]
    return [model.expand(x[x >= 0]) for x in found]


def _index(prio, best, heads, counts, keep):
    """Where each chunk's best candidate stands: its place in the chunk is in the low bits of its priority."""
    hit = np.flatnonzero(prio == np.repeat(best, counts))
    return hit if keep is None else keep[hit]


def _priorities(model, s, c, pos, key, rate, prio, where):
    """rank << 20 | first character of the pair that begins at each symbol, _NONE without a candidate."""
    if prio is None:
        prio, where = np.full(len(s), _NONE), np.arange(len(s))
    prio[where] = _NONE
    i = where[where + 1 < len(s)]
    i = i[c[i] == c[i + 1]]
    piece = model.merge(s[i], s[i + 1])
    ok = piece >= 0
    i, piece = i[ok], piece[ok]
    if rate > 0:
        go = ~_skip(key[c[i]], pos[i], pos[i + 1], piece, rate)
        i, piece = i[go], piece[go]
    prio[i] = (model.rank[piece] << 20) | pos[i]
    return prio


def _keys(ids: list[int | None], seed: int) -> np.ndarray:
    values = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
    return mix(values * _A + mix(np.array([seed + 1], np.uint64)))


def encode(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 17, digests: bool = False, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 1 << 16) -> DataFrame:
    """One row per row of docs: doc_id, ids, lossless (the ids decode to the text).

    digests: n_bytes, n_tokens and ids_crc32 (unsigned, of little-endian unsigned 32-bit ids) in place
    of ids. A null text counts as empty and has no ids. Rows of one id and text get the same ids; rows
    that repeat an id with other texts are encoded each. Other columns are not read.
    """
    kept = "n_bytes long, n_tokens long, ids_crc32 long" if digests else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            part = (np.cumsum([len(t) for t in texts]) // slice_chars) if texts else np.zeros(0, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                found = encode_many(model, texts[a:b], _keys(ids[a:b], seed), rate)
                same = pa.array([model.decode(x.tolist()) == t for x, t in zip(found, texts[a:b], strict=True)])
                if digests:
                    columns = [pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts[a:b]], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())]
                    names = ["n_bytes", "n_tokens", "ids_crc32"]
                else:
                    ends = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
                    columns, names = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))], ["ids"]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), *columns, same], names=["doc_id", *names, "lossless"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), f"doc_id long, {kept}, lossless boolean")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
