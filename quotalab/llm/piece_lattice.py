"""N-best SentencePiece segmentation over the lattice of a model's pieces, and decoding.

A text is a blank and the text itself (blanks are the model's U+2581); each place of the lattice reaches the ends of
all pieces that start there; a character that no piece covers is an edge of its own and becomes byte pieces. The best
paths have the largest sums of the model's scores. No piece has a blank after another character, and most control
characters are in no piece at all, so every path passes the node at each such place; paths between these nodes,
segments, are found once for each distinct segment of a slice.

Forward Viterbi keeps the two best scores of each node. The scores of the forward pass are exact heuristics of the
backward A* search: what is left of a path costs exactly the forward score of its node, so complete paths leave the
agenda in order. A text's n best paths differ from the best one in at most its n - 1 least-loss segments; only there
A* runs.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U64, buffers, prefix_hash, slices, span_hash, tidy
from .store import small_batches

N_BEST = 4
SLICE = 1 << 20
CHUNK = 1 << 17  # bytes of distinct segments in one forward pass
SHORT = 48  # bytes of segments that are passed side by side; longer ones one by one
UNKNOWN_LOSS = 10  # below the least score of all pieces, for a character that no piece covers

_HASH_BITS = 20


class Pieces:
    """The pieces of a model as sorted hashes of their bytes, with scores; the last score is that of no piece."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        self.text = [model.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.by_text = {self.text[i]: i for i in normal}
        self.longest = max(map(len, self.by_text), default=1)
        self.unknown = size  # the number of an uncovered character
        known = np.array([model.get_score(i) for i in range(size)], np.float64)
        self.scores = np.concatenate([known, [min([0.0, *known[normal]]) - UNKNOWN_LOSS, -np.inf]])
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        for b in range(256):
            self.text[self.byte[b]] = bytes([b])
        joined = np.frombuffer(b"".join(self.text), np.uint8)
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = joined
        bad = [t for t in self.by_text if b" " in t.lstrip(b" ")]
        if bad:
            raise ValueError(f"pieces have blanks after other characters: {bad[:3]}")
        self.apart = np.zeros(256, bool)  # control characters that no piece has
        self.apart[[b for b in range(0x20) if not any(b in t for t in self.by_text)]] = True
        own = np.array(normal, np.int64)
        h = span_hash(*prefix_hash(joined), self.starts[own], self.starts[own] + self.sizes[own])
        order = np.argsort(h)
        self.hashes, self.ids = h[order], own[order].astype(np.int32)
        slot, first, count = np.unique(self.hashes >> U64(64 - _HASH_BITS), return_index=True, return_counts=True)
        self.slots = np.full(1 << _HASH_BITS, -1, np.int32)  # the first hash with these leading bits
        self.slots[slot.astype(np.int64)] = first
        self.deepest = int(count.max(initial=1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers by hash, -1 for no piece."""
        slot = self.slots[(h >> U64(64 - _HASH_BITS)).astype(np.int64)]
        k = np.flatnonzero(slot >= 0)
        out, slot, h = np.full(len(h), -1, np.int32), slot[k], h[k]
        for depth in range(self.deepest):
            at = np.minimum(slot + depth, len(self.hashes) - 1)
            same = self.hashes[at] == h
            out[k[same]] = self.ids[at[same]]
        return out


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _width(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def _edges(model: Pieces, segment: bytes, start: int) -> list[tuple[int, int]]:
    """(end, piece) of all pieces from start; the character itself if no piece is just that."""
    if 0x80 <= segment[start] < 0xC0:
        return []  # inside a character
    out = []
    for end in range(start + 1, min(len(segment), start + model.longest) + 1):
        found = model.by_text.get(segment[start:end])
        if found is not None:
            out.append((end, found))
    char = min(start + _width(segment[start]), len(segment))
    if not any(end == char for end, _ in out):
        out.append((char, model.unknown))
    return out


@dataclass
class Forward:
    """Of each place the best score, the second best, the bytes of a best path's last piece (of ties the longest), and
    the sizes of all pieces that end there, as bits from that of one byte on.

    Flat arrays, 28 bytes for each byte of a segment, which can be a whole text without blanks.
    """

    best: array
    second: array
    back: array
    into: array | list


def forward(model: Pieces, segment: bytes) -> Forward:
    n = len(segment)
    none = array("d", [-np.inf])
    into = array("Q", [0]) if max(model.longest, 4) <= 64 else [0]
    f = Forward(none * (n + 1), none * (n + 1), array("i", [0]) * (n + 1), into * (n + 1))
    f.best[0] = 0.0
    for start in range(n):
        if f.best[start] == -np.inf:
            continue
        for end, piece in _edges(model, segment, start):
            f.into[end] |= 1 << (end - start - 1)
            score = float(model.scores[piece])
            one, two = f.best[start] + score, f.second[start] + score
            if one > f.best[end]:
                f.second[end] = max(f.best[end], two)
                f.best[end], f.back[end] = one, end - start
            else:
                f.second[end] = max(f.second[end], one)
    return f


def n_best(model: Pieces, segment: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The n best (score, piece numbers) of a segment, by backward A* search.

    The bound of an entry is the loss of a whole path, as forward scores are exact, and no two entries share a path:
    of the agenda only as many of the best are kept as paths are still wanted.
    """
    f = forward(model, segment)
    out: list[tuple[float, list[int]]] = []
    # (loss bound, order, place, score behind the place, pieces behind the place); of equals the last pushed goes first
    agenda = [(-f.best[-1], 0, len(segment), 0.0, None)]
    ticket = 0
    while agenda and len(out) < n:
        bound, _, place, behind, chain = heapq.heappop(agenda)
        if place == 0:
            path = []
            end = 0
            while chain:
                (piece, size), chain = chain
                path += [piece] if piece != model.unknown else model.byte[list(segment[end : end + size])].tolist()
                end += size
            out.append((-bound, path))
            continue
        sizes = f.into[place]
        while sizes:  # the longest piece last
            start = place - (sizes & -sizes).bit_length()
            sizes &= sizes - 1
            piece = model.by_text.get(segment[start:place], model.unknown)
            ticket -= 1
            score = behind + float(model.scores[piece])
            agenda.append((-(f.best[start] + score), ticket, start, score, ((piece, place - start), chain)))
        agenda = heapq.nsmallest(n - len(out), agenda)  # sorted, so a heap
    return out


def _ways(path: str, segment: bytes, n: int) -> tuple:
    return tuple(n_best(pieces(path), segment, n))


#: _ways() of short segments, which come again.
_remembered = lru_cache(4096)(_ways)


@dataclass
class Segments:
    """Best path and losses of distinct segments: ids[first[k]:first[k + 1]], score and second best score of each."""

    ids: np.ndarray
    first: np.ndarray
    best: np.ndarray
    second: np.ndarray


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all spans one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _side_by_side(model: Pieces, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, place, id) of the best paths' pieces in order, best, second. Segments come longest first."""
    n, words = len(buf), len(start)
    stop = np.repeat(start + size, size)
    own = np.repeat(np.arange(words), size)
    at = np.arange(n)
    head = (buf < 0x80) | (buf >= 0xC0)
    sums, down = prefix_hash(buf)
    none = len(model.scores) - 1  # the last score stands for no piece
    found = np.full((model.longest + 1, n), none, np.int32)
    for k in range(1, model.longest + 1):
        p = at[head & (at + k <= stop)]
        ids = model.find(span_hash(sums, down, p, p + k))
        ok = ids >= 0
        found[k, p[ok]] = ids[ok]
    width = np.where(buf < 0xC0, 1, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4)))
    width = np.minimum(width, stop - at)
    p = at[head]
    lone = p[found[width[p], p] == none]
    found[width[lone], lone] = model.unknown
    node = start + np.arange(words)  # a segment has a node more than bytes
    best, second = np.full(n + words, -np.inf), np.full(n + words, -np.inf)
    back = np.zeros(n + words, np.int8)
    best[node] = 0
    for e in range(1, int(size.max(initial=0)) + 1):
        k = int(np.searchsorted(-size, -e, "right"))
        own_start, own_node = start[:k], node[:k]
        a, b = np.full(k, -np.inf), np.full(k, -np.inf)
        last = np.zeros(k, np.int8)
        for width_ in range(min(e, model.longest), 0, -1):
            piece = found[width_, e - width_ :].take(own_start)
            at_ = np.flatnonzero(piece < none)  # few places end a long piece
            if not len(at_):
                continue
            score, from_, a_, b_ = model.scores.take(piece.take(at_)), own_node.take(at_) + (e - width_), a.take(at_), b.take(at_)
            one, two = best.take(from_) + score, second.take(from_) + score
            better = one > a_
            b[at_] = np.where(better, np.maximum(a_, two), np.maximum(b_, one))
            a[at_] = np.maximum(a_, one)
            last[at_[better]] = width_
        best[node[:k] + e], second[node[:k] + e], back[node[:k] + e] = a, b, last
    word, place, piece = [], [], []
    left, k = size.copy(), np.arange(words)
    while len(k):
        w = back[node[k] + left[k]].astype(np.int64)
        left[k] -= w
        word.append(k)
        place.append(left[k])
        piece.append(np.stack([found[w, start[k] + left[k]].astype(np.int64), w]))
        k = k[left[k] > 0]
    word, place, piece = np.concatenate(word), np.concatenate(place), np.concatenate(piece, axis=1)
    order = np.lexsort((place, word))
    word, place, (ids, w) = word[order], place[order], piece[:, order]
    n_ids = np.where(ids == model.unknown, w, 1)  # an uncovered character has a piece for each byte
    of = np.repeat(np.arange(len(ids)), n_ids)
    byte = model.byte[buf[_gather(start[word] + place, n_ids)]]
    out = np.where(ids[of] == model.unknown, byte, ids[of]).astype(np.int32)
    return out, np.bincount(word[of], minlength=words), best[node + size], second[node + size]


def segment_paths(model: Pieces, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> Segments:
    """Best paths of the segments, in their order."""
    total = len(start)
    best, second = np.zeros(total), np.full(total, -np.inf)
    counts = np.zeros(total, np.int64)
    parts, wheres = [], []
    order = np.argsort(-size, kind="stable")
    long = order[: int(np.searchsorted(-size[order], -SHORT, "left"))]
    short = order[len(long) :]
    cuts = np.searchsorted(np.cumsum(size[short]), np.arange(CHUNK, int(size[short].sum()) + CHUNK, CHUNK), "right")
    for lo, hi in pairwise([0, *cuts]):  # none if all segments are long
        k = short[lo:hi]
        if len(k):
            own = buf[_gather(start[k], size[k])]
            path, counts[k], best[k], second[k] = _side_by_side(model, own, np.cumsum(size[k]) - size[k], size[k])
            parts.append(path)
            wheres.append(k)
    for k in long:
        text = buf[start[k] : start[k] + size[k]].tobytes()
        f = forward(model, text)
        path, end = [], len(text)
        while end:
            begin = end - f.back[end]
            piece = model.by_text.get(text[begin:end], model.unknown)
            path.append([piece] if piece != model.unknown else model.byte[list(text[begin:end])].tolist())
            end = begin
        path = np.array([x for part in reversed(path) for x in part], np.int32)
        counts[k], best[k], second[k] = len(path), f.best[-1], f.second[-1]
        parts.append(path)
        wheres.append(np.array([k]))
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    where = np.concatenate(wheres) if wheres else np.empty(0, np.int64)
    at = np.zeros(total, np.int64)
    at[where] = np.cumsum(counts[where]) - counts[where]
    return Segments(flat[_gather(at, counts)], np.concatenate([[0], np.cumsum(counts)]), best, second)


def _segments(model: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with the leading blank of each text, row offsets, segment starts, segment of each row's first)."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text, pa.scalar(" ", pa.large_string())))
    data, offs = buffers(text)
    n = len(data)
    blank, control = data == 0x20, model.apart[data]
    cut = np.zeros(n, bool)
    cut[1:] = (blank[1:] & ~blank[:-1]) | control[1:] | control[:-1]
    cut[offs[:-1][offs[:-1] < n]] = True
    start = np.flatnonzero(cut)
    return data, offs, start, np.searchsorted(start, offs)


def encode_slice(path: str, batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, list]]], np.ndarray, np.ndarray]:
    """(ids of all rows, first of each row, n best of each row as (score, edits), bytes, row offsets).

    An edit (place, count, ids) puts ids instead of count ids from a place of the row's best path.
    """
    model = pieces(path)
    data, offs, start, first = _segments(model, batch.column("text"))
    end = np.append(start[1:], len(data))
    _, one, of = np.unique(span_hash(*prefix_hash(data), start, end), return_index=True, return_inverse=True)
    found = segment_paths(model, data, start[one], end[one] - start[one])
    counts = np.diff(found.first)[of]
    ids = found.ids[_gather(found.first[of], counts)]
    before = np.concatenate([[0], np.cumsum(counts)])
    row_first = before[first]
    loss = (found.best - found.second)[of]
    # sums by row in one order, whatever the slice
    totals = np.bincount(np.repeat(np.arange(len(first) - 1), np.diff(first)), weights=found.best[of], minlength=len(first) - 1)
    rows = []
    for r in range(batch.num_rows):
        a, b = int(first[r]), int(first[r + 1])
        own = loss[a:b]
        least = np.sort(np.argpartition(own, n - 2)[: n - 1]) if n > 1 and b - a > n - 1 else np.arange(b - a)
        if n > 1 and b - a > n - 1:  # of equal losses the first places
            most = own[least].max()
            below, equal = np.flatnonzero(own < most), np.flatnonzero(own == most)
            least = np.sort(np.concatenate([below, equal[: n - 1 - len(below)]]))
        least = [a + int(k) for k in least if own[k] < np.inf] if n > 1 else []
        ways = [(_remembered if end[k] - start[k] <= SHORT else _ways)(path, data[start[k] : end[k]].tobytes(), n) for k in least]
        total = float(totals[r])
        combined = [(0.0, ())]
        for w in ways:  # n best of the places so far
            combined = sorted((lost + w[0][0] - w[c][0], (*choice, c)) for lost, choice in combined for c in range(len(w)))[:n]
        rows.append(
            [
                (total - lost, [(int(before[k] - before[a]), int(counts[k]), list(w[c][1])) for k, w, c in zip(least, ways, choice, strict=True) if c])
                for lost, choice in combined
            ]
        )
    return ids, row_first, rows, data, offs


def decode_ids(path: str, ids: np.ndarray) -> bytes:
    """The bytes of pieces one after the other, with each text's leading blank."""
    model = pieces(path)
    return model.joined[_gather(model.starts[ids], model.sizes[ids])].tobytes()


_EDITS = "array<struct<score:double,edits:array<struct<place:int,count:int,ids:array<int>>>>>"
_EDITS_ARROW = pa.list_(
    pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("place", pa.int32()), ("count", pa.int32()), ("ids", pa.list_(pa.int32()))])))])
)


def encode_texts(docs: DataFrame, path: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, ids (of the best path), best (the n best: score, edits of ids).

    Fewer than n paths give fewer entries. Null and empty texts have no ids and one path of score 0. Ties go to the
    longest piece, from the end of a segment, then to the first place. Rows that share an id are separate texts.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, first, rows, _, _ = encode_slice(path, batch, n)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                best = pa.array([[{"score": s, "edits": [{"place": p, "count": c, "ids": x} for p, c, x in e]} for s, e in r] for r in rows], _EDITS_ARROW)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, best], ["doc_id", "ids", "best"])

    return texts.mapInArrow(tidy(run), f"doc_id long, ids array<int>, best {_EDITS}")


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of encode_texts() rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode_ids(path, np.array(x, np.int64))[1:].decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """What encode_texts() finds, as digests: doc_id, n_ids, ids_sha256 (of little-endian uint32), n_paths, score, scores, paths_sha256, decoded.

    scores has the n best scores; paths_sha256 covers all n id sequences, one after the other; decoded tells whether
    the best path's ids decode to the text. Null texts are empty; rows that share an id are separate texts; an empty
    table gives an empty one; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, first, rows, data, offs = encode_slice(path, batch, n)
                text = decode_ids(path, ids)
                same = np.frombuffer(text, np.uint8) == data if len(text) == len(data) else np.zeros(len(data), bool)
                wrong = np.concatenate([[0], np.cumsum(~same)])[offs]
                digests, paths = [], []
                for r, best in enumerate(rows):
                    own = ids[first[r] : first[r + 1]].astype("<u4")
                    raw = own.tobytes()
                    digests.append(hashlib.sha256(raw).hexdigest())
                    every = hashlib.sha256(raw)
                    for _, edits in best[1:]:
                        at = 0
                        for place, count, new in edits:
                            every.update(raw[4 * at : 4 * place])
                            every.update(np.array(new, "<u4").tobytes())
                            at = place + count
                        every.update(raw[4 * at :])
                    paths.append(every.hexdigest())
                columns = [
                    batch.column("doc_id"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(digests),
                    pa.array([len(b) for b in rows], pa.int64()),
                    pa.array([b[0][0] for b in rows], pa.float64()),
                    pa.array([[s for s, _ in b] for b in rows], pa.list_(pa.float64())),
                    pa.array(paths),
                    pa.array(np.diff(wrong) == 0),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_sha256", "n_paths", "score", "scores", "paths_sha256", "decoded"])

    return texts.mapInArrow(tidy(run), "doc_id long, n_ids long, ids_sha256 string, n_paths long, score double, scores array<double>, paths_sha256 string, decoded boolean")
