"""Vectorised words, rolling hashes and shingles over the buffers of Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
#: Powers that a worker keeps, 16 bytes each; a longer text has its own made and dropped again.
KEPT_POWERS = 1 << 20
#: Bytes of text in a slice: the arrays over it have up to 8 bytes for each of them.
SLICE_BYTES = 1 << 19

#: Bytes that are white space in [\x20\x09-\x0D]; every other byte belongs to a word.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a to z and everything beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base and of its inverse modulo 2**64; only KEPT_POWERS of them are kept."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    made = []
    for base in (_BASE, _BASE_INV):
        out = np.full(max(n, KEPT_POWERS), base, U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        made.append(out)
    if n <= KEPT_POWERS:
        _powers["up"], _powers["down"] = made
    return made[0][:n], made[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def tidy(run: Callable) -> Callable:
    """run for mapInArrow(), giving freed memory back to the system at the end of each partition.

    Workers stay for the stages that follow, where memory that their allocator keeps would add up.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other libraries have none
        if trim:
            trim(0)

    return inner


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about limit bytes of the named column, and of a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    at, cum = 0, np.cumsum(sizes, dtype=np.int64)
    while at < len(sizes):
        base = cum[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(cum, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): span_hash() takes the hash of any span from them."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def span_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from start to end, wherever they stand."""
    return mix((sums[end] - sums[start]) * down[start])


@dataclass
class Words:
    """All words of a batch: span in the bytes, row, hash, and of each row its first word (n rows + 1)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of the bytes that kind marks; no run crosses rows."""
    n = len(data)
    mask = kind[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    sums, down = prefix_hash(data)
    row = np.searchsorted(offs, start, "right") - 1
    first = np.searchsorted(row, np.arange(len(offs)), "left")
    return Words(start, end, row, span_hash(sums, down, start, end), first)


def lower_words(column: pa.Array, kind: np.ndarray) -> Words:
    """words() after lower-casing A-Z."""
    data, offs = buffers(column)
    return words(LOWER[data], offs, kind)


def shingles(found: Words, rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of each row's shingles of size words, repeats included; fewer words make one shingle.

    A row without words has none.
    """
    h, count = found.hash, np.diff(found.first)
    total = len(h)
    out, rows_of = np.empty(0, U64), np.empty(0, np.int64)
    if total >= size:
        acc = np.zeros(total - size + 1, U64)
        for k in range(size):
            acc = acc * U64(0xD6E8FEB86659FD93) + h[k : total - size + 1 + k]
        ok = found.row[: total - size + 1] == found.row[size - 1 :]
        out, rows_of = mix(acc[ok]), found.row[: total - size + 1][ok]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.empty(len(short), U64)
        for i, r in enumerate(short):
            acc = int(count[r])
            for x in h[found.first[r] : found.first[r + 1]].tolist():
                acc = (acc * 0xD6E8FEB86659FD93 + x) & 0xFFFFFFFFFFFFFFFF
            extra[i] = acc
        out, rows_of = np.concatenate([out, mix(extra)]), np.concatenate([rows_of, short])
        order = np.argsort(rows_of, kind="stable")
        out, rows_of = out[order], rows_of[order]
    return out, rows_of


def joined(data: np.ndarray, found: Words, keep: np.ndarray, rows: int) -> pa.Array:
    """Of each row the words that keep marks, joined by one space."""
    start, end, row = found.start[keep], found.end[keep], found.row[keep]
    inner = np.zeros(len(start), bool)
    inner[:-1] = row[1:] == row[:-1]
    size = end - start + inner  # a word with the space after it
    at = np.cumsum(size) - size
    source = np.arange(int(size.sum())) + np.repeat(start - at, size)
    out = data[np.minimum(source, max(len(data) - 1, 0))]
    out[(at + size - 1)[inner]] = 0x20
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=rows))]).astype(np.int32)
    return pa.StringArray.from_buffers(rows, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(out)))
