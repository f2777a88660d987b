"""Elias-Fano sequences in plain arrays that tasks map from files; all look-ups take and give whole arrays."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from pathlib import Path

import numpy as np

U64 = np.uint64
EVERY = 64  # ones or zeros between two samples
ALL = U64(0xFFFFFFFFFFFFFFFF)


@dataclass
class EliasFano:
    """n monotone values: low_bits of each packed, the rest in unary with sampled ones and zeros."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray

    def at(self, k: np.ndarray) -> np.ndarray:
        """The k-th values."""
        high = (_select(self.high, self.ones, k, False) - k).astype(U64)
        return (high << U64(self.low_bits)) | self._low(k)

    def pair(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k-th and the next values of a sequence, as a pointer and the end of its range."""
        pos = _select(self.high, self.ones, k, False)
        at, shift = (pos + 1) >> 6, ((pos + 1) & 63).astype(U64)
        word = self.high[at] & (ALL << shift)
        empty = np.flatnonzero(word == 0)
        while len(empty):
            at[empty] += 1
            word[empty] = self.high[at[empty]]
            empty = empty[word[empty] == 0]
        after = (at << 6) + np.bitwise_count((word & (~word + U64(1))) - U64(1))
        bits = U64(self.low_bits)
        first = ((pos - k).astype(U64) << bits) | self._low(k)
        return first.astype(np.int64), (((after - k - 1).astype(U64) << bits) | self._low(k + 1)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value that is x or more, whether it is x); places run up to n."""
        h = (x >> U64(self.low_bits)).astype(np.int64)
        last = int(self.zeros[-1])
        over = h >= last
        h = np.minimum(h, max(last - 1, 0))
        # the values with this high part stand between two zeros
        begin = np.where(h > 0, _select(self.high, self.zeros, np.maximum(h - 1, 0), True) + 1, 0)
        place = begin - h
        word, shift = begin >> 6, (begin & 63).astype(U64)
        bits = self.high[word] >> shift
        bits |= np.where(shift > 0, self.high[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        run = _trailing_ones(bits)
        want = x & ((U64(1) << U64(self.low_bits)) - U64(1))
        end = place + run
        long = np.flatnonzero(run >= 64)
        if len(long):  # a crowded high part: its end is the zero that closes it
            end[long] = _select(self.high, self.zeros, h[long], True) - h[long]
        lo, hi = place.copy(), end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        same = np.zeros(len(x), bool)
        inside = np.flatnonzero((lo < end) & ~over)
        same[inside] = self._low(lo[inside]) == want[inside]
        return np.where(over, self.n, lo), same

    def _low(self, k: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(k), U64)
        bit = k * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(U64)
        out = self.low[word] >> shift
        out |= np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return out & ((U64(1) << U64(self.low_bits)) - U64(1))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones, "zeros": self.zeros, "head": np.array([self.n, self.low_bits], np.int64)}


def _trailing_ones(x: np.ndarray) -> np.ndarray:
    free = x ^ ALL  # the first zero of x is the lowest one of free
    lowest = free & (~free + U64(1))
    return np.where(free == 0, 64, np.bitwise_count(lowest - U64(1))).astype(np.int64)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits, lowest first, in 64-bit words with two words to spare."""
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate([raw, np.zeros(-len(raw) % 8 + 16, np.uint8)]).view(U64)


def encode(values: np.ndarray, universe: int) -> EliasFano:
    """values: sorted uint64 below universe."""
    n = len(values)
    low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
    low_bits = min(low_bits, 63)
    width = np.arange(low_bits, dtype=U64)
    packed = [((values[a : a + 65536, None] >> width) & U64(1)).astype(np.uint8).ravel() for a in range(0, n, 65536)] if low_bits else []
    low = _words(np.concatenate(packed)) if packed else np.zeros(2, U64)
    high = (values >> U64(low_bits)).astype(np.int64)
    buckets = int(high[-1]) + 1 if n else 1
    bits = np.zeros(n + buckets + 1, np.uint8)
    bits[-1] = 1  # pair() finds an end after the last value too
    at = high + np.arange(n)
    bits[at] = 1
    zeros = np.flatnonzero(bits == 0)
    # the last entry of zeros is their number
    return EliasFano(n, low_bits, low, _words(bits), np.append(at[::EVERY], 0), np.append(zeros[::EVERY], len(zeros)))


def of_arrays(found: dict[str, np.ndarray], prefix: str) -> EliasFano:
    n, low_bits = (int(x) for x in found[prefix + "head"])
    return EliasFano(n, low_bits, *(found[prefix + x] for x in ("low", "high", "ones", "zeros")))


#: place of the k-th one of a byte, at 8 * byte + k
_IN_BYTE = np.array([([b for b in range(8) if byte >> b & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.int64)


def _select(words: np.ndarray, samples: np.ndarray, k: np.ndarray, zeros: bool) -> np.ndarray:
    """Positions of the k-th ones, or zeros."""
    flip = ALL if zeros else U64(0)
    pos = samples[k >> 6]
    rest = (k & 63).astype(np.int64)
    at = pos >> 6
    word = (words[at] ^ flip) & (ALL << (pos & 63).astype(U64))
    count = np.bitwise_count(word).astype(np.int64)
    more = np.flatnonzero(rest >= count)
    while len(more):
        rest[more] -= count[more]
        at[more] += 1
        word[more] = words[at[more]] ^ flip
        count[more] = np.bitwise_count(word[more])
        more = more[rest[more] >= count[more]]
    base = at << 6
    for half in (32, 16, 8):
        c = np.bitwise_count(word & U64((1 << half) - 1))
        up = rest >= c
        rest -= c * up
        up = up * half
        base += up
        word = word >> up.astype(U64)
    return base + _IN_BYTE[((word & U64(255)).astype(np.int64) << 3) | rest]


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays that read_arrays() maps; it appears whole or not at all, also if written twice."""
    head, at, body = {}, 0, []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x)
        head[name] = [raw.dtype.str, len(raw), at]
        body.append(raw)
        at += -(-raw.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for raw in body:
            out.write(raw.tobytes())
            out.write(b"\0" * (-raw.nbytes % 8))
    os.replace(draft, path)


def read_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    whole = np.memmap(path, np.uint8, "r")
    size = int(whole[:8].view(np.int64)[0])
    head = json.loads(bytes(whole[8 : 8 + size]))
    start = 8 + size
    out = {}
    for name, (kind, n, at) in head.items():
        width = np.dtype(kind).itemsize
        out[name] = np.asarray(whole)[start + at : start + at + n * width].view(kind)
    return out
