"""Periodic runs of words by Main-Lorentz divide and conquer.

A run is a maximal stretch of words that repeats itself with a smallest period q and has at least LEAST words and
REPEATS periods. Each text is halved again and again; a run crosses the midpoint of exactly one segment first and lies
inside that segment. There the Z-function of the right half, taken from the midpoint, says how far the words agree with
those q further on, and the Z-function of the reversed left half how far they agree with those q before; a shift whose
agreement is long enough is extended to both sides into a run.

All midpoints of a level, of all texts of a slice, are worked on together. The Z values that can matter are at least
PROBE, so shifts whose first PROBE words differ are dismissed by one comparison of hashes, and the values of the others
come from halving search over prefix hashes. Each run is compared word by word before it counts; should two different stretches
have one hash, the slice is worked on again with values that are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import SPACE_WORDS, U64, buffers, joined, mix, prefix_hash, slices, span_hash, tidy, words
from .store import small_batches

LEAST = 24  # words of a run
REPEATS = 3  # periods of a run
#: Words that agree at the midpoint with those a period away, on the run's longer side: max(24, 3q) / 2 - q at least.
PROBE = 4
#: Shifts of midpoints that are looked at together; a text of any length takes bounded memory for them.
SHIFTS = 1 << 20
_MULTIPLIER = U64(0xD6E8FEB86659FD93)

RUNS = "array<struct<start:long,length:long,period:long>>"


def _probes(ids: np.ndarray) -> np.ndarray:
    """The hash of PROBE words from each place; the last places, which have fewer, have hashes that agree with none."""
    n = len(ids)
    out = mix(np.arange(n, dtype=U64) + U64(1 << 40))
    if n >= PROBE:
        acc = np.zeros(n - PROBE + 1, U64)
        for k in range(PROBE):
            acc = acc * _MULTIPLIER + ids[k : n - PROBE + 1 + k]
        out[: len(acc)] = mix(acc)
    return out


class _Agreement:
    """How far words agree after, and before, two places: by hash, or compared word by word if exact."""

    def __init__(self, ids: np.ndarray, exact: bool) -> None:
        self.ids, self.exact = ids, exact
        self.sums, self.down = prefix_hash(ids)

    def after(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The Z value: words from a on that equal those from b on, up to most."""
        return self._search(a, b, most, 1)

    def before(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The Z value of the reversed words: those before a that equal those before b, up to most."""
        return self._search(a, b, most, -1)

    def _search(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while len(k := np.flatnonzero(low < high)):
            half = (low[k] + high[k] + 1) // 2
            x, y = (a[k], b[k]) if way > 0 else (a[k] - half, b[k] - half)
            same = span_hash(self.sums, self.down, x, x + half) == span_hash(self.sums, self.down, y, y + half)
            low[k] = np.where(same, half, low[k])
            high[k] = np.where(same, high[k], half - 1)
        for k in np.flatnonzero(low).tolist() if self.exact else ():
            n, x, y = int(low[k]), int(a[k]), int(b[k])
            differ = self.ids[x : x + n] != self.ids[y : y + n] if way > 0 else self.ids[x - n : x][::-1] != self.ids[y - n : y][::-1]
            low[k] = int(differ.argmax()) if differ.any() else n
        return low


def _halved(lo: np.ndarray, hi: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The segments of each level; those that are too short for a run are left out."""
    while len(k := np.flatnonzero(hi - lo >= least)):
        lo, hi = lo[k], hi[k]
        yield lo, hi
        mid = (lo + hi) // 2
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])


def _shifts(lo: np.ndarray, hi: np.ndarray, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(segment, period) of all periods that a run inside the segment can have, about SHIFTS at a time."""
    most = (hi - lo) // repeats
    ends = np.cumsum(most)
    for at in range(0, int(ends[-1]), SHIFTS):
        flat = np.arange(at, min(at + SHIFTS, int(ends[-1])))
        segment = np.searchsorted(ends, flat, "right")
        yield segment, flat - (ends[segment] - most[segment]) + 1


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period; ids are the words of all texts, first their bounds.

    Words are equal if their ids are. start counts from the text's first word. PROBE rests on at least 6 * PROBE words
    and three periods.
    """
    if least < 6 * PROBE or repeats < 3:
        raise ValueError(f"a run has {6 * PROBE} words and three periods at least")
    for exact in (False, True):
        runs = _maximal(ids, first, _stretches(ids, first, least, repeats, exact))
        if exact or all(np.array_equal(ids[s : e - q], ids[s + q : e]) for _, s, e, q in runs.T.tolist()):
            break
    text, start, end, period = runs
    return np.stack([text, start - first[text], end - start, period], axis=1)


def _stretches(ids: np.ndarray, first: np.ndarray, least: int, repeats: int, exact: bool) -> np.ndarray:
    """(start, end, period) of the stretches that cross midpoints, up to the ends of their segments."""
    agree, probe = _Agreement(ids, exact), _probes(ids)
    last = max(len(ids) - 1, 0)
    found = [np.empty((3, 0), np.int64)]
    for lo, hi in _halved(first[:-1], first[1:], least):
        mid = (lo + hi) // 2
        for s, q in _shifts(lo, hi, repeats):
            m = mid[s]
            # the longer side of a run is the right one, or the left one
            right = np.flatnonzero((probe[m] == probe[np.minimum(m + q, last)]) & (m + q + PROBE <= hi[s]))
            before = m - PROBE - q
            left = np.flatnonzero((probe[m - PROBE] == probe[np.maximum(before, 0)]) & (before >= lo[s]))
            for k, x in ((right, m), (left, m - q)):  # words from x on against those from x + q on, and before both
                x, period, bottom, top = x[k], q[k], lo[s[k]], hi[s[k]]
                start = x - agree.before(x, x + period, x - bottom)
                end = x + period + agree.after(x, x + period, top - x - period)
                ok = end - start >= np.maximum(least, repeats * period)
                found.append(np.stack([start[ok], end[ok], period[ok]]))
    return np.concatenate(found, axis=1)


def _maximal(ids: np.ndarray, first: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """(text, start, end, period), each interval once with its smallest period, without those that a neighbour extends.

    A stretch that its segment cuts off is one of them: the whole run crosses a midpoint further up.
    """
    start, end, period = stretches[:, np.lexsort((stretches[2], stretches[1], stretches[0]))]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    text = np.searchsorted(first, start, "right") - 1
    last = max(len(ids) - 1, 0)
    before = (start > first[text]) & (ids[np.maximum(start - 1, 0)] == ids[np.minimum(start - 1 + period, last)])
    after = (end < first[text + 1]) & (ids[np.minimum(end, last)] == ids[np.maximum(end - period, 0)])
    return np.stack([text, start, end, period])[:, ~before & ~after]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offs = buffers(batch.column("text"))
            found = words(data, offs, SPACE_WORDS)
            text, start, length, period = find_runs(found.hash, found.first).T
            at = found.first[text] + start
            # words that some run covers after its first period
            change = np.zeros(len(found.hash) + 1, np.int64)
            np.add.at(change, at + period, 1)
            np.add.at(change, at + length, -1)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            columns = [batch.column("doc_id"), pa.array(np.diff(found.first)), pa.ListArray.from_arrays(pa.array(bounds), runs), joined(data, found, np.cumsum(change[:-1]) == 0, batch.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, runs (start, length, period by start, then period), collapsed.

    Words have no white space ([\\x20\\x09-\\x0D]). collapsed joins by one space the words that no run covers after its
    first period. Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are judged one by
    one, so null and repeated ids and rows come back as they are; an empty table gives an empty one. Other columns are
    ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(tidy(_marked), f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
