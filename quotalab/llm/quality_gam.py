"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting.

Each feature of a text is cut into bins. Shallow trees over one feature's bins are boosted in turn, round after round,
and summed into one look-up table for each feature; then the same over the bins of pairs of features whose interaction
explains most of what is left. A text's score is the sum of its bins' entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import SPACE_WORDS, U64, Words, buffers, shingles, slices, words
from .store import saved, small_batches

#: Labelled rows that the model is fitted on, by the hash of their id: the bound of the training sample.
TRAIN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.1
LEAVES = 3
SHRINK = 1.0  # added to the second derivatives of a leaf
GOOD = 0.7  # least score of a predicted 1

FEATURES = [
    "log_words", "word_bytes", "upper", "symbols", "exclaim", "digits", "pipes", "stops", "beyond_ascii", "lines",
    "distinct", "stutter", "repeated", "symbol_ends", "longest", "single", "commonest",
]


def _mask(text: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text)] = True
    return out


_UPPER, _LETTER = _mask(bytes(range(0x41, 0x5B))), _mask(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
_SYMBOL, _EXCLAIM, _DIGIT, _PIPE, _STOP, _LINE = (_mask(x) for x in (b"#*$%&|<>", b"!?", b"0123456789", b"|", b".,;:", b"\n"))
_BEYOND = _mask(bytes(range(0x80, 0x100)))


def _runs(key: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: distinct keys, occurrences of keys that come again, and the commonest one's."""
    joint = (row.astype(U64) << U64(40)) | (key >> U64(24))
    joint.sort()
    first = np.flatnonzero(np.append(True, joint[1:] != joint[:-1])) if len(joint) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(joint)))
    of = (joint[first] >> U64(40)).astype(np.int64)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, of, n)
    return np.bincount(of, minlength=rows), np.bincount(of, weights=np.where(n > 1, n, 0), minlength=rows), top


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; texts without words have zeros. Rows of one batch only matter to themselves."""
    data, offs = buffers(column)
    rows = len(column)
    w: Words = words(data, offs, SPACE_WORDS)
    n = np.diff(w.first)
    full = np.flatnonzero(np.diff(offs) > 0)

    def bytes_of(kind: np.ndarray) -> np.ndarray:
        out = np.zeros(rows)
        if len(full):
            out[full] = np.add.reduceat(kind[data], offs[full], dtype=np.int64)
        return out

    per_word = lambda x: np.bincount(w.row, weights=x, minlength=rows)
    share = lambda a, b: np.divide(a, b, out=np.zeros(rows), where=np.asarray(b) > 0)
    size = np.diff(offs).astype(float)
    length = (w.end - w.start).astype(float)
    longest = np.zeros(rows)
    np.maximum.at(longest, w.row, length)
    stutter = np.zeros(len(w.hash), bool)
    stutter[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    distinct, _, commonest = _runs(w.hash, w.row, rows)
    grams, of = shingles(w, rows)
    _, repeated, _ = _runs(grams, of, rows)
    ends = data[w.end - 1] if len(w.end) else data[:0]
    return np.stack(
        [
            np.log1p(n), share(per_word(length), n), share(bytes_of(_UPPER), bytes_of(_LETTER)), share(bytes_of(_SYMBOL), size),
            share(bytes_of(_EXCLAIM), size), share(bytes_of(_DIGIT), size), share(bytes_of(_PIPE), size), share(bytes_of(_STOP), size),
            share(bytes_of(_BEYOND), size), share(bytes_of(_LINE), n), share(distinct, n), share(per_word(stutter), n),
            share(repeated, np.bincount(of, minlength=rows)), share(per_word(_SYMBOL[ends]), n), np.log1p(longest),
            share(per_word(length == 1), n), share(commonest, n),
        ],
        axis=1,
    )


@dataclass
class Model:
    """Cuts and one table for each feature; (i, j, cuts, cuts, table) for each pair; sums are log odds."""

    start: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, k], "right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.empty(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The step of a tree over ordered bins: the best cut of any leaf, again and again, then a Newton step by leaf."""
    bounds = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(bounds) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = _gain(cg[m] - cg[a], ch[m] - ch[a]) + _gain(cg[b] - cg[m], ch[b] - ch[m]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(m[k])))
        if not best[1]:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """(step, gain) of the best tree of four leaves over a grid: one cut of each feature."""
    corner = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = corner(g), corner(h)
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return np.zeros_like(g), 0.0
    parts = []
    for c in (cg, ch):
        a = c[i, j]
        parts.append((a, c[i, -1] - a, c[-1, j] - a, c[-1, -1] - c[i, -1] - c[-1, j] + a))
    gain = sum(_gain(x, y) for x, y in zip(*parts, strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
    at = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    sides = [(slice(0, at[0] + 1), slice(0, at[1] + 1)), (slice(0, at[0] + 1), slice(at[1] + 1, None)), (slice(at[0] + 1, None), slice(0, at[1] + 1)), (slice(at[0] + 1, None), slice(at[1] + 1, None))]
    for side, x, y in zip(sides, *parts, strict=True):
        out[side] = x[at] / (y[at] + SHRINK)
    return out, float(gain[at])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit to features x and labels y, 0 or 1. Without rows every score is a half."""
    count = x.shape[1]
    cuts = [_cuts(x[:, k], BINS) for k in range(count)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]
    for _ in range(ROUNDS if len(y) else 0):
        for k in range(count):
            g, h = slopes()
            size = len(tables[k])
            step = RATE * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size), LEAVES)
            tables[k] += step
            total += step[bins[k]]
    coarse = [_cuts(x[:, k], PAIR_BINS) for k in range(count)]
    small = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(small[i] * b + small[j], v, a * b).reshape(a, b)

    g, h = slopes()
    found = sorted(((-_pair_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(count) for j in range(i)), key=lambda z: z) if len(y) else []
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in found[:PAIRS] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in pairs:
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[0]
            table += step
            total += step[small[i], small[j]]
    return Model(start, cuts, tables, pairs)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text leaves 2 of 4; rows without an id are not, and are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return saved(texts.mapInArrow(run, "doc_id long, x array<double>").withColumn("held_out", is_held_out("doc_id")), "features")


def train(featured: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", limit: int = TRAIN_ROWS) -> Model:
    """Fit to at most limit labelled rows that are not held out. Several labels of a document count as their mean, at
    least a half for 1; null labels are ignored."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = featured.where(~F.col("held_out")).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(limit).select("x", "y").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(y) else np.empty((0, len(FEATURES)))
    return fit(x, y)


def classified(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (score >= GOOD).

    Null and empty texts are scored from zero features. Other columns of docs are never read.
    """
    featured = _featured(docs, id_col, text_col)
    model = train(featured, labels, label_col, id_col, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            p = model.score(x)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= GOOD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return featured.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
