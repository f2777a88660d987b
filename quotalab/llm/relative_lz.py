"""Removal of repeated word windows by relative Lempel-Ziv parsing.

1. The windows of each text are cut into runs that share an anchor (see anchored.py). A run whose context stood earlier
   is a duplicate as a whole.
2. The distinct contexts of an anchor form its reference block, in the order of their first places. The block is indexed
   by a suffix array, and each context is factored greedily against all of the block that stands before it: a factor is
   the longest match with an earlier context from where the last factor ended, or a single word that has none.
3. A factor of LENGTH words or more makes all windows inside it duplicates. A window that crosses factor boundaries may
   still match another place than the factors around it, so its own longest match decides.
4. An anchor with more contexts than one block may hold is dealt over several. The windows that are the first in their
   block are then compared between the blocks by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import KEY, RUNS, factored, keyed, placed
from .hashing import SPACE_WORDS, U64, buffers, joined, mix, prefix_hash, slices, span_hash, tidy, words
from .store import saved, small_batches
from .suffix_dedup import chunked_anchors

LENGTH = 20  # words of a window
GRAM = 6  # words of an anchor
BLOCK_BYTES = 1 << 19  # text of whole reference blocks that is indexed at once at least
PER_BLOCK = 2048  # distinct contexts of a reference block
CHUNK = 1 << 18  # windows of a text whose anchors are found at once
NO_ID = (1 << 63) - 1  # rows without an id come last


def _runs(length: int, gram: int):
    """The runs of windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = words(*buffers(batch.column("text")), SPACE_WORDS)
                sums, down = prefix_hash(found.hash)
                for row, lo, hi, anchor in chunked_anchors(found.hash, found.first, length, gram, CHUNK):
                    at = found.first[row]
                    same = span_hash(sums, down, at + lo, at + hi + length)
                    own = [batch.column(k).take(pa.array(row)) for k in KEY]
                    columns = [*own, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(same.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, [*KEY, "lo", "hi", "anchor", "same"])

    return run


def _contexts(length: int):
    """The words of the runs that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offs = buffers(batch.column("text"))
                found, text = words(data, offs, SPACE_WORDS), memoryview(data)
                lists = batch.column("runs")
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                lo, hi, anchor, part, parts, n = (lists.flatten().field(k) for k in range(6))
                start = found.start[found.first[row] + lo.to_numpy()]
                end = found.end[found.first[row] + hi.to_numpy() + length - 1]
                context = pa.array([bytes(text[s:e]) for s, e in zip(start, end, strict=True)], pa.binary())
                own = [batch.column(k).take(pa.array(row)) for k in KEY]
                yield pa.RecordBatch.from_arrays([*own, lo, anchor, part, parts, n, context], [*KEY, "lo", "anchor", "part", "parts", "n", "context"])

    return run


def _suffixes(ids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffix array, ranks by the first 1, 2, 4 ... words); a suffix ends with its context, left words further on."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    span, ranks = 1, [(1, rank)]
    while span < left.max(initial=0):
        further = np.where(left > span, np.append(rank, np.zeros(span, np.int64))[span : n + span] + 1, 0)
        rank = np.unique((rank << 32) | further, return_inverse=True)[1].astype(np.int64)
        span *= 2
        ranks.append((span, rank))
    return np.argsort(rank, kind="stable"), ranks


def _nearest_earlier(order: np.ndarray) -> np.ndarray:
    """Of each place of the suffix array the last place before it whose context is an earlier one, or -1."""
    near = np.arange(len(order)) - 1
    open_ = np.arange(len(order))
    while len(open_ := open_[(near[open_] >= 0) & (order[np.maximum(near[open_], 0)] >= order[open_])]):
        near[open_] = near[near[open_]]
    return near


def longest_earlier(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each word the length of the longest match from there with a context that stands before its own.

    ids are the words of all contexts, equal ones only within one block; first has the bounds of the contexts.
    """
    n, sizes = len(ids), np.diff(first)
    context = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(first[1:], sizes) - np.arange(n)
    suffix, ranks = _suffixes(ids, left)
    best = np.zeros(n, np.int64)
    for line in (suffix, suffix[::-1]):  # towards smaller, then greater suffixes
        near = _nearest_earlier(context[line])
        k = np.flatnonzero(near >= 0)
        at, other = line[k], line[near[k]]
        a, b, length, most = at.copy(), other.copy(), np.zeros(len(k), np.int64), np.minimum(left[at], left[other])
        for span, rank in reversed(ranks):
            ok = length + span <= most
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            step = ok * span
            a, b, length = a + step, b + step, length + step
        best[at] = np.maximum(best[at], length)
    return best


def parsed(longest: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the greedy factors of all contexts; a word that no earlier context has is a factor of its own."""
    at, end = first[:-1].copy(), first[1:]
    starts, lengths = [], []
    while len(k := np.flatnonzero(at < end)):
        size = np.maximum(longest[at[k]], 1)
        starts.append(at[k])
        lengths.append(size)
        at[k] += size
    start, length = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, lengths))
    order = np.argsort(start)
    return start[order], length[order]


def _duplicates(longest: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Whether the window that starts at each word is a duplicate; windows end within their context."""
    start, size = parsed(longest, first)
    factor = np.repeat(np.arange(len(start)), size)  # of each word
    n, end = len(longest), np.repeat(first[1:], np.diff(first))
    window = np.flatnonzero(np.arange(n) + length <= end)
    out = np.zeros(n, bool)
    whole = factor[window] == factor[window + length - 1]
    out[window[whole]] = True
    crossing = window[~whole]
    out[crossing] = longest[crossing] >= length
    return out


def _factor(length: int):
    """(key, digest, start, end, window) of duplicate words; for divided anchors also each window that is the first in its
    block, with its hash and no end."""

    def blocks(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        anchor, part, parts, lo = (table.column(k).to_numpy() for k in ("anchor", "part", "parts", "lo"))
        keys = np.stack([table.column(k).to_numpy() for k in KEY])
        new_block = np.ones(len(anchor), bool)
        new_block[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
        again = np.zeros(len(anchor), bool)  # the same context of the same text, which rows that are equal send
        again[1:] = ~new_block[1:] & (keys[:, 1:] == keys[:, :-1]).all(0) & (lo[1:] == lo[:-1])
        kept = np.flatnonzero(~again)
        anchor, parts, lo, keys, block = anchor[kept], parts[kept], lo[kept], keys[:, kept], (np.cumsum(new_block) - 1)[kept]
        found = words(*buffers(table.column("context").combine_chunks().take(pa.array(kept))), SPACE_WORDS)
        own = np.unique(found.hash, return_inverse=True)[1].astype(np.int64) | (block[found.row] << 32)
        longest = longest_earlier(own, found.first)
        duplicate = _duplicates(longest, found.first, length)
        # stretches of windows that follow each other in one context
        ends = np.concatenate([[False], duplicate, [False]]).astype(np.int8)
        edge = np.diff(ends)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = found.row[start]
        at = lo[row] + start - found.first[row]
        rows, starts, stops = [keys[:, row]], [at], [at + (stop - start) - 1 + length]
        hashes = [pa.nulls(len(row), pa.int64())]
        loose = np.flatnonzero((parts[found.row] > 1) & ~duplicate & (np.arange(len(duplicate)) + length <= found.first[found.row + 1]))
        if len(loose):
            sums, down = prefix_hash(found.hash)
            of = found.row[loose]
            h = mix(span_hash(sums, down, loose, loose + length) ^ anchor[of].view(U64))
            rows.append(keys[:, of])
            starts.append(lo[of] + loose - found.first[of])
            stops.append(np.full(len(loose), -1))
            hashes.append(pa.array(h.view(np.int64)))
        keys = np.concatenate(rows, axis=1)
        columns = [*(pa.array(k) for k in keys), pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(stops).astype(np.int64)), pa.concat_arrays(hashes)]
        return pa.RecordBatch.from_arrays(columns, [*KEY, "start", "end", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "context", BLOCK_BYTES):
                if not batch.num_rows:
                    continue
                held.append(batch)
                size += batch.column("context").nbytes
                if size >= BLOCK_BYTES:
                    table = pa.Table.from_batches(held)
                    anchor, part = table.column("anchor").to_numpy(), table.column("part").to_numpy()
                    other = np.flatnonzero((anchor != anchor[-1]) | (part != part[-1]))
                    if len(other):
                        cut = int(other[-1]) + 1
                        yield blocks(table.slice(0, cut))
                        held = table.slice(cut).combine_chunks().to_batches()
                        size = sum(b.column("context").nbytes for b in held)
        if held:
            yield blocks(pa.Table.from_batches(held))

    return run


def _spans(texts: DataFrame, length: int, gram: int, per_block: int) -> DataFrame:
    """(key, digest, spans) of the texts(key, digest, text) with duplicate windows; spans (start, end) of words, sorted."""
    runs = placed(texts.mapInArrow(tidy(_runs(length, gram)), RUNS))
    found = factored(runs, texts, _contexts(length), _factor(length), "key long, digest long, start long, end long, window long", per_block)
    found = saved(found, "factors")
    place = F.struct(*KEY, "start")
    loose = found.where("window is not null")
    earliest = loose.groupBy("window").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1")  # a row for each block at most
    across = loose.join(earliest, "window").where(place != F.col("least")).select(*KEY, "start", (F.col("start") + length).alias("end"))
    whole = runs.where("not first").select(*KEY, F.col("lo").cast("long").alias("start"), (F.col("hi") + length).cast("long").alias("end"))
    spans = whole.unionByName(found.where("window is null").drop("window")).unionByName(across)
    return spans.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            found = words(*(data := buffers(batch.column("text"))), SPACE_WORDS)
            lists = batch.column("spans")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row, flat = np.repeat(np.arange(len(lists)), sizes), lists.flatten()
            change = np.zeros(len(found.hash) + 1, np.int64)
            for k, step in ((0, 1), (1, -1)):
                np.add.at(change, found.first[row] + flat.field(k).to_numpy(), step)
            keep = np.cumsum(change[:-1]) == 0
            removed = np.bincount(found.row[~keep], minlength=batch.num_rows)
            columns = [batch.column("doc_id"), pa.array(np.diff(found.first)), pa.array(removed.astype(np.int64)), joined(data[0], found, keep, batch.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


def without_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, per_block: int = PER_BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words have no white space ([\\x20\\x09-\\x0D]) and count as they stand. A word goes if a window of length consecutive
    words of its text covers it that also starts earlier: in a text of smaller id, or before it in the same text, overlaps
    included; windows are judged on the input. Null, empty and short texts lose nothing. Rows that share an id but not the
    text come by the hash of their texts; rows that share both are one text, and all of them keep or lose the same; rows
    without an id come last. An empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    texts = keyed(docs, id_col, text_col, F.col(id_col).cast("long").alias("doc_id"), no_id=NO_ID)
    both = texts.join(_spans(texts.select(*KEY, "text"), length, min(gram, length), per_block), KEY, "left").select("doc_id", "text", "spans")
    return both.mapInArrow(tidy(_cut), "doc_id long, n_words long, n_removed long, kept string")
