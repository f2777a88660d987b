"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of all items is built once for each block of items, sized by words, and sent to the tasks. There the
words of the documents are streamed through it; the longest match that ends at each word tells which words lie
inside an item's window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .hashing import ALNUM_WORDS, LOWER, buffers, lower_words, slices, tidy, words
from .store import saved, small_batches

WINDOW = 13  # consecutive words of an item that count as its occurrence
#: Words of the items in one automaton, at most twice as many states of some 300 bytes: 60 MB in a worker. A larger
#: item table is dealt over several automata; the driver builds them one by one and a task holds one at a time.
BLOCK_WORDS = 100_000


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers, with the items of each state's windows."""

    window: int
    vocabulary: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    following: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: state -> ids of the items that have its window-long string, or that end there as a whole and are shorter
    full: dict[int, frozenset] = field(default_factory=dict)
    whole: dict[int, list[tuple[int, frozenset]]] = field(default_factory=dict)
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    least: int = 1

    def _extend(self, last: int, w: int) -> int:
        known = self.following[last].get(w)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._copy(last, w, known)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.following[p]:
            self.following[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.following[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, w, q)
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.following.append(following)
        self.link.append(link)
        return len(self.length) - 1

    def _copy(self, p: int, w: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.following[q]), self.link[q])
        while p >= 0 and self.following[p].get(w) == q:
            self.following[p][w] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while state and w not in self.following[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.following[state].get(w)
        return (to, length + 1) if to is not None else (0, 0)

    def at_window(self, state: int) -> int:
        """The state of the window-long end of a match that is long enough."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state


def build(items: list[tuple[int, np.ndarray]], window: int) -> Automaton:
    """The automaton of (item id, word hashes); items without words are left out."""
    items = [(i, h) for i, h in items if len(h)]
    a = Automaton(window)
    a.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else a.vocabulary
    coded = [(i, np.searchsorted(a.vocabulary, h).tolist()) for i, h in items]
    for _, codes in coded:
        last = 0
        for w in codes:
            last = a._extend(last, w)
    full: dict[int, set] = {}
    whole: dict[int, dict[int, set]] = {}
    for i, codes in coded:
        state = length = 0
        for w in codes:
            state, length = a.step(state, length, w)
            if length >= window:
                full.setdefault(a.at_window(state), set()).add(i)
        if len(codes) < window:
            whole.setdefault(state, {}).setdefault(len(codes), set()).add(i)
    a.full = {s: frozenset(x) for s, x in full.items()}
    a.whole = {s: [(n, frozenset(x)) for n, x in by.items()] for s, by in whole.items()}
    # a match of n words needs n - 1 pairs of neighbours that some item has
    a.pairs = np.unique(np.concatenate([np.array(c[:-1], np.uint64) * np.uint64(len(a.vocabulary)) + np.array(c[1:], np.uint64) for _, c in coded if len(c) > 1] or [np.empty(0, np.uint64)]))
    a.least = min([window, *(len(c) for _, c in coded)])
    return a


def _occurrences(a: Automaton, codes: list[int], hit: np.ndarray, base: int, found: set) -> None:
    """Stream a stretch of words; mark those inside windows and collect the items."""
    state = length = 0
    short = bool(a.whole)
    for k, w in enumerate(codes):
        state, length = a.step(state, length, w)
        if length >= a.window:
            hit[base + k + 1 - a.window : base + k + 1] = True
            found |= a.full[a.at_window(state)]
        if short:
            s = state
            while s:
                for n, ids in a.whole.get(s, ()):
                    if n <= length:
                        hit[base + k + 1 - n : base + k + 1] = True
                        found |= ids
                s = a.link[s]


def _scan(a: Automaton, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
    """(hit, row -> item ids) of a batch's words."""
    n = len(hashes)
    hit, found = np.zeros(n, bool), {}
    size = len(a.vocabulary)
    if not n or not size:
        return hit, found
    code = np.searchsorted(a.vocabulary, hashes)
    code[code == size] = 0
    known = a.vocabulary[code] == hashes
    # stretches of known words in one row whose neighbours are neighbours in some item too
    joined = np.zeros(n, bool)
    k = np.flatnonzero(known[:-1] & known[1:] & (row[:-1] == row[1:]))
    if len(k) and len(a.pairs):
        pair = code[k].astype(np.uint64) * np.uint64(size) + code[k + 1].astype(np.uint64)
        at = np.minimum(np.searchsorted(a.pairs, pair), len(a.pairs) - 1)
        joined[k[a.pairs[at] == pair] + 1] = True
    opens = np.flatnonzero(known & ~joined)
    closes = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
    long = closes - opens >= a.least
    for s, e in zip(opens[long], closes[long], strict=True):
        ids = found.setdefault(int(row[s]), set())
        _occurrences(a, code[s:e].tolist(), hit, s, ids)
    return hit, {r: ids for r, ids in found.items() if ids}


def _pieces(h: np.ndarray, window: int, limit: int) -> Iterator[np.ndarray]:
    """The words of an item in pieces of at most limit words (two windows at least): each window is whole in one of them."""
    limit = max(limit, 2 * window)
    for at in range(0, max(len(h) - window + 1, 1), limit - window + 1):
        yield h[at : at + limit]


def _blocks(items: DataFrame, window: int, limit: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items in blocks of at most limit words, never all at once on the driver; a longer item goes in pieces."""
    block, size = [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        for h in _pieces(lower_words(pa.array([r["text"]], pa.string()), ALNUM_WORDS).hash, window, limit):
            if block and size + len(h) > limit:
                yield block
                block, size = [], 0
            block.append((r["item_id"], h))
            size += len(h)
    yield block


def _parse(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def _match(spark: SparkSession, texts: DataFrame, block: list, window: int, keep: bool) -> tuple[DataFrame, Broadcast]:
    """(texts with what the block's items match, the broadcast automaton that this rests on)."""
    shared = spark.sparkContext.broadcast(build(block, window))  # bounded by BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offs = buffers(batch.column("text"))
                w = words(LOWER[data], offs, ALNUM_WORDS)
                hit, found = _scan(a, w.hash, w.row)
                edge = np.flatnonzero(hit & ~np.append(False, hit[:-1] & (w.row[:-1] == w.row[1:])) if len(hit) else hit)
                stop = np.flatnonzero(hit & ~np.append(hit[1:] & (w.row[:-1] == w.row[1:]), False) if len(hit) else hit)
                bounds = np.searchsorted(w.row[edge], np.arange(batch.num_rows + 1)).astype(np.int32)
                word0 = w.first[w.row[edge]]
                byte0 = offs[w.row[edge]]
                spans = pa.StructArray.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (edge - word0, stop + 1 - word0, w.start[edge] - byte0, w.end[stop] - byte0)],
                    ["first", "last", "start", "end"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(x) for x in batch.schema.names if keep or x != "text"),
                        pa.array(np.diff(w.first)),
                        pa.ListArray.from_arrays(pa.array(bounds), spans),
                        pa.array([sorted(found.get(r, ())) for r in range(batch.num_rows)], pa.list_(pa.int64())),
                    ],
                    [*(x for x in batch.schema.names if keep or x != "text"), "n_words", "spans", "items"],
                )

    own = [f for f in texts.schema if keep or f.name != "text"]
    kinds = _parse("n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<long>")
    return texts.mapInArrow(tidy(run), StructType([*own, *kinds])), shared


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = False,
) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, spans, items; with keep_text also the text.

    spans are the runs of words inside windows (first and last word, start and end byte); items are the sorted ids of
    the items with a window in the text. Null or empty texts have no words and no spans. Items that are null, without
    words or without an id match nothing; without items nothing matches. Items that share an id count as one. With
    more than block_words words of items, documents are matched against each block, with the same result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _contamination(texts, items, item_col, item_text_col, window, block_words, keep_text)


def _contamination(texts: DataFrame, items: DataFrame, item_col: str, item_text_col: str, window: int, block_words: int, keep_text: bool) -> DataFrame:
    """texts(doc_id, text, ...): further columns come through."""
    small_batches(texts.sparkSession)
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = _blocks(rows, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _match(texts.sparkSession, texts, first, window, keep_text)[0]
    # ids may be null or repeat: a saved key tells the rows apart
    keyed = saved(texts.withColumn("__row", F.monotonically_increasing_id()), "texts")
    union = None
    for block in chain((first, second), blocks):
        # each block's result is written, so that one automaton at a time is held
        part, shared = _match(texts.sparkSession, keyed.select("__row", "text"), block, window, False)
        part = saved(part, "matches")
        shared.destroy()
        union = part if union is None else union.unionByName(part)
    found = union.groupBy("__row").agg(
        F.first("n_words").alias("n_words"), joined_spans(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return keyed.select("__row", *(c for c in texts.columns if keep_text or c != "text")).join(found, "__row").drop("__row")


def joined_spans(spans: F.Column) -> F.Column:
    """Sorted spans with those that touch or overlap made one, as within a block."""

    def step(acc: F.Column, x: F.Column) -> F.Column:
        last = F.try_element_at(acc, F.lit(-1))
        one = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(last["last"] >= x["first"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<first:long,last:long,start:long,end:long>>)"), step)


def hit_words(spans: str = "spans") -> F.Column:
    """Words covered by the spans, which come sorted."""
    start = F.expr("named_struct('n', 0L, 'to', 0L)")
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["last"] - F.greatest(acc["to"], x["first"]))).alias("n"), F.greatest(acc["to"], x["last"]).alias("to"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: at least one hit word, and a twentieth of all words."""
    n = hit_words()
    return found.withColumn("n_hit", n).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if not spans:
                out.append(text)
                continue
            at, parts = 0, []
            for s in sorted(spans, key=lambda x: x["start"]):
                parts.append(text[at : max(at, s["start"])])
                at = max(at, s["end"])
            out.append(b"".join([*parts, text[at:]]))
        column = pa.array(out, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("rest"), column], ["rest", "text"])


def decontaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of docs that are not contaminated, all columns, their text without the spans that match an item.

    Null and empty texts stay as they are; rows are judged one by one, whether ids are null or shared; an empty table
    gives an empty one.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))
    found = judged(_contamination(texts, items, item_col, item_text_col, window, block_words, True)).where(~F.col("contaminated"))
    cut = found.select("rest", "text", "spans").mapInArrow(tidy(_without_spans), StructType([texts.schema["rest"], StructField("text", StringType())]))
    return cut.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
