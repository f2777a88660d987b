"""An Elias-Fano n-gram trie of words, pairs and triples, built in shards by Spark and mapped from files to score texts.

Words: each shard holds a range of 64-bit word hashes as one Elias-Fano sequence; a word's number is its place in all
shards. Pairs and triples: a shard holds the contexts whose hash falls to it. Under a context, a monotone pointer
gives the range of its successors; inside the range the successors' numbers ascend, stored relative to the end of the
range before, so that a level is one monotone sequence. A look-up is a pointer, then a successor search.

Smoothing is a hierarchy of Dirichlet priors: p(w) = (c + ALPHA) / (N + ALPHA (V + 1)) for words, V + 1 for one unknown
word; p(w | u) = (c(u w) + PRIOR_2 p(w)) / (c(u) + PRIOR_2); p(w | u v) = c(u v w) / (c(u v) + PRIOR_3) + back p(w | v)
with back = PRIOR_3 / (c(u v) + PRIOR_3). The second, the fraction of the third and back are stored quantised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, encode, of_arrays, read_arrays, write_arrays
from .hashing import SPACE_WORDS, U64, lower_words, mix, slices, tidy
from .store import posix_path, scratch_path, small_batches

ALPHA = 0.1
PRIOR_2 = 4.0
PRIOR_3 = 2.0
STEPS = 4096  # quantisation steps to a power of ten
END = U64(0x9AE16A3B2F90404F)  # stands for the hash of the end of a text
SLICE = 5 << 20  # bytes of text scored at once: a whole Arrow batch, which has 4 MB
HELD = 3_000_000  # counted rows that a task holds before it sends them on

#: Training tokens whose pairs and triples go to one shard, which a task builds in memory; at least as many shards as
#: spark.sql.shuffle.partitions, and at most as 16 bits can name.
SHARD_TOKENS = 4_000_000
MOST_SHARDS = 65_535
#: Shards whose levels a worker keeps mapped, some ten mappings each.
MOST_OPEN = 1024

_open: dict[str, Trie] = {}


def _pack(keys: np.ndarray, *rest: np.ndarray) -> bytes:
    """Sorted keys as differences, and columns beside them, compressed."""
    raw = np.diff(keys, prepend=U64(0)).tobytes() + b"".join(np.ascontiguousarray(x, np.uint32).tobytes() for x in rest)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // (8 + 4 * columns)
    out = [np.cumsum(np.frombuffer(raw, U64, n), dtype=U64)]
    return out + [np.frombuffer(raw, np.uint32, n, 8 * n + 4 * n * k) for k in range(columns)]


def _sum_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _sum_triples(pair: np.ndarray, third: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, third) in order with their summed counts."""
    own, rank = np.unique(pair, return_inverse=True)
    key, counts = _sum_keys((rank.astype(U64) << U64(32)) | third.astype(U64), counts)
    return own[(key >> U64(32)).astype(np.int64)], (key & U64(0xFFFFFFFF)).astype(np.uint32), counts


def _rows(shard: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])


def _by_shard(shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One packed row for each shard that has any; columns stay sorted within it."""
    order = np.argsort(shard.astype(np.uint16), kind="stable")
    ordered = shard[order]
    cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(order))
    return _rows(ordered[cuts], [_pack(*(x[order[a:b]] for x in columns)) for a, b in zip(cuts, ends, strict=True)])


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes, in order."""
    return (((h >> U64(48)) * U64(shards)) >> U64(16)).astype(np.int64)


def _lowest(shard: int, shards: int) -> int:
    """The least hash of a shard's range."""
    return -(-(shard << 16) // shards) << 48


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, U64), np.empty(0, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                own, n = np.unique(lower_words(batch.column("text"), SPACE_WORDS).hash, return_counts=True)
                keys, counts = _sum_keys(np.concatenate([keys, own, [END]]), np.concatenate([counts, n, [batch.num_rows]]))
                if len(keys) > HELD:
                    yield _by_shard(_word_shard(keys, shards), keys, counts)
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield _by_shard(_word_shard(keys, shards), keys, counts)

    return run


def _each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows come sorted by shard."""
    now, held = None, []
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append(blob)
    if held:
        yield now, held


def _build_words(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blobs in _each_shard(batches):
            parts = [_unpack(b, 1) for b in blobs]
            keys, counts = _sum_keys(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
            low = _lowest(shard, shards)
            high = 1 << 64 if shard == shards - 1 else _lowest(shard + 1, shards)
            levels = encode(keys - U64(low), high - low).arrays()
            write_arrays(f"{folder}/words-{shard}", {f"hash-{k}": x for k, x in levels.items()} | {"count": counts})
            ends = int(counts[np.searchsorted(keys, END)]) if END in keys else 0
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(keys), int(counts.sum()), ends)], ["shard", "n", "tokens", "ends"])

    return run


class Trie:
    """The mapped levels; look-ups take whole arrays."""

    def __init__(self, folder: str, shards: int, stats: list[tuple[int, int, int, int]]) -> None:
        self.folder, self.shards = folder, shards
        self.words: dict[int, tuple[EliasFano, int]] = {}
        self.size = self.tokens = self.texts = 0
        counts = []
        for shard, n, tokens, ends in sorted(stats):
            found = read_arrays(f"{folder}/words-{shard}")
            self.words[shard] = (of_arrays(found, "hash-"), self.size)
            counts.append(found["count"])
            self.size, self.tokens, self.texts = self.size + n, self.tokens + tokens, self.texts + ends
        self._counts = counts
        self._firsts = np.array([first for _, first in self.words.values()], np.int64)
        self.pair_shards = min(max(shards, -(-self.tokens // SHARD_TOKENS)), MOST_SHARDS)
        self.begin, self.none = self.size, self.size + 1
        if self.none >= 1 << 32:
            raise ValueError("more than 2**32 - 2 distinct words")
        self._pairs: dict[int, dict | None] = {}

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words by their hash, -1 for unknown ones; h is sorted."""
        out = np.full(len(h), -1, np.int64)
        cuts = np.searchsorted(_word_shard(h, self.shards), np.arange(self.shards + 1))
        for shard, (level, first) in self.words.items():
            a, b = cuts[shard], cuts[shard + 1]
            if a < b:
                place, same = level.find(h[a:b] - U64(_lowest(shard, self.shards)))
                out[a:b] = np.where(same, first + place, -1)
        return out

    def counts(self, number: np.ndarray) -> np.ndarray:
        """Training counts by number; the beginning counts once for each text, unknown words never."""
        out = np.zeros(len(number), np.int64)
        which = np.searchsorted(self._firsts, number, "right") - 1
        known = (number >= 0) & (number < self.size)
        for k, x in enumerate(self._counts):
            at = np.flatnonzero(known & (which == k))
            out[at] = x[number[at] - self._firsts[k]]
        out[number == self.begin] = self.texts
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        """p(w) of words with these counts."""
        return (counts + ALPHA) / (self.tokens + ALPHA * (self.size + 1))

    def pairs(self, shard: int) -> dict | None:
        """The levels of a shard; look-ups come by shard, and beyond MOST_OPEN of them the first one that was opened is let go."""
        if shard not in self._pairs:
            while len(self._pairs) >= MOST_OPEN:
                del self._pairs[next(iter(self._pairs))]
            try:
                found = read_arrays(f"{self.folder}/pairs-{shard}")
            except FileNotFoundError:  # no context fell to this shard
                self._pairs[shard] = None
            else:
                self._pairs[shard] = found | {k: of_arrays(found, f"{k}-") for k in ("context", "to_2", "word_2", "to_3", "word_3")}
        return self._pairs[shard]


def _opened(folder: str, shards: int, stats: list) -> Trie:
    if folder not in _open:
        _open.clear()
        _open[folder] = Trie(folder, shards, stats)
    return _open[folder]


def _pair_shard(pair: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(pair) >> U64(33)) % U64(shards)).astype(np.int64)


@dataclass
class Grams:
    """The distinct (pair, next token) of a batch, as ranks among its own words, sorted; and their places in the texts.

    A text is begin, words, end; it has a pair at each place but its end. Beyond the end comes none.
    """

    number: np.ndarray  # by rank
    count: np.ndarray  # training count by rank
    seq: np.ndarray  # ranks of all texts
    row: np.ndarray
    place: np.ndarray  # of the first token of each pair
    pair: np.ndarray  # distinct, with third: two ranks of 32 bits each
    third: np.ndarray
    gram: np.ndarray | None  # index into them for each pair
    repeats: np.ndarray  # how often each distinct one stands there


#: Three ranks of so many bits make one number to sort by; a text of more distinct words has its pairs numbered first.
BITS = 21


def _grams(batch: pa.RecordBatch, trie: Trie, places: bool, bits: int = BITS) -> Grams:
    rows = batch.num_rows
    found = lower_words(batch.column("text"), SPACE_WORDS)
    own, inverse = np.unique(np.append(found.hash, END), return_inverse=True)
    number = np.append(trie.numbers(own), [trie.begin, trie.none])
    begin, none = len(own), len(own) + 1
    first = found.first[:-1] + 2 * np.arange(rows)
    last = found.first[1:] + 2 * np.arange(rows) + 1
    seq = np.empty(len(found.hash) + 2 * rows, np.int64)
    row = np.repeat(np.arange(rows), np.diff(found.first) + 2)
    inside = np.ones(len(seq), bool)
    inside[first] = inside[last] = False
    seq[inside], seq[first], seq[last] = inverse[:-1], begin, inverse[-1]
    third = np.full(len(seq), none, np.int64)
    third[:-2] = np.where(row[:-2] == row[2:], seq[2:], none)
    place = np.flatnonzero(row[:-1] == row[1:])
    pair, third = (seq[place].astype(U64) << U64(32)) | seq[place + 1].astype(U64), third[place].astype(U64)
    if none < 1 << bits:
        low = U64(2 * bits), U64(bits), U64((1 << bits) - 1)
        key = ((pair >> U64(32)) << low[0]) | ((pair & U64(0xFFFFFFFF)) << low[1]) | third
    else:
        distinct, key = np.unique(pair, return_inverse=True)
        key = (key.astype(U64) << U64(32)) | third
    gram = None
    if places:
        order = np.argsort(key)
        key = key[order]
    else:
        key.sort()
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
    at = np.flatnonzero(new)
    if places:
        gram = np.empty(len(key), np.int64)
        gram[order] = np.cumsum(new) - 1
    repeats, key = np.diff(np.append(at, len(key))), key[at]
    if none < 1 << bits:
        pair, third = ((key >> low[0]) << U64(32)) | ((key >> low[1]) & low[2]), key & low[2]
    else:
        pair, third = distinct[(key >> U64(32)).astype(np.int64)], key & U64(0xFFFFFFFF)
    return Grams(number, trie.counts(number), seq, row, place, pair, third.astype(np.int64), gram, repeats)


def _count_triples(folder: str, shards: int, stats: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _opened(folder, shards, stats)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                g = _grams(batch, trie, False)
                number = g.number.astype(U64)
                pair = (number[(g.pair >> U64(32)).astype(np.int64)] << U64(32)) | number[(g.pair & U64(0xFFFFFFFF)).astype(np.int64)]
                yield _by_shard(_pair_shard(pair, trie.pair_shards), pair, number[g.third], g.repeats)

    return run


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65535).astype(np.uint16)


def _plain(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) / -STEPS)


def _level(parent: np.ndarray, number: np.ndarray, parents: int) -> tuple[EliasFano, EliasFano]:
    """(pointers, successors) of nodes sorted by (parent, number)."""
    begin = np.searchsorted(parent, np.arange(parents + 1))
    ends = np.zeros(parents, np.int64)
    full = np.diff(begin) > 0
    ends[full] = number[begin[1:][full] - 1] + 1
    before = np.concatenate([[0], np.cumsum(ends)[:-1]]) if parents else ends
    value = before[parent] + number + 1
    return encode(begin.astype(U64), len(number) + 1), encode(value.astype(U64), int(value[-1]) + 1 if len(value) else 1)


def _build_pairs(folder: str, shards: int, stats: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _opened(folder, shards, stats)
        for shard, blobs in _each_shard(batches):
            parts = [_unpack(b, 2) for b in blobs]
            blobs.clear()
            pair, third, count = _sum_triples(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)), np.concatenate([p[2] for p in parts]).astype(np.int64))
            del parts
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            c_pair = np.add.reduceat(count, first)
            own = pair[first]
            context, parent = np.unique(own >> U64(32), return_inverse=True)
            word = (own & U64(0xFFFFFFFF)).astype(np.int64)
            to_2, word_2 = _level(parent, word, len(context))
            c_context = trie.counts(context.astype(np.int64))[parent]
            p2 = (c_pair + PRIOR_2 * trie.base(trie.counts(word))) / (c_context + PRIOR_2)
            goes_on = third < trie.none
            node = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(pair))))[goes_on]
            to_3, word_3 = _level(node, third[goes_on].astype(np.int64), len(own))
            c_on = np.bincount(node, weights=count[goes_on], minlength=len(own))
            levels = {"context": encode(context, trie.size + 2), "to_2": to_2, "word_2": word_2, "to_3": to_3, "word_3": word_3}
            arrays = {f"{name}-{k}": x for name, level in levels.items() for k, x in level.arrays().items()}
            arrays |= {"p_2": _quantised(p2), "back_3": _quantised(PRIOR_3 / (c_on + PRIOR_3)), "part_3": _quantised(count[goes_on] / (c_on[node] + PRIOR_3))}
            write_arrays(f"{folder}/pairs-{shard}", arrays)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(own), len(node))], ["shard", "pairs", "triples"])

    return run


@dataclass
class Ranges:
    """Of each parent: where its successors begin and end, the value before them and the first one's."""

    begin: np.ndarray
    end: np.ndarray
    before: np.ndarray
    first: np.ndarray

    def of(self, k: np.ndarray) -> Ranges:
        return Ranges(self.begin[k], self.end[k], self.before[k], self.first[k])


def _ranges(to: EliasFano, words: EliasFano, parent: np.ndarray) -> Ranges:
    begin, end = to.pair(parent)
    if not words.n:  # no parent has a successor
        return Ranges(begin, end, np.zeros_like(begin), np.zeros_like(begin))
    value, after = words.pair(np.maximum(begin - 1, 0))
    return Ranges(begin, end, np.where(begin > 0, value, 0), np.where(begin > 0, after, value))


def _successor(words: EliasFano, r: Ranges, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of a number among the successors, stored relative to the value before them.

    The first successor is known already; only numbers above it in longer ranges are searched for.
    """
    want = r.before + number + 1
    place, found = r.begin.copy(), (r.begin < r.end) & (r.first == want)
    k = np.flatnonzero((r.end - r.begin > 1) & (r.first < want))
    if len(k):
        at, same = words.find(want[k].astype(U64))
        place[k], found[k] = at, same & (at < r.end[k])
    return place, found


def _distinct(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places of distinct keys, index of each key's own)."""
    new = np.append(True, sorted_keys[1:] != sorted_keys[:-1]) if len(sorted_keys) else np.empty(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def token_scores(trie: Trie, g: Grams) -> np.ndarray:
    """p of the second token of each pair of the batch, by place."""
    heads, pair_of = _distinct(g.pair)
    pair = g.pair[heads]
    u, v = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
    w = g.number[g.third]
    nu, nv = g.number[u], g.number[v]
    p2 = (PRIOR_2 / (g.count + PRIOR_2))[u] * trie.base(g.count)[v]
    back, part = np.ones(len(pair)), np.zeros(len(g.pair))
    known = np.flatnonzero((nu >= 0) & (nv >= 0))
    shard = _pair_shard((nu[known].astype(U64) << U64(32)) | nv[known].astype(U64), trie.pair_shards)
    order = np.argsort(shard.astype(np.uint16), kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(trie.pair_shards + 1))
    ends = np.append(heads[1:], len(g.pair))
    for s in np.flatnonzero(np.diff(cuts)):
        level = trie.pairs(int(s))
        if level is None:
            continue
        k = known[order[cuts[s] : cuts[s + 1]]]
        one, of = _distinct(nu[k])
        context, same = level["context"].find(nu[k[one]].astype(U64))
        r = _ranges(level["to_2"], level["word_2"], np.where(same, context, 0))
        node, found = _successor(level["word_2"], r.of(of), nv[k])
        found &= same[of]
        k, node = k[found], node[found]
        p2[k], back[k] = _plain(level["p_2"][node]), _plain(level["back_3"][node])
        if not len(k):
            continue
        r = _ranges(level["to_3"], level["word_3"], node)
        # the triples of each pair stand side by side
        n = ends[k] - heads[k]
        of = np.repeat(np.arange(len(k)), n)
        t = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + heads[k][of]
        place, found = _successor(level["word_3"], r.of(of), w[t])
        found &= w[t] >= 0
        part[t[found]] = _plain(level["part_3"][place[found]])
    of_pair = pair_of[g.gram]
    p = p2[of_pair]
    # the token after a pair: its place is the next one, unless the text ends there
    follow = np.flatnonzero(g.place[1:] == g.place[:-1] + 1)
    p[follow + 1] = part[g.gram[follow]] + back[of_pair[follow]] * p[follow + 1]
    return p


def _score(folder: str, shards: int, stats: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _opened(folder, shards, stats)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                g = _grams(batch, trie, True)
                row, count = g.row[g.place], g.count[g.seq[g.place + 1]]
                per = lambda x: np.bincount(row, weights=x, minlength=batch.num_rows)
                out = [
                    batch.column("doc_id"),
                    pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64)),
                    pa.array(per(count > 0).astype(np.int64)),
                    pa.array(np.full(batch.num_rows, trie.tokens)),
                    pa.array(per(np.log10(trie.base(count)))),
                    pa.array(per(np.log10(token_scores(trie, g)))),
                ]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def is_held_out(id_col: str = "doc_id", parts: int = 10) -> Column:
    """Whether the crc32 of the id as text leaves 0; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == 0, F.lit(True))


def build_trie(docs: DataFrame, text_col: str = "text") -> tuple[str, int, list]:
    """(folder, shards, sizes of the word shards): the levels of all texts of docs, under the shared folder.

    Word shards are as many as spark.sql.shuffle.partitions, shards of pairs by the counted tokens. Null texts are empty: an end alone. An empty table gives a trie
    without words, under which every probability is that of the one unknown word, 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SHARDS)
    path = scratch_path(spark, "trie")
    folder = posix_path(path)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    grouped = lambda df, n: df.repartition(n, "shard").sortWithinPartitions("shard")
    words = grouped(texts.mapInArrow(tidy(_count_words(shards)), "shard int, blob binary"), shards)
    stats = [tuple(r) for r in words.mapInArrow(_build_words(folder, shards), "shard long, n long, tokens long, ends long").collect()]  # a row for each shard
    if stats:
        tokens = sum(t for _, _, t, _ in stats)
        triples = grouped(texts.mapInArrow(tidy(_count_triples(folder, shards, stats)), "shard int, blob binary"), min(max(shards, -(-tokens // SHARD_TOKENS)), MOST_SHARDS))
        triples.mapInArrow(tidy(_build_pairs(folder, shards, stats)), "shard long, pairs long, triples long").collect()
    return folder, shards, stats


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that is_held_out() leaves. Words are runs without white space, A-Z lower-cased; each text
    ends with an end token. score and base_score are log10 probabilities of the text under the trie and under its
    words alone. Null texts are empty and score their end. Rows that share an id are separate texts.
    """
    folder, shards, stats = build_trie(docs.where(~is_held_out(id_col, parts)), text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(tidy(_score(folder, shards, stats)), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.select("doc_id", is_held_out("doc_id", parts).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
