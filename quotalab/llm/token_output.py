"""Token ids in compressed blocks: each document its own zstandard frame under one shared dictionary.

A written table has one row for each block of about BLOCK_BYTES: the frames one after the other, the byte offset and
the token count of each document, and the hash of the dictionary they need. One document is read by slicing its frame
from its block. The dictionary is trained on a bounded sample of the serialised arrays and stored beside the blocks.
Blocks are written by Spark, so that a lost executor's blocks are written again and none appears twice.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import LOWER, U64, buffers, prefix_hash, slices, span_hash, tidy
from .store import forget, saved, scratch_path, small_batches

END_ID = 2
BLOCK_BYTES = 1 << 20
LEVEL = 3
DICT_BYTES = 64 << 10
#: Documents whose arrays train the dictionary, by the hash of their id, and the characters of each that are taken.
DICT_DOCS = 1000
DICT_DOC_CHARS = 8 << 10
#: Slots of a worker's table of encoded units, filled up to three quarters, and the ids it keeps; then it begins anew.
#: 12 bytes a slot, 12 bytes an entry and 4 an id: 50 MB at most between two steps.
MEMO_SLOTS = 1 << 20
MEMO_IDS = 1 << 22
#: Units of a text that are looked up and encoded in one step, far fewer than the table has slots.
STEP_UNITS = 1 << 18

#: What cutting texts into units rests on: a tokenizer file that differs in any of this has its texts encoded whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[list(b".,!?;:")] = _MARK


class _Coder:
    """A tokenizer with the units that a worker has encoded: an open table from a unit's hash to its ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        model = told["model"]
        self.divisible = (
            (told["normalizer"], told["pre_tokenizer"], told["post_processor"]) == (_NORMALIZER, _PRE_TOKENIZER, None)
            and (model["type"], model["end_of_word_suffix"], model["dropout"], model["continuing_subword_prefix"]) == ("BPE", "</w>", None, None)
            # added tokens must hold a character that is neither letter nor mark nor blank
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or not set(t["content"]) & set("<|>") for t in told["added_tokens"])
        )
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(MEMO_SLOTS, U64), np.zeros(MEMO_SLOTS, np.int32)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entries by hash, -1 for those that the table does not have."""
        out = np.full(len(h), -1, np.int32)
        slot = (h & U64(MEMO_SLOTS - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            same = key == h[left]
            out[left[same]] = self.entry[slot[same]]
            on = ~same & (key != 0)
            left, slot = left[on], (slot[on] + 1) & (MEMO_SLOTS - 1)
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New entries with distinct hashes."""
        base = len(self.first)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count, self.ids = np.concatenate([self.count, count.astype(np.int32)]), np.concatenate([self.ids, ids])
        slot = (h & U64(MEMO_SLOTS - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]  # of several for one slot the last stays
            mine = self.keys[slot] == h[left]
            self.entry[slot[mine]] = base + left[mine]
            left, slot = left[~mine], (slot[~mine] + 1) & (MEMO_SLOTS - 1)

    def encoded(self, units: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each unit has); plain units are one pre-token each."""
        count = np.zeros(len(units), np.int64)
        words, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units[k] for k in words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a unit is not one pre-token")
        count[words] = np.diff(ends, prepend=0)
        part = [units[k] for k in others]
        got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
        first = np.array([a for a, _ in got.offsets], np.int64)
        count[others] = np.diff(np.searchsorted(first, np.concatenate([[0], np.cumsum([len(w) + 1 for w in part])])))
        # ids of both kinds, dealt out in the order of the units
        at = np.empty(len(units), np.int64)
        at[words] = ends - count[words]
        at[others] = len(ids) + np.cumsum(count[others]) - count[others]
        return np.concatenate([ids, np.array(got.ids, np.uint32)])[_gather(at, count)], count

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, how many each row has)."""
        rows = len(offs) - 1
        if not self.divisible:
            raw = data.tobytes()
            found = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:], strict=True)], add_special_tokens=False)
            return np.array([i for x in found for i in x.ids], np.uint32), np.array([len(x.ids) for x in found], np.int64)
        start, end, row, folded, plain = _units(data, offs)
        h = span_hash(*prefix_hash(folded), start, end)
        h[h == 0] = U64(1)
        raw, ids, counts = memoryview(folded), [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(h), STEP_UNITS):
            k = slice(at, at + STEP_UNITS)
            ids_of, count = self._step(raw, start[k], end[k], h[k], plain[k])
            ids.append(ids_of)
            counts.append(count)
        return np.concatenate(ids), np.bincount(row, weights=np.concatenate(counts), minlength=rows).astype(np.int64)

    def _step(self, raw: memoryview, start: np.ndarray, end: np.ndarray, h: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each unit has) of at most STEP_UNITS units."""
        entry = self.find(h)
        if (entry < 0).any():
            new, one = np.unique(h[entry < 0], return_index=True)
            one = np.flatnonzero(entry < 0)[one]
            if len(self.first) + len(new) > MEMO_SLOTS * 3 // 4:
                self.clear()
                new, one = np.unique(h, return_index=True)
            self.add(new, *self.encoded([bytes(raw[a:b]).decode() for a, b in zip(start[one], end[one], strict=True)], plain[one]))
            entry = self.find(h)
        count = self.count[entry].astype(np.int64)
        found = self.ids[_gather(self.first[entry], count)]
        if len(self.ids) > MEMO_IDS:
            self.clear()
        return found, count


def _units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, row, bytes, plain) of what a text's ids are made of, in order.

    A run between white space that holds only letters (ASCII, and Latin ones of two bytes) and the marks .,!?;: is cut
    where letters and marks meet: each part is one pre-token, whatever stands beside it, and its ASCII letters count as
    lower case. Any other run is a unit as it stands, as added tokens are found in raw text.
    """
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    lead = lead[lead + 1 < n]
    pair = data[lead].astype(np.int64) << 8 | data[np.minimum(lead + 1, n - 1)]
    lead = lead[(pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)]  # signs, and a letter that lower case takes apart
    kind[lead] = kind[lead + 1] = _LETTER
    word = kind != _SPACE
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    opens = np.flatnonzero(word & (np.append(True, ~word[:-1]) | cut[:n])) if n else np.empty(0, np.int64)
    closes = np.flatnonzero(word & (np.append(~word[1:], True) | cut[1:])) + 1 if n else np.empty(0, np.int64)
    odd = np.concatenate([[0], np.cumsum(kind == _OTHER)])
    odd = np.flatnonzero(odd[closes] > odd[opens])
    step = np.zeros(n + 1, np.int8)
    step[opens[odd]] += 1
    step[closes[odd]] -= 1
    whole = np.cumsum(step[:n]) > 0
    kind[whole] = _OTHER
    edge = np.append(True, kind[1:] != kind[:-1]) if n else np.empty(0, bool)
    edge |= cut[:n]
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)[: len(start)]
    own = kind[start] != _SPACE
    start, end = start[own], end[own]
    return start, end, np.searchsorted(offs, start, "right") - 1, np.where(whole, data, LOWER[data]), kind[start] != _OTHER


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all spans one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(2)
def _coder(path: str) -> _Coder:
    return _Coder(path)


def encode_column(column: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(little-endian uint32 ids of all rows with the end id after each, bounds of the rows). Nulls are empty."""
    data, offs = buffers(column)
    ids, count = _coder(path).texts(data, offs)
    return np.insert(ids, np.cumsum(count), end_id).astype("<u4"), np.concatenate([[0], np.cumsum(count + 1)])


def encode_rows(texts: list[str | None], path: str, end_id: int = END_ID) -> list[bytes]:
    """Little-endian uint32 ids of each text, the end id last. Null texts are empty."""
    ids, at = encode_column(pa.array(texts, pa.string()), path, end_id)
    return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _frames(path: str, dictionary: bytes, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the content size is needed to read a frame back, checksum and dictionary id are kept in the block
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_dict_id=False)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = encode_column(batch.column("text"), path, end_id)
                raw = memoryview(ids).cast("B")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(at)), pa.array([packer.compress(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["doc_id", "n_tokens", "frame"],
                )

    return run


def _blocks(dict_hash: str) -> Callable:
    """Packs consecutive documents of a partition into blocks; start counts within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = number = at = 0

        def block() -> pa.RecordBatch:
            nonlocal number, at
            ids, counts, frames, part = zip(*held, strict=True)
            ends = np.cumsum([len(f) for f in frames])
            row = [part[0], number, at, list(ids), list(counts), [0, *ends.tolist()], dict_hash, b"".join(frames)]
            number, at = number + 1, at + sum(counts)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _BLOCK_TYPES, strict=True)], _BLOCK_NAMES)

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "n_tokens", "frame", "part")), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return run


_BLOCK_NAMES = ["part", "block", "first_token", "doc_ids", "n_tokens", "offsets", "dict_hash", "frames"]
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary()]
_BLOCK_SCHEMA = "part int, block int, first_token long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, dict_hash string, frames binary"


def train_dictionary(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The shared dictionary from the first DICT_DOC_CHARS characters of at most DICT_DOCS documents.

    If they are too few to train on it is empty, and frames are plain zstandard."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null")
    picked = picked.select("doc_id", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, DICT_DOC_CHARS).alias("text"))
    # ids alone are ranked, so that no task sends more than a few bytes for each of them
    last = picked.select("h", "doc_id").orderBy("h", "doc_id").limit(DICT_DOCS).agg(F.max(F.struct("h", "doc_id")).alias("last")).first()["last"]
    if last is None:
        return b""
    rows = picked.where((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("doc_id") <= last["doc_id"]))).orderBy("h", "doc_id", "text").limit(DICT_DOCS).collect()
    samples = encode_rows([r["text"] for r in rows], path, end_id)
    try:
        return zstandard.train_dictionary(DICT_BYTES, sorted(samples)).as_bytes()
    except zstandard.ZstdError:  # too little data for a dictionary
        return b""


def write_tokens(docs: DataFrame, path: str, target: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts under target: blocks in ascending order of doc_id, parts, and the dictionary.

    Null texts are empty and have the end id alone. Rows without an id come first; rows that share an id are all
    kept, in any order among themselves. An empty table writes no blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(texts, path, end_id)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary), end_id)], "dict_hash string, dictionary binary, end_id int").coalesce(1).write.parquet(f"{target}/dictionary")
    frames = saved(texts.mapInArrow(tidy(_frames(path, dictionary, end_id)), "doc_id long, n_tokens long, frame binary"), "frames")
    ordered = frames.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(_blocks(dict_hash), _BLOCK_SCHEMA).write.parquet(f"{target}/blocks")
    forget(frames)
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{target}/blocks")
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    # as many rows as there are partitions
    starts = sorted((r["part"], r["tokens"]) for r in parts.collect())
    cum = np.cumsum([0, *(t for _, t in starts)]).tolist()
    spark.createDataFrame([(p, c) for (p, _), c in zip(starts, cum, strict=False)], "part int, start long").coalesce(1).write.parquet(f"{target}/parts")


def _read(dictionaries: dict[str, bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {k: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None) for k, d in dictionaries.items()}
        for batch in batches:
            for row in batch.to_pylist():
                reader = readers[row["dict_hash"]]
                frames, offsets = row["frames"], row["offsets"]
                ids = [reader.decompress(frames[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                if counts.tolist() != row["n_tokens"]:
                    raise ValueError(f"block {row['part']}/{row['block']}: its index does not fit its frames")
                start = row["start"] + row["first_token"] + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(counts), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
                )

    return run


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each written document, start in ids of all before it, ids as uint32 bytes."""
    dictionaries = {r["dict_hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{target}/dictionary").collect()}
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{target}/blocks")
    starts = spark.read.schema("part int, start long").parquet(f"{target}/parts")
    return blocks.join(F.broadcast(starts), "part").mapInArrow(_read(dictionaries), "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, target: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this id; only their blocks' rows are read."""
    dictionaries = {r["dict_hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{target}/dictionary").collect()}
    out = []
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{target}/blocks")
    for row in blocks.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).toLocalIterator():
        d = dictionaries[row["dict_hash"]]
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None)
        for k, x in enumerate(row["doc_ids"]):
            if x == doc_id:
                out.append(np.frombuffer(reader.decompress(bytes(row["frames"][row["offsets"][k] : row["offsets"][k + 1]])), np.uint32))
    return out


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = pa.array([zlib.crc32(x.as_py()) for x in batch.column("ids")], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "start", "n_tokens")), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read back from files written under the shared folder."""
    target = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, target)
    return read_tokens(docs.sparkSession, target).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
