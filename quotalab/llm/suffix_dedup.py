"""Removal of long repeated strings by run-length Burrows-Wheeler indexes.

1. The windows of LENGTH bytes of each text are cut into runs that share an anchor (see anchored.py).
2. Runs with equal contexts repeat each other whole; they are counted, and their texts need not meet. Anchors that
   stand once hold no repeat. The distinct contexts of every other anchor go to its task, each of them once.
3. There an index is built over them: the run-compressed BWT with the text positions sampled at both ends of each run
   and the irreducible longest-common-prefix values there. Streaming over the text, the samples give each position's
   longest match elsewhere; positions with LENGTH or more start a repeated string.
4. An anchor with more contexts than one index may hold is dealt over several; the windows that no index has matched
   are then compared between these by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .anchored import KEY, RUNS, factored, keyed, placed
from .hashing import U64, buffers, mix, prefix_hash, slices, span_hash, tidy
from .store import saved, small_batches

LENGTH = 400  # bytes of a repeated string
GRAM = 48  # bytes of an anchor gram
INDEX_BYTES = 1 << 20  # text that goes into one index at least, before the next begins
PER_INDEX = 2048  # distinct contexts of an anchor that one index takes; each has up to 2 * LENGTH bytes
CHUNK = 1 << 19  # windows of a text whose anchors are found at once
_POS_BITS = U64(28)  # places within a chunk


def _window_anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor hash) of each run of windows, positions within the row."""
    n, span = len(data), length - gram + 1
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, U64))
    sums, down = prefix_hash(data)
    at = np.arange(n - gram + 1)
    grams = span_hash(sums, down, at, at + gram)
    low = (U64(1) << _POS_BITS) - U64(1)
    # the least gram, the last of equal ones: gram bits above, reversed position below
    key = (grams & ~low) | (low - (at.astype(U64) & low))
    pad = -len(key) % span
    blocks = np.concatenate([key, np.full(pad, ~U64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    anchor = (low - (least & low)).astype(np.int64)
    row = np.searchsorted(offs, np.arange(windows), "right") - 1
    inside = np.arange(windows) + length <= offs[row + 1]
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new & inside)
    ok = np.flatnonzero(inside)
    # the last window of a run: before the next run begins, or the row's last
    nxt = np.append(np.flatnonzero(new), windows)
    last = nxt[np.searchsorted(nxt, first, "right")] - 1
    last = np.minimum(last, offs[row[first] + 1] - length) if len(ok) else last
    r = row[first]
    return r, first - offs[r], last - offs[r], grams[anchor[first]]


def chunked_anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int, chunk: int) -> Iterator[tuple[np.ndarray, ...]]:
    """_window_anchors() of chunk windows at a time, so that a text of any length takes bounded memory."""
    for at in range(0, max(len(data) - length + 1, 0), chunk):
        to = min(at + chunk + length - 1, len(data))
        a, b = int(np.searchsorted(offs, at, "right")) - 1, int(np.searchsorted(offs, to, "left"))
        row, lo, hi, h = _window_anchors(data[at:to], np.clip(offs[a : b + 1], at, to) - at, length, gram)
        moved = np.maximum(at - offs[a + row], 0)  # of the first row's part
        yield a + row, lo + moved, hi + moved, h


def _anchors(length: int, gram: int, chunk: int = CHUNK):
    """The runs of windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offs = buffers(batch.column("text"))
                text = memoryview(data)
                for row, lo, hi, h in chunked_anchors(data, offs, length, gram, chunk):
                    start, end = offs[row] + lo, offs[row] + hi + length
                    same = np.fromiter((xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(start, end, strict=True)), U64, len(start))
                    keys = [batch.column(k).take(pa.array(row)) for k in KEY]
                    columns = [*keys, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(same.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, [*KEY, "lo", "hi", "anchor", "same"])

    return run


def _contexts(length: int):
    """The bytes of the runs that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offs = buffers(batch.column("text"))
                text, lists = memoryview(data), batch.column("runs")
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                lo, hi, anchor, part, parts, n = (lists.flatten().field(k) for k in range(6))
                start, end = offs[row] + lo.to_numpy(), offs[row] + hi.to_numpy() + length
                context = pa.array([bytes(text[s:e]) for s, e in zip(start, end, strict=True)], pa.binary())
                keys = [batch.column(k).take(pa.array(row)) for k in KEY]
                yield pa.RecordBatch.from_arrays([*keys, lo, anchor, part, parts, n, context], [*KEY, "lo", "anchor", "part", "parts", "n", "context"])

    return run


def run_length_matches(texts: list[bytes]) -> np.ndarray:
    """For each byte of the joined texts the length of its longest match that starts anywhere else.

    A match ends with its text. Built as a run-compressed BWT: only run ends keep a text position and a
    longest-common-prefix value; all other positions follow from the nearest sample to their left.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum()) + len(texts)
    body = np.zeros(n, np.int64)
    stops = np.cumsum(sizes + 1) - 1  # each text ends with a separator of its own
    inside = np.ones(n, bool)
    inside[stops] = False
    body[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    left = np.repeat(stops, sizes + 1) - np.arange(n)  # bytes to the end of the text
    # ranks of all suffixes by their first 7, 14, 28 ... bytes; separators are 0 and end the comparison
    padded = np.append(body, np.zeros(7, np.int64))
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for k in range(7):
        c = padded[k : n + k] * alive
        alive &= c > 0
        key = (key << 9) | c
    span, ranks = 7, []
    order = np.argsort(key, kind="stable")
    rank = _ranks(order, key)
    ranks.append((span, rank))
    longest = int(sizes.max(initial=0))
    tied = np.flatnonzero(_repeated(rank))
    while span < longest and len(tied):
        further = np.where(left > span, np.append(rank, np.zeros(span, np.int64))[span : n + span] + 1, 0)
        # only suffixes that are still equal to another are sorted on
        both = (rank[tied] << 32) | further[tied]
        by = np.argsort(both, kind="stable")
        s, sorted_both = tied[by], both[by]
        fresh = rank.copy()
        group = np.ones(len(s), bool)
        group[1:] = (sorted_both[1:] >> 32) != (sorted_both[:-1] >> 32)
        change = np.ones(len(s), bool)
        change[1:] = sorted_both[1:] != sorted_both[:-1]
        at = np.arange(len(s))
        start = np.maximum.accumulate(np.where(group, at, 0))
        lead = np.maximum.accumulate(np.where(change, at, 0))
        fresh[s] = rank[s] + (lead - start)
        rank = fresh
        span *= 2
        ranks.append((span, rank))
        same = np.zeros(len(s), bool)
        same[1:] |= ~change[1:]
        same[:-1] |= ~change[1:]
        tied = np.sort(s[same])
    suffix = np.lexsort((np.arange(n), rank)) if len(tied) else _from_rank(rank)
    bwt = np.where(suffix > 0, body[suffix - 1], 0)
    # separators all differ, so none of them continues a run
    starts = np.flatnonzero(np.append(True, (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)))
    heads = suffix[starts]  # sampled first position of each run, with the suffix before it
    lcp = np.zeros(len(starts), np.int64)
    lcp[1:] = _common(heads[1:], suffix[starts[1:] - 1], ranks, body, left)
    tails = suffix[np.append(starts[1:], n) - 1]  # sampled last position of each run, with the suffix after it
    after = np.append(lcp[1:], 0)
    best = np.maximum(_stream(heads, lcp, n), _stream(tails, after, n))
    return np.minimum(best, left)[inside]


def _stream(samples: np.ndarray, lcp: np.ndarray, n: int) -> np.ndarray:
    """Match lengths of all text positions: that of the last sample, less the distance from it."""
    value = np.zeros(n, np.int64)
    value[samples] = lcp
    last = np.zeros(n, np.int64)
    last[samples] = samples
    np.maximum.accumulate(last, out=last)
    return np.maximum(value[last] - (np.arange(n) - last), 0)


def _ranks(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of each suffix the place of the first one with an equal key."""
    ordered = key[order]
    change = np.ones(len(order), bool)
    change[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))
    return rank


def _repeated(rank: np.ndarray) -> np.ndarray:
    return np.bincount(rank, minlength=len(rank))[rank] > 1


def _from_rank(rank: np.ndarray) -> np.ndarray:
    suffix = np.empty(len(rank), np.int64)
    suffix[rank] = np.arange(len(rank))
    return suffix


def _common(a: np.ndarray, b: np.ndarray, ranks: list[tuple[int, np.ndarray]], body: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Bytes that suffixes a and b have in common: ranks of halving spans, then single bytes."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    most = np.minimum(left[a], left[b])
    top, rank = ranks[-1]
    for span, rank in reversed(ranks):
        for _ in range(2 if span == top else 1):
            ok = (out + span <= most) & (rank[a] == rank[b])
            step = ok * span
            a, b, out = a + step, b + step, out + step
    for _ in range(7):
        ok = (out < most) & (body[np.minimum(a, len(body) - 1)] == body[np.minimum(b, len(body) - 1)])
        a, b, out = a + ok, b + ok, out + ok
    return out


def _index(length: int, buckets: int):
    """Rows of one anchor part follow each other. Gives (key, digest, start, end) of repeated bytes of contexts that stand
    once; for divided anchors also, packed by bucket of their hash, the windows that nothing has matched yet and those
    that are known to repeat."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        anchor, part, parts, n, lo = (table.column(k).to_numpy() for k in ("anchor", "part", "parts", "n", "lo"))
        keys = np.stack([table.column(k).to_numpy() for k in KEY])
        again = np.zeros(len(anchor), bool)  # the same context of the same text, which rows that are equal send
        again[1:] = (anchor[1:] == anchor[:-1]) & (part[1:] == part[:-1]) & (keys[:, 1:] == keys[:, :-1]).all(0) & (lo[1:] == lo[:-1])
        kept = np.flatnonzero(~again)
        texts = table.column("context").combine_chunks().take(pa.array(kept)).to_pylist()
        match = run_length_matches(texts)
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        rows, starts, ends, known, loose = [], [], [], [], []
        for k, text, at in zip(kept.tolist(), texts, base[:-1].tolist(), strict=True):
            w = len(text) - length + 1
            hit = match[at : at + w] >= length
            if n[k] == 1:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                rows.append(np.full(len(edge) // 2, k))
                starts.append(lo[k] + edge[::2])
                ends.append(lo[k] + edge[1::2] - 1 + length)
            else:  # repeated whole, as its count says
                hit[:] = True
            if parts[k] > 1:
                p = np.arange(w)
                sums, down = prefix_hash(np.frombuffer(text, np.uint8))
                h = mix(span_hash(sums, down, p, p + length) ^ U64(anchor[k] & 0x7FFFFFFFFFFFFFFF))
                known.append(h[hit])
                loose.append((h[~hit], np.full(w - int(hit.sum()), k), lo[k] + p[~hit]))
        rows, starts, ends = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (rows, starts, ends))
        packed, blobs = np.empty(0, np.int64), []
        if loose:  # windows that are known here may stand unmatched in another part
            h = np.unique(np.concatenate(known))
            loose.append((h, np.zeros(len(h), np.int64), np.full(len(h), -1)))
            h, row, start = (np.concatenate([x[k] for x in loose]) for k in range(3))
            bucket = (h % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            packed = bucket[order][cuts]
            whole = np.stack([h.view(np.int64), *keys[:, row], start.astype(np.int64)])[:, order]
            blobs = [whole[:, a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        none = pa.nulls(len(blobs), pa.int64())
        columns = [pa.concat_arrays([pa.array(x), none]) for x in (*keys[:, rows], starts, ends)]
        columns += [pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(packed)]), pa.concat_arrays([pa.nulls(len(rows), pa.binary()), pa.array(blobs, pa.binary())])]
        return pa.RecordBatch.from_arrays(columns, [*KEY, "start", "end", "bucket", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "context", INDEX_BYTES):
                if not batch.num_rows:
                    continue
                held.append(batch)
                size += batch.column("context").nbytes
                if size >= INDEX_BYTES:
                    table = pa.Table.from_batches(held)
                    anchor, part = table.column("anchor").to_numpy(), table.column("part").to_numpy()
                    other = np.flatnonzero((anchor != anchor[-1]) | (part != part[-1]))
                    cut = int(other[-1]) + 1 if len(other) else 0
                    if cut:
                        yield flush(table.slice(0, cut))
                        held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(b.column("context").nbytes for b in held)
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _across(length: int):
    """The loose windows whose hash some other part has too. Rows come sorted by bucket."""

    def matched(blobs: list[bytes]) -> pa.RecordBatch:
        h, key, digest, start = np.concatenate([np.frombuffer(b, np.int64).reshape(4, -1) for b in blobs], axis=1)
        _, of, count = np.unique(h, return_inverse=True, return_counts=True)
        k = np.flatnonzero((count[of] > 1) & (start >= 0))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[k], digest[k], start[k], start[k] + length)], [*KEY, "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                if bucket != now and held:
                    yield matched(held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield matched(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's sorted spans with overlapping ones made one."""
    for batch in batches:
        lists = batch.column("s")
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        start, end = (lists.flatten().field(k).to_numpy() for k in range(2))
        # a span that begins after all before it have ended opens a new one
        far = np.maximum.accumulate(end + row * (1 << 32)) - row * (1 << 32) if len(row) else end
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > far[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(row))[: len(at)] - 1
        spans = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(far[last])], ["start", "end"])
        bounds = np.searchsorted(row[at], np.arange(len(lists) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.ListArray.from_arrays(pa.array(bounds), spans), batch.column("n_candidates")], [*KEY, "spans", "n_candidates"])


def _spans(texts: DataFrame, length: int, per_index: int) -> DataFrame:
    """(key, digest, spans, n_candidates) of the texts(key, digest, text) with runs whose anchor stands elsewhere too."""
    spark = texts.sparkSession
    small_batches(spark)
    texts = texts.where(F.octet_length("text") >= length)
    runs = placed(texts.mapInArrow(tidy(_anchors(length, min(GRAM, length))), RUNS))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = factored(runs, texts, _contexts(length), _index(length, buckets), "key long, digest long, start long, end long, bucket long, windows binary", per_index)
    found = saved(found, "repeats")
    loose = found.where("bucket is not null").select("bucket", "windows").repartition("bucket").sortWithinPartitions("bucket")
    across = loose.mapInArrow(tidy(_across(length)), "key long, digest long, start long, end long")
    whole = runs.select(*KEY, "lo", F.when(F.col("n") > 1, F.struct(F.col("lo").cast("long").alias("start"), (F.col("hi") + length).cast("long").alias("end"))).alias("span"))
    parts = found.where("bucket is null").select(*KEY, "start", "end").unionByName(across).select(*KEY, F.struct("start", "end").alias("span"))
    spans = whole.unionByName(parts, allowMissingColumns=True)
    ordered = spans.groupBy(*KEY).agg(F.sort_array(F.collect_set("span")).alias("s"), F.size(F.collect_set("lo")).cast("long").alias("n_candidates"))
    return ordered.mapInArrow(_merged, "key long, digest long, spans array<struct<start:long,end:long>>, n_candidates long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_index: int = PER_INDEX) -> DataFrame:
    """(doc_id, digest, spans): of each text with bytes inside a repeated string, its merged spans (start, end) in bytes.

    A string of length bytes is repeated if it starts at another place too, in the same document or another one;
    strings end with their document. Texts that are null, empty or shorter have none. Each row is a document of its
    own, whether its id is null or shared; rows with one id and one text, which repeat each other, give one row.
    digest is the hash of the text and of whether there is an id, which tells rows that share an id apart; rows without
    an id have doc_id 0.
    """
    found = _spans(keyed(docs, id_col, text_col), length, per_index).where(F.size("spans") > 0)
    return found.select(F.col("key").alias("doc_id"), "digest", "spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            kept, removed = [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, spans = text or b"", spans or []
                at, out = 0, []
                for s in spans:
                    out.append(text[at : s["start"]])
                    at = s["end"]
                out.append(text[at:])
                kept.append(b"".join(out))
                removed.append(sum(s["end"] - s["start"] for s in spans))
            names = [x for x in batch.schema.names if x not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(kept, pa.binary()), pa.array(removed, pa.int64())], [*names, "kept", "n_removed"])


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same, as text: the pieces of a character that is cut go too."""
    for batch in _cut(batches):
        text = pa.array([x.decode(errors="ignore") for x in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("rest"), text], ["rest", "text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_index: int = PER_INDEX) -> DataFrame:
    """Each row of docs as (doc_id, n_bytes, n_removed, n_spans, n_candidates, kept): kept has the bytes that no repeat covers.

    n_candidates counts the runs of windows whose anchor stands at another place too, each of which the indexes decide.
    Null texts are empty. One row comes back for each row of docs, with its own text, also if ids are null or shared.
    An empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    texts = keyed(docs, id_col, text_col, F.col(id_col).cast("long").alias("doc_id"))
    both = texts.join(_spans(texts.select(*KEY, "text"), length, per_index), KEY, "left")
    zero = F.lit(0).cast("long")
    both = both.select(
        "doc_id", F.coalesce(F.octet_length("text"), zero).cast("long").alias("n_bytes"), F.greatest(F.coalesce(F.size("spans"), zero), zero).cast("long").alias("n_spans"),
        F.coalesce("n_candidates", zero).alias("n_candidates"), "text", "spans",
    )
    made = both.mapInArrow(tidy(_cut), "doc_id long, n_bytes long, n_spans long, n_candidates long, kept binary, n_removed long")
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "n_candidates", "kept")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_index: int = PER_INDEX) -> DataFrame:
    """The rows of docs with all columns, their text without repeated strings; a character that is cut goes whole.

    Null texts become empty. Rows, null or shared ids and empty tables are treated as by without_repeats().
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    texts = keyed(docs, id_col, text_col, rest.alias("rest"))
    both = texts.join(_spans(texts.select(*KEY, "text"), length, per_index), KEY, "left")
    cut = both.select("rest", "text", "spans").mapInArrow(tidy(_cut_text), StructType([texts.schema["rest"], StructField("text", StringType())]))
    return cut.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
