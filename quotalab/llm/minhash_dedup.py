"""MinHash near-duplicate groups with tensored banding.

Documents with equal shingle sets are one node. Two small collections of hash groups, left and right, are computed for
each node; a table key is a pair of one left and one right group, so SIDE * SIDE tables cost only 2 * SIDE * WIDTH
minhashes. The diagonal tables, left and right group of one number, are filled first and link most copies to the
smallest node under their key. The other tables are filled only for left groups whose nodes these links leave in
different components. Every candidate that is near enough by its signature is confirmed on the full shingle sets.

A pair at the least similarity shares no table key with a probability of 2 * (1 - 0.75 ** WIDTH) ** SIDE, 5 in 10 ** 9,
and has less than AGREE equal minhashes with one of 1 in 10 ** 8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import SPACE_WORDS, U64, lower_words, mix, shingles, slices, tidy
from .store import forget, saved, small_batches

WORDS = 5  # words in a shingle
PERCENT = 75  # least similarity of a link
SIDE = 24  # groups in each of the two collections
WIDTH = 2  # minhashes in a group
HASHES = 2 * SIDE * WIDTH
#: A pair at the least similarity agrees in 72 of 96 minhashes on average.
AGREE = 48
#: Documents under a left group that make one cell; more are a crowd, which is compared as pairs of blocks.
BLOCK = 512
#: A crowd has at most so many blocks, and so many copies of a row, unless a block would hold more documents or text.
BLOCKS = 16
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
FOUND = 1 << 20  # pairs that a comparing task holds at once
#: A class of equal sets with more than this share of all rows is large: at most as many are, small enough to broadcast.
HOT_SHARE = 1000
HELD_BYTES = 16 << 20  # text that a comparing task gathers before it looks for whole cells

_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=U64)) | U64(1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            n = batch.num_rows
            hashes, rows = shingles(lower_words(batch.column("text"), SPACE_WORDS), n, WORDS)
            sizes, low, high = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
            mins = np.zeros((HASHES, n), U64)
            if len(hashes):
                full, starts = np.unique(rows, return_index=True)
                for r, a, b in zip(full, starts, [*starts[1:], len(rows)], strict=True):
                    own = np.unique(hashes[a:b])
                    sizes[r], low[r], high[r] = len(own), own.sum(dtype=U64), np.bitwise_xor.reduce(mix(own))
                for k in range(HASHES):
                    mins[k, full] = np.minimum.reduceat(mix_light(hashes, _MULTIPLIERS[k]), starts)
            groups = mins.reshape(2 * SIDE, WIDTH, n)
            acc = np.broadcast_to(np.arange(2 * SIDE, dtype=U64)[:, None], (2 * SIDE, n))
            for k in range(WIDTH):
                acc = mix(acc * U64(0x2545F4914F6CDD1D) + groups[:, k])
            keys = np.ascontiguousarray(acc.T).view(np.int64)
            sig = np.ascontiguousarray((mins.T >> U64(40)).astype(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("digest"),
                    pa.array(sizes),
                    pa.array(low.view(np.int64)),
                    pa.array(high.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * SIDE * n + 1, 2 * SIDE, dtype=np.int32)), pa.array(keys.ravel())),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * HASHES), n, [None, pa.py_buffer(sig)]).cast(pa.binary()),
                ],
                ["doc_id", "digest", "n_shingles", "low", "high", "groups", "sig"],
            )


def mix_light(x: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    """One of the family of hash functions over hashes that are already mixed."""
    y = x * multiplier
    return (y ^ (y >> U64(29))) * multiplier


def _rows(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint16).reshape(len(column), HASHES)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough and whose set sizes allow the similarity."""
    for batch in batches:
        if batch.num_rows:
            agree = (_rows(batch.column("sig_a")) == _rows(batch.column("sig_b"))).sum(1)
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            ok = (agree >= AGREE) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that reach the similarity on their full shingle sets."""
    for whole in batches:
        for batch in slices(whole, "text_b"):
            n = batch.num_rows
            ok = np.zeros(n, bool)
            texts = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]).dictionary_encode()
            of = texts.indices.to_numpy()
            hashes, rows = shingles(lower_words(texts.dictionary, SPACE_WORDS), len(texts.dictionary), WORDS)
            bounds = np.searchsorted(rows, np.arange(len(texts.dictionary) + 1))
            sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i in range(n):
                x, y = sets[of[i]], sets[of[n + i]]
                ok[i] = _similar(x, y)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs(a, b) that are links."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(tidy(_near), "a long, b long")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return saved(both.mapInArrow(tidy(_confirm), "a long, b long").distinct(), "near-links")


class _Roots(dict):
    """Components that links inside a cell have joined."""

    def of(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components inside one cell. Rows come sorted by cell; a cell is bounded.

    A pair under several keys is compared once, in the cell of the first left group that it shares, and in the crowds
    that hold both; the pairs of a cell go by the agreement of their signatures, and those that links of the cell have
    joined by then need no comparison. Near pairs are confirmed on their shingle sets here, so that only links leave
    the task.
    """
    held: list[pa.RecordBatch] = []

    def links(table: pa.Table) -> pa.RecordBatch:
        cell, ids, comp, n, slot = (table.column(x).to_numpy() for x in ("cell", "doc_id", "component", "n_shingles", "slot"))
        sig = _rows(table.column("sig").combine_chunks())
        groups = table.column("groups").combine_chunks().flatten().to_numpy().reshape(-1, 2 * SIDE)
        low, high = (table.column(x).to_numpy(zero_copy_only=False) for x in ("lower", "upper"))
        texts = table.column("text").combine_chunks()
        cuts = np.flatnonzero(np.diff(cell)) + 1
        a, b = [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(cell)], strict=True):
            if comp[lo:hi].min() == comp[lo:hi].max():
                continue
            lowers, uppers = np.flatnonzero(low[lo:hi]) + lo, np.flatnonzero(high[lo:hi]) + lo
            roots, sets = _Roots(), {}

            def set_of(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = np.unique(shingles(lower_words(texts.slice(k, 1), SPACE_WORDS), 1, WORDS)[0])
                return sets[k]

            step = max(1, FOUND // max(len(uppers), 1))
            for at in range(0, len(lowers), step):
                found = []
                for i in lowers[at : at + step]:
                    # in a block with itself each pair is seen from its smaller id
                    other = uppers[(comp[uppers] != comp[i]) & (100 * np.minimum(n[uppers], n[i]) >= PERCENT * np.maximum(n[uppers], n[i])) & (~(low[uppers] & high[i]) | (ids[uppers] > ids[i]))]
                    agree = (sig[other] == sig[i]).sum(1)
                    other, agree = other[agree >= AGREE], agree[agree >= AGREE]
                    same = groups[other] == groups[i]
                    left, right = same[:, :SIDE], same[:, SIDE:]
                    ok = (left.any(1) if slot[i] < 0 else left.argmax(1) == slot[i]) & right.any(1)
                    found.append(np.stack([-agree[ok], np.full(int(ok.sum()), i), other[ok]]))
                found = np.concatenate(found, axis=1)
                for _, i, k in found[:, np.lexsort(found)].T.tolist():
                    c, d = roots.of(int(comp[i])), roots.of(int(comp[k]))
                    if c != d and _similar(set_of(i), set_of(k)):
                        roots[max(c, d)] = min(c, d)
                        a.append(min(ids[i], ids[k]))
                        b.append(max(ids[i], ids[k]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for whole in batches:
        for batch in slices(whole, "text", HELD_BYTES):
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= 20_000 or sum(x.column("text").nbytes for x in held) >= HELD_BYTES:
                table = pa.Table.from_batches(held)
                cell = table.column("cell").to_numpy()
                other = np.flatnonzero(cell != cell[-1])
                if len(other):
                    last = int(other[-1]) + 1
                    yield links(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield links(pa.Table.from_batches(held))


def _spanning(rows: DataFrame) -> DataFrame:
    """The rows under keys that still hold more than one component, with the number of documents under the key."""
    keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    return rows.join(keys, "key")


def _crowds(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The documents under the crowded keys of rows as crowds (key, doc_id, component, nb blocks), each once in a crowd.

    Texts that are alike, near copies or holders of one passage, meet under many left groups. The keys of which one
    document is the busiest, the one under most crowded keys, are one crowd: at most SIDE of them, as it has SIDE keys.
    A crowd holds all documents under its keys, so no pair is lost.
    """
    busy = rows.groupBy("doc_id").agg(F.count("*").alias("keys"))
    heads = rows.join(busy, "doc_id").groupBy("key").agg(F.max(F.struct("keys", "doc_id")).alias("head"))
    crowds = rows.join(heads, "key").select(F.col("head.doc_id").alias("key"), "doc_id", "component").distinct()
    sizes = crowds.join(texts.select("doc_id", "bytes"), "doc_id").groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    # few blocks, so that the copies of a row do not grow with its crowd; more of them only to bound the memory of a task
    blocks = F.greatest(F.least(F.ceil(F.col("n") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES))
    return crowds.join(sizes.select("key", blocks.cast("int").alias("nb")), "key")


def _rest(lefts: DataFrame, reps: DataFrame, texts: DataFrame, comps: DataFrame) -> DataFrame:
    """Links of all tables that the diagonal ones leave open: pairs of different components under one key.

    Documents meet under their left groups; those of a pair that share a right group too are under one table's key.
    Left groups with more than BLOCK documents are put together as crowds and compared as pairs of blocks, each its
    own cell. Nothing is left out.
    """
    own = lefts.join(comps, lefts.doc_id == comps.node, "left").select("key", "slot", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    rows = saved(_spanning(own), "spanning")
    few = rows.where(F.col("n") <= BLOCK).select("key", "slot", "doc_id", "component", F.lit(1).alias("nb"))
    crowds = _crowds(rows.where(F.col("n") > BLOCK), texts).select("key", F.lit(-1).alias("slot"), "doc_id", "component", "nb")
    met = few.unionByName(crowds)
    own_block = F.pmod(F.xxhash64("doc_id"), "nb").cast("int")
    # a row goes to the cells of its block with every block; there the lower block's rows meet the upper one's
    cells = met.withColumn("own", own_block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = cells.select(
        F.xxhash64("key", "slot", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "slot", "doc_id", "component",
        (F.col("own") <= F.col("other")).alias("lower"), (F.col("own") >= F.col("other")).alias("upper"),
    )
    cells = cells.join(reps.select("doc_id", "n_shingles", "sig", "groups"), "doc_id").join(texts.select("doc_id", "text"), "doc_id")
    links = saved(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(_compare), "a long, b long"), "rest-links")
    forget(rows)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Links documents whose sets of 5-word shingles (words without white space, A-Z lower-cased; fewer words make one
    shingle) have a Jaccard similarity of at least 0.75; component_id is the smallest id reachable. Texts that are
    null, empty or without words have no shingles and link with nothing: component_id is their own id. Rows without
    an id are returned, unlinked, with a null component_id and kept true. Rows that share an id are documents of
    their own, told apart by their texts. An empty table gives an empty one. Other columns are ignored, whatever
    their names.
    """
    return _groups(docs, id_col, text_col).drop("digest")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates() with digest, the xxhash64 of the text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    sk = saved(texts.mapInArrow(tidy(_sketch), "doc_id long, digest long, n_shingles long, low long, high long, groups array<long>, sig binary"), "sketches")
    same = ["low", "high", "n_shingles"]
    # a node for each distinct set, numbered once and written; its rows all have the same groups, and any text will do
    classes = sk.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "digest")).alias("r"), F.count("*").alias("n"))
    classes = saved(classes.select(*same, "n", F.col("r.doc_id").alias("rep"), F.col("r.digest").alias("digest"), F.monotonically_increasing_id().alias("node")), "classes")
    own = classes.select(F.col("rep").alias("doc_id"), "digest", "node")
    heads = saved(sk.join(own, ["doc_id", "digest"]).select("node", "n_shingles", "groups", "sig").dropDuplicates(["node"]), "heads")

    # nodes that share a left group with another one; all others are alone under every key
    each = heads.select("node", F.posexplode(F.slice("groups", 1, SIDE)).alias("slot", "g")).select(F.col("node").alias("doc_id"), "slot", F.xxhash64("slot", "g").alias("key"))
    common = each.groupBy("key").count().where("count > 1").select("key")
    lefts = saved(each.join(common, "key").select("key", "slot", "doc_id"), "lefts")
    reps = saved(heads.withColumnRenamed("node", "doc_id").join(lefts.select("doc_id").distinct(), "doc_id", "left_semi"), "reps")
    forget(heads)
    wanted = own.join(reps.select(F.col("doc_id").alias("node")), "node", "left_semi")
    needed = saved(texts.join(wanted, ["doc_id", "digest"]).select(F.col("node").alias("doc_id"), "text", F.octet_length("text").alias("bytes")).dropDuplicates(["doc_id"]), "near-texts")

    # the diagonal tables: each node against the smallest one under any of its keys; then, for keys that these links
    # leave divided, against one smallest node of each other component
    diagonal = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.xxhash64(i, F.get("groups", i), F.get("groups", i + SIDE)))
    tables = reps.select("doc_id", F.explode(diagonal).alias("key"))
    hubs = tables.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    stars = saved(tables.join(hubs, "key").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct(), "stars")
    links = _links(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), reps, needed)
    comps = saved(components(links), "components")
    side = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    open_ = stars.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({f"c_{x}": F.coalesce(f"c_{x}", x) for x in "ab"})
    open_ = open_.where("c_a <> c_b").groupBy("b", "c_a").agg(F.min("a").alias("a")).select("a", "b")
    comps = _joined(comps, _links(open_, reps, needed))
    # all tables: what these links leave open
    comps = _joined(comps, _rest(lefts, reps, needed, comps))
    for table in (lefts, reps, needed, stars):
        forget(table)

    # rows to their node, nodes to the smallest id of their component; large classes are joined apart, so that none meets
    # in one task, and rows without shingles, which are all alone, not at all
    linked = classes.join(comps, "node").select(*same, "component", "rep")
    least = linked.groupBy("component").agg(F.min("rep").alias("root"))
    roots = classes.where("n > 1").select(*same, "n", "rep").join(linked.join(least, "component").select(*same, "root"), same, "full")
    roots = saved(roots.select(*same, F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("root", "rep").alias("root")), "roots")
    hot = F.col("n") * HOT_SHARE > sk.count()
    large = F.broadcast(roots.where(hot).select(*same, F.col("root").alias("large")))
    rows = sk.select("doc_id", "digest", *same).where("n_shingles > 0").join(large, same, "left")
    rest = rows.where("large is null").drop("large").join(roots.where(~hot).drop("n"), same, "left")
    alone = sk.where("n_shingles = 0").select("doc_id", "digest", "n_shingles", F.lit(None).cast("long").alias("root"))
    every = rest.drop("low", "high").unionByName(rows.where("large is not null").select("doc_id", "digest", "n_shingles", F.col("large").alias("root"))).unionByName(alone)
    out = every.select("doc_id", "digest", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components once more links are there: those found so far count as links to their smallest node."""
    if links.isEmpty():
        return comps
    return saved(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "components")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one document of each near-duplicate group stays: that of smallest id.

    Rows that share an id are judged by their own texts; of rows with one id and one text any one stays. Null texts
    and rows without an id are linked with nothing and stay. An empty table gives an empty one. Columns come through,
    whatever their names.
    """
    gone = _groups(docs, id_col, text_col).where(~F.col("kept")).select("doc_id", "digest").distinct()
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), whole)
    rows = rows.withColumn("own", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    rows = rows.join(gone, ["doc_id", "digest"], "left_anti").dropDuplicates(["doc_id", "digest", "own"])
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
