"""Centroid clustering of integer vectors by partial-distance search.

Dimensions are visited in the order of their variance, the largest first. A vector's squared distance to its best
centroid so far is the bound: a centroid that is strictly above it after a few dimensions is abandoned, and only
survivors add up all dimensions. Sums are exact integers; each round ships one sum for each centroid, dimension and task.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import tidy
from .store import saved, small_batches

DIMS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SALT = "3:"  # stands before an id in the hash that orders the first centroids
STEP = 8  # dimensions that are added before centroids are abandoned again
#: Integers below this size have distances of 64 bits; a vector with larger ones is kept as decimal text in `wide`.
NARROW = 1 << 27
_LIMB = 60  # bits of a part of a sum, so that the parts of all tasks add up without overflow


def _integer(x: float, scale: int) -> int:
    """floor(scale * x), where the product may be beyond a double too."""
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def _integers(dims: int, scale: int):
    """(vec_id, v, wide) of the vectors that are kept; v of a wide one is zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            row = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
            flat = column.take(pa.array(row)).flatten().fill_null(float("nan"))
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            finite = np.isfinite(x).all(1)
            x, row = x[finite], row[finite]
            wide = ~(np.abs(x) < NARROW / scale).all(1)
            far = [[str(_integer(c, scale)) for c in x[i].tolist()] if wide[i] else None for i in range(len(x))] if wide.any() else pa.nulls(len(x))
            v = np.floor(np.where(wide[:, None], 0, x) * scale).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dims, dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), lists, pa.array(far, pa.list_(pa.string()))], ["vec_id", "v", "wide"])

    return run


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, its squared distance) of each row of integers; of equal ones the smaller number.

    Exact for int64 with entries below NARROW, and for Python integers of any size.
    """
    x, centroids = x[:, order], centroids[:, order]
    cluster, best = np.zeros(len(x), np.int32), ((x - centroids[0]) ** 2).sum(1)
    for c in range(1, len(centroids)):
        alive, partial = np.arange(len(x)), np.zeros(len(x), x.dtype)
        for at in range(0, x.shape[1], STEP):
            partial = partial + ((x[alive, at : at + STEP] - centroids[c, at : at + STEP]) ** 2).sum(1)
            on = partial <= best[alive]
            alive, partial = alive[on], partial[on]
        better = partial < best[alive]
        best[alive[better]], cluster[alive[better]] = partial[better], c
    return cluster, best


def _groups(batch: pa.RecordBatch, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, integers, centroids) of the batch: narrow vectors at once, wide ones as Python integers."""
    lists = batch.column("v")
    x = lists.flatten().to_numpy().astype(np.int64).reshape(len(lists), -1)
    wide = batch.column("wide").is_valid().to_numpy(zero_copy_only=False)
    fits = all(abs(c) < NARROW for one in centroids for c in one)
    if len(narrow := np.flatnonzero(~wide)):
        kind = np.int64 if fits else object
        yield narrow, x[narrow].astype(kind), np.array(centroids, kind)
    if len(far := np.flatnonzero(wide)):
        texts = batch.column("wide").take(pa.array(far)).to_pylist()
        yield far, np.array([[int(c) for c in one] for one in texts], object), np.array(centroids, object)


def _sums(centroids: list[list[int]], order: np.ndarray):
    """(cluster, dim, limb, part): what this task's vectors add to each centroid; dim -1 has their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            for _, x, own in _groups(batch, centroids):
                cluster, _ = nearest(x, own, order)
                for c in np.unique(cluster).tolist():
                    members = x[cluster == c]
                    total[c, -1] += len(members)
                    for d, s in enumerate(members.sum(0).tolist()):
                        total[c, d] += s
        rows = []
        for (c, d), s in total.items():
            limb = 0
            while not -(1 << _LIMB) < s < 1 << _LIMB:
                rows.append((c, d, limb, s & ((1 << _LIMB) - 1)))
                s, limb = s >> _LIMB, limb + 1
            rows.append((c, d, limb, s))
        names, kinds = ("cluster", "dim", "limb", "part"), (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    return run


def _assigned(centroids: list[list[int]], order: np.ndarray):
    """(vec_id, cluster, distance); a distance beyond 64 bits is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x, own in _groups(batch, centroids):
                cluster, distance = nearest(x, own, order)
                distance = [d if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), pa.array(cluster), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _moved(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """The centroids after a round: the floor of each component's mean, or the same where no vector is nearest.

    The driver gets a row for each centroid and dimension, whatever the number of vectors.
    """
    parts = vectors.mapInArrow(tidy(_sums(centroids, order)), "cluster int, dim int, limb int, part long")
    total: dict[tuple[int, int], int] = defaultdict(int)
    for row in parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        total[row["cluster"], row["dim"]] += int(row["part"]) << (_LIMB * row["limb"])
    return [[total[c, d] // n for d in range(len(own))] if (n := total.get((c, -1), 0)) else own for c, own in enumerate(centroids)]


def cluster_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT
) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of each vector that is kept, the final centroids).

    A vector is kept if it has exactly dims components, none of them null or non-finite; its components become
    floor(scale * x). Other rows give none. The first centroids are the k vectors of smallest sha256(salt || id), in
    this order; of equal ids the smaller vector, and vectors without an id come last. With fewer than k vectors each of
    them is a centroid; an empty table gives an empty one and no centroids. Repeated rows all count and come back. A
    distance that 64 bits cannot hold is null. Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    small_batches(spark)
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = saved(given.mapInArrow(tidy(_integers(dims, scale)), "vec_id long, v array<int>, wide array<string>"), "vectors")
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "v", "wide").limit(k).collect()
    centroids = [[int(c) for c in row["wide"] or row["v"]] for row in first]
    spread = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("var")).collect()
    order = np.array([row["dim"] for row in sorted(spread, key=lambda row: (-row["var"], row["dim"]))], np.int64)
    for _ in range(rounds if centroids else 0):
        centroids, before = _moved(vectors, centroids, order), centroids
        if centroids == before:  # every further round gives the same
            break
    return saved(vectors.mapInArrow(tidy(_assigned(centroids, order)), "vec_id long, cluster int, distance long"), "clusters"), centroids


def clustered(rows: DataFrame, **options) -> DataFrame:
    """cluster_vectors() with cluster_inertia, inertia (distances summed over the cluster and over all) and centroid_sha256.

    A sum with a distance that 64 bits cannot hold, or that is itself beyond them, is null.
    """
    out, centroids = cluster_vectors(rows, **options)
    spark = rows.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()) for c, own in enumerate(centroids)]
    digests = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"), (F.count("distance") < F.count("*")).alias("open"))
    every = sums.agg(F.sum("own").alias("all"), F.max("open").alias("any"))
    long = lambda x, y: F.expr(f"case when not {y} then try_cast({x} as bigint) end")
    stats = sums.crossJoin(every).join(digests, "cluster").select("cluster", long("own", "open").alias("cluster_inertia"), long("`all`", "`any`").alias("inertia"), "centroid_sha256")
    # a row for each centroid
    return out.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
