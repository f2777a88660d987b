"""Centroid clustering, periodic runs and word-window dedup against brute force, with nulls, ties, repeats and odd columns."""

import hashlib
import math
import random

import numpy as np
import pytest
import pytest

from quotalab.llm import anchored
from quotalab.llm.centroids import cluster_vectors, clustered, nearest
from quotalab.llm.periodic_runs import find_runs, periodic_runs
from quotalab.llm.relative_lz import without_windows

NARROW_SCHEMA = "vec_id long, embedding array<double>, v string, wide int, cluster string, `ve.c` int"


def plain_clusters(rows, k=8, rounds=10):
    """(vec_id, cluster, distance) of the kept rows and the centroids, in Python integers."""
    kept = [(i, [int(x) * 1024 if abs(x) > 2**53 else math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[v for _, v in kept if near(v)[1] == n] for n in range(len(centroids))]
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(own, centroids, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in rows], NARROW_SCHEMA)


def test_clusters_equal_plain_ones(spark):
    r = random.Random(5)
    rows = [(k, [r.uniform(-1, 1) + (k % 5) * (d < 9) for d in range(64)]) for k in range(150)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[8][1]), (400, None), (401, [0.5] * 63), (402, [0.5] * 65), (403, []), (404, [0.1] * 63 + [None])]
    rows += [(405, [float("nan")] + [0.0] * 63), (406, [math.inf] + [0.0] * 63), (407, [-0.0004] * 64)]
    want, centroids = plain_clusters(rows)
    got, found = cluster_vectors(vector_rows(spark, rows).repartition(5))
    as_text = lambda rows: sorted(map(str, rows))
    assert found == centroids and as_text(map(tuple, got.collect())) == as_text(want)
    out = clustered(vector_rows(spark, rows)).collect()
    assert len(out) == len(want) and {x["inertia"] for x in out} == {sum(d for _, _, d in want)}
    for x in out:
        assert x["cluster_inertia"] == sum(d for _, c, d in want if c == x["cluster"])
        assert x["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[x["cluster"]])).encode()).hexdigest()


def test_clusters_of_few_equal_and_huge_vectors(spark):
    same = [(k, [0.25] * 64) for k in range(20)]
    assert {tuple(x)[1:] for x in cluster_vectors(vector_rows(spark, same))[0].collect()} == {(0, 0)}  # ties: the smaller number
    assert clustered(vector_rows(spark, same[:3])).count() == 3
    assert clustered(vector_rows(spark, same).limit(0)).count() == 0
    huge = [(k, [float(k)] * 64) for k in range(12)] + [(50, [3e38] * 64), (51, [-1e300] + [0.0] * 63), (52, [2.0**20 + 0.3] * 64)]
    want, centroids = plain_clusters(huge)
    got, found = cluster_vectors(vector_rows(spark, huge))
    assert found == centroids
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, c, d if d < 2**63 else None) for i, c, d in want), key=str)
    assert clustered(vector_rows(spark, huge)).count() == len(huge)


def test_nearest_keeps_the_first_of_equal_centroids():
    r = np.random.default_rng(1)
    x, c = r.integers(-3, 4, (500, 64)), r.integers(-3, 4, (8, 64))
    c[5] = c[2]
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    for order in (np.arange(64), r.permutation(64)):
        cluster, best = nearest(x, c, order)
        assert (cluster == d.argmin(1)).all() and (best == d.min(1)).all()


def plain_runs(w):
    """(start, length, period) of all runs, shift by shift."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(24, 3 * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic_texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        few = r.choice([1, 2, 3, 40])
        some = lambda most: ["w%d" % r.randrange(few) for _ in range(r.randrange(most))]
        part = some(15) or ["é"]
        yield some(120) + (part * 60)[: r.randrange(140)] + some(20) + (part * 9)[: r.randrange(100)]


def test_runs_equal_brute_force():
    texts = list(periodic_texts(3, 300)) + [[], ["a"] * 23, ["a"] * 24, ["a"] * 25, ["a", "b"] * 12]
    ids = np.array([hash(x) & (2**63 - 1) for t in texts for x in t], np.uint64)
    got = {}
    for t, *run in find_runs(ids, np.concatenate([[0], np.cumsum([len(t) for t in texts])])).tolist():
        got.setdefault(t, []).append(tuple(run))
    assert [got.get(k, []) for k in range(len(texts))] == [plain_runs(t) for t in texts]


def test_runs_where_hashes_collide():
    # the Thue-Morse word defeats polynomial hashes modulo powers of two; it has no cubes
    word = [bin(k).count("1") % 2 for k in range(1 << 14)]
    ids = np.array(word * 3, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert find_runs(ids, np.array([0, 3 << 14])).tolist() == [[0, 0, 3 << 14, 1 << 14]]
    assert not len(find_runs(ids[: 1 << 14], np.array([0, 1 << 14])))


def test_runs_of_rows(spark):
    texts = [(k, " \n".join(t)) for k, t in enumerate(periodic_texts(8, 60))] + [(None, "x " * 30), (7, "y  z\t" * 20), (7, "y  z\t" * 20), (90, None), (91, ""), (92, " \n")]
    docs = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in texts], "doc_id long, text string, n_words int, runs int, `collapsed` string")
    want = []
    for i, t in texts:
        w = (t or "").split()
        runs = plain_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append(str((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [str((x["doc_id"], x["n_words"], [tuple(y) for y in x["runs"]], x["collapsed"])) for x in periodic_runs(docs).collect()]
    assert sorted(got) == sorted(want)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_a_long_text_with_runs(spark):
    r = random.Random(2)
    w = ["w%d" % r.randrange(10**9) for _ in range(300_000)]
    w[1000:251_000] = (w[1000:51_000] * 5)[:250_000]
    w[260_000:260_100] = ["a"] * 100
    row = periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert [tuple(x) for x in row["runs"]] == [(1000, 250_000, 50_000), (260_000, 100, 1)]
    assert row["collapsed"] == " ".join(w[:51_000] + w[251_000:260_001] + w[260_100:])


def plain_windows(rows, length):
    """(id, words, removed, kept) of each row: windows that start earlier, text by text in the order of the ids."""
    digest = {}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen = set()
    for i, t in order:
        w, hit = t.split(), set()
        for p in range(len(w) - length + 1):
            if (x := tuple(w[p : p + length])) in seen:
                hit.update(range(p, p + length))
            seen.add(x)
        digest[i, t] = (len(w), len(hit), " ".join(x for k, x in enumerate(w) if k not in hit))
    return [(i, *digest.get((i, t), (0, 0, ""))) for i, t in rows]


def windowed_texts(seed, n=80):
    r = random.Random(seed)
    few = ["w%d" % k for k in range(12)] + ["É", "日本"]
    passages = [[r.choice(few) for _ in range(r.randrange(4, 40))] for _ in range(8)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(r.randrange(6)):
            w += r.choice(passages) if r.random() < 0.5 else [r.choice([*few, "x%d" % r.randrange(10**6)]) for _ in range(r.randrange(12))]
        texts.append(w)
    texts += [passages[0] * 6, ["a"] * 70, ["a", "b"] * 30, [], texts[3], texts[3]]
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


@pytest.mark.parametrize("length,gram,per_block,hot", [(6, 3, 2048, 1), (6, 2, 3, 1000), (12, 4, 2, 1), (20, 6, 2048, 30), (5, 5, 1, 1)])
def test_windows_equal_brute_force(spark, monkeypatch, length, gram, per_block, hot):
    monkeypatch.setattr(anchored, "HOT_SHARE", hot)
    rows = windowed_texts(length) + [(2000, None), (2001, " \n"), (2002, "b  a\t" * 20)]
    rows += [rows[5], rows[5], (None, "one more " * 12), (None, "one more " * 12)]
    docs = spark.createDataFrame([(i, t, 1, 2, "c", 3) for i, t in rows], "doc_id long, text string, key int, digest int, spans string, `first` int").repartition(7)
    got = [tuple(x) for x in without_windows(docs, length=length, gram=gram, per_block=per_block).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_windows(rows, length)))
    assert without_windows(docs.limit(0)).count() == 0


def test_windows_of_rows_that_share_an_id(spark):
    one, two = " ".join(f"p{k}" for k in range(30)), " ".join(f"p{k}" for k in range(40))
    rows = [(1, one), (1, two), (2, two + " tail")]
    got = sorted(map(tuple, without_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    # of the two texts of id 1 one is the earlier; what they have in common stays once
    assert sorted(x[2] for x in got) == [0, 30, 40]
    assert got[-1] == (2, 41, 40, "tail")


def test_a_hot_passage_and_a_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(anchored, "HOT_SHARE", 20)  # a twentieth of all runs
    r = random.Random(4)
    word = lambda: "w%d" % r.randrange(10**6)
    passage, phrase = [word() for _ in range(26)], ["a"] * 8
    rows = [(k, " ".join([word() for _ in range(9)] + passage + [word() for _ in range(9)] + phrase + [r.choice("bc") for _ in range(14)])) for k in range(200)]
    rows += [(500 + k, rows[7][1]) for k in range(100)]
    for per_block in (2048, 9):
        got = [tuple(x) for x in without_windows(spark.createDataFrame(rows, "doc_id long, text string"), per_block=per_block).collect()]
        assert sorted(got) == sorted(plain_windows(rows, 20))


def test_a_long_text_with_windows(spark):
    r = random.Random(3)
    w = ["w%d" % r.randrange(10**9) for _ in range(400_000)]
    w[300_000:350_000] = w[100_000:150_000]
    rows = without_windows(spark.createDataFrame([(2, " ".join(w)), (1, " ".join(w[:1000]))], "doc_id long, text string")).collect()
    got = {x["doc_id"]: x for x in rows}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 51_000 and got[2]["kept"] == " ".join(w[1000:300_000] + w[350_000:])
