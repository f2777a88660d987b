"""Operators of the corpus pipeline against brute force on small fixtures with nulls, empty texts, ties and repeats."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotalab.llm import anchored, decontaminate, minhash_dedup, suffix_dedup
from quotalab.llm.anchored import keyed
from quotalab.llm.decontaminate import contamination, decontaminated, judged
from quotalab.llm.minhash_dedup import near_duplicates, without_copies
from quotalab.llm.quality_rules import cleaned, quality
from quotalab.llm.store import saved
from quotalab.llm.suffix_dedup import cut_repeats, repeated_spans, without_repeats

SCHEMA = "doc_id long, text string, source string, rest string, `key` string, component long"


def docs_of(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, source, "x", "k", 1) for i, t in texts], SCHEMA)


def random_texts(seed, n=60, vocabulary=30, words=60):
    r = random.Random(seed)
    own = ["w%d" % k for k in range(vocabulary)] + ["É", "ñandú", "日本"]
    texts = [" ".join(r.choices(own, k=r.randrange(0, words))) for _ in range(n)]
    for k in range(0, n, 5):  # near copies
        parts = texts[k].split()
        if parts:
            parts[r.randrange(len(parts))] = "changed"
            texts[(k + 3) % n] = " ".join(parts)
    texts[7] = texts[11]
    return [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "  \n ")]


@pytest.mark.parametrize("length,per_index,hot", [(12, 2048, 1000), (12, 3, 1), (30, 5, 30)])
def test_repeated_spans_equal_brute_force(spark, monkeypatch, length, per_index, hot):
    monkeypatch.setattr(anchored, "HOT_SHARE", hot)  # 1: no anchor is hot
    texts = random_texts(length)
    texts += [(950 + k, "common passage that all of them have " * 2 + str(k)) for k in range(9)] + [(990, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa")]
    seen = {}
    for i, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    hit = {}
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                hit.setdefault(i, set()).update(range(p, p + length))
    got = {}
    for r in repeated_spans(docs_of(spark, texts), length=length, per_index=per_index).collect():
        own = got.setdefault(r["doc_id"], set())
        for s in r["spans"]:
            assert not own & set(range(s["start"], s["end"]))
            own.update(range(s["start"], s["end"]))
    assert got == hit


def test_without_repeats_keeps_rows_and_columns(spark):
    docs = docs_of(spark, [(1, None), (2, "é" * 300 + "x"), (3, "é" * 300 + "y"), (None, "z")])
    rows = {r["doc_id"]: r for r in without_repeats(docs).collect()}
    assert len(rows) == 4 and rows[1]["n_bytes"] == 0 and rows[2]["kept"] == b"x" and rows[3]["n_spans"] == 1
    kept = cut_repeats(docs)
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == {1: "", 2: "x", 3: "y", None: "z"}
    assert without_repeats(docs.limit(0)).count() == 0 == cut_repeats(docs.limit(0)).count()


def test_rows_that_share_an_id_keep_their_own_text(spark):
    r = random.Random(4)
    text = lambda: " ".join("w%d" % r.randrange(10**6) for _ in range(120))
    x, y, z = text(), text(), text()
    rows = [(1, x), (1, y), (2, x), (1, "short"), (None, y[:100]), (None, z), (None, z), (0, z + " more"), (7, y[300:] + " tail")]
    docs = docs_of(spark, rows)
    got = sorted((str(i["doc_id"]), i["n_bytes"], i["kept"].decode()) for i in without_repeats(docs).collect())
    cut = lambda t: t.replace(y[300:], "") if y[300:] in t and len(y) - 300 >= 400 else t
    want = [(i, t, "" if t in (x, z) else " more" if t.startswith(z) else cut(t)) for i, t in rows]
    assert got == sorted((str(i), len(t), k) for i, t, k in want)
    assert sorted((str(i["doc_id"]), i["text"]) for i in cut_repeats(docs).collect()) == sorted((str(i), k) for i, _, k in want)


def test_candidates_are_counted(spark):
    r = random.Random(6)
    text = lambda n: " ".join("w%d" % r.randrange(10**6) for _ in range(n))
    shared = text(48)  # shorter than a window, long enough for common anchors
    docs = docs_of(spark, [(k, f"{text(60)} {shared} {text(60)}") for k in range(20)] + [(100 + k, text(150)) for k in range(20)] + [(200, None)])
    rows = {x["doc_id"]: x for x in without_repeats(docs).collect()}
    assert len(shared) < 400 and not any(x["n_removed"] for x in rows.values())
    assert sum(rows[k]["n_candidates"] > 0 for k in range(20)) > 10 and not any(rows[100 + k]["n_candidates"] for k in range(20)) and rows[200]["n_candidates"] == 0
    assert all(len(x["text"]) < 1500 for x in cut_repeats(docs, length=240).where("doc_id < 20").collect())


def test_long_texts_go_by_chunks():
    from quotalab.llm import suffix_dedup as S

    r = np.random.default_rng(2)
    sizes = [5, 900, 0, 400, 2500, 39, 40]
    data, offs = r.integers(97, 99, sum(sizes)).astype(np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    windows = lambda found: {(int(i), p): int(h) for row, lo, hi, h in found for i, a, b, h in zip(row, lo, hi, h) for p in range(a, b + 1)}
    whole = windows([S._window_anchors(data, offs, 40, 12)])
    assert len(whole) == sum(max(0, n - 39) for n in sizes)
    for chunk in (1, 7, 64, 1000):
        assert windows(S.chunked_anchors(data, offs, 40, 12, chunk)) == whole


@pytest.mark.parametrize("hot", [1, 1000])
def test_equal_texts_send_one_context(spark, monkeypatch, hot):
    monkeypatch.setattr(anchored, "HOT_SHARE", hot)
    r = random.Random(12)
    text = lambda n: " ".join("w%d" % r.randrange(10**6) for _ in range(n))
    page, tail = text(150), text(40)
    rows = [(k, page) for k in range(12_000)] + [(20_000 + k, page[:500] + text(100)) for k in range(30)] + [(30_000, tail)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    found = suffix_dedup.placed(keyed(docs, "doc_id", "text").mapInArrow(suffix_dedup._anchors(400, 48), anchored.RUNS))
    sent = found.where("first and m > 1").groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert sent is None or sent <= 31  # distinct contexts, not the 12,000 copies
    got = {x["doc_id"]: x["kept"].decode() for x in without_repeats(docs).collect()}
    assert not any(got[k] for k in range(12_000)) and got[30_000] == tail
    assert all(t[500:].endswith(got[i]) and len(t) - 510 < len(got[i]) for i, t in rows[12_000:12_030])  # by chance some go on alike


def test_a_common_passage_over_many_indexes_and_partitions(spark):
    r = random.Random(9)
    word = lambda: "w%d" % r.randrange(10**6)
    passage = " ".join(word() for _ in range(80))
    texts = [(k, " ".join([*(word() for _ in range(60)), passage, *(word() for _ in range(60))])) for k in range(300)] + [(900, passage[:399]), (901, passage[5:404])]
    texts += [(1000 + k, " ".join(word() for _ in range(150))) for k in range(50)]
    docs = docs_of(spark, texts).repartition(40)
    for per_index in (2048, 7):
        rows = {x["doc_id"]: x for x in without_repeats(docs, per_index=per_index).collect()}
        for i, t in texts[:300]:
            # by chance some neighbours have the same characters beside the passage
            assert passage not in rows[i]["kept"].decode() and len(passage) <= rows[i]["n_removed"] <= len(passage) + 16, i
        assert all(rows[i]["n_removed"] == 0 for i, _ in texts[300:])


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    base = [" ".join("t%d" % r.randrange(5000) for _ in range(120)) for _ in range(12)]
    texts = []
    for b in base:
        words = b.split()
        for copy in range(7):
            own = list(words)
            for _ in range(copy):
                own[r.randrange(120)] = "n%d" % r.randrange(10**6)
            texts.append(" ".join(own).upper() if copy == 2 else " ".join(own))
    texts = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (5002, "one two"), (5003, "One two"), (5004, base[0])]
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def alike_texts(n, seed):
    """Near copies of one text, a part of them linked, and holders of one passage, which are not."""
    r = random.Random(seed)
    base, passage = [["%s%d" % (kind, k) for k in range(size)] for kind, size in (("b", 150), ("p", 60))]
    texts = []
    for i in range(n):
        own = ["o%d" % r.randrange(10**9) for _ in range(60)]
        if i % 4 == 3:
            texts.append(" ".join(passage + own))
            continue
        words = list(base)
        for k in range(1 + 2 * (i % 5)):
            words[(k * 17 + r.randrange(17)) % 150] = own[k]
        texts.append(" ".join(words))
    return list(enumerate(texts))


def components_of(texts):
    sets, root = {i: shingle_set(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_copies_of_rows_do_not_grow_with_the_square_of_a_crowd(spark, monkeypatch):
    whole, sent = minhash_dedup._rest, []

    def rows_of(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column("cell"), x.column("doc_id")], ["a", "b"])

    def rest(*tables):
        with monkeypatch.context() as patch:
            patch.setattr(minhash_dedup, "_compare", rows_of)
            patch.setattr(minhash_dedup, "saved", lambda df, name: df if name == "rest-links" else saved(df, name))
            patch.setattr(minhash_dedup, "forget", lambda df: None)
            sent.append(whole(*tables).count())
        return whole(*tables)

    monkeypatch.setattr(minhash_dedup, "_rest", rest)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "BLOCKS", 4, raising=False)
    for n in (160, 320):
        texts = alike_texts(n, 4)
        got = {x["doc_id"]: x["component_id"] for x in near_duplicates(docs_of(spark, texts)).collect()}
        want = components_of(texts)
        assert got == want and n // 3 < len(set(want.values())) < n
    assert 0 < sent[1] <= 2.5 * sent[0], sent


def test_a_large_cell_is_compared_in_steps(monkeypatch):
    texts = alike_texts(150, 5)
    ids, words = zip(*texts, strict=True)
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": list(words), "digest": pa.array(ids, pa.int64())})
    table = pa.Table.from_batches(minhash_dedup._sketch(iter([rows])))
    n = len(ids)
    cell = {"cell": np.zeros(n, np.int64), "slot": np.full(n, -1, np.int32), "component": np.array(ids), "lower": np.ones(n, bool), "upper": np.ones(n, bool), "text": list(words)}
    for name, x in cell.items():
        table = table.append_column(name, pa.array(x))
    want = components_of(texts)
    for step in (1 << 20, 1000):
        monkeypatch.setattr(minhash_dedup, "FOUND", step)
        links = pa.Table.from_batches(minhash_dedup._compare(iter(table.combine_chunks().to_batches())))
        pairs = list(zip(*links.to_pydict().values(), strict=True))
        assert len(pairs) == n - len(set(want.values()))  # a forest
        assert all(want[a] == want[b] for a, b in pairs)


def test_copies_under_shared_and_missing_ids(spark):
    r = random.Random(12)
    text = lambda: " ".join("t%d" % r.randrange(10**6) for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, a), (7, None), (7, None), (8, ""), (9, b + " more"), (2, c)]
    docs = docs_of(spark, rows)
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"]), x["kept"]) for x in found) == sorted(
        (str(i), len(shingle_set(t)), str({(5, a): 1, (9, b + " more"): 5}.get((i, t), i)), (i, t) not in ((5, a), (9, b + " more"))) for i, t in rows
    )
    kept = sorted((str(x["doc_id"]), str(x["text"])) for x in without_copies(docs).collect())
    assert kept == sorted((str(i), str(t)) for i, t in [(1, a), (5, b), (None, a), (None, a), (7, None), (8, ""), (2, c)])
    assert without_copies(docs).columns == docs.columns and without_copies(docs.limit(0)).count() == 0


def test_whole_table_has_the_components_of_brute_force(spark):
    """Every pair at the similarity or above, found by an index of all shingles, whatever the signatures say."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    of, first = {}, {}
    for i, t in sorted(texts.items()):
        s = frozenset(hash(x) for x in shingle_set(t))
        of[i] = first.setdefault(s, i) if s else i
    sets = {i: s for s, i in first.items() if s}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        common = {}
        for x in s:
            for j in holders[x] if len(holders[x]) > 1 else ():
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert sum(got[i] != find(of[i]) for i in texts) == 0


def test_contamination_equals_brute_force(spark):
    texts = random_texts(5, words=80)
    r = random.Random(1)
    items = [(k, " ".join(r.choice([t for _, t in texts if t]).split()[: r.randrange(1, 30)])) for k in range(8)] + [(20, None), (21, ""), (22, "w1")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            k = min(13, len(v))
            windows = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if v else set()
            for p in range(len(w) - k + 1):
                if k and tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    found.add(item)
        want[i] = (len(w), len(hit), sorted(found))
    docs, table = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 20):
        found = judged(contamination(docs, table, block_words=block))
        assert {x["doc_id"]: (x["n_words"], x["n_hit"], list(x["items"])) for x in found.collect()} == want
    clean = decontaminated(docs, table)
    assert clean.columns == docs.columns
    assert {x["doc_id"] for x in clean.collect()} == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}


def test_long_items_go_in_pieces(spark):
    r = random.Random(21)
    words = [f"v{r.randrange(60)}" for _ in range(700)]  # one item of 27 blocks, with words that repeat
    items = [(1, " ".join(words)), (1, "v1 v2"), (2, " ".join(words[300:340])), (3, " ".join(words[:13]))]
    texts = [(k, " ".join([*(f"n{r.randrange(10**6)}" for _ in range(9)), *words[at : at + n], "tail"])) for k, (at, n) in enumerate((a, n) for a in range(0, 690, 23) for n in (12, 13, 30))]
    docs, table = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    plain = lambda block: {x["doc_id"]: (x["n_words"], x["n_hit"], list(x["items"])) for x in judged(contamination(docs, table, block_words=block)).collect()}
    whole = plain(500_000)
    assert plain(26) == whole and sum(1 in i for _, _, i in whole.values()) > 40 and {len(p) for p in decontaminate._pieces(np.arange(700), 13, 26)} <= {26, *range(13, 26)}


def test_contamination_is_the_same_with_many_blocks(spark):
    r = random.Random(8)
    words = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(words[20 * k : 20 * k + 20])) for k in range(20)]
    texts = []
    for k in range(40):  # whole items amid other words, some side by side
        parts = [" ".join(f"n{r.randrange(10**6)}" for _ in range(r.randrange(300, 900))) for _ in range(2)]
        at = r.randrange(19)
        texts.append(", ".join([parts[0], items[at][1], items[at + k % 2][1] if k % 4 else "", parts[1]]))
    ids = [None, None, None, 5, 5, 5, *range(100, 134)]
    docs, table = docs_of(spark, [*zip(ids, texts, strict=True), (None, None), (5, None), (5, texts[3])]), spark.createDataFrame(items, "item_id long, text string")
    plain = lambda rows: sorted(str(x.asDict(recursive=True)) for x in rows.collect())
    whole = contamination(docs, table, keep_text=True)
    assert whole.count() == len(texts) + 3 and whole.where("size(spans) > 0").count() == len(texts) + 1
    parts = contamination(docs, table, block_words=20, keep_text=True)
    assert sorted(parts.columns) == sorted(whole.columns) and plain(parts.select(whole.columns)) == plain(whole)
    assert plain(contamination(docs, table, block_words=20).select("doc_id", "n_words", "spans", "items")) == plain(whole.drop("text"))
    clean = decontaminated(docs, table)
    assert clean.where("doc_id is null").count() > 2 and plain(decontaminated(docs, table, block_words=20)) == plain(clean)


def test_quality_rules(spark):
    good = " ".join("g%d" % k for k in range(30))
    texts = [(k, f"{good} {k}\nshared boilerplate line") for k in range(80)] + [(900, None), (901, "few words"), (902, "same words again and again here now " * 20)]
    texts += [(950 + k, f"lone {k}\n" + "shared boilerplate line\n" * 10) for k in range(3)]
    rows = {r["doc_id"]: r for r in quality(docs_of(spark, texts), min_docs=50).collect()}
    assert rows[0]["kept"] and rows[0]["removed_words"] == 0 and rows[5]["removed_words"] == 3 and rows[5]["kept"]
    assert rows[900]["base_failed"] and rows[901]["base_failed"] and rows[902]["base_failed"] and not rows[950]["kept"]
    out = {r["doc_id"]: r["text"] for r in cleaned(docs_of(spark, texts), min_docs=50).collect()}
    assert out[5] == f"{good} 5" and out[0].endswith("boilerplate line") and 901 not in out
    assert quality(docs_of(spark, texts).limit(0)).count() == 0


def test_cleaned_keeps_each_row_by_its_own_verdict(spark):
    good = [" ".join(f"{name}{k}" for k in range(30)) for name in "abcd"]
    texts = [(None, good[0]), (None, good[1]), (None, good[1]), (None, "few words"), (None, None)]
    texts += [(7, good[2]), (7, None), (7, "few words"), (7, good[3]), (8, good[0]), (8, good[0])]
    docs = docs_of(spark, texts)
    want = sorted(((i, t) for i, t in texts if t in good), key=str)
    assert quality(docs).where("kept").count() == len(want)
    out = cleaned(docs)
    assert out.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == want
    shared = "shared boilerplate line"
    texts = [(k, f"{good[0]} {k}\n{shared}") for k in range(60)] + [(5, f"{good[1]}\n{shared}"), (5, "few words"), (None, f"{good[2]}\n{shared}")]
    out = [(r["doc_id"], r["text"]) for r in cleaned(docs_of(spark, texts), min_docs=50).collect()]
    assert len(out) == 62 and (5, f"{good[0]} 5") in out and (5, good[1]) in out and (None, good[2]) in out


def test_a_clean_row_is_not_judged_by_rows_of_its_id(spark):
    shared = "a common line of eight words stands here"
    clean = " ".join(f"c{k}" for k in range(25))
    texts = [(k, " ".join(f"d{k}x{j}" for j in range(30)) + f"\n{shared}") for k in range(80)]
    texts += [(900, " ".join(f"e{k}x{j}" for j in range(22)) + f"\n{shared}" * 3) for k in range(4)] + [(900, clean), (900, clean)]
    rows = [x for x in quality(docs_of(spark, texts)).collect() if x["doc_id"] == 900]
    assert sorted((x["n_words"], x["removed_words"], x["kept"]) for x in rows) == [(25, 0, True)] * 2 + [(46, 24, False)] * 4
    out = [x["text"] for x in cleaned(docs_of(spark, texts)).collect() if x["doc_id"] == 900]
    assert out == [clean, clean]
    # where no holder has an id, one of the texts keeps the line
    texts = [(None, " ".join(f"d{k}x{j}" for j in range(30)) + f"\n{shared}") for k in range(60)] + [(None, None)]
    assert sorted(x["removed_words"] for x in quality(docs_of(spark, texts)).collect()) == [0, 0] + [8] * 59


def test_pipeline_on_odd_rows(spark):
    """Nulls, empty and repeated rows, and an empty table, through all stages."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    r = random.Random(3)
    good = [" ".join("g%d" % r.randrange(10**6) for _ in range(60)) for _ in range(4)]
    texts = [(None, good[0]), (None, good[0]), (1, good[1]), (1, good[1]), (1, good[2]), (2, None), (3, ""), (None, None), (4, good[1]), (5, " ".join("l%d" % r.randrange(10**6) for _ in range(40_000)))]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in texts], table.schema)
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = saved(stage(spark, now, folder), "stage")
            assert now.columns == docs.columns
        done = corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()
        # the copies without an id stay through the second stage, and the third removes the bytes they repeat
        want = [] if start is not docs else [(None, ""), (None, ""), (1, good[1]), (1, good[2]), (5, texts[-1][1])]
        assert sorted(map(str, ((x["doc_id"], x["text"]) for x in now.collect()))) == sorted(map(str, want)) and len(done) == len(want)
        assert all(x["decoded"] for x in done)


def test_pipeline_stages_chain(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns
        docs = saved(after, "stage")
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").agg(F.bool_and("decoded")).first()[0]
