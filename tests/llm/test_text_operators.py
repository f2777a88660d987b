"""Formatting, token output, classifier, WARC, language model and piece lattice on small fixtures."""

import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalab.llm import chat_format, elias_fano, ngram_trie, piece_lattice, quality_gam, token_output, warc_derivatives
from quotalab.llm.queries import tokenizer_path
from quotalab.llm.store import new_path

TEXTS = [
    "The the of and", "", None, "  \n\t ", "Étion ñandú 日本語 😀 \x00 end", "the of and the of and the", "the of and", "a" * 300, "line\nline\r\nthe of\x0band", "the of and",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 7, t, "x", 1.0, [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, score double, x array<int>")


def test_chat_layouts_round_trip(spark):
    hard = r"\### Assistant: </turn> ok \\ : ### </turn"
    records = [
        {"prompt": hard, "response": "b"}, {"instruction": "i", "input": None, "output": "o"}, {"messages": [{"role": "user", "content": hard}, {"role": "odd: ###", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": hard}]}, {"messages": []}, {"other": {"deep": [1]}},
    ]
    want = [
        [("user", hard), ("assistant", "b")], [("system", "i"), ("assistant", "o")], [("user", hard), ("odd: ###", "")], [("user", "q"), ("assistant", hard)], [], None,
    ]
    rows = spark.createDataFrame([(k, 0, json.dumps(r)) for k, r in enumerate(records)] + [(90, 0, None), (91, 0, "{")], "conv_id long, seq long, record string")
    found = {r["conv_id"]: r for r in chat_format.format_records(rows).collect()}
    for k, turns in enumerate(want):
        row = found[k]
        assert (row["text"] is None) if turns is None else chat_format.parse(row["text"]) == turns
        if turns:
            assert [chat_format.unescape(row["text"][s["start"] : s["end"]]) for s in row["loss"]] == [t for r, t in turns if r == "assistant"]
    assert found[5]["fingerprint"] and found[90]["text"] is None and found[91]["text"] is None


def test_long_conversations_are_cut_and_counted(spark):
    rows = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", None if k == 5 else f"t{k}") for k in range(150)] + [(None, 0, None, "n")], "conv_id long, turn long, role string, text string")
    assert chat_format.to_records(rows).count() == 4
    found = {r["conv_id"]: r for r in chat_format.conversation_digests(rows).collect()}
    assert found[1]["n_turns"] == 150 and found[1]["loss_chars"] == sum(len(f"t{k}") for k in range(0, 150, 2)) and found[None]["n_turns"] == 1
    assert chat_format.conversation_digests(rows.limit(0)).count() == 0


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    at = 0
    got = {r["doc_id"]: r for r in token_output.token_digests(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i * 7]["start"], got[i * 7]["n_tokens"], got[i * 7]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    target = new_path(spark, "tokens")
    token_output.write_tokens(docs, path, target)
    assert token_output.read_document(spark, target, 0)[0].tolist() == [*tokenizer.encode(TEXTS[0], add_special_tokens=False).ids, 2]
    assert token_output.token_digests(docs.limit(0), path).count() == 0


def test_a_text_of_more_units_than_the_table_holds(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    letters = np.array([97 + np.arange(1_100_000) // 26**k % 26 for k in range(5)], np.uint8).T
    text = " ".join(np.concatenate([letters, np.full((len(letters), 1), 32, np.uint8)], axis=1).tobytes().decode().split())
    coder = token_output._Coder(path)
    for _ in range(2):  # the table is full, then empty again
        ids, counts = coder.texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert len(coder.first) <= token_output.MEMO_SLOTS * 3 // 4 and len(coder.ids) <= token_output.MEMO_IDS and counts.tolist() == [len(ids)]
    want = np.array(Tokenizer.from_file(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
    assert np.array_equal(ids, want)
    row = token_output.token_digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).first()
    assert row["n_tokens"] == len(want) + 1 and row["ids_crc32"] == zlib.crc32(np.append(want, 2).astype("<u4").tobytes())


def test_control_strings_in_any_case(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    marks = [m for name in ("startoftext", "endoftext") for m in (f"<|{name}|>", f"<|{name.upper()}|>", f"<|{name.title()}|>", f"<|{name[:5]}{name[5:].upper()}|>")]
    texts = [*marks, *(f"The {m} END" for m in marks), *(f"aB{m}Cd {m}. {m}!?" for m in marks), "Don't STOP. X-Ray 3D, It's", "<|EndOfText|>", "<|StartOfText|>x"]
    for t, ids in zip(texts, token_output.encode_rows(texts, path), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], t


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_gam.classified(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = found.where("held_out").join(labels, "doc_id").toPandas()
    pairs = [(a > b) + 0.5 * (a == b) for a in rows.score[rows.quality == 1] for b in rows.score[rows.quality == 0]]
    assert np.mean(pairs) > 0.97 and (rows.predicted == rows.quality).mean() > 0.95
    none = quality_gam.classified(spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string"), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == 3


def test_scores_are_sums_of_table_entries(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    featured = quality_gam._featured(docs, "doc_id", "text")
    model = quality_gam.train(featured, labels)
    assert model.pairs and len(model.tables) == len(quality_gam.FEATURES)
    x = {r["doc_id"]: list(r["x"]) for r in featured.collect()}
    for r in quality_gam.classified(docs, labels).collect():
        total, own = model.start, x[r["doc_id"]]
        for k, cuts in enumerate(model.cuts):
            total += model.tables[k][sum(own[k] >= c for c in cuts)]
        for i, j, a, b, table in model.pairs:
            total += table[sum(own[i] >= c for c in a)][sum(own[j] >= c for c in b)]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total))) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def plain_fit(x, y, rounds, pair_rounds):
    """Cyclic boosting row by row: every cut of every leaf is tried on the rows themselves."""
    G = quality_gam
    n, count = len(y), len(x[0])
    bins_of = lambda cuts, v: sum(v >= c for c in cuts)
    cuts = [sorted(set(np.quantile([r[k] for r in x], [q / G.BINS for q in range(1, G.BINS)]))) for k in range(count)]
    coarse = [sorted(set(np.quantile([r[k] for r in x], [q / G.PAIR_BINS for q in range(1, G.PAIR_BINS)]))) for k in range(count)]
    share = (sum(y) + 0.5) / (n + 1)
    total = [math.log(share / (1 - share))] * n
    tables = [[0.0] * (len(c) + 1) for c in cuts]

    def slopes():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]

    def score(rows, g, h):
        return sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + G.SHRINK)

    value = lambda rows, g, h: sum(g[r] for r in rows) / (sum(h[r] for r in rows) + G.SHRINK)
    for _ in range(rounds):
        for k in range(count):
            g, h = slopes()
            own = [bins_of(cuts[k], r[k]) for r in x]
            bounds = [0, len(tables[k])]
            while len(bounds) <= G.LEAVES:
                gains = []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    inside = lambda lo, hi: [r for r in range(n) if lo <= own[r] < hi]  # noqa: B023, E731
                    gains += [(score(inside(a, m), g, h) + score(inside(m, b), g, h) - score(inside(a, b), g, h), m) for m in range(a + 1, b)]
                if not gains or max(gains)[0] <= 1e-9:
                    break
                bounds = sorted([*bounds, max(gains)[1]])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                step = G.RATE * value([r for r in range(n) if a <= own[r] < b], g, h)
                tables[k][a:b] = [t + step for t in tables[k][a:b]]
            total[:] = [math.log(share / (1 - share)) + sum(tables[f][bins_of(cuts[f], r[f])] for f in range(count)) for r in x]

    def best_pair(i, j, g, h):
        a, b = [bins_of(coarse[i], r[i]) for r in x], [bins_of(coarse[j], r[j]) for r in x]
        out = []
        for m in range(1, len(coarse[i]) + 1):
            for q in range(1, len(coarse[j]) + 1):
                sides = [[r for r in range(n) if (a[r] < m) == u and (b[r] < q) == v] for u in (True, False) for v in (True, False)]
                out.append((sum(score(s, g, h) for s in sides) - score(range(n), g, h), -m, -q, [value(s, g, h) for s in sides]))
        return max(out)

    g, h = slopes()
    chosen = sorted((-best_pair(i, j, g, h)[0], i, j) for i in range(count) for j in range(i))[: G.PAIRS]
    grids = {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for gain, i, j in chosen if gain < 0}
    for _ in range(pair_rounds):
        for (i, j), grid in grids.items():
            _, m, q, steps = best_pair(i, j, *slopes())
            add = np.zeros_like(grid)
            for (u, v), s in zip([(u, v) for u in (True, False) for v in (True, False)], steps, strict=True):
                add[slice(0, -m) if u else slice(-m, None), slice(0, -q) if v else slice(-q, None)] = G.RATE * s
            grid += add
            total[:] = [t + add[bins_of(coarse[i], r[i]), bins_of(coarse[j], r[j])] for t, r in zip(total, x, strict=True)]
    return tables, grids


def test_fit_equals_row_by_row_boosting(monkeypatch):
    monkeypatch.setattr(quality_gam, "ROUNDS", 3)
    monkeypatch.setattr(quality_gam, "PAIR_ROUNDS", 2)
    monkeypatch.setattr(quality_gam, "BINS", 8)
    monkeypatch.setattr(quality_gam, "PAIR_BINS", 4)
    r = np.random.default_rng(4)
    x = r.normal(size=(70, 3))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=70) / 2) > 0).astype(float)
    model = quality_gam.fit(x, y)
    tables, grids = plain_fit(x.tolist(), y.tolist(), 3, 2)
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables, strict=True))
    assert [(i, j) for i, j, *_ in model.pairs] == list(grids) and all(np.allclose(t, grids[i, j]) for i, j, _, _, t in model.pairs)


def test_learning_never_sees_held_out_labels(spark):
    docs = spark.createDataFrame([(k, " ".join(["word"] * (k % 9 + 1)), "y", 0) for k in range(200)], "doc_id long, text string, quality string, x int")
    kept = [(k, k % 2) for k in range(200)]
    other = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q) for k, q in kept] + [(None, 1), (5, None)]
    frames = [spark.createDataFrame(x, "doc_id long, quality int") for x in (kept, other)]
    one, two = ({r["doc_id"]: r["score"] for r in quality_gam.classified(docs, labels).collect()} for labels in frames)
    assert one == two and quality_gam.classified(docs.limit(0), frames[0]).count() == 0


def plain_page(html):
    """A page's text and links by walking its characters."""
    out, links, at = [], [], 0
    while at < len(html):
        if html.startswith("<!--", at):
            end = html.find("-->", at)
            out.append(" ")
            at = len(html) if end < 0 else end + 3
        elif html[at] == "<" and re.match(r"[a-zA-Z/!?]", html[at + 1 : at + 2]):
            end = html.find(">", at)
            end = len(html) if end < 0 else end
            tag = html[at : end + 1]
            name = re.match(r"</?([a-zA-Z0-9]*)", tag)[1].lower()
            if name == "script" and not tag.startswith("</"):
                close = re.search(r"(?i)</script\s*>", html[at:])
                at = len(html) if close is None else at + close.end()
                out.append(" ")
                continue
            if name == "a" and (href := re.search(r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", tag)):
                links.append(next(x for x in href.groups() if x is not None))
            out.append("\n" if name in ("p", "br", "div", "td", "h1") else "")
            at = end + 1
        else:
            out.append(html[at])
            at += 1
    lines = [" ".join(x.split()) for x in "".join(out).split("\n")]
    return "\n".join(x for x in lines if x), links


def test_pages_equal_a_plain_walk(spark):
    r = random.Random(4)
    parts = ["<p>", "</p>", "<br/>", "<a href='/x'>", '<a class="k" href="y z">', "<a href=bare>", "<a>", "</a>", "<b>", "</b>", "<!-- c > d -->", "<script>if (a<b) {}</script>", "word", " ", "\n", "3 < 4", "é", "\t", "<td>", "<h1>", "<DIV >"]
    for _ in range(500):
        html = "".join(r.choice(parts) for _ in range(r.randrange(25))) + r.choice(["", "", "<p", "<!-- open", "<script>", "<a href=end"])
        text, links = plain_page(html)
        assert warc_derivatives.page_text(html) == text, html
        assert list(warc_derivatives._addresses(html)) == links, html
    for mark in ("<a ", "<title ", "<title>", "<script", '<a href="', "<!--", "</script "):
        began = time.time()
        html = mark * (1_000_000 // len(mark))
        warc_derivatives.page_text(html), warc_derivatives.page_links(html, ""), warc_derivatives.page_title(html)
        assert time.time() - began < 5, mark


def test_derivatives_of_odd_rows(spark):
    schema = "page_id long, url string, html string, target string, body string"
    rows = [(1, "http://e.org/", "<p>a</p>", "t", "b"), (1, "http://e.org/", "<p>a</p>", "t", "b"), (None, None, None, None, None), (2, "", "", "t", "b"), (3, "u", "<p>" + "long " * 200_000, "t", "b")]
    pages = spark.createDataFrame(rows, schema)
    found = warc_derivatives.derivatives(warc_derivatives.responses_of(pages).withColumn("type", F.lit("clash"))).collect()
    assert len(found) == 2 * len(rows) and len({bytes(x["record"]) for x in found if x["page_id"] == 1}) == 2
    assert {bytes(x["block"]) for x in found if x["type"] == "conversion"} == {b"a", b"", ("long " * 200_000).strip().encode()}
    assert warc_derivatives.derivatives(warc_derivatives.responses_of(pages.limit(0))).count() == 0


def test_warc_records(spark):
    html = '<title>A &amp; B</title><script>x</script><!-- c --><p>One<br>two <b>t</b>hree</p><a href="/q?a=1&amp;b=2">l</a>'
    rows = warc_derivatives.derivatives(warc_derivatives.responses_of(spark.createDataFrame([(1, "http://e.org/d/", html), (2, None, None)], "page_id long, url string, html string"))).collect()
    assert len(rows) == 4
    meta, text = ({r["type"]: r for r in rows if r["page_id"] == 1}[k] for k in ("metadata", "conversion"))
    assert bytes(text["block"]).decode() == "A & B\nOne\ntwo three\nl" and meta["refers_to"] == text["refers_to"] != meta["record_id"]
    assert b"outlink: http://e.org/q?a=1&b=2 L a/@href" in bytes(meta["block"]) and b"source-header: Content-Type: text/html" in bytes(meta["block"])
    for r in rows:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest == bytes(r["block"]) + b"\r\n\r\n" and size == len(r["block"]) and r["refers_to"].encode() in head and r["block_digest"] == warc_derivatives.digest(bytes(r["block"]))


def test_elias_fano_equals_search():
    r = np.random.default_rng(1)
    for universe, n in ((1 << 64, 500), (1000, 300), (10, 4), (5_000_000, 3000), (3, 0)):
        values = np.sort(r.integers(0, universe, n, dtype=np.uint64)) if n else np.empty(0, np.uint64)
        e = elias_fano.encode(values, universe)
        if n:
            assert (e.at(np.arange(n)) == values).all()
        values = np.unique(values)
        e = elias_fano.encode(values, universe)
        asked = np.concatenate([values, r.integers(0, universe, 500, dtype=np.uint64)])
        place, same = e.find(asked)
        assert (place[same] == np.searchsorted(values, asked)[same]).all() and (same == np.isin(asked, values)).all()


_ANY = random.Random(2)
_MANY = [" ".join(_ANY.choice(["the", "Of", "and", "é", "rare%d" % _ANY.randrange(40)]) for _ in range(_ANY.randrange(25))) for _ in range(80)] + [None, ""]


@pytest.mark.parametrize("texts", [_MANY, [None, "", " \n "], ["ab" * 50_000, "x y"], ["one"] * 30], ids=["many", "empty", "long word", "same"])
def test_trie_equals_counts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    one, two, three, after, after2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        if not held(i):
            s = ["<", *split(t), ">"]
            one.update(s[1:])
            for a, b in zip(s, s[1:]):
                two[a, b] += 1
                after[a] += 1
            for g in zip(s, s[1:], s[2:]):
                three[g] += 1
                after2[g[:2]] += 1
    total, size = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.1) / (total + 0.1 * (size + 1))
    p2 = lambda u, w: (two[u, w] + 4 * p1(w)) / (after[u] + 4)
    for row in ngram_trie.score_texts(docs).collect():
        s = ["<", *split(texts[row["doc_id"]]), ">"]
        score = sum(math.log10(p2(s[k - 1], s[k]) if k == 1 else (three[tuple(s[k - 2 : k + 1])] + 2 * p2(s[k - 1], s[k])) / (after2[s[k - 2], s[k - 1]] + 2)) for k in range(1, len(s)))
        assert row["held_out"] == held(row["doc_id"]) and row["n_tokens"] == len(s) - 1 and row["train_tokens"] == total
        assert row["n_known"] == sum(one[w] > 0 for w in s[1:]) and row["base_score"] == pytest.approx(sum(math.log10(p1(w)) for w in s[1:]))
        assert row["score"] == pytest.approx(score, abs=3e-4 * len(s))
    assert ngram_trie.score_texts(docs.limit(0)).count() == 0


def test_shards_are_let_go(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    texts = [(k, " ".join(f"w{r.randrange(300)}" for _ in range(60))) for k in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    plain = lambda: sorted(map(str, ngram_trie.score_texts(docs).collect()))
    monkeypatch.setattr(ngram_trie, "SHARD_TOKENS", 100)
    want = plain()
    opened = []
    monkeypatch.setattr(ngram_trie, "read_arrays", lambda path, read=ngram_trie.read_arrays: opened.append(path) or read(path))
    trie = ngram_trie.Trie.__new__(ngram_trie.Trie)
    trie.folder, trie._pairs = str(tmp_path), {}
    monkeypatch.setattr(ngram_trie, "MOST_OPEN", 3)
    for shard in (0, 1, 2, 3, 3, 0):
        assert trie.pairs(shard) is None and len(trie._pairs) <= 3
    assert len(opened) == 5 and plain() == want


def test_grams_of_many_distinct_words(spark):
    import pyarrow as pa

    class Known:
        begin, none = 1000, 1001

        def numbers(self, h):
            return np.arange(len(h))

        def counts(self, number):
            return number

    r = random.Random(7)
    texts = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(50))) for _ in range(30)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for places in (True, False):
        one, other = (ngram_trie._grams(batch, Known(), places, bits) for bits in (ngram_trie.BITS, 3))
        for name in ("number", "seq", "row", "place", "pair", "third", "repeats", *(["gram"] if places else [])):
            assert (getattr(one, name) == getattr(other, name)).all(), name


def test_piece_lattice_equals_all_paths(spark, docs):
    path = tokenizer_path("piece_bpe_32k.model")
    model = piece_lattice.pieces(path)

    def every(segment, at=0):
        if at == len(segment):
            return [(0.0, ())]
        out = []
        for end, piece in piece_lattice._edges(model, segment, at):
            own = (piece,) if piece != model.unknown else tuple(model.byte[list(segment[at:end])].tolist())
            out += [(float(model.scores[piece]) + s, own + rest) for s, rest in every(segment, end)]
        return out

    for segment in (b" the", "  Étio".encode(), b" aaaaaa", "😀x".encode(), b"\n", b" and,"):
        want = sorted(every(segment), key=lambda x: -x[0])
        got = piece_lattice.n_best(model, segment, 5)
        assert [s for s, _ in got] == [s for s, _ in want[:5]] and {(s, tuple(p)) for s, p in got} <= set(want) and len({tuple(p) for _, p in got}) == len(got)
        own = piece_lattice.segment_paths(model, np.frombuffer(segment, np.uint8), np.array([0]), np.array([len(segment)]))
        assert own.ids.tolist() == got[0][1] and own.best[0] == got[0][0] and (len(got) < 2 or own.second[0] == got[1][0])
    text = "of the and"
    want = sorted((-a[0] - b[0] - c[0], a[1] + b[1] + c[1]) for a in every(b" of") for b in every(b" the") for c in every(b" and"))
    rows = piece_lattice.encode_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, 4).first()
    assert [b["score"] for b in rows["best"]] == [-s for s, _ in want[:4]]
    encoded = piece_lattice.encode_texts(docs, path)
    assert {r["doc_id"]: r["text"] for r in piece_lattice.decode_texts(encoded, path).collect()} == {i * 7: t or "" for i, t in enumerate(TEXTS)}
    assert piece_lattice.piece_digests(docs, path).agg(F.bool_and("decoded")).first()[0]
    assert piece_lattice.piece_digests(docs.limit(0), path).count() == 0


def test_a_long_text_without_blanks():
    """Some 60 KB in one segment: flat arrays in the forward pass, and never more agenda entries than wanted paths."""
    model = piece_lattice.pieces(tokenizer_path("piece_bpe_32k.model"))
    segment = ("的一是不了人我在有他" * 1_000 + "abcdef" * 5_000).encode()
    own = piece_lattice.segment_paths(model, np.frombuffer(segment, np.uint8), np.array([0]), np.array([len(segment)]))
    got = piece_lattice.n_best(model, segment, 4)
    assert got[0][0] == own.best[0] and got[1][0] == own.second[0] and len({tuple(p) for _, p in got}) == 4
    for score, ids in got:
        assert b"".join(model.text[i] for i in ids) == segment


@pytest.mark.parametrize("texts", [["", None], [None], ["的一是不了人我在有他" * 20], ["", "a" * 100]])
def test_slices_of_empty_texts_or_long_segments_alone(spark, texts):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r for r in piece_lattice.piece_digests(rows, path).collect()}
    assert all(found[i]["decoded"] and (found[i]["n_ids"] > 0) == bool(t) for i, t in enumerate(texts)) and len(found) == len(texts)
    assert {r["doc_id"]: r["text"] for r in piece_lattice.decode_texts(piece_lattice.encode_texts(rows, path), path).collect()} == {i: t or "" for i, t in enumerate(texts)}
