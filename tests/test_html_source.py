"""The HTML data source: tables written and read back, files that are no tables, and names of columns."""

import random

import pytest

from quotalab.operators import orders
from quotalab.sources.html_source import HtmlTable, read_tables, write_tables
from quotalab.sources.ledger import COLUMNS, HtmlRows, html_rows, read_html

ROWS = [(f"u{k}", f"2026-01-{k % 28 + 1:02d}", "p <b> & 'q'", None if k % 7 == 0 else "Categória", str(k), "NaN", "", "Enviada", "Sim", "Janeiro/2026") for k in range(40)]


def test_tables_come_back(spark, tmp_path):
    table = spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in COLUMNS)).repartition(3)
    path = str(tmp_path / "out")
    write_tables(table, path)
    read = read_tables(spark, path)
    assert read.columns == [*COLUMNS, "_arquivo", "_erro"] and read.rdd.getNumPartitions() == 3
    want = sorted(str([None if v in ("", "NaN") else v for v in r]) for r in ROWS)
    assert sorted(str(list(r)) for r in read.select(COLUMNS).collect()) == want
    assert sorted(str(list(r)) for r in read_html(spark, f"{path}/*.html").collect()) == want
    assert read.select("_arquivo").distinct().count() == 3 and read.where("_erro is not null").count() == 0
    assert orders.normalised(read_tables(spark, f"file://{path}").select(COLUMNS)).count() == 40
    write_tables(table.limit(2), path)
    assert read_tables(spark, path).count() == 42


def test_files_that_are_no_tables(spark, tmp_path):
    (tmp_path / "a.html").write_text("<table><tr><th>x</th></tr><tr>" + "<td>1</td>" * 10 + "</tr></table>", encoding="utf-8")
    (tmp_path / "b.html").write_text("no table", encoding="utf-8")
    (tmp_path / "c.html").write_text("<table><tr><th>x</th></tr><tr><td>1</td></tr></table>", encoding="utf-8")
    (tmp_path / "d.html").write_bytes(b"<table><tr><td>\xff</td></tr></table>")
    (tmp_path / "e.html").write_text("<table><tr><th>header alone</th></tr></table>", encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("")
    rows = {r["_arquivo"]: r for r in read_tables(spark, str(tmp_path), mode="permissive").collect()}
    assert sorted(rows) == ["a.html", "b.html", "c.html", "d.html"]
    assert rows["a.html"]["_erro"] is None and rows["a.html"]["unidade"] == "1" and "one table" in rows["b.html"]["_erro"] and "found 1" in rows["c.html"]["_erro"] and rows["d.html"]["unidade"] is None
    with pytest.raises(Exception, match=r"[bcd]\.html: "):
        read_tables(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="missing"):
        read_tables(spark, str(tmp_path / "missing")).collect()
    (tmp_path / "empty").mkdir()
    assert read_tables(spark, str(tmp_path / "empty")).count() == 0


def test_pieces_give_what_the_whole_file_gives(spark, tmp_path):
    r = random.Random(3)
    odd = ["<tr><td>a</td><td>b</td></tr>\n", "<tr><td> a&amp;b </td><td></td></tr>", "<tr>", "<td>c</td>", "<td>c</td>", "</tr>", "<!-- <tr><td>1</td><td>2</td></tr> -->", "<script><tr><td>x</td><td>y</td></tr></script>", "<tr id='1'><td>a<td>b</td></tr>", "<!--"]
    same = 0
    for _ in range(3000):
        text = "<table><tr><th>h</th></tr>" + "".join(r.choice(odd) for _ in range(r.randrange(10))) + "</table>"
        want = html_rows(text)
        rows, got, at = HtmlRows(2), [], 0
        try:
            while at < len(text):
                size = r.randrange(1, 40)
                got += rows.feed(text[at : at + size])
                at += size
            got += rows.feed("", last=True)
        except ValueError:
            assert any(len(x) != 2 for x in want)
        else:
            same += bool(got)
            assert [list(x) for x in got] == want
    assert same > 500
    table = spark.range(60_000).selectExpr(*(f"cast(id as string) {c}" for c in COLUMNS)).coalesce(1)
    write_tables(table, str(tmp_path / "packed"), compression="gzip")
    (file,) = (tmp_path / "packed").glob("*.html.gz")
    reader = HtmlTable({"path": str(file)}).reader(HtmlTable({}).schema())
    sizes = [b.num_rows for part in reader.partitions() for b in reader.read(part)]
    assert sum(sizes) == 60_000 and max(sizes) < 20_000
    assert read_tables(spark, str(tmp_path / "packed")).where("unidade = mes_ref").count() == 60_000
