"""Quality rules: base counts of a text, and line frequency across the documents of a host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8  # words of a repeated window
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: A line is above the limits in a host if more distinct documents than this have it, and more than this share of them.
MIN_DOCS = 50
SHARE_PERCENT = 2
#: A document is depleted if the removed lines have more than this share of its words.
DEPLETED_PERCENT = 50
#: Lines that hold more than one in so many of all lines are joined apart from the others.
HOT_SHARE = 1000


#: Of a row: its id, 0 for none, and the hash of its text, its host and whether it has an id.
KEY = ["key", "digest"]


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str, *others: Column) -> DataFrame:
    """(doc_id, key, digest, host, t, ...): rows with one key have one id, text and host, and one verdict."""
    own, t, host = F.col(id_col), F.col(text_col).cast("string"), F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    digest = F.xxhash64(t, host, own.isNull())
    return docs.select(own.alias("doc_id"), F.coalesce(own.cast("long"), F.lit(0).cast("long")).alias("key"), digest.alias("digest"), host.alias("host"), t.alias("t"), *others)


def base_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, key, digest, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of rows(doc_id, key, digest, t).

    Null texts count as empty: every count is 0 and base_failed is true.
    """
    own = ("doc_id", *KEY)
    t = rows.select(*own, F.coalesce("t", F.lit("")).alias("t"))
    t = t.withColumn("h", F.transform(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)))
    n = F.size("h")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("h", i, WINDOW))))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    t = t.select(
        *own,
        n.cast("long").alias("n_words"),
        (F.length("t") - left(WORD)).cast("long").alias("word_chars"),
        left(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("g"),
    )
    t = t.withColumn("twice", F.coalesce(F.size(F.array_distinct("g")) < F.size("g"), F.lit(False)))
    # equal windows stand side by side once sorted; only texts that have some are sorted
    t = t.withColumn("s", F.when(F.col("twice"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("s")
    beside = lambda x, i: F.coalesce(F.get(s, i - 1)["x"] == x["x"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == x["x"], F.lit(False))
    at = F.array_sort(F.transform(F.filter(s, beside), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    cover = F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    t = t.select(
        *own, "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice"), cover).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    return t.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def line_hash(line: Column) -> Column:
    """The hash of a line in lower case with its white space made single blanks."""
    return F.xxhash64(F.trim(F.lower(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))))


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """(key, digest, lines, removed_words): of each row with lines above the limits of its host, their hashes and words.

    Rows with one text in one host count once. A line's first holder in a host keeps it, so a passage never vanishes: the
    row of smallest id, or where no holder has an id the one whose text has the smallest hash. A null host is a host of
    its own together with the empty name. Rows without a text are ignored.
    """
    d = rows.where("t is not null").select("doc_id", *KEY, "host", F.xxhash64("t").alias("doc"), F.posexplode(F.split("t", "\n")).alias("at", "line"))
    d = d.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    d = saved(d.select("doc_id", *KEY, "host", "doc", "at", line_hash(F.col("line")).alias("line"), F.regexp_count("line", F.lit(WORD)).alias("w")), "lines")
    sizes = d.groupBy("host", "doc").agg(F.min("at").alias("x")).groupBy("host").agg(F.count("*").alias("docs"))
    each = d.groupBy("host", "line", "doc").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    often = each.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.min("doc").alias("first_doc"), F.sum("copies").alias("copies")).where(F.col("n") > min_docs)
    often = often.join(sizes, "host").where(100 * F.col("n") > share_percent * F.col("docs")).select("host", "line", "first", "first_doc", "copies")
    # lines with more than this share of all rows are few enough to broadcast, so that none meets in one task
    often, total = saved(often, "often"), d.count()
    often = often.withColumn("hot", F.col("copies") * HOT_SHARE > total)
    hot, cold = F.broadcast(often.where("hot").drop("hot", "copies")), often.where("not hot").drop("hot", "copies")
    hits = d.join(hot, ["host", "line"]).unionByName(d.join(hot, ["host", "line"], "left_anti").join(cold, ["host", "line"]))
    hits = hits.where("case when first is null then doc <> first_doc else doc_id is null or doc_id <> first end")
    hits = hits.select(*KEY, "at", "line", "w").distinct()  # rows with one key have the same lines
    return hits.groupBy(*KEY).agg(F.collect_set("line").alias("lines"), F.sum("w").cast("long").alias("removed_words"))


def _judged(rows: DataFrame, depleted_percent: int, limits: dict) -> DataFrame:
    out = base_counts(rows).join(frequent_lines(rows, **limits), KEY, "left")
    removed = F.coalesce("removed_words", F.lit(0).cast("long"))
    out = out.withColumn("removed_words", removed).withColumn("depleted", 100 * F.col("removed_words") > depleted_percent * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", depleted_percent: int = DEPLETED_PERCENT, **limits) -> DataFrame:
    """base_counts() with removed_words, lines (hashes of the removed lines, null if none), depleted and kept.

    kept is false for documents that fail the base rules or are depleted by the removal of lines above the limits. One
    row comes back for each row of docs and depends on its own id, text and host, also where ids are null or shared; rows
    that agree in all three have one verdict. Null and empty texts fail. An empty table gives an empty one. Other columns
    are ignored, whatever their names.
    """
    return _judged(_rows(docs, id_col, text_col, host_col), depleted_percent, limits).drop(*KEY)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", depleted_percent: int = DEPLETED_PERCENT, **limits) -> DataFrame:
    """The rows of docs that quality() keeps, all columns, their text without the removed lines.

    Rows, null or shared ids, empty tables and columns of any name are treated as by quality(); all columns come through.
    """
    # written first: a filter on kept would be pushed into the counts, which then are made again for each use
    verdict = saved(_judged(_rows(docs, id_col, text_col, host_col), depleted_percent, limits).select(*KEY, "lines", "kept"), "verdicts")
    verdict = verdict.where("kept").drop("kept").dropDuplicates(KEY)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    both = _rows(docs, id_col, text_col, host_col, whole).join(verdict, KEY)
    own = F.array_join(F.filter(F.split("t", "\n"), lambda x: ~F.array_contains("lines", line_hash(x))), "\n")
    text = F.when(F.col("lines").isNull(), F.col(f"row.`{text_col}`")).otherwise(own)
    return both.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
