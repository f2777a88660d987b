"""Every operator and stage on tables whose other columns have the names that operators use themselves."""

import importlib
import pkgutil
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import quotalab.llm
from quotalab.llm import (
    centroids, chat_format, decontaminate, minhash_dedup, ngram_trie, periodic_runs, piece_lattice, quality_gam, quality_rules, relative_lz, suffix_dedup, token_output, warc_derivatives,
)
from quotalab.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


def names():
    """Every name of a column in the code of the subpackage, and some more."""
    found = {"__id", "__digest", "__none", "__lines", "__kept", "a.b", "row", "rest", "own"}
    for module in pkgutil.iter_modules(quotalab.llm.__path__):
        code = open(importlib.import_module(f"quotalab.llm.{module.name}").__file__).read()
        found |= set(re.findall(r"alias\(\"(\w+)\"\)|withColumn\(\"(\w+)\"", code)) and {x for pair in re.findall(r"alias\(\"(\w+)\"\)|withColumn\(\"(\w+)\"", code) for x in pair if x}
    return sorted(found)


def clashing(table, *own):
    """The table with a column of each name, of a type that its use would not take."""
    return table.select(*own, *(F.create_map(F.lit(n), F.lit(77)).cast("map<string,int>").alias(n) for n in names() if n not in {x.lower() for x in own}))


def as_text(rows):
    return sorted(str(r.asDict(recursive=True)) for r in rows.collect())


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet").cache()
    return {name: read(name) for name in ("documents", "benchmark", "labels", "conversations", "pages", "embeddings")}


OPERATORS = {
    "op1": lambda t: quality_rules.quality(t("documents", "doc_id", "text", "source")),
    "op2": lambda t: chat_format.conversation_digests(t("conversations", "conv_id", "turn", "role", "text")),
    "op3": lambda t: suffix_dedup.without_repeats(t("documents", "doc_id", "text")),
    "op4": lambda t: decontaminate.contamination(t("documents", "doc_id", "text"), t("benchmark", "item_id", "text")),
    "op5": lambda t: token_output.token_digests(t("documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json")),
    "op6": lambda t: quality_gam.classified(t("documents", "doc_id", "text"), t("labels", "doc_id", "quality")),
    "op7": lambda t: warc_derivatives.derivatives(warc_derivatives.responses_of(t("pages", "page_id", "url", "html"))),
    "op8": lambda t: ngram_trie.score_texts(t("documents", "doc_id", "text")),
    "op9": lambda t: minhash_dedup.near_duplicates(t("documents", "doc_id", "text")),
    "op10": lambda t: piece_lattice.piece_digests(t("documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model")),
    "op11": lambda t: centroids.clustered(t("embeddings", "vec_id", "embedding")),
    "op12": lambda t: relative_lz.without_windows(t("documents", "doc_id", "text")),
    "op13": lambda t: periodic_runs.periodic_runs(t("documents", "doc_id", "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_other_columns(tables, name):
    plain = as_text(OPERATORS[name](lambda table, *own: tables[table].select(*own)))
    assert plain and as_text(OPERATORS[name](lambda table, *own: clashing(tables[table], *own))) == plain


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_other_columns(spark, tables, name, stage):
    own = tables["documents"].columns
    docs = clashing(tables["documents"], *own)
    out = stage(spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert as_text(out.select(*own)) == as_text(stage(spark, tables["documents"], FOLDER))
    assert all(set(v.values()) == {77} for r in out.drop(*own).collect() for v in r)
