"""From raw documents to piece sequences: five stages, each written and read again before the next.

All stages take tables with any other columns, whatever their names; all but the last return them as they are. Rows are
judged by id and text, so that null and repeated ids keep rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalab.llm.decontaminate import decontaminated
from quotalab.llm.minhash_dedup import without_copies
from quotalab.llm.piece_lattice import piece_digests
from quotalab.llm.quality_rules import cleaned
from quotalab.llm.queries import tokenizer_path
from quotalab.llm.store import saved
from quotalab.llm.suffix_dedup import cut_repeats
from quotalab.shipping import ship


#: Least bytes of a passage that goes if it stands elsewhere too: some 50 short words.
PASSAGE_BYTES = 240


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, if there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; the others lose lines above the limits.

    Null, empty and short texts fail. Of the holders of a line the first keeps it: the smallest id, else the smallest hash.
    """
    return _measured(cleaned(docs))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each near-duplicate group stays; rows without text or id stay too.

    Of rows with one id and one text any one stays, of texts that share the smallest id the one that stands for the group.
    """
    ship(spark)
    return without_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated strings, every copy of them; a character that is cut goes whole.

    Null texts become empty, and so do texts that repeated rows or copies cover whole.
    """
    ship(spark)
    return _measured(cut_repeats(docs, length=PASSAGE_BYTES))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others lose the words inside benchmark windows.

    Null and empty texts stay, null and empty items have no windows, and repeated items count as one each.
    """
    ship(spark)
    return _measured(decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The n best piece sequences of all documents that are left, as digests."""
    ship(spark)
    return piece_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: No SQL: stages 2, 3 and 5 are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
