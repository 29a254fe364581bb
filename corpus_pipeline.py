"""From raw documents to a mixed training corpus, in stages that each read what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontaminate, linededup, mixing, nearcopies, subwords
from tidewater.llm.common import table, written

#: What each stage but the last hands on; other columns of ``docs`` are dropped. An empty table gives an empty one at every stage.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts get the score of no words; each row is judged by itself."""
    return subwords.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that stand in an earlier document; documents of which nothing is left go.

    Null texts stay null and blank ones stay; rows without doc_id stay as they are.
    """
    return linededup.without_repeated_lines(docs, drop_emptied=True).selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as long) n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles or fingerprints: that of smallest doc_id.

    Null and empty texts are copies of each other; rows without doc_id stay, one for each text.
    """
    return nearcopies.one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows without doc_id stay."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, with their place in a mixture of sources by weight; a null source is one of its own."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("source mixing", mixture),
]

#: The classifier and the fingerprints can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
