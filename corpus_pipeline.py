"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.

Defined for odd rows: a null or empty text has no words and goes with the first stage, which also drops texts
without enough of them; rows with a null doc_id are documents like any other, and so are several rows of one
doc_id with different texts, while of equal texts one row stays, that of the smallest doc_id, nulls last. A null source is a
source of its own. An empty benchmark takes nothing away and items with a null text match nothing; an empty documents
table gives no rows, with the columns of any result. Further columns of documents, whatever their names, go through all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import discard, table, tables_written, written
from quire.llm.decontam import decontaminate
from quire.llm.mixing import mix
from quire.llm.pii import redact
from quire.llm.quality import keep_good
from quire.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by placeholders."""
    return redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("source mixing", source_mixing),
]

#: The trees of the personal-data stage and the draws of the mixing stage are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; what lies between two stages is written once and read again."""
    docs = table(spark, sf_dir, "documents")
    others = set(tables_written())
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        # what the stage read and what it wrote on its way is not needed any more
        discard(spark, [t for t in tables_written()[:-1] if t not in others])
    return STAGES[-1][1](spark, docs, sf_dir)
