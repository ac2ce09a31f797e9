"""From raw documents to an ordered training corpus, in five stages of shutterlake.llm operators.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

In every stage each row is judged for itself: repeated rows, repeated ids and null ids stay or go as their texts do, but
for near_dedup, which keeps one row of an id. An empty table gives an empty one. Other columns of docs are dropped, whatever
their names are. Texts are whole, of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import decontaminate, mixing, near_dup, quality, secret_scan
from shutterlake.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go. Null and empty texts have no words and so fail; documents without a source count as one host."""
    return quality.filtered(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id; of rows under one id the one whose text has the smallest hash. Rows with a null id stay, and so do texts without words, which are linked with nothing."""
    return near_dup.deduplicated(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Items that are null or empty match nothing; without items all documents stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. Null texts stay null, with a null n_chars; of overlapping secrets one mark is left; a text may hold any number."""
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its position in the mix. Documents without a source are a source of their own; within a source they keep the order that `mixing.mix` states, ties included."""
    return mixing.mix(docs, carry=("text", "lang", "n_chars")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
]

#: Block-max retrieval and Pfair scheduling are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
