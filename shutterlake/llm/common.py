"""What the operators share: tables, written intermediate results, names that cannot clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.components import connected_components
from ..sources.shared import shared_dir, written

__all__ = ["connected_components", "numbered", "shared_dir", "small_batches", "table", "written"]

#: Rows and bytes of an Arrow batch, one setting for all operators, so that long texts do not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns as in_0, in_1 and so on, and those names: an operator may add columns of any other name."""
    names = [f"in_{k}" for k in range(len(df.columns))]
    return df.toDF(*names), names
