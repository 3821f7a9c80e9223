"""Named datasets: tables of a folder as temporary views, and observation files as canonical series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import series

#: Names of the observation and index files of each dataset, below one folder.
FILES = {"train": ("X_train.parquet", "y_train_index.parquet"), "test_reduced": ("X_test.reduced.parquet", "y_test_index.reduced.parquet")}


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """A temporary view for each Parquet table of ``folder``."""
    for n in names:
        spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet").createOrReplaceTempView(n)


def load(spark: SparkSession, folder: str, name: str, order: str, indexed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Series and break index (id, tau) of the dataset ``name``; without an index no series has a break. An id without an index row is an error."""
    observations, index = FILES[name]
    rows = series.from_parquet(spark, f"{folder.rstrip('/')}/{observations}", order)
    breaks = spark.read.parquet(f"{folder.rstrip('/')}/{index}").withColumnRenamed("tau_index", "tau") if indexed else None
    return rows, series.with_breaks(rows.select("id").distinct(), breaks)
