"""Feature matrices and models kept as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cached(spark: SparkSession, path: str, names: list[str], build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The Parquet matrix at ``path``; built and written first where it is absent or its columns are not ``names``."""
    if not rebuild:
        try:
            kept = spark.read.parquet(path)
            if kept.columns == names:
                return kept
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    build().select(names).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_block(block: DataFrame, path: str, name: str) -> None:
    """A block of feature columns with its keys (id, step), written beside others; a block of that name is replaced."""
    block.write.mode("overwrite").parquet(f"{path}/{name}")


def with_blocks(rows: DataFrame, path: str, names: list[str]) -> DataFrame:
    """``rows`` (id, step ...) with the columns of the named blocks, aligned by key, never by place; null where a block has no row."""
    for n in names:
        rows = rows.join(rows.sparkSession.read.parquet(f"{path}/{n}"), ["id", "step"], "left")
    return rows


def save_scores(scores: DataFrame, path: str, tag: str) -> None:
    """Out-of-fold scores (id, step, fold, score) under a tag; rows that no model scored are simply absent."""
    scores.select("id", "step", "fold", "score").write.mode("overwrite").parquet(f"{path}/oof_{tag}")


def load_scores(spark: SparkSession, path: str, tags: list[str]) -> DataFrame:
    """id, step and one score column a tag, by full join."""
    out = None
    for t in tags:
        one = spark.read.parquet(f"{path}/oof_{t}").select("id", "step", F.col("score").alias(t))
        out = one if out is None else out.join(one, ["id", "step"], "full")
    return out


def save_models(models: list[GBTClassificationModel], path: str) -> None:
    """One folder a seed; a model already there is replaced."""
    for k, m in enumerate(models):
        m.write().overwrite().save(f"{path}/model_{k}")


def load_models(path: str, count: int) -> list[GBTClassificationModel]:
    return [GBTClassificationModel.load(f"{path}/model_{k}") for k in range(count)]
