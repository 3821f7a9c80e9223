"""Gradient-boosted ensemble over features: seeds averaged on the log-odds, grouped folds, importances."""

from __future__ import annotations

from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting


def assemble(features: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the columns as one vector, null as 0; the columns themselves stay as they are."""
    return features.withColumn("features", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])))


#: Boosting rounds and seeds of an ensemble, where a call names no others.
ROUNDS, SEEDS = 20, (0, 1, 2)
#: Models trained at a time, and rows of a partition: a model is a chain of many short jobs, whose tasks should not be shorter still.
PARALLEL, PARTITION_ROWS = 8, 20_000


def _dealt(rows: DataFrame) -> DataFrame:
    """Persisted rows, computed, in as many partitions as they need at most."""
    return rows.coalesce(max(1, -(-rows.count() // PARTITION_ROWS)))


def _train(jobs, rounds: int, rate: float, depth: int, weight: str | None) -> list[GBTClassificationModel]:
    """A model for each (assembled rows, seed), several at a time."""
    params = {"featuresCol": "features", "labelCol": "label", "maxIter": rounds, "stepSize": rate, "maxDepth": depth, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7"}
    if weight:
        params["weightCol"] = weight
    with ThreadPool(max(1, min(PARALLEL, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(jobs[0][0].sparkSession)(lambda job: GBTClassifier(seed=job[1], **params).fit(job[0])), jobs, 1)


def fit(features: DataFrame, columns: list[str], seeds=None, rounds: int | None = None, rate: float = 0.1, depth: int = 4, weight: str | None = None) -> list[GBTClassificationModel]:
    """One model for each seed; the assembled rows are kept for all of them."""
    rows = assemble(features, columns).select("label", "features", *([weight] if weight else [])).persist()
    try:
        dealt = _dealt(rows)
        return _train([(dealt, s) for s in seeds or SEEDS], rounds or ROUNDS, rate, depth, weight)
    finally:
        rows.unpersist()


def _scored(rows: DataFrame, models: list[GBTClassificationModel]) -> DataFrame:
    for k, m in enumerate(models):
        rows = m.transform(rows).withColumn(f"_s{k}", 2 * vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")
    total = sum((F.col(f"_s{k}") for k in range(len(models))), F.lit(0.0))
    return rows.withColumn("score", total / len(models)).drop("features", *[f"_s{k}" for k in range(len(models))])


def score(features: DataFrame, columns: list[str], models: list[GBTClassificationModel]) -> DataFrame:
    """Rows plus score, the mean log-odds; the raw prediction of the library is half of the log-odds."""
    return _scored(assemble(features, columns), models)


def importances(models: list[GBTClassificationModel], columns: list[str], top: int = 20) -> list[tuple[str, float]]:
    mean = sum(m.featureImportances.toArray() for m in models) / len(models)
    return sorted(zip(columns, mean.tolist()), key=lambda x: (-x[1], x[0]))[:top]


def cross_validated(features: DataFrame, columns: list[str], folds: int = 5, seeds=None, rounds: int | None = None, rate: float = 0.1, depth: int = 4, weight: str | None = None) -> DataFrame | None:
    """Rows (id, step, label, score, fold) scored by models that never saw their series; None without rows.

    All models grow in step over one binned table (:mod:`boosting`), which stays kept, as the scores read it.
    """
    rows = features.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int"))
    counts = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}  # at most ``folds`` rows
    if not counts:
        return None
    spark, width, n = features.sparkSession, len(columns), sum(counts.values())
    cuts = boosting.bounds(rows, columns, n)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, n // 1000))
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", boosting.CHUNK_ROWS):
        table = boosting.chunks(rows, columns, cuts, weight).coalesce(tasks).persist()  # each task sends sums of fixed size
        table.count()
    models = [boosting.Model(k, s) for k in sorted(counts) for s in seeds or SEEDS]
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", 4):
        boosting.train(table, models, width, rounds or ROUNDS, rate, depth)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return boosting.scores(table, models, width, rate, f"id {types['id']}, step {types['step']}, label {types['label']}, score double, fold int")


@contextmanager
def _setting(spark, key: str, value):
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def predictability(features: DataFrame, columns: list[str], folds: int = 5, **options) -> DataFrame:
    """auc: how well columns of one row a series tell its label, from scores out of fold; 0.5 without rows or both classes."""
    from .stats import pooled_auc

    scored = cross_validated(features.withColumn("step", F.lit(0)).select("id", "step", "label", *columns), columns, folds, **options)
    if scored is None:
        return features.agg(F.lit(0.5).alias("auc"))
    return pooled_auc(scored)


def with_length(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds log_t and frac, of the length of the online segment (id, online_len): a diagnostic only, as no stream knows its length."""
    t = F.col("online_len")
    return features.join(lengths, "id").withColumns({"log_t": F.ln(t), "frac": (F.col("step") + 1) / t}).drop("online_len")


def learning_curve(features: DataFrame, columns: list[str], shares=(1.0, 0.5), folds: int = 5, **options) -> DataFrame:
    """share, auc: the first fold scored by models of that share of the other folds' series; a share without series has no row."""
    from .stats import ts_auc

    rows = features.withColumn("_f", F.pmod(F.xxhash64("id"), F.lit(folds))).withColumn("_u", F.pmod(F.xxhash64("id", F.lit("share")), F.lit(1000)) / 1000)
    out = features.sparkSession.createDataFrame([], "share double, auc double")
    for share in shares:
        train = rows.filter((F.col("_f") != 0) & (F.col("_u") < share))
        if train.isEmpty():
            continue
        scored = score(rows.filter(F.col("_f") == 0), columns, fit(train, columns, **options))
        out = out.unionByName(ts_auc(scored).select(F.lit(float(share)).alias("share"), "auc"))
    return out
