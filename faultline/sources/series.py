"""Canonical series: id, period (1 history, 2 online), pos (from 1), step (from 0, online only), value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_BREAK = -1
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("period", T.ByteType()), T.StructField("value", T.FloatType())])


#: Rows of a range of the order column; a key's rows are numbered range by range.
RANGE_ROWS, MOST_RANGES = 1_000_000, 1000


def numbered(df: DataFrame, key: str, order: str, ranges: int | None = None) -> DataFrame:
    """``df`` plus _r, the place of a row among those of its key (from 0), and _n, how many these are.

    Rows are ranked in ranges of ``order`` (a number), and the counts of earlier ranges are added, so a key with most of the
    rows is spread over as many tasks as there are ranges. ``ranges`` follows the count of rows; it changes no result.
    """
    if ranges is None:
        ranges = min(MOST_RANGES, -(-df.count() // RANGE_ROWS))
    part = F.lit(0)
    if ranges > 1:
        cuts = df.select(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 10 * ranges)).head()[0]
        # ranges - 1 numbers at most
        part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order)))
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy(key, "_part").agg(F.count("*").alias("_c"))
    of_key = Window.partitionBy(key).orderBy("_part")
    before = F.coalesce(F.sum("_c").over(of_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_c").over(Window.partitionBy(key)).alias("_n"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)) - 1)
    joined = ranked.join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_r", F.col("_r") + F.col("_before")).drop("_part", "_p", "_key", "_before")


def chunked(df: DataFrame, key: str, order: str, value: str, hist: int, online: int, ranges: int | None = None) -> DataFrame:
    """Cut each key's rows, in order, into series of ``hist`` and ``online`` points. All rows enter.

    Those after the last full series make its online part longer, and a key of fewer rows than a series is one
    short series, its history the same share (one point at least).
    """
    size = hist + online
    rows = numbered(df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(value).cast("double").alias("value")), "_k", "_o", ranges)
    full = F.floor(F.col("_n") / size)
    chunk = F.least(F.floor(F.col("_r") / size), F.greatest(full - 1, F.lit(0)))
    rows = rows.select("_k", "_n", chunk.cast("int").alias("chunk"), (F.col("_r") - chunk * size + 1).cast("int").alias("pos"), "value")
    h = F.when(F.col("_n") >= size, F.lit(hist)).otherwise(F.greatest(F.floor(F.col("_n") * hist / size), F.lit(1))).cast("int")
    return rows.withColumn("_h", h).select(
        F.concat_ws("-", F.col("_k").cast("string"), F.col("chunk").cast("string")).alias("id"),
        "chunk",
        F.when(F.col("pos") <= F.col("_h"), 1).otherwise(2).alias("period"),
        "pos",
        F.when(F.col("pos") > F.col("_h"), F.col("pos") - F.col("_h") - 1).alias("step"),
        "value",
    )


def from_parquet(spark: SparkSession, path: str, order: str) -> DataFrame:
    """Observation files (id, period, value and an explicit order column) as canonical series."""
    raw = spark.read.parquet(path).select("id", F.col("period").cast("tinyint"), F.col("value").cast("double"), order)
    pos = F.row_number().over(Window.partitionBy("id").orderBy(order))
    out = raw.withColumn("pos", pos).withColumn("_h", F.sum((F.col("period") == 1).cast("int")).over(Window.partitionBy("id")))
    return out.select("id", "period", "pos", F.when(F.col("period") == 2, F.col("pos") - F.col("_h") - 1).alias("step"), "value")


def validate(series: DataFrame, breaks: DataFrame | None = None) -> DataFrame:
    """One row per id that breaks an invariant, with the reason; an empty table means valid series."""
    per = series.groupBy("id").agg(
        F.max(F.when(F.col("period") == 1, F.col("pos"))).alias("h"),
        F.min(F.when(F.col("period") == 2, F.col("pos"))).alias("o"),
        F.count_if(~F.col("period").isin(1, 2)).alias("x"),
    )
    bad = per.select("id", F.when(F.col("x") > 0, "unknown period").when(F.col("h") > F.col("o"), "interleaved periods").when(F.col("h").isNull(), "no history").alias("reason")).filter(F.col("reason").isNotNull())
    if breaks is not None:
        bad = bad.unionByName(per.select("id").join(breaks.select("id"), "id", "left_anti").withColumn("reason", F.lit("no index row")))
    return bad


def with_breaks(series_ids: DataFrame, breaks: DataFrame | None) -> DataFrame:
    """id, tau for every id: the index row, or no break where there is no index."""
    if breaks is None:
        return series_ids.select("id", F.lit(NO_BREAK).alias("tau"))
    return series_ids.join(breaks.select("id", "tau"), "id", "left").select("id", F.coalesce("tau", F.raise_error(F.concat(F.lit("no index row for "), F.col("id").cast("string"))).cast("int")).alias("tau"))


def labels(series: DataFrame, breaks: DataFrame) -> DataFrame:
    """id, step, label: 1 from step tau on."""
    on = F.col("period") == 2
    lab = ((F.col("tau") != NO_BREAK) & (F.col("step") >= F.col("tau"))).cast("int")
    return series.filter(on).join(breaks, "id").select("id", "step", lab.alias("label"))
