"""Evaluation metrics, two-sample statistics and segment statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ts_auc(scored: DataFrame, step: str = "step", label: str = "label", score: str = "score") -> DataFrame:
    """Mid-rank AUC in each step, weighted by pairs; 0.5 where no step has both classes. One shuffle on step.

    Rows are first counted by (step, score), so a step's ranks run over distinct scores.
    """
    cells = scored.groupBy(step, score).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    below = Window.partitionBy(step).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = cells.withColumn("q", F.col("n") - F.col("p")).withColumn("less", F.coalesce(F.sum("q").over(below), F.lit(0)))
    per = wins.groupBy(step).agg(F.sum(F.col("p") * (F.col("less") + F.col("q") / 2)).alias("won"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    total = F.sum(F.col("np") * F.col("nq"))
    return per.agg(F.when(total > 0, F.sum("won") / total).otherwise(0.5).alias("auc"))


#: Distinct scores of a range that a pooled AUC ranks in one task.
RANGE_SCORES = 1_000_000


def pooled_auc(scored: DataFrame, label: str = "label", score: str = "score", ranges: int | None = None) -> DataFrame:
    """auc over all rows, with mid-ranks; 0.5 without both classes. Null scores are left out.

    Rows are counted by score; ranges of scores are ranked apart, and the counts of lower ranges added, so no task holds all.
    ``ranges`` follows the number of rows; it changes no result.
    """
    cells = scored.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.sum(label).alias("p"), (F.count("*") - F.sum(label)).alias("q"))
    if ranges is None:
        ranges = min(1000, max(1, -(-scored.count() // RANGE_SCORES)))
    part = F.lit(0)
    if ranges > 1:
        cuts = scored.select(F.percentile_approx(score, [k / ranges for k in range(1, ranges)], 10 * ranges)).head()[0]
        part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("_s")))
    cells = cells.withColumn("_part", part)
    below = F.coalesce(F.sum("q").over(Window.partitionBy("_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = cells.withColumn("w", F.col("p") * (below + F.col("q") / 2)).groupBy("_part").agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    # one row a range
    lower = F.coalesce(F.sum("q").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("p") * F.sum("q")
    return per.withColumn("w", F.col("w") + F.col("p") * lower).agg(F.when(total > 0, F.sum("w") / total).otherwise(0.5).alias("auc"))


def lag_products(scored: DataFrame, cuts: DataFrame, column: str, lags, least: int = 100) -> DataFrame:
    """id, lag, gg, aa: products of a stream, and of its centred size, with the value so many places before, summed after the cut
    over the root of their number, less what the history's mean product makes expect. Series with fewer than ``least`` points after it have no row.
    """
    by_id, order = Window.partitionBy("id"), Window.partitionBy("id").orderBy("pos")
    past = F.col("period") == 1
    rows = scored.select("id", "period", "pos", "step", F.col(column).alias("g")).join(cuts.select("id", "t"), "id")
    rows = rows.withColumn("a", F.abs("g") - F.avg(F.when(past, F.abs("g"))).over(by_id)).withColumn("n", F.count_if(~past).over(by_id) - F.col("t")).filter(F.col("n") >= least)
    pairs = [F.struct(F.lit(k).alias("lag"), (F.col("g") * F.lag("g", k).over(order)).alias("g"), (F.col("a") * F.lag("a", k).over(order)).alias("a")) for k in lags]
    long = rows.select("id", "n", past.alias("past"), (~past & (F.col("step") >= F.col("t"))).alias("post"), F.array(*pairs).alias("_p")).select("id", "n", "past", "post", F.explode("_p").alias("_p"))
    value = lambda c: F.sum(F.when(F.col("post"), F.col(f"_p.{c}"))) / F.sqrt("n") - F.avg(F.when(F.col("past"), F.col(f"_p.{c}"))) * F.sqrt("n")
    return long.groupBy("id", "n", F.col("_p.lag").alias("lag")).agg(value("g").alias("gg"), value("a").alias("aa")).select("id", "lag", "gg", "aa")


def step_weights(rows: DataFrame) -> DataFrame:
    """Rows plus weight p (n - p) / n of their step, with mean 1."""
    w = Window.partitionBy("step")
    raw = F.sum("label").over(w) * (F.count("*").over(w) - F.sum("label").over(w)) / F.greatest(F.count("*").over(w), F.lit(1))
    out = rows.withColumn("_w", raw)
    mean = out.agg(F.avg("_w").alias("_m"))
    return out.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")  # one row


def ks_statistic(series: DataFrame) -> DataFrame:
    """id, ks: largest distance of the history's and the online part's distribution functions."""
    w = Window.partitionBy("id").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    a = Window.partitionBy("id")
    h, o = (F.col("period") == 1).cast("int"), (F.col("period") == 2).cast("int")
    d = F.abs(F.sum(h).over(w) / F.sum(h).over(a) - F.sum(o).over(w) / F.sum(o).over(a))
    return series.select("id", d.alias("d")).groupBy("id").agg(F.max("d").alias("ks"))


def mann_whitney(series: DataFrame) -> DataFrame:
    """id, mw: distance of U / (n m) from a half, with mid-ranks."""
    order = Window.partitionBy("id").orderBy("value")
    mid = F.rank().over(order) + (F.count("*").over(Window.partitionBy("id", "value")) - 1) / 2
    r = series.select("id", "period", mid.alias("r")).groupBy("id").agg(F.sum(F.when(F.col("period") == 2, F.col("r"))).alias("s"), F.count_if(F.col("period") == 2).alias("m"), F.count_if(F.col("period") == 1).alias("n"))
    return r.select("id", F.abs((F.col("s") - F.col("m") * (F.col("m") + 1) / 2) / (F.col("n") * F.col("m")) - 0.5).alias("mw"))


def levene(series: DataFrame) -> DataFrame:
    """id, w: median-centred Levene statistic of history and online."""
    med = series.groupBy("id", "period").agg(F.percentile("value", 0.5).alias("med"))
    z = series.join(med, ["id", "period"]).withColumn("z", F.abs(F.col("value") - F.col("med")))
    g = z.groupBy("id", "period").agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    w = Window.partitionBy("id")
    g = g.withColumn("total", F.sum("n").over(w)).withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / F.col("total"))
    t = g.groupBy("id", "total").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), F.lit(2))).alias("b"), F.sum(F.col("n") * F.col("v")).alias("i"))
    return t.select("id", ((F.col("total") - 2) * F.col("b") / F.col("i")).alias("w"))


def segment_stats(series: DataFrame) -> DataFrame:
    """id, period, n, mean, sd (sample) and lag-1 autocorrelation; undefined values are null."""
    w = Window.partitionBy("id", "period")
    d = series.withColumn("d", F.col("value") - F.avg("value").over(w)).withColumn("l", F.lag("value").over(w.orderBy("pos")) - F.avg("value").over(w))
    css = F.sum(F.col("d") * F.col("d"))
    return d.groupBy("id", "period").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.when(css > 0, F.sum(F.col("d") * F.col("l")) / css).alias("acf1"))


def anderson_darling(series: DataFrame) -> DataFrame:
    """id, ad: the standardised two-sample Anderson-Darling statistic of history and online, with mid-ranks.

    A series with an empty part has no row; where all values are equal the distance before standardising is 0.
    """
    rows = series.select("id", "value", (F.col("period") == 1).cast("long").alias("h")).repartition("id")
    cells = rows.groupBy("id", "value").agg(F.sum("h").alias("f1"), F.count("*").alias("l"))
    upto = Window.partitionBy("id").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("id")
    cells = cells.withColumn("n1", F.sum("f1").over(every)).withColumn("n", F.sum("l").over(every))
    cells = cells.withColumn("b", F.sum("l").over(upto) - F.col("l") / 2).withColumn("m1", F.sum("f1").over(upto) - F.col("f1") / 2)
    n, l, b = F.col("n"), F.col("l"), F.col("b")
    room = b * (n - b) - n * l / 4
    term = lambda m, k: F.when(room > 0, l / n * F.pow(n * m - b * k, F.lit(2)) / room).otherwise(0.0)
    one = cells.groupBy("id", "n", "n1").agg(F.sum(term(F.col("m1"), F.col("n1"))).alias("t1"), F.sum(term(b - F.col("m1"), n - F.col("n1"))).alias("t2"))
    # the variance depends on the sizes only: two harmonic sums, folded over 1 .. n - 1
    size, n2 = F.col("n").cast("int"), F.col("n") - F.col("n1")
    start = F.struct(F.lit(0.0).alias("inner"), F.lit(0.0).alias("g"), F.lit(0.0).alias("h"))
    fold = F.aggregate(
        F.sequence(F.lit(1), size - 1),
        start,
        lambda s, j: F.struct((s["inner"] + 1.0 / (size - j)).alias("inner"), (s["g"] + s["inner"] / j).alias("g"), (s["h"] + 1.0 / j).alias("h")),
    )
    one = one.filter((F.col("n1") > 0) & (n2 > 0) & (n > 3)).withColumn("_f", fold)
    g, h, H = F.col("_f.g"), F.col("_f.h"), 1 / F.col("n1") + 1 / n2
    a = (4 * g - 6) + (10 - 6 * g) * H
    bb = (2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * H - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * H + 4 * h
    d = (2 * h + 6) * 4 - 8 * h
    x = n.cast("double")
    var = (a * x * x * x + bb * x * x + c * x + d) / ((x - 1) * (x - 2) * (x - 3))
    a2 = (F.col("t1") / F.col("n1") + F.col("t2") / n2) * (n - 1) / n
    return one.select("id", ((a2 - 1) / F.sqrt(var)).alias("ad"))


def fair_coin_p(k: int, n: int) -> float:
    """Two-sided exact p-value of k of n against a half: twice the smaller tail, at most 1; terms shrink by a ratio."""
    from math import exp, lgamma, log

    i = min(k, n - k)
    if n == 0 or 2 * i >= n:
        return 1.0
    term = exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2))
    total = 0.0
    while term > total * 1e-17:
        total += term
        term *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * total)


def break_rate(index: DataFrame) -> DataFrame:
    """n, k, p: series, series with a break, and the exact binomial test of their share against a half; one row."""
    @F.pandas_udf("double")
    def p_value(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([fair_coin_p(int(a), int(b)) for a, b in zip(k, n)])

    counts = index.agg(F.count("*").alias("n"), F.count_if(F.col("tau") >= 0).alias("k"))
    return counts.withColumn("p", p_value("k", "n"))


def variance_ratio(scored: DataFrame, cuts: DataFrame, e: str, scales=(2, 4, 8, 16, 32, 64, 128), least: int = 30) -> DataFrame:
    """id, scale, vr_z, dlog_vr: squared block sums after the cut against the history's, at each scale.

    vr_z is standardised by batch means of four scales and null where the history has fewer than two batches.
    """
    by_id, order = Window.partitionBy("id"), Window.partitionBy("id").orderBy("pos")
    rows = scored.withColumn("nh", F.count_if(F.col("period") == 1).over(by_id)).join(cuts, "id").withColumn("_k", F.row_number().over(order))
    block = lambda k: F.when(F.col("_k") >= k, F.pow(F.sum(e).over(order.rowsBetween(1 - k, 0)), F.lit(2)) / k)
    rows = rows.select("id", "period", "step", "t", "nh", "_k", *[block(k).alias(f"_s{k}") for k in scales])
    long = rows.select("id", "period", "step", "t", "nh", "_k", F.explode(F.array(*[F.struct(F.lit(k).alias("scale"), F.col(f"_s{k}").alias("s")) for k in scales])).alias("_b"))
    long = long.select("id", "_b.scale", "_b.s", "_k", "nh", (F.col("period") == 1).alias("past"), ((F.col("period") == 2) & (F.col("step") >= F.col("t"))).alias("post")).filter("s IS NOT NULL")
    # batches of four scales, counted from the first whole block; the last, partial one is left out
    batch = F.when(F.col("past"), F.floor((F.col("_k") - F.col("scale")) / (4 * F.col("scale"))))
    parts = long.withColumn("_batch", batch).groupBy("id", "scale", "nh", "_batch").agg(
        F.count_if("past").alias("c"), F.sum(F.when(F.col("past"), F.col("s"))).alias("sh"), F.count_if("post").alias("np"), F.sum(F.when(F.col("post"), F.col("s"))).alias("sp")
    )
    full = F.when(F.col("c") == 4 * F.col("scale"), F.col("sh") / F.col("c"))
    t = parts.groupBy("id", "scale").agg(
        (F.sum("sh") / F.sum("c")).alias("mh"), (F.sum("sp") / F.sum("np")).alias("mp"), F.sum("np").alias("np"), (F.stddev_samp(full) * F.sqrt(4 * F.first("scale"))).alias("sd")
    ).filter(F.col("np") >= least)
    return t.select("id", "scale", (F.abs(F.col("mp") - F.col("mh")) / F.col("sd") * F.sqrt("np")).alias("vr_z"), F.abs(F.ln(F.col("mp") + 1e-9) - F.ln(F.col("mh") + 1e-9)).alias("dlog_vr"))


def bootstrap_auc(scored: DataFrame, key: Column, draws: int = 200, size: int = 100) -> DataFrame:
    """draw, auc: the time-stratified AUC on ``size`` series drawn without replacement, ``draws`` times.

    ``key`` is an integer of a series that decides the draws. The rank limit runs in each task before the shuffle,
    and the picks, at most draws x size rows, are sent to all tasks.
    """
    ids = scored.select("id", F.pmod(key.cast("long"), F.lit(1000003)).alias("_key")).distinct()
    h = F.pmod(F.col("_key") * (2 * F.col("draw") + 1) * 69069 + F.col("draw") * 12345, F.lit(1000003))
    ranked = ids.select("id", "_key", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("_h", h)
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("draw").orderBy("_h", "id")))
    picks = ranked.filter(F.col("_r") <= size).select("draw", "id")
    rows = scored.join(F.broadcast(picks) if draws * size <= 100_000 else picks, "id")
    cells = rows.groupBy("draw", "step", "score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    below = Window.partitionBy("draw", "step").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    wins = cells.withColumn("q", F.col("n") - F.col("p")).withColumn("less", F.coalesce(F.sum("q").over(below), F.lit(0)))
    per = wins.groupBy("draw", "step").agg(F.sum(F.col("p") * (F.col("less") + F.col("q") / 2)).alias("won"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    total = F.sum(F.col("np") * F.col("nq"))
    return per.groupBy("draw").agg(F.when(total > 0, F.sum("won") / total).otherwise(0.5).alias("auc"))


def spread(draws: DataFrame) -> DataFrame:
    """mean, sd and the 5 and 95 % points of the draws; one row."""
    return draws.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("sd"), F.percentile("auc", 0.05).alias("q05"), F.percentile("auc", 0.95).alias("q95"))


def batch_sd(rows: DataFrame, column: str, sizes=(25, 50, 100)) -> DataFrame:
    """id and bm<size>: sd of non-overlapping block means times the root of the block's size; the rest of a series is no block."""
    out = None
    for n in sizes:
        blocks = rows.groupBy("id", F.floor((F.col("pos") - 1) / n).alias("_b")).agg(F.count("*").alias("_n"), F.avg(column).alias("_m"))
        one = blocks.groupBy("id").agg((F.stddev_samp(F.when(F.col("_n") == n, F.col("_m"))) * n**0.5).alias(f"bm{n}"))
        out = one if out is None else out.join(one, "id")
    return out


def portmanteau(rows: DataFrame, column: str, most=(10, 30)) -> DataFrame:
    """id and lb<lags>: sums of squared correlations with the values 1 to so many places before."""
    order = Window.partitionBy("id").orderBy("pos")
    wide = rows.select("id", column, *[F.lag(column, k).over(order).alias(f"_{k}") for k in range(1, max(most) + 1)])
    r = wide.groupBy("id").agg(*[F.corr(column, f"_{k}").alias(f"_{k}") for k in range(1, max(most) + 1)])
    return r.select("id", *[sum((F.col(f"_{k}") * F.col(f"_{k}") for k in range(1, n + 1)), F.lit(0.0)).alias(f"lb{n}") for n in most])


def quarter_moments(rows: DataFrame, column: str = "value") -> DataFrame:
    """id, mean (less the whole's) and sd (over the whole's) of the first and last quarter of the rows."""
    w = Window.partitionBy("id")
    rows = rows.withColumn("_r", F.row_number().over(w.orderBy("pos"))).withColumn("_n", F.count("*").over(w))
    q = F.floor(F.col("_n") / 4)
    ends = {"first": F.col("_r") <= q, "last": F.col("_r") > F.col("_n") - q}
    part = lambda k: F.when(ends[k], F.col(column))
    return rows.groupBy("id").agg(
        *[(F.avg(part(k)) - F.avg(column)).alias(f"mean_{k}_q") for k in ends], *[(F.stddev_pop(part(k)) / F.stddev_pop(column)).alias(f"sd_{k}_q") for k in ends]
    )
