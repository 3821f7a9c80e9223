"""Statistics on the scale of a series' own history: horizon curves, calibrated EWMA, null windows, random cuts, stage-2 features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows


#: Points of a history before its null is measured: exponential means need a start.
SKIP = 200


def curve(hist: DataFrame, column: str, skip: int = SKIP) -> DataFrame:
    """id and the horizon curve, after the first ``skip`` points, as one array, to be looked up in log-log steps.

    A history without points after that has no row; one of two or fewer has nulls.
    """
    h = windows.horizon_sd(hist.filter(F.col("pos") > skip), column)
    return h.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "sd"))), lambda x: x["sd"]).alias("curve"))


def centred(scored: DataFrame, column: str, skip: int = SKIP) -> DataFrame:
    """Adds e: the stream less its mean over the history after ``skip`` points."""
    kept = F.when((F.col("period") == 1) & (F.col("pos") > skip), F.col(column))
    return scored.withColumn("e", F.col(column) - F.avg(kept).over(Window.partitionBy("id")))


def inverse_sd(k: Column) -> Column:
    """1 / sd at horizon k: linear in logarithms between powers of two, root of time beyond the last."""
    x = F.least(F.log2(k.cast("double")), F.lit(10.0))
    lo = F.least(F.floor(x), F.lit(9)).cast("int")
    a, b = F.ln(F.greatest(F.get("curve", lo), F.lit(1e-9))), F.ln(F.greatest(F.get("curve", lo + 1), F.lit(1e-9)))
    known = F.get("curve", lo).isNotNull()  # greatest() passes over nulls
    return F.when(known, 1 / (F.exp(a + (x - lo) * (b - a)) * F.sqrt(F.greatest(k / 1024.0, F.lit(1.0)))))


def calibrated_sums(on: DataFrame, curves: DataFrame, e: str, widths=(16, 64, 256)) -> DataFrame:
    """Adds cal_sum and cal_w<width>: sums of a centred stream over the history's sd at their horizon; null without a curve."""
    on = on.withColumn("_n", F.row_number().over(windows.by_pos())).withColumn("_s", F.sum(e).over(windows.so_far()))
    on = on.withColumns({f"_w{w}": F.sum(e).over(windows.by_pos().rowsBetween(1 - w, 0)) for w in widths}).join(curves, "id", "left")
    sums = {"cal_sum": F.col("_s") * inverse_sd(F.col("_n"))} | {f"cal_w{w}": F.col(f"_w{w}") * inverse_sd(F.least(F.col("_n"), F.lit(w))) for w in widths}
    return on.withColumns(sums).drop("curve", "_n", "_s", *[f"_w{w}" for w in widths])


def recalibrated(on: DataFrame, curves: DataFrame, e: str, widths=(16, 64, 256)) -> DataFrame:
    """Running and windowed sums with the root of their horizon replaced by the history's sd at that horizon; null without a curve."""
    rows = windows.windowed_z(windows.running_z(on, e), e, widths).join(curves, "id", "left")
    factor = lambda h: F.sqrt(h) * inverse_sd(h)
    return rows.withColumns(
        {"sum_z": F.col("sum_z") * factor(F.col("n"))} | {f"w{w}": F.col(f"w{w}") * factor(F.least(F.col("n"), F.lit(w))) for w in widths}
    ).drop("curve")


def _runs(scored: DataFrame, e: str, alpha: float, skip: int) -> DataFrame:
    """Rows plus e (centred) and _w, its EWMA: history after ``skip`` points and online part are two runs from 0."""
    rows = centred(scored, e, skip).filter((F.col("period") == 2) | (F.col("pos") > skip))
    return windows._decayed(rows, alpha * F.col("e"), "_w", 1 - alpha, 0.0, ["id", "period"], True)


def _run_sd(alpha: float, skip: int) -> Column:
    """The rows that count for the sd of a history's EWMA: int(3 / alpha) steps after its start."""
    return F.when((F.col("period") == 1) & (F.col("pos") > skip + int(3 / alpha)), F.col("_w"))


def calibrated_ewma(scored: DataFrame, e: str, alpha: float = 0.03, skip: int = SKIP) -> DataFrame:
    """Online rows plus cal_ewma: the EWMA of the centred stream over its own sd in the history, int(3 / alpha) steps after ``skip``.

    Both windows and the sd share one exchange on id. A shorter history has no sd, and its rows get null.
    """
    rows = _runs(scored, e, alpha, skip)
    sd = F.stddev_pop(_run_sd(alpha, skip)).over(Window.partitionBy("id"))
    return rows.withColumn("cal_ewma", F.col("_w") / F.greatest(sd, F.when(sd.isNotNull(), 1e-9))).filter("period = 2").drop("e", "_w")


def calibration(scored: DataFrame, e: str, alpha: float = 0.03, skip: int = SKIP) -> DataFrame:
    """id, mu, curve, ew_sd: what the streaming twin needs of a history, fitted in batch. A short history has nulls."""
    hist = scored.filter("period = 1")
    kept = F.when(F.col("pos") > skip, F.col(e))
    means = hist.groupBy("id").agg(F.avg(kept).alias("mu"))
    spread = _runs(hist, e, alpha, skip).groupBy("id").agg(F.stddev_pop(_run_sd(alpha, skip)).alias("ew_sd"))
    return means.join(spread, "id", "left").join(curve(hist, e, skip), "id", "left").select("id", "mu", "curve", "ew_sd")


def _small(key: Column) -> Column:
    return F.pmod(key.cast("long"), F.lit(1000003))


#: Series of a group that random cuts are drawn in.
GROUP_SERIES = 100_000


def random_cuts(index: DataFrame, key: Column, groups: int | None = None) -> DataFrame:
    """id, t: the break, or for a series without one a cut at a relative place drawn from the series that have one.

    ``index`` has id, tau and online_len. ``key`` is an integer that decides the draw. Each of ``groups`` (one for every
    ``GROUP_SERIES`` series) draws from its own breaks, so neither ranking nor join runs in one task; in a group without
    breaks the cut is null.
    """
    groups = groups or max(1, -(-index.count() // GROUP_SERIES))
    rows = index.withColumn("_h", F.pmod(_small(key) * 1103515245 + 12345, F.lit(1000003))).withColumn("_g", F.pmod(key, F.lit(groups)))
    u = ((F.col("tau") + 0.5) / F.col("online_len")).alias("_u")
    order = Window.partitionBy("_g").orderBy(u, "id")
    given = rows.filter("tau >= 0").select("_g", (F.row_number().over(order) - 1).alias("_i"), u)
    counts = given.groupBy("_g").agg(F.count("*").alias("_c"))
    drawn = rows.join(counts, "_g", "left").withColumn("_i", F.when(F.col("tau") < 0, F.pmod(F.col("_h"), F.col("_c"))))
    drawn = drawn.join(given, ["_g", "_i"], "left")
    return drawn.select("id", F.when(F.col("tau") >= 0, F.col("tau")).otherwise(F.floor(F.col("_u") * F.col("online_len"))).cast("long").alias("t"))


#: Expected absolute value, and product of two, of a normal variable.
_ABS, _ABS2 = 0.7978845608028654, 0.6366197723675814
NULL_STATS = ["mean", "var", "abs", "acf1", "vol1"]


def whitened(scored: DataFrame, e: str, decay: float, burn: int = 200) -> DataFrame:
    """Adds w: the stream over its causal exponential volatility, standardised on the history after ``burn`` points."""
    rows = windows.volatility(scored.withColumn("_q", F.col(e) * F.col(e)), "_q", decay)
    rows = rows.withColumn("_w", F.col(e) / F.sqrt("vol"))
    kept = F.when((F.col("period") == 1) & (F.col("pos") > burn), F.col("_w"))
    by_id = Window.partitionBy("id")
    return rows.withColumn("w", (F.col("_w") - F.avg(kept).over(by_id)) / F.stddev_pop(kept).over(by_id)).drop("_q", "_w", "vol")


def null_windows(scored: DataFrame, cuts: DataFrame, e: str, key: Column, draws: int = 40, burn: int = 200, least: int = 50) -> DataFrame:
    """id and five statistics of the window after the cut, raw (mean_z ...) and against as many windows of the history (mean_cal ...).

    Windows are differences of prefix sums, so a draw joins three rows, not a whole window. Series with fewer
    than ``least`` points after the cut, or too short a history for the draws, have no row.
    """
    x, prev = F.col(e), F.lag(e).over(windows.by_pos())
    terms = {"s": x, "q": x * x, "a": F.abs(x), "p": F.coalesce(x * prev, F.lit(0.0)), "v": F.coalesce(F.abs(x) * F.abs(prev), F.lit(0.0))}
    prefix = scored.select("id", "pos", "period", x.alias("_x"), *[t.alias(f"_{c}") for c, t in terms.items()])
    prefix = prefix.select("id", "pos", *[F.sum(f"_{c}").over(windows.so_far()).alias(f"_{c}") for c in terms])
    size = scored.groupBy("id").agg(F.count_if(F.col("period") == 1).alias("nh"), F.count_if(F.col("period") == 2).alias("no"), F.first(_small(key)).alias("_key"))
    size = size.join(cuts, "id").filter(F.col("no") - F.col("t") >= least)
    size = size.withColumn("n", F.least(F.col("no") - F.col("t"), F.floor(F.col("nh") / 4))).filter(F.col("nh") - F.col("n") > burn)
    span = F.col("nh") - F.col("n") - burn
    draw = F.pmod(F.pmod(F.col("_key") * 69069 + F.col("j").cast("long") * 1103515245, F.lit(1000003)), span) + burn
    starts = size.withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1)))).withColumn("a", F.when(F.col("j") < 0, F.col("nh") + F.col("t")).otherwise(draw))
    ends = starts.select("id", "j", "n", F.explode(F.array(*[F.struct((F.col("a") + d).alias("pos"), F.lit(k).alias("k")) for d, k in ((0, 0), (1, 1), (F.col("n"), 2))])).alias("_p"))
    ends = ends.select("id", "j", "n", "_p.k", F.col("_p.pos").cast(scored.schema["pos"].dataType).alias("pos")).join(prefix, ["id", "pos"])
    at = lambda c, k: F.sum(F.when(F.col("k") == k, F.col(c)))
    sums = ends.groupBy("id", "j", "n").agg(*[(at(f"_{c}", 2) - at(f"_{c}", 0 if c in "sqa" else 1)).alias(c) for c in terms])
    n = F.col("n")
    made = {
        "mean": F.col("s") / F.sqrt(n), "var": (F.col("q") / n - 1) * F.sqrt(n / 2), "abs": (F.col("a") / n - _ABS) * F.sqrt(n),
        "acf1": F.col("p") / (n - 1) * F.sqrt(n), "vol1": (F.col("v") / (n - 1) - _ABS2) * F.sqrt(n),
    }
    values = sums.select("id", "j", *[made[c].alias(c) for c in NULL_STATS])
    real = lambda c: F.max(F.when(F.col("j") < 0, F.col(c)))
    null = lambda c: F.when(F.col("j") >= 0, F.col(c))
    return values.groupBy("id").agg(
        *[real(c).alias(f"{c}_z") for c in NULL_STATS], *[((real(c) - F.avg(null(c))) / F.stddev_pop(null(c))).alias(f"{c}_cal") for c in NULL_STATS]
    )


def stage2_features(scores: DataFrame, pseudo: DataFrame, stride: int = 4) -> DataFrame:
    """id, step and ten columns: a score against the scores of the same series' own null segment.

    ``scores`` and ``pseudo`` have id, step, s; the null's row for a step is the one at step / stride, at most its last.
    """
    order = Window.partitionBy("id").orderBy("step")
    null = pseudo.select(
        "id", (F.row_number().over(order) - 1).alias("_j"), F.col("s").alias("p_at"), F.avg("s").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("p_mean_to")
    )
    whole = pseudo.groupBy("id").agg(
        F.count("*").alias("_c"), F.avg("s").alias("p_mean"), F.greatest(F.stddev_pop("s"), F.lit(1e-3)).alias("p_sd"), F.percentile("s", 0.9).alias("p_q90")
    )
    j = F.least(F.floor(F.col("step") / stride), F.col("_c") - 1).cast("int")
    rows = scores.select("id", "step", "s").join(whole, "id").withColumn("_j", j).join(null, ["id", "_j"])
    s = F.col("s")
    return rows.select(
        "id", "step", "s", F.log1p("step").alias("logt"), "p_at", "p_mean_to", "p_mean", "p_sd", "p_q90",
        (s - F.col("p_at")).alias("s_m_at"), (s - F.col("p_mean_to")).alias("s_m_meanto"), ((s - F.col("p_mean")) / F.col("p_sd")).alias("s_z"),
    )
