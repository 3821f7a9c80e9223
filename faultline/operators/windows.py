"""Normal scores, streams and sequential statistics as window expressions over canonical series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normal import ndtri


def by_pos():
    return Window.partitionBy("id").orderBy("pos")


def by_value():
    return Window.partitionBy("id").orderBy("value")


def so_far():
    return by_pos().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rank_join(series: DataFrame) -> DataFrame:
    """Adds bl and br, the numbers of history values below, and at or below, each value: one sort, no join."""
    h = (F.col("period") == 1).cast("long")
    br = F.sum(h).over(by_value().rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum(h).over(by_value().rangeBetween(Window.currentRow, Window.currentRow))
    return series.withColumn("br", br).withColumn("bl", F.col("br") - same).withColumn("n_hist", F.sum(h).over(Window.partitionBy("id")))


def normal_scores(series: DataFrame) -> DataFrame:
    """Adds u, the mid-rank in history as a probability, and g, its normal score."""
    u = ((F.col("bl") + F.col("br")) / 2.0 + 0.5) / (F.col("n_hist") + 1)
    return rank_join(series).withColumn("u", u).withColumn("g", ndtri("u"))


def history_moments(series: DataFrame) -> DataFrame:
    """id, mu, sd of the history, with population sd and a floor."""
    return series.filter("period = 1").groupBy("id").agg(F.avg("value").alias("mu"), F.greatest(F.stddev_pop("value"), F.lit(1e-8)).alias("sd"))


def standardised(series: DataFrame) -> DataFrame:
    """Adds z, from the history's moments as window aggregates over the same partitioning."""
    w = Window.partitionBy("id")
    h = F.when(F.col("period") == 1, F.col("value"))
    return series.withColumn("z", (F.col("value") - F.avg(h).over(w)) / F.greatest(F.stddev_pop(h).over(w), F.lit(1e-8)))


def streams(scored: DataFrame) -> DataFrame:
    """The analytic streams of z and g that need no fit, one column each; lags run across history and online."""
    lag = lambda c, k: F.lag(c, k).over(by_pos())
    g, z = F.col("g"), F.col("z")
    tail, centre = 1.6448536269514722, 0.2533471031357997
    cols: dict[str, Column] = {
        "z2": z * z, "g2": g * g, "absg": F.abs(g), "g3": g * g * g, "g4": F.least(g * g * g * g, F.lit(50.0)),
        "tail": (F.abs(g) > tail).cast("double"), "upper": (g > 0).cast("double"), "center": (F.abs(g) < centre).cast("double"),
        "zz1": z * lag("z", 1), "absdz": F.abs(z - lag("z", 1)), "dz2": F.pow(z - lag("z", 1), F.lit(2)),
        "vol1": F.abs(g) * F.abs(lag("g", 1)), "vol5": F.abs(g) * F.abs(lag("g", 5)), "sgn1": F.signum(g) * F.signum(lag("g", 1)),
    }
    cols |= {f"gg{k}": g * lag("g", k) for k in (1, 2, 3, 5, 10)}
    return scored.withColumns(cols)


def residual_streams(rows: DataFrame) -> DataFrame:
    """Adds absr, r2, rg2 and absrg of the autoregressive residual r: its powers, and its normal score among those of the history."""
    known = rows.filter(F.col("r").isNotNull()).select("id", "pos", "period", F.col("r").alias("value"))
    score = normal_scores(known).select("id", "pos", F.col("g").alias("_rg"))
    r, rg = F.col("r"), F.col("_rg")
    return rows.join(score, ["id", "pos"], "left").withColumns({"absr": F.abs(r), "r2": r * r, "rg2": rg * rg, "absrg": F.abs(rg)}).drop("_rg")


def volatility_streams(scored: DataFrame, decay: float = 0.94) -> DataFrame:
    """Adds zf2, the square of z over the volatility before it."""
    return volatility(scored.withColumn("_q", F.col("z") * F.col("z")), "_q", decay).withColumn("zf2", F.col("_q") / F.col("vol")).drop("_q", "vol")


def calibrated_streams(scored: DataFrame, decays=(0.97, 0.99)) -> DataFrame:
    """Adds the level, square, size, lag-1 product and size product of g, and of g over its volatility for each decay."""
    bases = {"g": F.col("g")}
    for d in decays:
        name = f"w{round(100 * d)}"
        scored = volatility(scored.withColumn("_q", F.col("g") * F.col("g")), "_q", d).withColumn(f"{name}_lvl", F.col("g") / F.sqrt("vol")).drop("_q", "vol")
        bases[name] = F.col(f"{name}_lvl")
    before = {n: F.coalesce(F.lag(b).over(by_pos()), F.lit(0.0)) for n, b in bases.items()}
    cols = {f"{n}_lvl": b for n, b in bases.items()} | {f"{n}_sq": b * b for n, b in bases.items()} | {f"{n}_abs": F.abs(b) for n, b in bases.items()}
    cols |= {f"{n}_ac1": b * before[n] for n, b in bases.items()} | {f"{n}_vol1": F.abs(b) * F.abs(before[n]) for n, b in bases.items()}
    return scored.withColumns(cols)


def ordinal_pattern(series: DataFrame, column: str = "value") -> DataFrame:
    """Adds pattern, a code of the three pairwise comparisons of a value and the two before it."""
    a, b, c = F.lag(column, 2).over(by_pos()), F.lag(column, 1).over(by_pos()), F.col(column)
    return series.withColumn("pattern", (a < b).cast("int") * 4 + (b < c).cast("int") * 2 + (a < c).cast("int"))


def running_z(on: DataFrame, e: str) -> DataFrame:
    """n, log_n and the running sum of a standardised stream over its root n."""
    n = F.row_number().over(by_pos())
    return on.withColumn("n", n).withColumn("log_n", F.ln("n")).withColumn("sum_z", F.sum(e).over(so_far()) / F.sqrt("n"))


def windowed_z(on: DataFrame, e: str, widths=(16, 64, 256)) -> DataFrame:
    on = on.withColumn("n", F.row_number().over(by_pos()))
    return on.withColumns({f"w{w}": F.sum(e).over(by_pos().rowsBetween(1 - w, 0)) / F.sqrt(F.least(F.col("n"), F.lit(w))) for w in widths})


def cusum(on: DataFrame, e: str, k: float) -> DataFrame:
    """Two-sided Page statistics in closed form: a running sum less its own running minimum."""
    up, dn = F.sum(F.col(e) - k).over(so_far()), F.sum(-F.col(e) - k).over(so_far())
    on = on.withColumn("_u", up).withColumn("_d", dn)
    least = lambda c: F.least(F.lit(0.0), F.min(c).over(so_far()))
    return on.withColumn("cusum_up", F.col("_u") - least("_u")).withColumn("cusum_dn", F.col("_d") - least("_d")).drop("_u", "_d")


def _decayed(rows: DataFrame, x: Column, name: str, decay: float, start: float, by: list[str], after: bool) -> DataFrame:
    """Adds ``name``, the value after (or before) each row of s <- decay * s + x in order of pos, s being ``start`` at first; exact.

    Inside a block of places the sum is closed, a running sum of x / decay ** place; what earlier blocks leave is folded from
    their last values, few numbers even in a long series. All windows share the partitioning by ``by``.
    """
    if not 0 < decay < 1:
        raise ValueError("a decay is between 0 and 1")
    size = max(1, int(-200 / math.log(decay)))  # weights of a block stay below e ** 200
    order = Window.partitionBy(*by).orderBy("pos")
    rows = rows.withColumn("_x", x.cast("double")).withColumn("_i", F.row_number().over(order) - 1)
    rows = rows.withColumn("_b", F.floor(F.col("_i") / size)).withColumn("_i", F.col("_i") % size)
    power = lambda k: F.pow(F.lit(decay), k)
    inside, scaled = Window.partitionBy(*by, "_b").orderBy("pos"), F.col("_x") / power(F.col("_i"))
    upto = lambda last: F.coalesce(F.sum(scaled).over(inside.rowsBetween(Window.unboundedPreceding, last)), F.lit(0.0))
    rows = rows.withColumns({"_s": upto(0) * power(F.col("_i")), "_p": upto(-1) * power(F.col("_i") - 1)})
    last = F.collect_list(F.when(F.col("_i") == size - 1, F.col("_s"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    carried = F.aggregate(last, F.lit(float(start)), lambda s, t: s * decay**size + t)
    if after:
        value = F.col("_s") + F.col("_carry") * power(F.col("_i") + 1)
    else:
        value = F.col("_p") + F.col("_carry") * power(F.col("_i"))
    return rows.withColumn("_carry", carried).withColumn(name, value).drop("_x", "_i", "_b", "_s", "_p", "_carry")


def ewma(on: DataFrame, e: str, alpha: float = 0.03) -> DataFrame:
    """Exponentially weighted sum from 0, over its limiting sd."""
    rows = _decayed(on, alpha * F.col(e), "ewma", 1 - alpha, 0.0, ["id"], True)
    return rows.withColumn("ewma", F.col("ewma") * ((2 - alpha) / alpha) ** 0.5)


def volatility(scored: DataFrame, square: str, decay: float) -> DataFrame:
    """Exponential mean of the squares before each row, started at 1: causal, over history and online."""
    return _decayed(scored, (1 - decay) * F.col(square), "vol", decay, 1.0, ["id"], False)


def best_start(values, block: int = 256):
    """For each place the signed likelihood ratio over all starts and the age of the best start, the first on ties.

    Of (start, sum before it) only corners of the convex hull can be best; blocks of places meet the corners of all
    earlier starts and every start of their own, so the work is far below the square of the length and memory is bounded.
    """
    import numpy as np

    s = np.concatenate([[0.0], np.cumsum(values)])
    n = len(values)
    stat, age = np.empty(n), np.empty(n)
    corners = np.empty(0, np.int64)
    for a in range(0, n, block):
        b = min(n, a + block)
        own = np.arange(a, b)
        starts, ends = np.concatenate([corners, own]), np.arange(a + 1, b + 1)
        diff = s[ends][:, None] - s[starts][None, :]
        span = ends[:, None] - starts[None, :]
        ratio = np.where(span > 0, diff * diff / np.maximum(span, 1), -1.0)
        best = ratio.argmax(axis=1)
        rows = np.arange(b - a)
        age[a:b] = span[rows, best]
        stat[a:b] = diff[rows, best] / np.sqrt(age[a:b])
        corners = _hull(starts, s)
    return stat, age


def _hull(starts, s):
    """The starts at corners of the upper or lower hull of (start, s[start]); ``starts`` ascend."""
    import numpy as np

    kept = []
    for sign in (1.0, -1.0):
        up = []
        for j in starts.tolist():
            y = sign * s[j]
            while len(up) > 1 and (y - up[-1][1]) * (up[-1][0] - up[-2][0]) > (up[-1][1] - up[-2][1]) * (j - up[-1][0]):
                up.pop()
            up.append((j, y))
        kept += [j for j, _ in up]
    return np.unique(kept).astype(np.int64)


def glr(on: DataFrame, e: str) -> DataFrame:
    """Adds n, and glr and glr_age: likelihood ratio over all unknown starts, signed, and log age of the first best start.

    A maximum over all starts has no window of its own, so a series, which is bounded in length, is one Arrow group.
    """
    on = on.withColumn("n", F.row_number().over(by_pos()).cast("double"))

    def scan(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("pos")
        stat, age = best_start(table.column(e).to_numpy())
        return table.append_column("glr", pa.array(stat, pa.float64())).append_column("glr_age", pa.array(np.log(age), pa.float64()))

    schema = T.StructType([*on.schema.fields, T.StructField("glr", T.DoubleType()), T.StructField("glr_age", T.DoubleType())])
    return on.groupBy("id").applyInArrow(scan, schema)


def long_run_sd(hist: DataFrame, column: str) -> DataFrame:
    """id, lrsd: Bartlett long-run sd with ceil(n ** (1/3)) lags, clamped as a null model needs it.

    Every row takes the products with so many values before it from one array, so series of any length have all their lags.
    """
    w = Window.partitionBy("id")
    d = hist.withColumn("_n", F.count("*").over(w)).withColumn("_d", F.col(column) - F.avg(column).over(w)).withColumn("_l", F.ceil(F.pow(F.col("_n"), F.lit(1 / 3)) - 1e-9).cast("int"))
    longest = d.agg(F.max("_l")).head()[0] or 0
    lags = F.collect_list("_d").over(by_pos().rowsBetween(-longest, 0)) if longest else F.array("_d")
    one = d.withColumn("_a", F.reverse(lags)).select("id", "_n", "_l", "_d", F.posexplode(F.slice("_a", 1, F.col("_l") + 1)).alias("_j", "_v"))
    per = one.groupBy("id", "_n", "_l", "_j").agg((F.sum(F.col("_d") * F.col("_v")) / F.col("_n")).alias("_g"))
    weight = F.when(F.col("_j") == 0, 1.0).otherwise(2 * (1 - F.col("_j") / (F.col("_l") + 1)))
    out = per.groupBy("id").agg(F.max(F.when(F.col("_j") == 0, F.col("_g"))).alias("_g0"), F.sum(weight * F.col("_g")).alias("_t"))
    return out.select("id", F.when(F.col("_g0") <= 0, 1e-6).otherwise(F.sqrt(F.greatest("_t", 0.1 * F.col("_g0")))).alias("lrsd"))


def horizon_sd(hist: DataFrame, column: str, most: int = 10) -> DataFrame:
    """id, h (log2 of the horizon), sd of rolling sums; horizons of half the length (rounded down) and more extend the last by root of time."""
    c = hist.withColumn("_c", F.sum(column).over(so_far())).withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    ks = [2**j for j in range(most + 1)]
    diffs = c.select("id", "_n", *[F.when(F.row_number().over(by_pos()) >= k, F.col("_c") - F.coalesce(F.lag("_c", k).over(by_pos()), F.lit(0.0))).alias(f"_{k}") for k in ks])
    sds = diffs.groupBy("id").agg(F.max("_n").alias("n"), *[F.stddev_pop(f"_{k}").alias(f"_{k}") for k in ks])
    long = sds.select("id", "n", F.posexplode(F.array(*[F.when(F.floor(F.col("n") / 2) > k, F.col(f"_{k}")) for k in ks])).alias("h", "sd"))
    last = F.last("sd", True).over(Window.partitionBy("id").orderBy("h"))
    at = F.last(F.when(F.col("sd").isNotNull(), F.col("h")), True).over(Window.partitionBy("id").orderBy("h"))
    return long.select("id", "h", (last * F.pow(F.lit(2.0), (F.col("h") - at) / 2)).alias("sd"))
