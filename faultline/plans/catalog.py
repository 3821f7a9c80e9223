"""All queries of the engine by operator handle, each with DuckDB SQL for the same rows where SQL can say it.

Series come from ``events`` by type, cut into chunks of HIST + ONLINE points; what is left after the last makes that one's
online part longer, and a type of fewer rows is one short series, so all rows enter. The index of breaks is a fixed
rule on the series' name and length; no feature reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normal import for_duckdb, ndtri_sql
from ..operators import bayes, calibrated, features, fits, stats, windows
from ..sources import series as src

HIST, ONLINE = 450, 150
_Q: dict = {}
_SQL: dict[str, str] = {}

OBS = f"""
WITH obs AS (
  SELECT event_type || '-' || chunk AS id, chunk, event_type AS kind, CASE WHEN rn - chunk * {HIST + ONLINE} <= h THEN 1 ELSE 2 END AS period, rn - chunk * {HIST + ONLINE} AS pos,
         CASE WHEN rn - chunk * {HIST + ONLINE} > h THEN rn - chunk * {HIST + ONLINE} - h - 1 END AS step, value
  FROM (SELECT event_type, value, rn, least((rn - 1) // {HIST + ONLINE}, greatest(n // {HIST + ONLINE} - 1, 0)) AS chunk,
               CASE WHEN n >= {HIST + ONLINE} THEN {HIST} ELSE greatest(n * {HIST} // {HIST + ONLINE}, 1) END AS h
        FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events))
), sz AS (
  SELECT id, chunk, kind, count_if(period = 1)::BIGINT AS nh, count_if(period = 2)::BIGINT AS nl FROM obs GROUP BY ALL
), brk AS (
  SELECT id, CASE WHEN chunk % 2 = 0 THEN (30 + 7 * chunk + length(kind)) % greatest(nl, 1) ELSE -1 END AS tau FROM sz
), ranked AS (
  SELECT *, sum((period = 1)::INT) OVER (PARTITION BY id ORDER BY value RANGE UNBOUNDED PRECEDING) AS br,
         sum((period = 1)::INT) OVER (PARTITION BY id ORDER BY value RANGE UNBOUNDED PRECEDING) - sum((period = 1)::INT) OVER (PARTITION BY id, value) AS bl,
         sum((period = 1)::INT) OVER (PARTITION BY id) AS nh FROM obs
), pit AS (
  SELECT *, ((bl + br) / 2.0::DOUBLE + 0.5) / (nh + 1) AS u FROM ranked
), sc AS (
  SELECT id, period, pos, step, value, u, {for_duckdb(ndtri_sql("u"))} AS g,
         (value - avg(CASE WHEN period = 1 THEN value END) OVER (PARTITION BY id)) / greatest(stddev_pop(CASE WHEN period = 1 THEN value END) OVER (PARTITION BY id), 1e-8) AS z FROM pit
), onl AS (
  SELECT id, pos, step, g, z, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM sc WHERE period = 2
)
"""


def query(name: str, sql=None):
    """Registers a query with the SQL that follows OBS, as text or as a function that gives it once the module is read."""

    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def observations(spark: SparkSession, sf_dir: str, hist: int = HIST, online: int = ONLINE) -> DataFrame:
    return src.chunked(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "event_id", "value", hist, online)


def sizes(obs: DataFrame) -> DataFrame:
    """id, chunk, nh and nl: lengths of a series' history and online part."""
    return obs.groupBy("id", "chunk").agg(F.count_if(F.col("period") == 1).alias("nh"), F.count_if(F.col("period") == 2).alias("nl"))


def break_index(obs: DataFrame) -> DataFrame:
    k = F.length(F.regexp_extract("id", "^(.*)-", 1))
    tau = (30 + 7 * F.col("chunk") + k) % F.greatest("nl", F.lit(1))
    return sizes(obs).select("id", F.when(F.col("chunk") % 2 == 0, tau).otherwise(-1).cast("int").alias("tau"))


def scored(spark, sf_dir, **kw) -> DataFrame:
    return windows.standardised(windows.normal_scores(observations(spark, sf_dir, **kw)))


def online(spark, sf_dir, **kw) -> DataFrame:
    return scored(spark, sf_dir, **kw).filter("period = 2").select("id", "pos", "step", "g", "z")


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running two-sided CUSUM of the normal score of every event series."""
    on = scored(spark, sf_dir, hist=100, online=50).filter("period = 2").select("id", "pos", "step", "g")
    return windows.cusum(on, "g", 0.1).select("id", "step", *_r("g", "cusum_up", "cusum_dn"))


# Scans, groups and alignment


@query("src_01", "SELECT event_type AS id, event_id AS pos, value FROM events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("id"), F.col("event_id").alias("pos"), "value")


@query("src_02", "SELECT DISTINCT id FROM obs")
def _(s, d):
    return observations(s, d).select("id").distinct()


@query("src_03", "SELECT id, min(pos) AS first_pos, max(pos) + 1 AS end_pos FROM obs GROUP BY id")
def _(s, d):
    return observations(s, d).groupBy("id").agg(F.min("pos").alias("first_pos"), (F.max("pos") + 1).alias("end_pos"))


@query("src_04_agg_06", "SELECT id, count_if(period = 1)::BIGINT AS hist_len, count_if(period = 2)::BIGINT AS online_len FROM obs GROUP BY id")
def _(s, d):
    return observations(s, d).groupBy("id").agg(F.count_if(F.col("period") == 1).alias("hist_len"), F.count_if(F.col("period") == 2).alias("online_len"))


@query("src_05_jon_01", "SELECT id, tau FROM brk")
def _(s, d):
    obs = observations(s, d)
    return src.with_breaks(obs.select("id").distinct(), break_index(obs))


@query("src_06", "SELECT DISTINCT id, -1 AS tau FROM obs")
def _(s, d):
    return src.with_breaks(observations(s, d).select("id").distinct(), None)


@query("src_07", "SELECT id, step, value FROM obs WHERE period = 2")
def _(s, d):
    return observations(s, d).filter("period = 2").select("id", "step", "value")


@query("src_08", "SELECT id, count(*) AS n, round(list_sum(list(value ORDER BY pos)[1:10]), 6) AS head_sum, round(max_by(value, pos), 6) AS last_value FROM obs GROUP BY id")
def _(s, d):
    a = F.array_sort(F.collect_list(F.struct("pos", "value")))
    t = observations(s, d).groupBy("id").agg(a.alias("a"))
    total = F.aggregate(F.slice("a", 1, 10), F.lit(0.0), lambda acc, x: acc + x["value"])
    return t.select("id", F.size("a").cast("long").alias("n"), F.round(total, 6).alias("head_sum"), F.round(F.element_at("a", -1)["value"], 6).alias("last_value"))


@query("src_09", "SELECT o.id, o.step, (tau <> -1 AND step >= tau)::INT AS label FROM obs o JOIN brk USING (id) WHERE period = 2")
def _(s, d):
    obs = observations(s, d)
    return src.labels(obs, break_index(obs))


@query("src_10", "SELECT id, pos, value FROM obs WHERE id = 'click-0'")
def _(s, d):
    return observations(s, d).filter(F.col("id") == "click-0").select("id", "pos", "value")


@query("src_11", "SELECT count(*) AS n_series, count_if(tau <> -1)::BIGINT AS n_breaks FROM brk")
def _(s, d):
    return break_index(observations(s, d)).agg(F.count("*").alias("n_series"), F.count_if(F.col("tau") != -1).alias("n_breaks"))


@query("src_validate", "SELECT id, '' AS reason FROM obs WHERE FALSE")
def _(s, d):
    obs = observations(s, d)
    return src.validate(obs, break_index(obs))


@query("src_validate_bad", "SELECT DISTINCT id, CASE WHEN kind = 'click' THEN 'interleaved periods' ELSE 'no index row' END AS reason FROM obs WHERE kind IN ('click', 'view') AND nullif(chunk, 1) IS NOT NULL")
def _(s, d):
    """The invariants on series that were damaged: the last row of some is history, others have no index row."""
    obs = observations(s, d)
    damaged = obs.withColumn("period", F.when(F.col("id").startswith("click-") & (F.col("chunk") != 1) & F.col("step").isNotNull() & (F.col("step") % 7 == 1), 1).otherwise(F.col("period")))
    return src.validate(damaged, break_index(obs).filter(~(F.col("id").startswith("view-") & ~F.col("id").endswith("-1"))))


# Projections and filters


@query("prj_01_02", "SELECT id, step, round(g * g, 6) AS g2, round(abs(g), 6) AS absg FROM onl")
def _(s, d):
    wide = windows.streams(scored(s, d)).filter("period = 2")
    keep = [c for c in wide.columns if c in ("g2", "absg", "not_there")]
    return wide.select("id", "step", *_r(*keep))


@query("prj_03", "SELECT id, step, round(g, 6) AS g, round(z, 6) AS z FROM onl")
def _(s, d):
    on = online(s, d)
    return on.select("id", "step", *_r("g")).join(on.select("id", "step", *_r("z")), ["id", "step"])


@query("flt_01", "SELECT id, step, value FROM obs WHERE period = 2 AND step % 2 = 0")
def _(s, d):
    return observations(s, d).filter("period = 2 AND step % 2 = 0").select("id", "step", "value")


@query("flt_02", "SELECT DISTINCT id FROM obs WHERE chunk % 2 = 0")
def _(s, d):
    return observations(s, d).filter("chunk % 2 = 0").select("id").distinct()


@query("flt_02_half", "SELECT DISTINCT id FROM obs WHERE ('0x' || substr(md5(id), 1, 8))::BIGINT % 2 = 0")
def _(s, d):
    """A random half of the series, drawn by hash."""
    return observations(s, d).select("id").distinct().filter(fold_of("id", 2) == 0)


@query("flt_03", f"SELECT id, nl - tau AS n_post FROM brk JOIN sz USING (id) WHERE tau <> -1 AND nl - tau >= 100")
def _(s, d):
    obs = observations(s, d)
    return break_index(obs).filter("tau <> -1").join(sizes(obs), "id").select("id", (F.col("nl") - F.col("tau")).alias("n_post")).filter("n_post >= 100")


@query("flt_04", "SELECT id, pos FROM obs WHERE id IN (SELECT id FROM brk WHERE tau <> -1) AND pos <= 20")
def _(s, d):
    obs = observations(s, d)
    return obs.filter("pos <= 20").join(break_index(obs).filter("tau <> -1"), "id", "left_semi").select("id", "pos")


@query("flt_05", "SELECT id, step FROM onl WHERE n > 1 AND g IS NOT NULL")
def _(s, d):
    prev = F.lag("g").over(windows.by_pos())
    return online(s, d).withColumn("score", F.when(prev.isNotNull(), F.col("g"))).filter(F.col("score").isNotNull()).select("id", "step")


@query("flt_06", "SELECT id, count(*) AS n FROM obs WHERE period = 1 AND pos > 200 GROUP BY id")
def _(s, d):
    return observations(s, d).filter("period = 1 AND pos > 200").groupBy("id").agg(F.count("*").alias("n"))


# Rank join and normal scores


@query("jon_02", "SELECT id, pos, bl::BIGINT AS bl, br::BIGINT AS br FROM ranked")
def _(s, d):
    return windows.rank_join(observations(s, d)).select("id", "pos", "bl", "br")


@query("nsc_01", "SELECT id, pos, round(g, 6) AS g FROM sc")
def _(s, d):
    return windows.normal_scores(observations(s, d)).select("id", "pos", *_r("g"))


@query("nsc_02", "SELECT id, pos, least(floor(u * 16), 15)::INT AS bin FROM sc")
def _(s, d):
    return windows.normal_scores(observations(s, d)).select("id", "pos", F.least(F.floor(F.col("u") * 16), F.lit(15)).cast("int").alias("bin"))


# Aggregates


@query("agg_01", "SELECT id, round(avg(value), 6) AS mu, round(greatest(stddev_pop(value), 1e-8), 6) AS sd FROM obs WHERE period = 1 GROUP BY id")
def _(s, d):
    return windows.history_moments(observations(s, d)).select("id", *_r("mu", "sd"))


_SEG = """, seg AS (
  SELECT id, period, value - avg(value) OVER (PARTITION BY id, period) AS d, value, lag(value) OVER (PARTITION BY id, period ORDER BY pos) - avg(value) OVER (PARTITION BY id, period) AS l FROM obs
), st AS (SELECT id, period, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, sum(d * l) / sum(d * d) AS acf1 FROM seg GROUP BY id, period)"""


@query("agg_02_agg_13", _SEG + " SELECT id, period, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(acf1, 6) AS acf1 FROM st")
def _(s, d):
    return stats.segment_stats(observations(s, d)).select("id", "period", "n", *_r("mean", "sd", "acf1"))


@query("agg_03", _SEG + " SELECT a.id, round((b.mean - a.mean) / a.sd, 6) AS d_mean, round(ln(b.sd / a.sd), 6) AS d_sd, round(b.acf1 - a.acf1, 6) AS d_acf FROM st a JOIN st b ON a.id = b.id AND a.period = 1 AND b.period = 2")
def _(s, d):
    t = stats.segment_stats(observations(s, d))
    p = lambda c, k: F.max(F.when(F.col("period") == k, F.col(c)))
    return t.groupBy("id").agg(
        F.round((p("mean", 2) - p("mean", 1)) / p("sd", 1), 6).alias("d_mean"), F.round(F.ln(p("sd", 2) / p("sd", 1)), 6).alias("d_sd"), F.round(p("acf1", 2) - p("acf1", 1), 6).alias("d_acf")
    )


@query("agg_04", """, a AS (SELECT id, count(*) AS n, avg(z) AS m, stddev_pop(z) AS s0, stddev_samp(z) AS s1 FROM sc WHERE period = 1 GROUP BY id)
SELECT round(stddev_pop(m * sqrt(n)), 6) AS mean_spread, round(stddev_pop((s0 - 1) * sqrt(2 * n)), 6) AS sd0_spread, round(stddev_pop((s1 - 1) * sqrt(2 * n)), 6) AS sd1_spread FROM a""")
def _(s, d):
    a = scored(s, d).filter("period = 1").groupBy("id").agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.stddev_pop("z").alias("s0"), F.stddev_samp("z").alias("s1"))
    f = lambda c, x: F.round(F.stddev_pop(x), 6).alias(c)
    return a.agg(f("mean_spread", F.col("m") * F.sqrt("n")), f("sd0_spread", (F.col("s0") - 1) * F.sqrt(2 * F.col("n"))), f("sd1_spread", (F.col("s1") - 1) * F.sqrt(2 * F.col("n"))))


@query("agg_05_tst_06", ", b AS (SELECT least(floor(u * 10), 9)::INT AS bin FROM sc), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) SELECT bin, n, round(pow(n - t / 10.0, 2) / (t / 10.0), 6) AS chi FROM c, (SELECT sum(n) AS t FROM c)")
def _(s, d):
    c = windows.normal_scores(observations(s, d)).select(F.least(F.floor(F.col("u") * 10), F.lit(9)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    e = F.sum("n").over(Window.partitionBy(F.lit(1))) / 10  # ten rows
    return c.select("bin", "n", F.round(F.pow(F.col("n") - e, F.lit(2)) / e, 6).alias("chi"))


_LAB = ", lab AS (SELECT o.id, o.step, o.g, o.z, (tau <> -1 AND o.step >= tau)::INT AS label FROM onl o JOIN brk USING (id))"


def labelled(s, d) -> DataFrame:
    obs = observations(s, d)
    return online(s, d).join(src.labels(obs, break_index(obs)), ["id", "step"])


@query("agg_07", _LAB + " SELECT step, count(*) AS n, sum(label)::BIGINT AS n_pos FROM lab GROUP BY step")
def _(s, d):
    return labelled(s, d).groupBy("step").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


@query("agg_08_jon_06_trn_08", _LAB + ", w AS (SELECT *, sum(label) OVER (PARTITION BY step) * (count(*) OVER (PARTITION BY step) - sum(label) OVER (PARTITION BY step)) / count(*) OVER (PARTITION BY step)::DOUBLE AS w FROM lab) SELECT id, step, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def _(s, d):
    return stats.step_weights(labelled(s, d)).select("id", "step", *_r("weight"))


_LRV = """, d AS (SELECT id, pos, g - avg(g) OVER (PARTITION BY id) AS d, count(*) OVER (PARTITION BY id) AS n FROM sc WHERE period = 1), e AS (SELECT *, ceil(pow(n, 1 / 3.0::DOUBLE) - 1e-9) AS m FROM d),
l AS (SELECT a.id, j, max(a.m) AS m, sum(a.d * b.d) / max(a.n) AS gj FROM e a JOIN (SELECT unnest(range(0, 100)) AS j) ON j <= a.m JOIN e b ON a.id = b.id AND b.pos = a.pos - j GROUP BY a.id, j),
lr AS (SELECT id, CASE WHEN max(CASE WHEN j = 0 THEN gj END) <= 0 THEN 1e-6 ELSE sqrt(greatest(sum(CASE WHEN j = 0 THEN gj ELSE 2 * (1 - j / (m + 1.0)) * gj END), 0.1 * max(CASE WHEN j = 0 THEN gj END))) END AS lrsd FROM l GROUP BY id)"""


@query("agg_09", _LRV + " SELECT id, round(lrsd, 6) AS lrsd FROM lr")
def _(s, d):
    return windows.long_run_sd(scored(s, d).filter("period = 1"), "g").select("id", *_r("lrsd"))


@query("agg_10_agg_11", ", b AS (SELECT id, (pos - 1) // 25 AS b, count(*) AS n, avg(g) AS m FROM sc WHERE period = 1 GROUP BY ALL HAVING count(*) = 25) SELECT id, round(stddev_samp(m) * 5, 6) AS bm25 FROM b GROUP BY id")
def _(s, d):
    b = scored(s, d).filter("period = 1").groupBy("id", F.floor((F.col("pos") - 1) / 25).alias("b")).agg(F.count("*").alias("n"), F.avg("g").alias("m")).filter("n = 25")
    return b.groupBy("id").agg(F.round(F.stddev_samp("m") * 5, 6).alias("bm25"))


def _hsd_sql(skip: int, e: str = "g") -> str:
    """CTEs up to hs, the horizon curve (id, h, sd) of the history after ``skip`` points."""
    return f""", c AS (SELECT id, pos - {skip} AS pos, sum({e}) OVER (PARTITION BY id ORDER BY pos) AS c, count(*) OVER (PARTITION BY id) AS n FROM sc WHERE period = 1 AND pos > {skip}),
k AS (SELECT unnest(range(0, 11)) AS h), r AS (SELECT a.id, h, stddev_pop(a.c - coalesce(b.c, 0)) AS sd FROM c a JOIN k ON a.pos >= 1 << h LEFT JOIN c b ON b.id = a.id AND b.pos = a.pos - (1 << h) WHERE a.n // 2 > 1 << h GROUP BY a.id, h),
m AS (SELECT id, max(h) AS mh, max_by(sd, h) AS msd FROM r GROUP BY id), ids AS (SELECT DISTINCT id FROM c),
hs AS (SELECT ids.id, k.h, coalesce(r.sd, msd * pow(2.0, (k.h - mh) / 2.0)) AS sd FROM ids JOIN k ON TRUE LEFT JOIN m ON m.id = ids.id LEFT JOIN r ON r.id = ids.id AND r.h = k.h)"""


_HSD = _hsd_sql(calibrated.SKIP)


@query("agg_12_cal_01", _hsd_sql(0) + " SELECT id, h, round(sd, 6) AS sd FROM hs")
def _(s, d):
    return windows.horizon_sd(scored(s, d).filter("period = 1"), "g").select("id", "h", *_r("sd"))


def calibration(s, d) -> DataFrame:
    return calibrated.curve(scored(s, d).filter("period = 1"), "g")


_INV = "1 / exp(ln(greatest(a.sd, 1e-9)) + (log2(n::DOUBLE) - a.h) * (ln(greatest(b.sd, 1e-9)) - ln(greatest(a.sd, 1e-9))))"


_CENTRED = f", ce AS (SELECT id, avg(g) AS mu FROM sc WHERE period = 1 AND pos > {calibrated.SKIP} GROUP BY id), oc AS (SELECT o.id, o.step, o.n, o.g - mu AS e FROM onl o LEFT JOIN ce USING (id))"


@query("win_09_cal_02", _HSD + _CENTRED + f" SELECT o.id, o.step, round(sum(e) OVER (PARTITION BY o.id ORDER BY step) * {_INV}, 6) AS cal_sum FROM oc o LEFT JOIN hs a ON a.id = o.id AND a.h = least(floor(log2(n::DOUBLE)), 9) LEFT JOIN hs b ON b.id = o.id AND b.h = a.h + 1")
def _(s, d):
    on = calibrated.centred(scored(s, d), "g").filter("period = 2").select("id", "pos", "step", "e")
    return calibrated.calibrated_sums(on, calibration(s, d), "e").select("id", "step", *_r("cal_sum"))


@query("agg_14_agg_15", ", l AS (SELECT id, k, corr(a, b) AS r FROM (SELECT id, unnest([1, 2, 3]) AS k, g AS a, unnest([lag(g, 1) OVER w, lag(g, 2) OVER w, lag(g, 3) OVER w]) AS b FROM sc WHERE period = 1 WINDOW w AS (PARTITION BY id ORDER BY pos)) GROUP BY id, k) SELECT id, round(sum(r * r), 6) AS lb3 FROM l GROUP BY id")
def _(s, d):
    h = scored(s, d).filter("period = 1")
    for k in (1, 2, 3):
        h = h.withColumn(f"l{k}", F.lag("g", k).over(windows.by_pos()))
    total = sum((F.pow(F.corr("g", f"l{k}"), F.lit(2)) for k in (1, 2, 3)), F.lit(0.0))
    return h.groupBy("id").agg(F.round(total, 6).alias("lb3"))


@query("agg_16", "SELECT id, round(quantile_cont(value, 0.5), 6) AS med, round(quantile_cont(value, 0.9), 6) AS q90 FROM obs GROUP BY id")
def _(s, d):
    return observations(s, d).groupBy("id").agg(F.round(F.percentile("value", 0.5), 6).alias("med"), F.round(F.percentile("value", 0.9), 6).alias("q90"))


@query("agg_17", """, m AS (SELECT id, value, pos, avg(value) OVER (PARTITION BY id) AS m, count(*) OVER (PARTITION BY id) AS n FROM obs WHERE period = 1)
SELECT id, round(avg(pow(value - m, 3)) / pow(var_pop(value), 1.5), 5) AS skew, round(avg(pow(value - m, 4)) / pow(var_pop(value), 2) - 3, 5) AS kurt, min(value) AS lo, max(value) AS hi, round(count(DISTINCT value) / count(*)::DOUBLE, 6) AS distinct_ratio FROM m GROUP BY id""")
def _(s, d):
    return observations(s, d).filter("period = 1").groupBy("id").agg(
        F.round(F.skewness("value"), 5).alias("skew"), F.round(F.kurtosis("value"), 5).alias("kurt"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.count_distinct("value") / F.count("*"), 6).alias("distinct_ratio")
    )


@query("agg_18", "SELECT period, round(avg((abs(g) > 1.6448536269514722)::INT), 6) AS tail, round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS sd FROM sc GROUP BY period")
def _(s, d):
    return scored(s, d).groupBy("period").agg(F.round(F.avg((F.abs("g") > 1.6448536269514722).cast("int")), 6).alias("tail"), F.round(F.avg("g"), 6).alias("mean"), F.round(F.stddev_samp("g"), 6).alias("sd"))


@query("agg_19", ", b AS (SELECT id, pos, least(floor(u * 4), 3)::INT AS y FROM sc WHERE period = 1), t AS (SELECT id, y, lag(y) OVER (PARTITION BY id ORDER BY pos) AS x FROM b), c AS (SELECT i.id, x.x, y.y, 0.5 + count(t.id) AS n FROM (SELECT DISTINCT id FROM b) i, range(4) x(x), range(4) y(y) LEFT JOIN t ON t.id = i.id AND t.x = x.x AND t.y = y.y GROUP BY ALL) SELECT id, x::INT AS x, y::INT AS y, round(n / sum(n) OVER (PARTITION BY id, x), 6) AS p FROM c")
def _(s, d):
    b = windows.normal_scores(observations(s, d)).filter("period = 1").select("id", "pos", F.least(F.floor(F.col("u") * 4), F.lit(3)).cast("int").alias("y"))
    t = b.withColumn("x", F.lag("y").over(windows.by_pos())).filter("x IS NOT NULL").groupBy("id", "x", "y").agg(F.count("*").alias("c"))
    four = F.explode(F.sequence(F.lit(0), F.lit(3)))
    grid = b.select("id").distinct().select("id", four.alias("x")).select("id", "x", four.alias("y"))
    n = grid.join(t, ["id", "x", "y"], "left").withColumn("n", 0.5 + F.coalesce("c", F.lit(0)))
    return n.select("id", "x", "y", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("id", "x")), 6).alias("p"))


_AUC = ", r AS (SELECT step, label, rank() OVER (PARTITION BY step ORDER BY {s}) + (count(*) OVER (PARTITION BY step, {s}) - 1) / 2.0 AS r FROM lab), p AS (SELECT step, sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0 AS won, sum(label) AS a, count(*) - sum(label) AS b FROM r GROUP BY step) SELECT round(sum(won) / sum(a * b), 6) AS auc FROM p WHERE a > 0 AND b > 0"


@query("agg_20_win_14", _LAB + _AUC.replace("{s}", "g"))
def _(s, d):
    return stats.ts_auc(labelled(s, d).withColumn("g", F.col("g")), score="g").select(*_r("auc"))


@query("agg_21", _LAB.replace("o.step, o.g", "1 AS step, o.g") + _AUC.replace("{s}", "z"))
def _(s, d):
    return stats.pooled_auc(labelled(s, d), score="z").select(*_r("auc"))


_ANALYTIC = ["z", "z2", "g", "g2", "absg", "g3", "g4", "tail", "gg1", "gg2", "gg3", "gg5", "gg10", "zz1", "absdz", "dz2", "vol1", "vol5", "r", "absr", "r2", "rg2", "absrg", "zf2", "sgn1", "upper", "center"]
_CALIBRATED = [f"{b}_{k}" for b in ("g", "w97", "w99") for k in ("lvl", "sq", "abs", "ac1", "vol1")]
STREAMS = _ANALYTIC + fits.NL_STREAMS + _CALIBRATED


def all_streams(s, d) -> DataFrame:
    """Online rows with the 27 analytic, 4 learned and 15 calibrated streams of SURVEY 2.6, over all events."""
    z = scored(s, d).select("id", "pos", "period", "step", "value", "g", "z")
    wide = windows.residual_streams(windows.streams(fits.ar_residuals(z, fits.ar(z))))
    # volatilities begin behind the first lags
    wide = windows.volatility_streams(windows.calibrated_streams(wide.filter(F.col("pos") > features.LAGS))).filter("period = 2")
    return wide.join(fits.learned_streams(z), ["id", "pos"], "left").select("id", "pos", "step", *STREAMS)


@query("agg_22_srt_03")
def _(s, d):
    """Univariate AUC of every stream, best first."""
    obs = observations(s, d)
    return stream_aucs(all_streams(s, d).join(src.labels(obs, break_index(obs)), ["id", "step"]), STREAMS)


_ANALYTIC_SQL = {
    "z": "z", "z2": "z * z", "g": "g", "g2": "g * g", "absg": "abs(g)", "g3": "g * g * g", "g4": "least(pow(g, 4), 50)", "tail": "(abs(g) > 1.6448536269514722)::INT", "gg1": "g * lag(g) OVER w", "gg2": "g * lag(g, 2) OVER w",
    "gg3": "g * lag(g, 3) OVER w", "gg5": "g * lag(g, 5) OVER w", "gg10": "g * lag(g, 10) OVER w", "zz1": "z * lag(z) OVER w", "absdz": "abs(z - lag(z) OVER w)", "dz2": "pow(z - lag(z) OVER w, 2)", "vol1": "abs(g) * abs(lag(g) OVER w)",
    "vol5": "abs(g) * abs(lag(g, 5) OVER w)", "sgn1": "sign(g) * sign(lag(g) OVER w)", "upper": "(g > 0)::INT", "center": "(abs(g) < 0.2533471031357997)::INT",
}


def stream_aucs(wide: DataFrame, names: list[str]) -> DataFrame:
    """feature, auc: the time-stratified AUC of every named column of labelled rows, best first."""
    long = wide.select("step", "label", F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("feature", "score")).filter("score IS NOT NULL")
    cells = long.groupBy("feature", "step", "score").agg(F.sum("label").alias("p"), (F.count("*") - F.sum("label")).alias("q"))
    less = F.coalesce(F.sum("q").over(Window.partitionBy("feature", "step").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = cells.withColumn("w", F.col("p") * (less + F.col("q") / 2)).groupBy("feature", "step").agg(F.sum("w").alias("w"), (F.sum("p") * F.sum("q")).alias("n"))
    return per.groupBy("feature").agg(F.round(F.sum("w") / F.sum("n"), 6).alias("auc")).orderBy(F.desc("auc"), "feature")


# scores are cut to nine places, so that rounding in the last makes no ties of its own
@query("agg_22_analytic", _LAB + ", ws AS (SELECT id, period, step, " + ", ".join(f"round(({e})::DOUBLE, 9) AS {n}" for n, e in _ANALYTIC_SQL.items()) + f""" FROM sc WINDOW w AS (PARTITION BY id ORDER BY pos)),
lg AS (UNPIVOT ws ON {", ".join(_ANALYTIC_SQL)} INTO NAME feature VALUE x), fl AS (SELECT feature, lg.step, label, x + 0.0 AS x FROM lg JOIN lab ON lab.id = lg.id AND lab.step = lg.step WHERE lg.period = 2),
rk AS (SELECT feature, step, label, rank() OVER (PARTITION BY feature, step ORDER BY x) + (count(*) OVER (PARTITION BY feature, step, x) - 1) / 2.0 AS r FROM fl),
ps AS (SELECT feature, step, sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0 AS won, sum(label) * (count(*) - sum(label)) AS n FROM rk GROUP BY ALL)
SELECT feature, round(sum(won) / sum(n), 6) AS auc FROM ps GROUP BY feature ORDER BY auc DESC, feature""")
def _(s, d):
    """AUC of the streams of z and g, that SQL can say."""
    obs = observations(s, d)
    wide = windows.streams(scored(s, d)).filter("period = 2").join(src.labels(obs, break_index(obs)), ["id", "step"])
    return stream_aucs(wide.select("step", "label", *[(F.round(n, 9) + 0.0).alias(n) for n in _ANALYTIC_SQL]), list(_ANALYTIC_SQL))


# Whole menus: estimators, lags, scales


def _menu_sql() -> str:
    sizes = (25, 50, 100)
    means = "".join(f", m{n} AS (SELECT id, (pos - 1) // {n} AS b, avg(g) AS m FROM sc WHERE period = 1 GROUP BY ALL HAVING count(*) = {n}), b{n} AS (SELECT id, stddev_samp(m) * sqrt({n}) AS v FROM m{n} GROUP BY id)" for n in sizes)
    joins = "".join(f" LEFT JOIN b{n} ON b{n}.id = lr.id" for n in sizes)
    return (
        _LRV + means + ", ii AS (SELECT id, stddev_pop(g) AS v FROM sc WHERE period = 1 GROUP BY id) SELECT lr.id, round(lrsd, 6) AS bartlett, round(ii.v, 6) AS iid, "
        + ", ".join(f"round(b{n}.v, 6) AS bm{n}" for n in sizes) + f", round(greatest(lrsd, b50.v), 6) AS max_b_bm50 FROM lr JOIN ii ON ii.id = lr.id{joins}"
    )


@query("agg_11_menu", _menu_sql())
def _(s, d):
    """Six estimators of the long-run sd of the normal score's history."""
    h = scored(s, d).filter("period = 1").select("id", "pos", "g")
    out = windows.long_run_sd(h, "g").withColumnRenamed("lrsd", "bartlett").join(h.groupBy("id").agg(F.stddev_pop("g").alias("iid")), "id")
    out = out.join(stats.batch_sd(h, "g"), "id").withColumn("max_b_bm50", F.greatest("bartlett", "bm50"))
    return out.select("id", *_r("bartlett", "iid", "bm25", "bm50", "bm100", "max_b_bm50"))


@query("agg_15_lb", ", h AS (SELECT id, pos, g FROM sc WHERE period = 1), c AS (SELECT a.id, k, corr(a.g, b.g) AS r FROM h a JOIN (SELECT unnest(range(1, 31)) AS k) ON TRUE JOIN h b ON b.id = a.id AND b.pos = a.pos - k GROUP BY a.id, k) SELECT id, round(sum(CASE WHEN k <= 10 THEN r * r END), 6) AS lb10, round(sum(r * r), 6) AS lb30 FROM c GROUP BY id")
def _(s, d):
    return stats.portmanteau(scored(s, d).filter("period = 1"), "g").select("id", *_r("lb10", "lb30"))


_QUARTERS = {"first": "r <= n // 4", "last": "r > n - n // 4"}


@query("agg_17_quarters", ", q AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY pos) AS r, count(*) OVER (PARTITION BY id) AS n FROM obs WHERE period = 1) SELECT id, "
       + ", ".join([f"round(avg(CASE WHEN {c} THEN value END) - avg(value), 6) AS mean_{k}_q" for k, c in _QUARTERS.items()] + [f"round(stddev_pop(CASE WHEN {c} THEN value END) / stddev_pop(value), 6) AS sd_{k}_q" for k, c in _QUARTERS.items()]) + " FROM q GROUP BY id")
def _(s, d):
    out = stats.quarter_moments(observations(s, d).filter("period = 1"))
    return out.select("id", *_r(*out.columns[1:]))


_SCALES = (2, 4, 8, 16, 32, 64, 128)


@query("win_11_scales", "SELECT id, pos, " + ", ".join(f"CASE WHEN pos >= {k} THEN round(pow(sum(g) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 2) / {k}, 5) END AS b{k}" for k in _SCALES) + " FROM sc")
def _(s, d):
    """Squared block sums of all seven scales; null where the block would begin before the series."""
    n = F.row_number().over(windows.by_pos())
    blocks = {f"b{k}": F.when(n >= k, F.pow(F.sum("g").over(windows.by_pos().rowsBetween(1 - k, 0)), F.lit(2)) / k) for k in _SCALES}
    return scored(s, d).select("id", "pos", *[F.round(c, 5).alias(name) for name, c in blocks.items()])


# Sequential statistics


@query("win_01_win_02", "SELECT id, step, n::INT AS n, round(ln(n), 6) AS log_n, round(sum(g) OVER (PARTITION BY id ORDER BY step) / sqrt(n), 6) AS sum_z FROM onl")
def _(s, d):
    return windows.running_z(online(s, d), "g").select("id", "step", "n", *_r("log_n", "sum_z"))


@query("win_03", "SELECT id, step, " + ", ".join(f"round(sum(g) OVER (PARTITION BY id ORDER BY step ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) / sqrt(least(n, {w})), 6) AS w{w}" for w in (16, 64, 256)) + " FROM onl")
def _(s, d):
    return windows.windowed_z(online(s, d), "g").select("id", "step", *_r("w16", "w64", "w256"))


def _cusum_sql(k: float) -> str:
    return f""", u AS (SELECT id, step, sum(g - {k}) OVER w AS a, sum(-g - {k}) OVER w AS b FROM onl WINDOW w AS (PARTITION BY id ORDER BY step))
SELECT id, step, round(a - least(0, min(a) OVER w), 6) AS cusum_up, round(b - least(0, min(b) OVER w), 6) AS cusum_dn FROM u WINDOW w AS (PARTITION BY id ORDER BY step)"""


def _add_cusum(k: float, name: str) -> None:
    @query(name, _cusum_sql(k))
    def _(s, d):
        return windows.cusum(online(s, d), "g", k).select("id", "step", *_r("cusum_up", "cusum_dn"))


_add_cusum(0.1, "win_04")
_add_cusum(0.3, "win_04_k3")


@query("win_05_fn_03", "SELECT a.id, a.step, round(sum(b.g * 0.03 * pow(0.97, a.step - b.step)) * sqrt(1.97 / 0.03), 6) AS ewma FROM onl a JOIN onl b ON b.id = a.id AND b.step <= a.step GROUP BY a.id, a.step")
def _(s, d):
    return windows.ewma(online(s, d), "g").select("id", "step", *_r("ewma"))


@query("win_06_jon_03_srt_04", """, c AS (SELECT id, n, sum(g) OVER (PARTITION BY id ORDER BY n) AS c FROM onl), p AS (SELECT id, n AS j, c FROM c UNION ALL SELECT DISTINCT id, 0, 0.0 FROM c),
x AS (SELECT c.id, c.n, c.c - p.c AS diff, c.n - p.j AS age, pow(c.c - p.c, 2) / (c.n - p.j) AS stat FROM c JOIN p ON p.id = c.id AND p.j < c.n)
SELECT id, n - 1 AS step, round(diff / sqrt(age), 6) AS glr, round(ln(age), 6) AS glr_age FROM (SELECT *, row_number() OVER (PARTITION BY id, n ORDER BY stat DESC, age DESC) AS rk FROM x) WHERE rk = 1""")
def _(s, d):
    return windows.glr(online(s, d), "g").select("id", F.col("step").cast("long").alias("step"), *_r("glr", "glr_age"))


@query("win_07", "SELECT a.id, a.pos, round(pow(0.94, a.pos - 1) + coalesce(sum(b.z * b.z * 0.06 * pow(0.94, a.pos - 1 - b.pos)), 0), 6) AS vol FROM sc a LEFT JOIN sc b ON b.id = a.id AND b.pos < a.pos GROUP BY a.id, a.pos")
def _(s, d):
    return windows.volatility(scored(s, d).withColumn("z2", F.col("z") * F.col("z")), "z2", 0.94).select("id", "pos", *_r("vol"))


_STREAM_SQL = "z * z AS z2, g * g * g AS g3, least(pow(g, 4), 50) AS g4, (abs(g) > 1.6448536269514722)::INT::DOUBLE AS tail, z * lag(z) OVER w AS zz1, abs(z - lag(z) OVER w) AS absdz, abs(g) * abs(lag(g, 5) OVER w) AS vol5, g * lag(g, 10) OVER w AS gg10, sign(g) * sign(lag(g) OVER w)::DOUBLE AS sgn1"
_STREAM_COLS = ["z2", "g3", "g4", "tail", "zz1", "absdz", "vol5", "gg10", "sgn1"]


@query("win_08_streams", f", st AS (SELECT id, period, step, {_STREAM_SQL} FROM sc WINDOW w AS (PARTITION BY id ORDER BY pos)) SELECT id, step, " + ", ".join(f"round({c}, 5)::DOUBLE + 0.0 AS {c}" for c in _STREAM_COLS) + " FROM st WHERE period = 2")
def _(s, d):
    return windows.streams(scored(s, d)).filter("period = 2").select("id", "step", *[(F.round(c, 5) + 0.0).alias(c) for c in _STREAM_COLS])


@query("win_11", "SELECT id, pos, round(pow(sum(g) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 2) / 8, 5) AS b8 FROM sc")
def _(s, d):
    return scored(s, d).select("id", "pos", F.round(F.pow(F.sum("g").over(windows.by_pos().rowsBetween(-7, 0)), F.lit(2)) / 8, 5).alias("b8"))


@query("win_12", ", l AS (SELECT id, pos, value AS c, lag(value, 1) OVER w AS b, lag(value, 2) OVER w AS a FROM obs WINDOW w AS (PARTITION BY id ORDER BY pos)) SELECT id, (a < b)::INT * 4 + (b < c)::INT * 2 + (a < c)::INT AS pattern, count(*) AS n FROM l WHERE a IS NOT NULL GROUP BY ALL")
def _(s, d):
    return windows.ordinal_pattern(observations(s, d)).filter("pattern IS NOT NULL").groupBy("id", "pattern").agg(F.count("*").alias("n"))


@query("win_15", "SELECT id, step, round(avg(g) OVER (PARTITION BY id ORDER BY step), 6) AS mean_to FROM onl")
def _(s, d):
    return online(s, d).select("id", "step", F.round(F.avg("g").over(windows.so_far()), 6).alias("mean_to"))


# Two-sample tests


@query("tst_01", ", f AS (SELECT id, abs(sum((period = 1)::INT) OVER (PARTITION BY id ORDER BY value RANGE UNBOUNDED PRECEDING) / nh::DOUBLE - sum((period = 2)::INT) OVER (PARTITION BY id ORDER BY value RANGE UNBOUNDED PRECEDING) / nl::DOUBLE) AS d FROM obs JOIN sz USING (id)) SELECT id, round(max(d), 6)::DOUBLE AS ks FROM f GROUP BY id")
def _(s, d):
    return stats.ks_statistic(observations(s, d)).select("id", *_r("ks"))


@query("tst_02", ", r AS (SELECT id, period, rank() OVER (PARTITION BY id ORDER BY value) + (count(*) OVER (PARTITION BY id, value) - 1) / 2.0 AS r FROM obs) SELECT id, round(abs((sum(CASE WHEN period = 2 THEN r END) - nl * (nl + 1) / 2.0) / (nh * nl) - 0.5), 6)::DOUBLE AS mw FROM r JOIN sz USING (id) GROUP BY id, nh, nl")
def _(s, d):
    return stats.mann_whitney(observations(s, d)).select("id", *_r("mw"))


@query("tst_03", ", m AS (SELECT id, period, quantile_cont(value, 0.5) AS m FROM obs GROUP BY ALL), z AS (SELECT o.id, o.period, abs(value - m) AS z FROM obs o JOIN m USING (id, period)), g AS (SELECT id, period, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY ALL), t AS (SELECT id, sum(n) AS n, sum(n * m) / sum(n) AS m FROM g GROUP BY id) SELECT g.id, round((max(t.n) - 2) * sum(g.n * pow(g.m - t.m, 2)) / sum(g.n * g.v), 5) AS w FROM g JOIN t USING (id) GROUP BY g.id")
def _(s, d):
    return stats.levene(observations(s, d)).select("id", F.round("w", 5).alias("w"))


@query("tst_05", ", o AS (SELECT u, row_number() OVER (ORDER BY u) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT u FROM sc WHERE period = 2)) SELECT round(max(greatest(i / n::DOUBLE - u, u - (i - 1) / n::DOUBLE)), 6) AS ks FROM o")
def _(s, d):
    # a set of at most 2 * HIST + 1 mid-ranks
    u = windows.normal_scores(observations(s, d)).filter("period = 2").select("u").distinct()
    o = u.withColumn("i", F.row_number().over(Window.orderBy("u"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return o.agg(F.round(F.max(F.greatest(F.col("i") / F.col("n") - F.col("u"), F.col("u") - (F.col("i") - 1) / F.col("n"))), 6).alias("ks"))


_LAGS = [*range(1, 11), 12, 15, 20, 25, 30, 40, 50]


@query("tst_10_lags", lambda: _CUT + f""", x AS (SELECT s.id, s.period, s.pos, s.step, s.g, nh, t, nl - t AS n, abs(g) - avg(CASE WHEN period = 1 THEN abs(g) END) OVER (PARTITION BY s.id) AS a FROM sc s JOIN cut ON cut.id = s.id WHERE nl - t >= 100),
p AS (SELECT y.id, k AS lag, y.period, y.step, y.t, y.n, y.g * l.g AS pg, y.a * l.a AS pa FROM x y JOIN (SELECT unnest({_LAGS}) AS k) ON TRUE JOIN x l ON l.id = y.id AND l.pos = y.pos - k)
SELECT id, lag, round(sum(CASE WHEN step >= t THEN pg END) / sqrt(n) - avg(CASE WHEN period = 1 THEN pg END) * sqrt(n), 5) AS gg, round(sum(CASE WHEN step >= t THEN pa END) / sqrt(n) - avg(CASE WHEN period = 1 THEN pa END) * sqrt(n), 5) AS aa FROM p GROUP BY id, lag, n""")
def _(s, d):
    """Products at all 17 lags after the break, or after a drawn cut, against the history's."""
    return stats.lag_products(scored(s, d), cuts(s, d), "g", _LAGS).select("id", "lag", *[F.round(c, 5).alias(c) for c in ("gg", "aa")])


@query("tst_08", "SELECT id, round((avg(g * g) - 1) * sqrt(count(*) / 2.0), 6) AS var_z FROM onl GROUP BY id")
def _(s, d):
    return online(s, d).groupBy("id").agg(F.round((F.avg(F.col("g") * F.col("g")) - 1) * F.sqrt(F.count("*") / 2), 6).alias("var_z"))


@query("tst_09_tst_10", ", e AS (SELECT o.id, o.g, o.g * lag(o.g) OVER (PARTITION BY o.id ORDER BY step) AS p FROM onl o JOIN brk USING (id) WHERE tau <> -1 AND step >= tau) SELECT id, round(sum(g) / sqrt(count(*)), 6) AS oracle_z, round(sum(p) / sqrt(count(p)), 6) AS lag1 FROM e GROUP BY id")
def _(s, d):
    post = online(s, d).join(break_index(observations(s, d)), "id").filter("tau <> -1 AND step >= tau")
    post = post.withColumn("p", F.col("g") * F.lag("g").over(windows.by_pos()))
    return post.groupBy("id").agg(F.round(F.sum("g") / F.sqrt(F.count("*")), 6).alias("oracle_z"), F.round(F.sum("p") / F.sqrt(F.count("p")), 6).alias("lag1"))


# Fits and training sets


@query("fit_01_ar1", ", p AS (SELECT id, z AS y, lag(z) OVER (PARTITION BY id ORDER BY pos) AS x FROM sc WHERE period = 1) SELECT id, round(sum(x * y) / sum(CASE WHEN x IS NOT NULL THEN x * x END), 6) AS phi FROM p GROUP BY id")
def _(s, d):
    return fits.ar1(scored(s, d)).select("id", *_r("phi"))


@query("fit_01")
def _(s, d):
    z = scored(s, d)
    return fits.ar_residuals(z.select("id", "pos", "period", "z"), fits.ar(z)).filter("period = 2").select("id", "pos", *_r("r"))


@query("fit_02_fit_03")
def _(s, d):
    return fits.learned(scored(s, d))


@query("fit_04")
def _(s, d):
    return fits.garch(scored(s, d))


def _shift_u():
    key = F.length("id") * 7919 + F.col("tau") * 104729
    return F.pmod(key * 1103515245 + F.col("copy") * 12345, F.lit(1000003)) / 1000003.0


@query("trn_01_trn_02", """, c AS (SELECT id, tau, nh, least(CASE WHEN tau >= 0 THEN tau ELSE nl // 2 END, nl - 10) AS m, unnest([0, 1, 2]) AS copy FROM brk JOIN sz USING (id)),
k AS (SELECT *, CASE WHEN copy = 0 OR m < 1 THEN 0 ELSE floor((((length(id) * 7919 + tau * 104729)::HUGEINT * 1103515245 + copy * 12345) % 1000003 + 1000003) % 1000003 / 1000003.0::DOUBLE * m)::INT END AS k FROM c)
SELECT o.id, copy, count_if(o.pos <= nh + k)::BIGINT AS hist_len, count_if(o.pos > nh + k)::BIGINT AS online_len, CASE WHEN max(tau) >= 0 THEN max(tau) - max(k) ELSE -1 END AS tau FROM obs o JOIN k USING (id) GROUP BY o.id, copy""")
def _(s, d):
    obs = observations(s, d)
    moved = shifted(obs, break_index(obs), 2)
    return moved.groupBy("id", "copy").agg(F.count_if(F.col("period") == 1).alias("hist_len"), F.count_if(F.col("period") == 2).alias("online_len"), F.max("tau").alias("tau"))


def shifted(obs: DataFrame, index: DataFrame, copies: int) -> DataFrame:
    """Series as they are (copy 0) and ``copies`` copies of each whose first online points, all before the break, are history: id, copy, tau, and a row's columns."""
    c = index.withColumn("tau", F.col("tau").cast("long")).join(sizes(obs).select("id", "nh", "nl"), "id").select("*", F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("copy"))
    limit = F.least(F.when(F.col("tau") >= 0, F.col("tau")).otherwise(F.floor(F.col("nl") / 2)), F.col("nl") - 10)
    k = c.withColumn("k", F.when((F.col("copy") == 0) | (limit < 1), 0).otherwise(F.floor(_shift_u() * limit)).cast("int"))
    moved = obs.select("id", "pos", "value").join(k, "id")
    start = F.col("nh") + F.col("k")
    tau = F.when(F.col("tau") >= 0, F.col("tau") - F.col("k")).otherwise(-1).cast("int")
    return moved.select("id", "copy", F.when(F.col("pos") <= start, 1).otherwise(2).alias("period"), "pos", F.when(F.col("pos") > start, F.col("pos") - start - 1).cast("int").alias("step"), "value", tau.alias("tau"))


@query("trn_03", "SELECT id, pos, CASE WHEN pos > nh - least(500, nh // 3) THEN 2 ELSE 1 END AS period FROM obs JOIN sz USING (id) WHERE period = 1")
def _(s, d):
    obs = observations(s, d)
    tail = F.least(F.lit(500), F.floor(F.col("nh") / 3))
    return obs.filter("period = 1").join(sizes(obs).select("id", "nh"), "id").select("id", "pos", F.when(F.col("pos") > F.col("nh") - tail, 2).otherwise(1).alias("period"))


@query("trn_04_set_01", ", a AS (SELECT id, step, 1.0::DOUBLE AS weight FROM onl UNION ALL SELECT id, step, 2.0 FROM onl WHERE step % 4 = 0) SELECT id, step, count(*) AS n, sum(weight) AS weight FROM a GROUP BY ALL")
def _(s, d):
    on = online(s, d).select("id", "step", F.lit(1.0).alias("weight"))
    return on.unionByName(on.filter("step % 4 = 0").withColumn("weight", F.lit(2.0))).groupBy("id", "step").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def fold_of(id_: str, folds: int):
    """A fold that depends on the series alone, so no ranking of all ids is needed."""
    return (F.conv(F.substring(F.md5(F.col(id_).cast("binary")), 1, 8), 16, 10).cast("long") % folds).cast("int")


@query("trn_06", "SELECT DISTINCT id, (('0x' || substr(md5(id), 1, 8))::BIGINT % 5)::INT AS fold FROM obs")
def _(s, d):
    return observations(s, d).select("id").distinct().select("id", fold_of("id", 5).alias("fold"))


# Calibration on the series' own history


_KEY = ", ix AS (SELECT id, tau, nh, nl, (length(kind) * 7919 + chunk * 104729) % 1000003 AS key FROM sz JOIN brk USING (id))"
_CUT = _KEY + """, gv AS (SELECT row_number() OVER (ORDER BY (tau + 0.5) / nl::DOUBLE, id) - 1 AS i, (tau + 0.5) / nl::DOUBLE AS u FROM ix WHERE tau >= 0),
cut AS (SELECT ix.id, key, nh, nl, CASE WHEN tau >= 0 THEN tau ELSE floor(u * nl)::BIGINT END AS t FROM ix LEFT JOIN gv ON tau < 0 AND i = ((key * 1103515245 + 12345) % 1000003) % (SELECT count(*) FROM gv))"""


def _key():
    """An integer of a series that SQL can compute too."""
    return (F.length(F.regexp_extract("id", "^(.*)-", 1)) * 7919 + F.regexp_extract("id", "-([0-9]+)$", 1).cast("long") * 104729) % 1000003


def cuts(s, d) -> DataFrame:
    obs = observations(s, d)
    length = obs.groupBy("id").agg(F.count_if(F.col("period") == 2).cast("int").alias("online_len"))
    return calibrated.random_cuts(break_index(obs).join(length, "id"), _key())


@query("win_10", f""", c AS (SELECT id, period, pos, step, g - avg(CASE WHEN period = 1 AND pos > {calibrated.SKIP} THEN g END) OVER (PARTITION BY id) AS e FROM sc),
w AS (SELECT a.id, a.period, a.pos, a.step, sum(b.e * 0.03 * pow(0.97, a.pos - b.pos)) AS w FROM c a JOIN c b ON a.id = b.id AND a.period = b.period AND b.pos <= a.pos AND (b.period = 2 OR b.pos > {calibrated.SKIP}) GROUP BY ALL),
d AS (SELECT id, stddev_pop(w) AS sd FROM w WHERE period = 1 AND pos > {calibrated.SKIP + 100} GROUP BY id) SELECT id, step, round(w / greatest(sd, CASE WHEN sd IS NOT NULL THEN 1e-9 END), 6) AS cal_ewma FROM w LEFT JOIN d USING (id) WHERE period = 2""")
def _(s, d):
    return calibrated.calibrated_ewma(scored(s, d), "g").select("id", "step", *_r("cal_ewma"))


def _recalibrated_sql() -> str:
    out = [_HSD, ", ru AS (SELECT id, step, n, " + ", ".join(f"sum(g) OVER (PARTITION BY id ORDER BY step ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS s{w}" for w in (16, 64, 256, 1024)) + " FROM onl)"]
    terms = []
    for w in (16, 64, 256, 1024):
        out.append(f", r{w} AS (SELECT ru.id, ru.step, s{w} * {_INV.replace('n::DOUBLE', f'least(n, {w})::DOUBLE')} AS v FROM ru LEFT JOIN hs a ON a.id = ru.id AND a.h = least(floor(log2(least(n, {w})::DOUBLE)), 9) LEFT JOIN hs b ON b.id = ru.id AND b.h = a.h + 1)")
        terms.append(f"round(r{w}.v, 6) AS {'sum_z' if w == 1024 else f'w{w}'}")
    return "".join(out) + " SELECT id, step, " + ", ".join(terms) + " FROM r16 JOIN r64 USING (id, step) JOIN r256 USING (id, step) JOIN r1024 USING (id, step)"


@query("cal_03", _recalibrated_sql())
def _(s, d):
    return calibrated.recalibrated(online(s, d), calibration(s, d), "g").select("id", "step", *_r("w16", "w64", "w256", "sum_z"))


_NULL = """, wz AS (SELECT *, least(nl - t, nh // 4) AS n FROM cut WHERE nl - t >= 50),
st AS (SELECT id, j, n, CASE WHEN j < 0 THEN nh + t ELSE 200 + ((key * 69069 + j * 1103515245) % 1000003) % (nh - n - 200) END AS a FROM wz, range(-1, 40) r(j) WHERE nh - n > 200),
v AS (SELECT st.id, j, sum(w) / sqrt(n) AS mean, (sum(w * w) / n - 1) * sqrt(n / 2.0) AS var, (sum(abs(w)) / n - sqrt(2 / pi())) * sqrt(n) AS abs,
  sum(CASE WHEN pos > a + 1 THEN w * l END) / (n - 1) * sqrt(n) AS acf1, (sum(CASE WHEN pos > a + 1 THEN abs(w * l) END) / (n - 1) - 2 / pi()) * sqrt(n) AS vol1
  FROM st JOIN x ON x.id = st.id AND x.pos > a AND x.pos <= a + n GROUP BY st.id, j, n)
SELECT id, """ + ", ".join(
    f"round(max(CASE WHEN j < 0 THEN {c} END), 5) AS {c}_z, round((max(CASE WHEN j < 0 THEN {c} END) - avg(CASE WHEN j >= 0 THEN {c} END)) / stddev_pop(CASE WHEN j >= 0 THEN {c} END), 5) AS {c}_cal" for c in calibrated.NULL_STATS
) + " FROM v GROUP BY id"
_WHITE = """, vo AS (SELECT a.id, a.pos, a.period, a.g / sqrt(pow(0.97, a.pos - 1) + coalesce(sum(b.g * b.g * 0.03 * pow(0.97, a.pos - 1 - b.pos)), 0)) AS y FROM sc a LEFT JOIN sc b ON b.id = a.id AND b.pos < a.pos GROUP BY a.id, a.pos, a.period, a.g),
wh AS (SELECT id, pos, (y - avg(CASE WHEN period = 1 AND pos > 200 THEN y END) OVER p) / stddev_pop(CASE WHEN period = 1 AND pos > 200 THEN y END) OVER p AS w FROM vo WINDOW p AS (PARTITION BY id))"""


def _null_columns():
    return [F.round(f"{c}_{k}", 5).alias(f"{c}_{k}") for c in calibrated.NULL_STATS for k in ("z", "cal")]


@query("cal_04", _CUT + ", x AS (SELECT id, pos, g AS w, lag(g) OVER (PARTITION BY id ORDER BY pos) AS l FROM sc)" + _NULL)
def _(s, d):
    return calibrated.null_windows(scored(s, d), cuts(s, d), "g", _key()).select("id", *_null_columns())


@query("cal_04_whitened", _CUT + _WHITE + ", x AS (SELECT id, pos, w, lag(w) OVER (PARTITION BY id ORDER BY pos) AS l FROM wh)" + _NULL)
def _(s, d):
    return calibrated.null_windows(calibrated.whitened(scored(s, d), "g", 0.97), cuts(s, d), "w", _key()).select("id", *_null_columns())


@query("tst_12", _CUT + " SELECT id, t FROM cut")
def _(s, d):
    return cuts(s, d)


def _bayes_sql() -> str:
    bin_of = lambda n: f"least(floor(u * {n}), {n - 1})::INT"
    parts = [
        f""", bn AS (SELECT id, period, step, {bin_of(16)} AS mb, {bin_of(4)} AS pb, lag({bin_of(4)}) OVER (PARTITION BY id ORDER BY pos) AS pa FROM sc),
tr AS (SELECT id, pa, pb, count(*) AS c FROM bn WHERE period = 1 AND pa IS NOT NULL GROUP BY ALL),
p0 AS (SELECT i.id, x.a, y.b, (0.5 + coalesce(c, 0)) / sum(0.5 + coalesce(c, 0)) OVER (PARTITION BY i.id, x.a) AS p FROM (SELECT DISTINCT id FROM bn) i, range(4) x(a), range(4) y(b) LEFT JOIN tr ON tr.id = i.id AND tr.pa = x.a AND tr.pb = y.b),
pr AS (SELECT s.id, k.step AS k, s.step AS t, p0.p, row_number() OVER (PARTITION BY s.id, k.step, s.mb ORDER BY s.step) - 1 AS cm, row_number() OVER (PARTITION BY s.id, k.step, s.pa, s.pb ORDER BY s.step) - 1 AS cp,
  row_number() OVER (PARTITION BY s.id, k.step, s.pa ORDER BY s.step) - 1 AS cr FROM bn s JOIN bn k ON k.id = s.id AND k.period = 2 AND s.period = 2 AND k.step <= s.step JOIN p0 ON p0.id = s.id AND p0.a = s.pa AND p0.b = s.pb),
lb AS ("""
    ]
    inc = {f"bm{c}": f"ln(({c} / 16.0 + cm) / ({c} + t - k)) + ln(16.0)" for c in bayes.MARGINAL} | {f"bp{c}": f"ln(({c} * p + cp) / ({c} + cr)) - ln(p)" for c in bayes.PAIR}
    parts.append(" UNION ALL ".join(f"SELECT id, k, t, '{m}' AS m, sum({e}) OVER (PARTITION BY id, k ORDER BY t) AS l FROM pr" for m, e in inc.items()))
    parts.append("), mx AS (SELECT *, max(l) OVER (PARTITION BY id, t, m) AS mx FROM lb), f AS (SELECT id, t, m, max(mx) + ln(sum(exp(l - mx))) AS lse, max(mx) AS mx")
    parts += [f", max(mx) + ln(sum(CASE WHEN k > t - {r} THEN exp(l - mx) END)) AS rec{r}" for r in bayes.RECENT]
    parts.append(" FROM mx GROUP BY id, t, m) SELECT id, t AS step")
    for m in bayes.MODELS:
        pick = lambda e: f"round(max(CASE WHEN m = '{m}' THEN {e} END), 5) + 0.0"  # noqa: B023, E731
        parts.append(f", {pick('lse - ln(t + 1)')} AS {m}_lsr, {pick('mx')} AS {m}_max" + "".join(f", {pick(f'rec{r} - lse')} AS {m}_rec{r}" for r in bayes.RECENT))
    return "".join(parts) + " FROM f GROUP BY id, t"


@query("win_13_agg_24", _bayes_sql())
def _(s, d):
    return bayes.bayes_factors(scored(s, d)).select("id", "step", *[(F.round(c, 5) + 0.0).alias(c) for c in bayes.COLUMNS])


@query("tst_04", f""", c AS (SELECT id, value, count_if(period = 1) AS f1, count(*) AS l FROM obs GROUP BY id, value),
b AS (SELECT id, l, sum(l) OVER w - l / 2.0 AS b, sum(f1) OVER w - f1 / 2.0 AS m FROM c WINDOW w AS (PARTITION BY id ORDER BY value)),
ns AS (SELECT DISTINCT nh + nl AS n FROM sz), hn AS (SELECT n, sum(1::DOUBLE / i) AS h FROM ns, range(1, {2 * (HIST + ONLINE)}) r(i) WHERE i < n GROUP BY n),
gn AS (SELECT n, sum(1::DOUBLE / ((n - i) * j)) AS g FROM ns, range(1, {2 * (HIST + ONLINE)}) x(i), range(2, {2 * (HIST + ONLINE)}) y(j) WHERE i < n - 1 AND j < n AND j > i GROUP BY n),
z AS (SELECT id, n::DOUBLE AS n, nh::DOUBLE AS n1, nl::DOUBLE AS n2, 2::DOUBLE AS k, 1.0::DOUBLE / nh + 1.0::DOUBLE / nl AS hs, h, g FROM sz JOIN hn ON hn.n = nh + nl JOIN gn USING (n)),
q AS (SELECT *, (4 * g - 6) * (k - 1) + (10 - 6 * g) * hs AS a, (2 * g - 4) * k * k + 8 * h * k + (2 * g - 14 * h - 4) * hs - 8 * h + 4 * g - 6 AS bb,
  (6 * h + 2 * g - 2) * k * k + (4 * h - 4 * g + 6) * k + (2 * h - 6) * hs + 4 * h AS c, (2 * h + 6) * k * k - 4 * h * k AS d FROM z)
SELECT id, round((sum(CASE WHEN b * (n - b) - n * l / 4 > 0 THEN l / n * (pow(n * m - b * n1, 2) / n1 + pow(n * (b - m) - b * n2, 2) / n2) / (b * (n - b) - n * l / 4) ELSE 0 END) * (max(n) - 1) / max(n) - 1)
  / sqrt(max((a * n * n * n + bb * n * n + c * n + d) / ((n - 1) * (n - 2) * (n - 3)))), 5) AS ad FROM b JOIN q USING (id) GROUP BY id""")
def _(s, d):
    return stats.anderson_darling(observations(s, d)).select("id", F.round("ad", 5).alias("ad"))


@query("tst_07", """, c AS (SELECT count(*) AS n, count_if(tau >= 0)::BIGINT AS k FROM brk)
SELECT n, k, round(CASE WHEN 2 * least(k, n - k) >= n THEN 1.0::DOUBLE ELSE 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) END, 6) AS p FROM c JOIN range(0, 10000) r(i) ON i <= least(k, n - k) GROUP BY n, k""")
def _(s, d):
    return stats.break_rate(break_index(observations(s, d))).select("n", "k", *_r("p"))


_VR = (2, 4, 8, 16)


def _variance_sql(scales=_VR) -> str:
    blocks = " UNION ALL ".join(
        f"SELECT id, period, pos, step, {k} AS scale, pow(sum(z) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 2) / {k} AS s FROM sc" for k in scales
    )
    return f""", bl AS (SELECT * FROM ({blocks}) WHERE pos >= scale), h AS (SELECT id, scale, avg(s) AS mh FROM bl WHERE period = 1 GROUP BY ALL),
bt AS (SELECT id, scale, (pos - scale) // (4 * scale) AS b, avg(s) AS m FROM bl WHERE period = 1 GROUP BY ALL HAVING count(*) = 4 * scale),
bs AS (SELECT id, scale, stddev_samp(m) * sqrt(4 * scale) AS sd FROM bt GROUP BY id, scale),
p AS (SELECT bl.id, scale, avg(s) AS mp, count(*) AS np FROM bl JOIN cut ON cut.id = bl.id WHERE period = 2 AND step >= t GROUP BY ALL HAVING count(*) >= 30)
SELECT id, scale, round(abs(mp - mh) / sd * sqrt(np), 5) AS vr_z, round(abs(ln(mp + 1e-9) - ln(mh + 1e-9)), 5) AS dlog_vr FROM h LEFT JOIN bs USING (id, scale) JOIN p USING (id, scale)"""


@query("tst_11", _CUT + _variance_sql())
def _(s, d):
    return stats.variance_ratio(scored(s, d), cuts(s, d), "z", _VR).select("id", "scale", F.round("vr_z", 5).alias("vr_z"), F.round("dlog_vr", 5).alias("dlog_vr"))


def _bootstrap_sql(draws: int, size: int) -> str:
    return _KEY + _LAB + f""", pk AS (SELECT id, draw FROM (SELECT id, draw, row_number() OVER (PARTITION BY draw ORDER BY (key * (2 * draw + 1) * 69069 + draw * 12345) % 1000003, id) AS r FROM ix, range({draws}) d(draw)) WHERE r <= {size}),
rk AS (SELECT draw, step, label, rank() OVER (PARTITION BY draw, step ORDER BY g) + (count(*) OVER (PARTITION BY draw, step, g) - 1) / 2.0 AS r FROM lab JOIN pk USING (id)),
ps AS (SELECT draw, step, sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0 AS won, sum(label) AS a, count(*) - sum(label) AS b FROM rk GROUP BY ALL),
au AS (SELECT draw, CASE WHEN sum(a * b) > 0 THEN sum(won) / sum(a * b) ELSE 0.5 END AS auc FROM ps GROUP BY draw)
SELECT round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS sd, round(quantile_cont(auc, 0.05), 6) AS q05, round(quantile_cont(auc, 0.95), 6) AS q95 FROM au"""


@query("agg_25", _bootstrap_sql(20, 6))
def _(s, d):
    rows = labelled(s, d).withColumn("score", F.col("g"))
    return stats.spread(stats.bootstrap_auc(rows, _key(), draws=20, size=6)).select(*_r("mean", "sd", "q05", "q95"))


@query("trn_05_jon_04_jon_05", """, tl AS (SELECT id, nh, nh - least(500, nh // 3) AS tail FROM sz), ps AS (SELECT id, (pos - tail - 1) // 4 AS j, g AS s FROM sc JOIN tl USING (id) WHERE pos > tail AND pos <= tl.nh AND (pos - tail - 1) % 4 = 0),
w AS (SELECT id, count(*) AS c, avg(s) AS ma, greatest(stddev_pop(s), 1e-3) AS sa, quantile_cont(s, 0.9) AS q FROM ps GROUP BY id),
r AS (SELECT id, j, s AS pa, avg(s) OVER (PARTITION BY id ORDER BY j) AS mt FROM ps)
SELECT o.id, o.step, round(g, 6) AS s, round(ln(1 + o.step), 6) AS logt, round(pa, 6) AS p_at, round(mt, 6) AS p_mean_to, round(ma, 6) AS p_mean, round(sa, 6) AS p_sd, round(q, 6) AS p_q90,
  round(g - pa, 6) + 0.0 AS s_m_at, round(g - mt, 6) AS s_m_meanto, round((g - ma) / sa, 6) AS s_z FROM onl o JOIN w ON w.id = o.id JOIN r ON r.id = o.id AND r.j = least(o.step // 4, c - 1)""")
def _(s, d):
    z = scored(s, d)
    nh = F.max(F.when(F.col("period") == 1, F.col("pos"))).over(Window.partitionBy("id"))
    past = z.withColumn("_t", nh - F.least(F.lit(500), F.floor(nh / 3))).filter((F.col("period") == 1) & (F.col("pos") > F.col("_t")))
    pseudo = past.select("id", (F.col("pos") - F.col("_t") - 1).alias("step"), F.col("g").alias("s")).filter("step % 4 = 0")
    out = calibrated.stage2_features(z.filter("period = 2").select("id", "step", F.col("g").alias("s")), pseudo)
    return out.select("id", "step", *_r(*out.columns[2:])).withColumn("s_m_at", F.col("s_m_at") + 0.0)


@query("agg_25_full", _bootstrap_sql(200, 100))
def _(s, d):
    """The bootstrap's defaults: 200 draws of up to 100 series."""
    return stats.spread(stats.bootstrap_auc(labelled(s, d).withColumn("score", F.col("g")), _key())).select(*_r("mean", "sd", "q05", "q95"))


@query("tst_11_scales", lambda: _CUT + _variance_sql(_SCALES))
def _(s, d):
    """The variance ratio's defaults: all scales up to 128."""
    return stats.variance_ratio(scored(s, d), cuts(s, d), "z").select("id", "scale", F.round("vr_z", 5).alias("vr_z"), F.round("dlog_vr", 5).alias("dlog_vr"))


_NAMES = features.FEATURES


@query("fit_05_matrix")
def _(s, d):
    """The matrix of 417 features of every online row."""
    return features.feature_matrix(observations(s, d))


_STD = ["z", "z2", "g", "g2", "absg", "g4", "tail", "gg1", "zz1", "absdz", "dz2", "vol1", "g3", "vol5", "upper", "center", "gg10"]


def _standardised_sql() -> str:
    raw = {
        "z": "z", "z2": "z * z", "g": "g", "g2": "g * g", "absg": "abs(g)", "g4": "least(pow(g, 4), 50)", "tail": "(abs(g) > 1.6448536269514722)::INT", "gg1": "g * lag(g) OVER w", "zz1": "z * lag(z) OVER w",
        "absdz": "abs(z - lag(z) OVER w)", "dz2": "pow(z - lag(z) OVER w, 2)", "vol1": "abs(g) * abs(lag(g) OVER w)", "g3": "g * g * g", "vol5": "abs(g) * abs(lag(g, 5) OVER w)", "upper": "(g > 0)::INT",
        "center": "(abs(g) < 0.2533471031357997)::INT", "gg10": "g * lag(g, 10) OVER w",
    }
    cols = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in raw.items())
    wide = ", ".join(f"round(max(CASE WHEN stream = '{n}' THEN s END), 5) + 0.0 AS {n}_sum, round(max(CASE WHEN stream = '{n}' THEN v END), 5) + 0.0 AS {n}_w64" for n in _STD)
    return f""", ws AS (SELECT id, period, pos, step, {cols} FROM sc WINDOW w AS (PARTITION BY id ORDER BY pos)),
lg AS (UNPIVOT ws ON {", ".join(_STD)} INTO NAME stream VALUE x),
hi AS (SELECT id, stream, pos, x - avg(x) OVER p AS d, avg(x) OVER p AS mu, count(*) OVER p AS n FROM lg WHERE period = 1 AND pos > {features.LAGS} WINDOW p AS (PARTITION BY id, stream)),
ac AS (SELECT a.id, a.stream, j, max(a.mu) AS mu, max(a.n) AS n, ceil(pow(max(a.n), 1 / 3.0::DOUBLE) - 1e-9) AS m, sum(a.d * b.d) / max(a.n) AS gj FROM hi a JOIN (SELECT unnest(range(0, 30)) AS j) ON TRUE JOIN hi b ON b.id = a.id AND b.stream = a.stream AND b.pos = a.pos - j GROUP BY ALL),
nu AS (SELECT id, stream, max(mu) AS mu, CASE WHEN max(CASE WHEN j = 0 THEN gj END) <= 0 THEN 1e-6 ELSE sqrt(greatest(sum(CASE WHEN j = 0 THEN gj WHEN j <= m THEN 2 * (1 - j / (m + 1.0)) * gj ELSE 0 END), 0.1 * max(CASE WHEN j = 0 THEN gj END))) END AS sd FROM ac GROUP BY id, stream),
es AS (SELECT lg.id, stream, step, (x - mu) / sd AS e FROM lg JOIN nu USING (id, stream) WHERE period = 2),
st AS (SELECT id, stream, step, sum(e) OVER (PARTITION BY id, stream ORDER BY step) / sqrt(step + 1) AS s, sum(e) OVER (PARTITION BY id, stream ORDER BY step ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) / sqrt(least(step + 1, 64)) AS v FROM es)
SELECT id, step, round(ln(step + 1), 5) AS log_n, {wide} FROM st GROUP BY id, step"""


@query("fit_05_analytic", _standardised_sql())
def _(s, d):
    """Sums and windows of the matrix for the streams that SQL can say."""
    m = features.feature_matrix(observations(s, d))
    return m.select("id", "step", *[(F.round(c, 5) + 0.0).alias(c) for c in ["log_n", *[f"{n}_{k}" for n in _STD for k in ("sum", "w64")]]])


def training_rows(s, d) -> DataFrame:
    """Labelled rows of the matrix, every second online step of each series and of two copies with a later start; kept, as each fit reads them."""
    obs = observations(s, d)
    moved = shifted(obs, break_index(obs), 2).withColumn("_id", F.col("id")).withColumn("id", F.concat_ws("#", "id", "copy"))
    index = moved.groupBy("id").agg(F.first("_id").alias("series"), F.first("copy").alias("copy"), F.first("tau").alias("tau"))
    rows = features.feature_matrix(moved.select("id", "period", "pos", "step", "value"), stride=2).join(index, "id")
    label = ((F.col("tau") >= 0) & (F.col("step") >= F.col("tau"))).cast("int").alias("label")
    return rows.select(F.col("series").alias("id"), "copy", "step", label, *_NAMES).persist()


@query("trn_07_trn_12")
def _(s, d):
    """Scores of the ensemble on the odd series, learned on the even ones."""
    from ..operators import ensemble

    rows = training_rows(s, d)
    part = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(2))
    models = ensemble.fit(rows.filter(part == 0), _NAMES)
    return ensemble.score(rows.filter((part == 1) & (F.col("copy") == 0)), _NAMES, models).select("id", "step", "label", "score")


@query("trn_10")
def _(s, d):
    """Scores by models that never saw their series."""
    from ..operators import ensemble

    rows = training_rows(s, d)
    out = ensemble.cross_validated(rows, _NAMES)
    rows.unpersist()
    return out


@query("agg_23")
def _(s, d):
    """Shares of the features in the ensemble's gain, greatest first; one row a feature."""
    from ..operators import ensemble

    models = ensemble.fit(training_rows(s, d), _NAMES)
    return s.createDataFrame(ensemble.importances(models, _NAMES, top=len(_NAMES)), "feature string, share double")


def _has_break(s, d) -> DataFrame:
    return break_index(observations(s, d)).select("id", (F.col("tau") >= 0).cast("int").alias("label"))


@query("tst_13")
def _(s, d):
    """AUC of breaks told from the history's shape alone."""
    from ..operators import ensemble

    shape = observations(s, d).filter("period = 1").groupBy("id").agg(
        F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.count_distinct("value") / F.count("*")).alias("distinct_ratio"),
        F.ln(F.count("*")).alias("log_n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
    ).join(stats.quarter_moments(observations(s, d).filter("period = 1")), "id")
    names = [c for c in shape.columns if c != "id"]
    return ensemble.predictability(shape.join(_has_break(s, d), "id").persist(), names).select(*_r("auc"))


@query("trn_13")
def _(s, d):
    """AUC of breaks told from raw and calibrated statistics of the window after the cut."""
    from ..operators import ensemble

    wide = calibrated.null_windows(scored(s, d), cuts(s, d), "g", _key())
    names = [f"{c}_{k}" for c in calibrated.NULL_STATS for k in ("z", "cal")]
    return ensemble.predictability(wide.join(_has_break(s, d), "id").persist(), names).select(*_r("auc"))


def queries() -> dict:
    return dict(_Q)


def oracles() -> dict[str, str]:
    texts = {name: sql() if callable(sql) else sql for name, sql in _SQL.items()}
    return {name: sql if "FROM events" in sql else OBS + sql for name, sql in texts.items()}
