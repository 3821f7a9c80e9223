"""The feature row against sums written out place by place, the window operators and the stream; fits and scales against NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from statistics import NormalDist

from faultline.operators import calibrated, features, fits, stats, windows
from faultline.plans import catalog
from faultline.sources import artifacts, datasets, series as src
from faultline.streaming.online import score_stream

SCHEMA = "id string, period int, pos int, step int, value double"


def table(spark, parts):
    rows = []
    for name, (x, n) in parts.items():
        rows += [(name, 1 if p < n else 2, p + 1, p - n if p >= n else None, float(v)) for p, v in enumerate(x)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def wave(n, seed, ties=False):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for k in range(1, n):
        x[k] = 0.5 * x[k - 1] + rng.normal()
    return np.round(x, 1) if ties else x


#: Name: values and length of the history.
PARTS = {"long": (wave(700, 1), 450), "short": (wave(120, 2, True), 45), "mid": (wave(360, 3, True), 301), "edge": (wave(330, 4), 300)}


@pytest.fixture(scope="module")
def parts(spark):
    return table(spark, PARTS).persist()


@pytest.fixture(scope="module")
def matrix(parts):
    out = {}
    for r in features.feature_matrix(parts).collect():
        out.setdefault(r.id, {})[r.step] = r
    return out


def normal(values, x):
    n = len(values)
    return NormalDist().inv_cdf((((values < x).sum() + (values <= x).sum()) / 2 + 0.5) / (n + 1))


def test_names():
    assert len(features.FEATURES) == len(set(features.FEATURES)) == 417


def test_statistics_of_a_stream_written_out(matrix):
    x, n = PARTS["long"]
    hist = x[:n]
    g = np.array([normal(hist, v) for v in x])
    raw = np.abs(g[1:] * g[:-1])  # vol1; place k of it is place k + 1 of x
    past = raw[19 : n - 1]
    d = past - past.mean()
    lags = math.ceil(len(d) ** (1 / 3) - 1e-9)
    c = [sum(d[k + j] * d[k] for k in range(len(d) - j)) / len(d) for j in range(lags + 1)]
    sd = math.sqrt(max(c[0] + 2 * sum((1 - j / (lags + 1)) * c[j] for j in range(1, lags + 1)), 0.1 * c[0]))
    e = (raw[n - 1 :] - past.mean()) / sd
    up = dn = ew = 0.0
    for t, v in enumerate(e):
        up, dn, ew = max(0.0, up + v - 0.3), max(0.0, dn - v - 0.3), 0.97 * ew + 0.03 * v
        r = matrix["long"][t]
        best = max(((sum(e[j : t + 1]) ** 2 / (t + 1 - j), t + 1 - j) for j in range(t + 1)))
        want = {"sum": e[: t + 1].sum() / math.sqrt(t + 1), "w16": e[max(0, t - 15) : t + 1].sum() / math.sqrt(min(t + 1, 16)), "up3": up, "dn3": dn, "ewma": ew * math.sqrt(1.97 / 0.03), "glr_age": math.log(best[1])}
        got = {k: r[f"vol1_{k}"] for k in want}
        assert got == pytest.approx(want, abs=1e-8)
        assert r["vol1_glr"] ** 2 == pytest.approx(best[0], abs=1e-8)
        assert r["log_n"] == pytest.approx(math.log(t + 1))


def test_calibrated_block_written_out(matrix):
    x, n = PARTS["long"]
    g = np.array([normal(x[:n], v) for v in x])
    v, base, prev, stream = 1.0, [], 0.0, []
    for k in range(20, len(x)):
        b = g[k] / math.sqrt(v)
        v = 0.97 * v + 0.03 * g[k] ** 2
        stream.append(abs(b) * abs(prev))
        prev = b
    past = np.array(stream[180 : n - 20])
    e, h = np.array(stream[n - 20 :]) - past.mean(), past - past.mean()
    sds = []
    for j in range(11):
        k = 1 << j
        sds.append(np.std([h[a : a + k].sum() for a in range(len(h) - k + 1)]) if k < len(h) // 2 else sds[-1] * math.sqrt(2))
    at = lambda k: math.exp(np.interp(math.log2(k), range(11), np.log(sds)))
    w, run = 0.0, []
    for y in h:
        w = 0.97 * w + 0.03 * y
        run.append(w)
    w, scale = 0.0, np.std(run[100:])
    for t, y in enumerate(e):
        w = 0.97 * w + 0.03 * y
        r = matrix["long"][t]
        assert r["c_w97_vol1_sum"] == pytest.approx(e[: t + 1].sum() / at(t + 1), abs=1e-7)
        assert r["c_w97_vol1_w16"] == pytest.approx(e[max(0, t - 15) : t + 1].sum() / at(min(t + 1, 16)), abs=1e-7)
        assert r["c_w97_vol1_ewma"] == pytest.approx(w / scale, abs=1e-7)


def test_learned_and_residual_streams_against_least_squares(matrix):
    x, n = PARTS["long"]
    z = (x - x[:n].mean()) / x[:n].std()
    lags = np.array([[z[k - j] for j in range(1, 21)] for k in range(20, len(z))])
    phi = np.linalg.solve(lags[: n - 20].T @ lags[: n - 20], lags[: n - 20].T @ z[20:n])
    r = z[20:] - lags @ phi
    e = r / r[: n - 20].std()
    null = features.Null(x[:n])
    rows, _ = null.streams(x[n:], dict(null.start))
    assert rows[:, features.STREAMS.index("r")] == pytest.approx(e[n - 20 :], abs=1e-8)
    g = null.score(x)
    # leave-one-out by leaving out
    lag = np.array([g[k - 10 : k][::-1] for k in range(10, n)])
    f, y = fits.random_features(lag), g[10:n]
    assert f.shape[1] == 110
    left = null.predictors.e2
    lam = null.predictors.lam_mean * len(y)
    for k in (0, 17, 200):
        # with the penalty fixed at n rows and the mean left to move, as the closed form has it
        one = np.column_stack([np.ones(len(y)), f - f.mean(axis=0)])
        keep = np.arange(len(y)) != k
        penalty = np.diag([0.0] + [lam] * 110)
        beta = np.linalg.solve(one[keep].T @ one[keep] + penalty, one[keep].T @ y[keep])
        assert left[k] == pytest.approx((y[k] - one[k] @ beta) ** 2, rel=1e-6, abs=1e-9)


def test_streams_equal_the_window_operators(parts, matrix):
    z = windows.standardised(windows.normal_scores(parts)).select("id", "pos", "period", "step", "value", "g", "z")
    wide = windows.residual_streams(windows.streams(fits.ar_residuals(z, fits.ar(z))))
    wide = windows.volatility_streams(windows.calibrated_streams(wide.filter("pos > 20"))).join(fits.learned_streams(z), ["id", "pos"], "left")
    got = {}
    for r in wide.filter("period = 2").collect():
        got.setdefault(r.id, {})[r.step] = r
    for name in ("long", "mid"):
        x, n = PARTS[name]
        null = features.Null(x[:n])
        rows, cal = null.streams(x[n:], dict(null.start))
        for t in range(len(rows)):
            r = got[name][t]
            assert [r[s] for s in features.STREAMS] == pytest.approx(rows[t].tolist(), abs=1e-7), (name, t)
            assert [r[s] for s in features.CAL_STREAMS] == pytest.approx(cal[t].tolist(), abs=1e-7)


def test_short_histories_give_nulls(matrix):
    row = matrix["short"][3]
    assert row["z_sum"] is not None and row["c_g_lvl_sum"] is None and row["c_g_lvl_ewma"] is None
    assert matrix["edge"][3]["c_g_lvl_sum"] is not None and matrix["edge"][3]["c_g_lvl_ewma"] is None
    assert abs(matrix["mid"][3]["c_g_lvl_ewma"]) > 1e3  # one row has no spread, so the floor of the sd counts
    assert len(matrix["short"]) == 75


def test_stream_of_features_and_scores_equals_batch(spark, parts, tmp_path):
    from faultline.operators import ensemble

    matrix = features.feature_matrix(parts).persist()
    labelled = matrix.withColumn("label", (F.col("step") > 30).cast("int"))
    models = ensemble.fit(labelled, features.FEATURES, seeds=(0,), rounds=2, depth=2)
    want = {(r.id, r.step): r for r in ensemble.score(matrix, features.FEATURES, models).collect()}
    nulls = features.fit_nulls(parts).persist()
    on = parts.filter("period = 2")
    for a, b in ((0, 1), (1, 20), (20, 75), (75, 400)):
        on.filter(f"step >= {a} AND step < {b}").select("id", "pos", "value").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    lengths = {name: n for name, (_, n) in PARTS.items()}

    def run(name, of):
        stream = spark.readStream.schema("id string, pos long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = of(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r.id, r.pos - lengths[r.id] - 1): r for r in spark.table(name).collect()}

    got = run("rows", lambda s: features.stream_features(s, nulls))
    assert got.keys() == want.keys()
    for key, r in got.items():
        for f in features.FEATURES:
            assert (r[f] is None) == (want[key][f] is None) and (r[f] is None or r[f] == pytest.approx(want[key][f], rel=1e-7, abs=1e-7)), (key, f)
    scored = run("scored", lambda s: score_stream(s, nulls, models))
    assert {k: r.score for k, r in scored.items()} == pytest.approx({k: r.score for k, r in want.items()}, abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 257, 300, 301, 600, 7000])
def test_scales_of_any_length_equal_numpy(spark, n):
    x = wave(n, 10 + n)
    hist = table(spark, {"a": (x, n)}).withColumnRenamed("value", "g")
    d = x - x.mean()
    lags = math.ceil(n ** (1 / 3) - 1e-9)
    c = [(d[j:] @ d[: n - j]) / n for j in range(min(lags, n - 1) + 1)]
    total = c[0] + 2 * sum((1 - j / (lags + 1)) * c[j] for j in range(1, len(c)))
    want = 1e-6 if c[0] <= 0 else math.sqrt(max(total, 0.1 * c[0]))
    assert windows.long_run_sd(hist, "g").head().lrsd == pytest.approx(want, abs=1e-9)
    s = np.concatenate([[0], np.cumsum(x)])
    sds = []
    for h in range(11):
        k = 1 << h
        sds.append(np.std(s[k:] - s[:-k]) if k < n // 2 else sds[-1] * math.sqrt(2) if sds and sds[-1] is not None else None)
    got = [r.sd for r in windows.horizon_sd(hist, "g").orderBy("h").collect()]
    assert got == sds if sds[0] is None else got == pytest.approx(sds, abs=1e-9)


@pytest.mark.parametrize("decay", [0.5, 0.94, 0.999, 1e-30])
def test_exponential_sums_equal_a_loop_over_blocks(spark, decay):
    x = wave(1500, 8)
    rows = table(spark, {"a": (x, 1500)}).withColumn("q", F.col("value") * F.col("value"))
    got = [r.vol for r in windows.volatility(rows, "q", decay).orderBy("pos").collect()]
    v, want = 1.0, []
    for y in x:
        want.append(v)
        v = decay * v + (1 - decay) * y * y
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError):
        windows.volatility(rows, "q", 1.0)


@pytest.mark.parametrize("n,block", [(1, 256), (40, 7), (900, 64)])
def test_best_start_equals_all_starts(n, block):
    for x in (wave(n, 5), np.zeros(n), np.ones(n), np.round(wave(n, 6))):
        stat, age = windows.best_start(x, block)
        s = np.concatenate([[0], np.cumsum(x)])
        for t in range(n):
            ratio = (s[t + 1] - s[: t + 1]) ** 2 / (t + 1 - np.arange(t + 1))
            j = int(np.argmax(ratio))
            assert stat[t] ** 2 == pytest.approx(ratio[j], abs=1e-9)
            if np.sum(ratio > ratio[j] - 1e-9) == 1 or not x.any():
                assert age[t] == t + 1 - j


def test_garch_meets_a_fine_grid(spark):
    rng = np.random.default_rng(4)
    x, v = [], 1.0
    for _ in range(600):
        x.append(math.sqrt(v) * rng.normal())
        v = 0.05 + 0.15 * x[-1] ** 2 + 0.8 * v
    fitted = fits.garch(table(spark, {"a": (np.array(x), 600)}).withColumnRenamed("value", "g")).head()
    a, b = np.meshgrid(np.linspace(1e-4, 0.5, 60), np.linspace(0, 0.998, 120))
    cost = fits.garch_nll(np.array(x) ** 2, a, b)
    assert fitted.nll <= cost.min() + 1e-3
    assert fitted.a + fitted.b < 0.999
    assert fitted.nll == pytest.approx(float(fits.garch_nll(np.array(x) ** 2, np.array(fitted.a), np.array(fitted.b))))


def test_ridge_chooses_the_least_leave_one_out_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = x @ [1.0, 0, 0, -0.5, 0] + 0.3 * rng.normal(size=60)
    coef, const, lam, left = fits.ridge_loo(x, y)
    errors = []
    for g in fits.NL_GRID:
        one = np.column_stack([np.ones(60), x - x.mean(axis=0)])
        hat = one @ np.linalg.solve(one.T @ one + np.diag([0.0] + [g * 60] * 5), one.T)
        errors.append(float((((y - hat @ y) / (1 - np.diag(hat))) ** 2).sum()))
        if g == lam:
            assert left == pytest.approx((y - hat @ y) / (1 - np.diag(hat)))
            assert x @ coef + const == pytest.approx(hat @ y)
    assert lam == fits.NL_GRID[int(np.argmin(errors))]


@pytest.mark.parametrize("n", [1, 5, 10, 20, 21])
def test_learned_of_short_histories(spark, n):
    row = fits.learned(table(spark, {"a": (wave(n, 2), n)}).withColumnRenamed("value", "g")).head()
    assert (row.mse_nl is None) == (n < 21)


@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_numbering_by_ranges(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k) for k in rng.sample(range(10_000), 500)]
    got = src.numbered(spark.createDataFrame(rows, "k string, o long").repartition(3), "k", "o", ranges).collect()
    for key in ("a", "b", None):
        order = sorted(o for k, o in rows if k == key)
        assert {(r.o, r._r, r._n) for r in got if r.k == key} == {(o, i, len(order)) for i, o in enumerate(order)}


def test_all_rows_enter_series(spark):
    rows = [("a", k) for k in range(1390)] + [("b", k) for k in range(70)] + [("c", 1)]
    table_ = spark.createDataFrame(rows, "k string, o long").withColumn("v", F.lit(1.0))
    got = {r.id: (r.h, r.n) for r in src.chunked(table_, "k", "o", "v", 450, 150, ranges=3).groupBy("id").agg(F.count_if(F.col("period") == 1).alias("h"), F.count("*").alias("n")).collect()}
    assert got == {"a-0": (450, 600), "a-1": (450, 790), "b-0": (52, 70), "c-0": (1, 1)}


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_pooled_auc_by_ranges(spark, ranges):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(300)]
    got = stats.pooled_auc(spark.createDataFrame(rows, "label int, score double"), ranges=ranges).head().auc
    pairs = [(p, q) for p in (s for y, s in rows if y) for q in (s for y, s in rows if not y)]
    assert got == pytest.approx(sum((p > q) + 0.5 * (p == q) for p, q in pairs) / len(pairs))
    assert stats.pooled_auc(spark.createDataFrame([(1, 0.5)], "label int, score double"), ranges=ranges).head().auc == 0.5


def test_blocks_scores_and_datasets(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "id string, step int, x double")
    artifacts.save_block(spark.createDataFrame([("a", 1, 5.0)], "id string, step int, y double"), str(tmp_path), "more")
    assert sorted(map(tuple, artifacts.with_blocks(rows, str(tmp_path), ["more"]).collect())) == [("a", 0, 1.0, None), ("a", 1, 2.0, 5.0)]
    for tag, s in (("one", 0.25), ("two", 0.5)):
        artifacts.save_scores(spark.createDataFrame([("a", 1, 0, s)], "id string, step int, fold int, score double"), str(tmp_path), tag)
    assert [tuple(r) for r in artifacts.load_scores(spark, str(tmp_path), ["one", "two"]).collect()] == [("a", 1, 0.25, 0.5)]
    obs = [(1, 1, 0, 2.0), (1, 2, 1, 3.0), (2, 1, 2, 1.0)]
    spark.createDataFrame(obs, "id long, period int, seq int, value float").write.parquet(f"{tmp_path}/X_train.parquet")
    spark.createDataFrame([(1, 0), (2, -1)], "id long, tau_index long").write.parquet(f"{tmp_path}/y_train_index.parquet")
    rows, breaks = datasets.load(spark, str(tmp_path), "train", "seq")
    assert sorted((r.id, r.pos, r.step) for r in rows.collect()) == [(1, 1, None), (1, 2, 0), (2, 1, None)]
    assert sorted(map(tuple, breaks.collect())) == [(1, 0), (2, -1)]
    datasets.register(spark, str(tmp_path), ["X_train"])
    assert spark.sql("SELECT count(*) FROM X_train").head()[0] == 3


def test_command_line(capsys):
    from faultline.__main__ import main

    main(["list"])
    assert "fit_05_matrix" in capsys.readouterr().out.split()
    main(["run", "src_01", "--data", "x", "--sql"])
    assert capsys.readouterr().out.strip() == catalog.oracles()["src_01"]


def test_calibrated_sums_need_a_curve(spark, parts):
    z = windows.standardised(windows.normal_scores(parts))
    on = calibrated.centred(z, "g").filter("period = 2").select("id", "pos", "step", "e")
    got = calibrated.calibrated_sums(on, calibrated.curve(z.filter("period = 1"), "g"), "e").filter("step = 20").collect()
    assert {r.id: r.cal_sum is None for r in got} == {"long": False, "mid": False, "edge": False, "short": True}
