"""Exact p-values, kept files, and operators on tiny or empty series."""

from math import comb

import pytest
from pyspark.sql import functions as F

from faultline.operators import bayes, calibrated, ensemble, fits, stats, windows
from faultline.plans import catalog
from faultline.sources import artifacts
from faultline.sources import series as src

SCORED = "id string, period int, pos int, step int, value double, u double, g double, z double"


def test_fair_coin_equals_exact_sum():
    for n in (0, 1, 2, 7, 40, 61):
        for k in range(n + 1):
            tail = sum(comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
            assert stats.fair_coin_p(k, n) == pytest.approx(min(1.0, 2 * tail) if 2 * k != n else 1.0, rel=1e-9)
    assert 0 <= stats.fair_coin_p(400_000, 1_000_000) < 1e-300
    assert stats.fair_coin_p(500_000, 1_000_000) == 1.0


def test_matrix_is_rebuilt_only_when_columns_differ(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3).select("id", (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"))

    path = f"{tmp_path}/m"
    assert artifacts.cached(spark, path, ["id", "a"], build).count() == 3
    assert artifacts.cached(spark, path, ["id", "a"], build).columns == ["id", "a"] and len(calls) == 1
    assert artifacts.cached(spark, path, ["id", "b"], build).columns == ["id", "b"] and len(calls) == 2
    artifacts.cached(spark, path, ["id", "b"], build, rebuild=True)
    assert len(calls) == 3


def test_models_score_alike_after_reading_back(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("s"), F.col("id") % 6).alias("id"), F.col("id").alias("step"), (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) + F.col("id") * 0.01).alias("x"))
    models = ensemble.fit(rows, ["x"], seeds=(0, 1), rounds=2)
    artifacts.save_models(models, f"{tmp_path}/models")
    artifacts.save_models(models, f"{tmp_path}/models")
    again = artifacts.load_models(f"{tmp_path}/models", 2)
    a, b = (ensemble.score(rows, ["x"], m).orderBy("step").collect() for m in (models, again))
    assert [r.score for r in a] == [r.score for r in b]


def test_empty_and_one_sided_series(spark):
    empty = spark.createDataFrame([], SCORED)
    cuts = spark.createDataFrame([], "id string, t long")
    assert bayes.bayes_factors(empty).count() == 0
    assert calibrated.calibrated_ewma(empty, "g").count() == 0
    assert stats.anderson_darling(empty).count() == 0
    assert calibrated.null_windows(empty, cuts, "g", F.lit(1)).count() == 0
    assert stats.variance_ratio(empty, cuts, "z").count() == 0
    past = spark.createDataFrame([("a", 1, k + 1, None, float(k), 0.5, 0.0, 0.0) for k in range(5)], SCORED)
    assert bayes.bayes_factors(past).count() == 0 and stats.anderson_darling(past).count() == 0


def test_ties_only_have_a_finite_or_null_statistic(spark):
    flat = spark.createDataFrame([("a", 1 if k < 6 else 2, k + 1, None, 1.0) for k in range(12)], "id string, period int, pos int, step int, value double")
    assert stats.anderson_darling(flat).count() == 1


def test_random_cuts_keep_breaks_and_draw_from_them(spark):
    index = spark.createDataFrame([("a", 30, 100), ("b", -1, 200), ("c", -1, 50), ("d", 80, 100)], "id string, tau int, online_len int")
    got = {r.id: r.t for r in calibrated.random_cuts(index, F.ascii("id")).collect()}
    assert got["a"] == 30 and got["d"] == 80
    assert got["b"] in (61, 161) and got["c"] in (15, 40)
    none = calibrated.random_cuts(index.filter("tau < 0"), F.ascii("id")).collect()
    assert [r.t for r in none] == [None, None]


def test_calibrated_stream_equals_batch_and_carries_state(spark, tmp_path):
    import numpy as np

    from faultline.streaming.online import calibrated_statistics

    rng = np.random.default_rng(5)
    rows = [(i, 1 if p <= n else 2, p, float(v)) for i, n in (("a", 150), ("b", 90), ("c", 3)) for p, v in enumerate(rng.normal(size=n + 60), 1)]
    s = spark.createDataFrame(rows, "id string, period int, pos int, e double")
    params = calibrated.calibration(s, "e", skip=20)
    on = s.filter("period = 2").join(params.select("id", "mu"), "id").withColumn("x", F.col("e") - F.col("mu"))
    curves = calibrated.curve(s.filter("period = 1"), "e", 20)
    batch = calibrated.recalibrated(on, curves, "x", (4, 16)).join(calibrated.calibrated_ewma(s, "e", skip=20).select("id", "pos", "cal_ewma"), ["id", "pos"])
    want = {(r.id, r.pos): (r.sum_z, r.w4, r.w16, r.cal_ewma) for r in batch.collect()}
    for k in range(3):
        online = "pos > CASE id WHEN 'a' THEN 150 WHEN 'b' THEN 90 ELSE 3 END + {} AND pos <= CASE id WHEN 'a' THEN 150 WHEN 'b' THEN 90 ELSE 3 END + {}"
        s.filter(online.format(20 * k, 20 * k + 20)).select("id", "pos", "e").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema("id string, pos int, e double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = calibrated_statistics(stream, params, (4, 16)).writeStream.format("memory").queryName("calibrated").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.id, r.pos): (r.cal_sum, r.cal_w4, r.cal_w16, r.cal_ewma) for r in spark.table("calibrated").collect()}
    assert got.keys() == want.keys() and len(got) == 180
    for k in want:
        assert [x is None for x in got[k]] == [x is None for x in want[k]], k
        assert np.allclose([x or 0.0 for x in got[k]], [x or 0.0 for x in want[k]], atol=1e-9), k


def test_learning_curve_and_length_diagnostic(spark):
    rows = spark.range(600).select(F.concat(F.lit("s"), F.col("id") % 40).alias("id"), F.floor(F.col("id") / 40).alias("step"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.col("id") * 0.001).alias("x"))
    got = {r.share: r.auc for r in ensemble.learning_curve(rows, ["x"], (1.0, 0.5, 0.0), seeds=(0,), rounds=2).collect()}
    assert got.keys() == {1.0, 0.5} and all(a > 0.9 for a in got.values())
    wide = ensemble.with_length(rows, rows.groupBy("id").agg(F.count("*").alias("online_len")))
    r = wide.filter("id = 's3' AND step = 2").head()
    assert r.frac == pytest.approx(3 / 15) and "online_len" not in wide.columns


def test_chunks_keep_every_row(spark):
    rows = [(k, e, float(e)) for k, n in (("a", 17), ("b", 10), ("c", 4), ("d", 1)) for e in range(n)]
    table = spark.createDataFrame(rows, "k string, e long, v double")
    got = src.chunked(table, "k", "e", "v", 3, 2)
    size = {r.id: (r.h, r.o, r.first, r.last) for r in got.groupBy("id").agg(F.count_if(F.col("period") == 1).alias("h"), F.count_if(F.col("period") == 2).alias("o"), F.min("value").alias("first"), F.max("value").alias("last")).collect()}
    assert size == {"a-0": (3, 2, 0, 4), "a-1": (3, 2, 5, 9), "a-2": (3, 4, 10, 16), "b-0": (3, 2, 0, 4), "b-1": (3, 2, 5, 9), "c-0": (2, 2, 0, 3), "d-0": (1, 0, 0, 0)}
    assert sorted((r.pos, r.step) for r in got.filter("id = 'a-2' AND period = 2").collect()) == [(4, 0), (5, 1), (6, 2), (7, 3)]
    assert got.count() == len(rows)


def test_flagship_takes_all_events(spark):
    sf = "/root/testdata/sf0.001"
    obs = catalog.observations(spark, sf, 100, 50)
    assert obs.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert catalog.flagship(spark, sf).count() == obs.filter("period = 2").count()


def test_short_histories_have_defined_fits(spark):
    z = windows.standardised(windows.normal_scores(src.chunked(spark.range(5).selectExpr("'a' AS k", "id AS e", "CAST(id AS double) AS v"), "k", "e", "v", 450, 150)))
    assert fits.learned(z).head().lam_mean is None and fits.garch(z).count() == 1 and fits.ar(z).head().phi is None


def test_whole_menus_equal_numpy(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=230)
    rows = spark.createDataFrame([("a", k + 1, float(v)) for k, v in enumerate(x)], "id string, pos int, value double")
    bm = stats.batch_sd(rows, "value").head()
    for n in (25, 50, 100):
        m = len(x) // n
        assert bm[f"bm{n}"] == pytest.approx(x[: m * n].reshape(m, n).mean(1).std(ddof=1) * n**0.5)
    lb, r2 = stats.portmanteau(rows, "value").head(), [np.corrcoef(x[k:], x[:-k])[0, 1] ** 2 for k in range(1, 31)]
    assert (lb.lb10, lb.lb30) == (pytest.approx(sum(r2[:10])), pytest.approx(sum(r2)))
    q = stats.quarter_moments(rows).head()
    assert q.mean_first_q == pytest.approx(x[:57].mean() - x.mean()) and q.sd_last_q == pytest.approx(x[-57:].std() / x.std())


def test_agg_22_ranks_every_stream(spark):
    got = {r.feature: r.auc for r in catalog.queries()["agg_22_srt_03"](spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == set(catalog.STREAMS) and len(got) == 46
    assert all(0 <= v <= 1 for v in got.values())


def test_streams_of_residual_volatility_and_whitening_equal_loops(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=160)
    s = spark.createDataFrame([("a", 1 if k < 100 else 2, k + 1, float(v), float(v), float(v)) for k, v in enumerate(x)], "id string, period int, pos int, g double, z double, r double")
    rows = windows.residual_streams(windows.volatility_streams(windows.calibrated_streams(s))).orderBy("pos").collect()
    v, vol, last = 1.0, 1.0, 0.0
    for k, r in enumerate(rows):
        b = x[k] / v**0.5
        assert (r.w99_lvl, r.w99_ac1, r.zf2) == (pytest.approx(b), pytest.approx(b * last), pytest.approx(x[k] ** 2 / vol))
        v, vol, last = 0.99 * v + 0.01 * x[k] ** 2, 0.94 * vol + 0.06 * x[k] ** 2, b
    from statistics import NormalDist

    h = np.sort(x[:100])
    g = NormalDist().inv_cdf(((np.searchsorted(h, x[150], "left") + np.searchsorted(h, x[150], "right")) / 2 + 0.5) / 101)
    assert rows[150].absrg == pytest.approx(abs(g)) and rows[150].rg2 == pytest.approx(g * g)
    nl = fits.learned_streams(s).collect()
    # leave-one-out values of the history from the tenth place on, and the online rows
    assert len(nl) == 150 and all(r.nl_std2 == pytest.approx(r.nl_e2 / np.exp(r.nl_logv)) for r in nl)


def test_ensemble_queries_run_with_the_defaults(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ensemble, "cross_validated", lambda f, c, folds=5, **o: seen.append((len(c), folds, o)) or f)
    monkeypatch.setattr(ensemble, "predictability", lambda f, c, folds=5, **o: seen.append((len(c), folds, o)) or spark.createDataFrame([(0.5,)], "auc double"))
    monkeypatch.setattr(ensemble, "fit", lambda f, c, **o: seen.append((len(c), 5, o)) or [])
    monkeypatch.setattr(ensemble, "importances", lambda m, c, **o: [("x", 1.0)])
    monkeypatch.setattr(ensemble, "score", lambda f, c, m: f.withColumn("score", F.lit(0.0)))
    for name in ("trn_07_trn_12", "trn_10", "agg_23", "tst_13", "trn_13"):
        catalog.queries()[name](spark, "/root/testdata/sf0.01")
    # the matrix of the reference, which the Bayes factors are not part of
    assert seen == [(n, 5, {}) for n in (417, 417, 417, 12, 10)]


def _labelled(spark, n=1200):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(n, 3)).round(3)
    rows = [(f"s{k % 40}", k // 40, int(a + 0.5 * b * b > 0.6), float(a), float(b), None if k % 50 == 0 else float(c), 1.0 + k % 2) for k, (a, b, c) in enumerate(x)]
    return spark.createDataFrame(rows, "id string, step int, label int, a double, b double, c double, w double")


def test_models_of_all_folds_and_seeds_share_their_passes(spark):
    rows, sc = _labelled(spark), spark.sparkContext
    jobs = []
    for k, seeds in enumerate(((0,), (0, 1, 2))):
        sc.setJobGroup(f"cv{k}", "")
        out = ensemble.cross_validated(rows, ["a", "b", "c"], seeds=seeds, rounds=2, depth=2)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"cv{k}")))
        assert out.count() == 1200 and stats.pooled_auc(out).head().auc > 0.8
    sc.setJobGroup("rest", "")
    assert jobs[1] <= jobs[0] + 2  # MLlib had a chain of jobs for each model


@pytest.mark.parametrize("weight", [None, "w"])
def test_scores_do_not_depend_on_partitions(spark, weight):
    rows = _labelled(spark)
    got = [{(r.id, r.step): r.score for r in ensemble.cross_validated(rows.repartition(n), ["a", "b", "c"], seeds=(0, 1), rounds=3, depth=3, weight=weight).collect()} for n in (1, 3)]
    assert len(got[0]) == 1200 and got[0] == pytest.approx(got[1], abs=1e-9)


@pytest.mark.parametrize("weight", [None, "w"])
def test_trees_equal_those_of_plain_loops(spark, weight):
    import numpy as np

    from faultline.operators import boosting

    names, depth, rate = ["a", "b", "c"], 3, 0.1
    rows = _labelled(spark).withColumn("fold", (F.col("step") % 2).cast("int")).coalesce(2)
    table = boosting.chunks(rows, names, boosting.bounds(rows, names, 1200), weight).persist()
    models = [boosting.Model(0, 5), boosting.Model(1, 6)]
    boosting.train(table, models, 3, 3, rate, depth)
    parts = [boosting._opened(r, 3) for b in table.toArrow().to_batches() for r in boosting._rows(b)]
    label, fold = (np.concatenate([p[0].column(c).to_numpy() for p in parts]) for c in ("label", "fold"))
    draws, w, bins = (np.concatenate([p[k] for p in parts], axis=-1) for k in (1, 2, 3))
    y = np.where(label > 0, 1.0, -1.0)
    for m in models:
        margin = np.zeros(len(y))
        for turn, tree in enumerate(m.trees):
            g = 4 * y / (1 + np.exp(2 * y * margin)) if turn else y
            part = boosting._drawn(draws, m.seed, turn) & (fold != m.fold)
            assert 0.7 < part.sum() / (fold != m.fold).sum() < 0.9
            rng = np.random.default_rng((m.seed, turn, m.fold + 1))
            at = np.zeros(len(y), int)
            for level in range(depth):
                turns = np.zeros(len(y), int)
                for n in range(2**level):
                    chosen, here = sorted(rng.permutation(3)[:3]), (at == n) & part
                    if not here.any():
                        continue
                    cost = {}
                    for c in chosen:
                        for b in range(31):
                            sides = [here & (bins[c] <= b), here & (bins[c] > b)]
                            if all(s.any() for s in sides):
                                cost[c, b] = sum((w[s] * (g[s] - np.average(g[s], weights=w[s])) ** 2).sum() for s in sides)
                    c, b = (tree.column[2**level - 1 + n], tree.bound[2**level - 1 + n])
                    if b == 255:
                        mean = np.average(g[here], weights=w[here])
                        assert min(cost.values(), default=1e9) > (w[here] * (g[here] - mean) ** 2).sum() - 1e-6
                    else:
                        assert cost[c, b] == pytest.approx(min(cost.values()), abs=1e-4)
                    turns[(at == n) & (bins[c] > b)] = 1
                at = 2 * at + turns
            assert (tree.place(bins, depth) == at).all()
            for leaf in set(at[part].tolist()):
                s = part & (at == leaf)
                assert tree.value[leaf] == pytest.approx(np.average(g[s], weights=w[s]), abs=1e-5)
            margin += (rate if turn else 1.0) * np.array(tree.value)[at]
        assert np.allclose(m.margin(bins, rate), margin)


def test_a_single_fold_or_class_and_no_rows(spark):
    rows = _labelled(spark)
    one = ensemble.cross_validated(rows.filter("id = 's1'"), ["a", "b"], rounds=2, depth=2)
    assert one.count() == 30 and {r.score for r in one.collect()} == {0.0}  # no other series to learn from
    same = ensemble.cross_validated(rows.withColumn("label", F.lit(1)), ["a"], seeds=(0,), rounds=2, depth=2)
    assert same.count() == 1200 and all(r.score > 0 for r in same.collect())
    assert ensemble.cross_validated(rows.limit(0), ["a"]) is None
