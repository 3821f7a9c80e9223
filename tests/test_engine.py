"""Every query against its DuckDB SQL, NumPy twins of the window formulations, and the stream against the batch."""

import glob
import os

import duckdb
import numpy as np
import pytest
from statistics import NormalDist

from faultline.functions.normal import ndtri
from faultline.operators import ensemble, stats, windows
from faultline.plans import catalog
from faultline.sources import series as src
from faultline.streaming.online import online_statistics

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name, monkeypatch):
    # ensembles as small as can be: what they learn is tested elsewhere
    monkeypatch.setattr(ensemble, "ROUNDS", 1)
    monkeypatch.setattr(ensemble, "SEEDS", (0,))
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    sql = catalog.oracles().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    assert rows == sorted(repr(tuple(r[rel.columns.index(c)] for c in cols)) for r in rel.fetchall())


def test_entry_runs(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").count() > 0


def test_ndtri(spark):
    us = [1e-12, 1e-6, 0.01, 0.2, 0.5, 0.7, 0.93, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(u,) for u in us], "u double").select("u", ndtri("u").alias("x")).collect()
    assert all(abs(r.x - NormalDist().inv_cdf(r.u)) < 1e-9 * max(1, abs(r.x)) for r in got)


def toy(spark, n_hist=40, n_on=60):
    x = np.random.default_rng(1).integers(0, 9, (2, n_hist + n_on)).astype(float)
    rows = [(f"s{k}", 1 if p < n_hist else 2, p + 1, p - n_hist if p >= n_hist else None, float(v)) for k in range(2) for p, v in enumerate(x[k])]
    return x, spark.createDataFrame(rows, "id string, period int, pos int, step int, value double")


def test_rank_join_equals_searchsorted_with_ties(spark):
    x, s = toy(spark)
    for r in windows.rank_join(s).collect():
        h = np.sort(x[int(r.id[1])][:40])
        assert (r.bl, r.br) == (np.searchsorted(h, r.value, "left"), np.searchsorted(h, r.value, "right"))


def test_stream_equals_batch_and_carries_state(spark, tmp_path):
    _, s = toy(spark)
    params = windows.history_moments(s)
    on = s.filter("period = 2")
    z = on.join(params, "id").selectExpr("id", "pos", "step", "(value - mu) / sd AS e")
    batch = windows.ewma(windows.cusum(windows.running_z(z, "e"), "e", 0.1), "e")
    want = {(r.id, r.pos): (r.sum_z, r.cusum_up, r.cusum_dn, r.ewma) for r in batch.collect()}
    for k in range(3):
        on.filter(f"pos > {40 + 20 * k} AND pos <= {60 + 20 * k}").select("id", "pos", "value").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema("id string, pos int, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = online_statistics(stream, params).writeStream.format("memory").queryName("online").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.id, r.pos): (r.sum_z, r.cusum_up, r.cusum_dn, r.ewma) for r in spark.table("online").collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_validate_rejects_interleaved_and_unindexed(spark):
    s = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 1, 3), ("b", 1, 1), ("b", 2, 2)], "id string, period int, pos int")
    bad = src.validate(s, spark.createDataFrame([("a",)], "id string")).collect()
    assert sorted(map(tuple, bad)) == [("a", "interleaved periods"), ("b", "no index row")]


def test_auc_is_half_without_both_classes_and_counts_ties(spark):
    one = spark.createDataFrame([(1, 1, 0.3), (1, 1, 0.4)], "step int, label int, score double")
    assert stats.ts_auc(one).head()[0] == 0.5
    tied = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5), (2, 1, 0.9), (2, 0, 0.1)], "step int, label int, score double")
    assert stats.ts_auc(tied).head()[0] == 0.75
