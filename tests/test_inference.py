import numpy as np
import pytest
from pyspark.sql import functions as F

from echoplot.functions import kernels
from echoplot.operators import dynamics as D
from echoplot.operators import inference as I
from echoplot.operators import meta as M
from echoplot.operators import series as S
from echoplot.streaming import windows as W


def table(seed=0, shift=2.0):
    rng = np.random.default_rng(seed)
    return [(s, s % 2, w, float(rng.normal() + shift * (s % 2) * (w == 3))) for s in range(24) for w in range(5)]


def test_timecourse_finds_the_window(spark):
    df = spark.createDataFrame(table(shift=3.0), "subject long, g int, window int, value double").withColumn("metric", F.lit("m"))
    units = df.select("subject", "g").distinct()
    curve, summary = I.group_timecourse(df.drop("g"), units, 99)
    s = summary.collect()
    assert len(s) == 1 and s[0].peak_window == 3 and s[0].p_peak == pytest.approx(0.01) and s[0].n_windows_tested == 5
    rows = table(shift=3.0)
    a = [v for _, g, w, v in rows if w == 3 and g == 0]
    b = [v for _, g, w, v in rows if w == 3 and g == 1]
    assert curve.where("window = 3").first().auc == pytest.approx(np.mean([y > x for x in a for y in b]))
    dealt = I.label_permutations(units, 20).groupBy("permutation").agg(F.sum("g").alias("ones")).collect()
    assert len(dealt) == 21 and {r.ones for r in dealt} == {12}


@pytest.mark.parametrize("model", ["logistic", "linear_svm"])
def test_classes_apart_are_told(spark, model):
    df = spark.createDataFrame([(s, y, None if s == 5 else v, v * v) for s, y, w, v in table(shift=6.0) if w == 3], "subject long, label int, x double, z double")
    got = I.classify_groups(df, ["x", "z"], model, 2).collect()
    assert len(got) == 2 and np.mean([r.auc for r in got]) > 0.9 and all(0 <= r.accuracy <= 1 for r in got)
    assert I.label_baseline(df).first().accuracy == 0.5


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 1, 1, 0.9), (0, 0, 0, 1, 0.6), (0, 0, 0, 0, 0.2), (0, 0, 1, 0, 0.3)], "repeat int, fold int, label int, prediction int, score double")
    r = I.scores(df).first()
    assert (r.auc, r.accuracy, r.sensitivity, r.specificity, r.precision, r.f1, r.mcc) == (0.75, 0.5, 0.5, 0.5, 0.5, 0.5, 0.0)


def cao_by_hand(x, m_max):
    e, s = [], []
    for m in range(1, m_max + 2):
        y = kernels.embed(x, m + 1, 1)
        d = np.round(np.sqrt(((y[:, None, :m] - y[None, :, :m]) ** 2).sum(-1)), 9)
        d[d <= 1e-9 * np.sqrt(y[:, :m].var(0).sum())] = np.inf
        j, i = d.argmin(1), np.arange(len(y))
        near = d[i, j]
        e.append(np.mean(np.hypot(near, y[i, m] - y[j, m]) / near))
        s.append(np.mean(np.abs(y[i, m] - y[j, m])))
    return np.array(e[1:]) / np.array(e[:-1]), np.array(s[1:]) / np.array(s[:-1])


def test_cao_by_hand(spark):
    x = np.random.default_rng(4).normal(size=40)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "subject long, i long, v double")
    curve = D.cao(df, "v", 1, 2)
    got = {r.m: (r.e1, r.e2) for r in curve.collect()}
    e1, e2 = cao_by_hand(x, 2)
    assert sorted(got) == [1, 2]
    for m in (1, 2):
        assert got[m] == pytest.approx((e1[m - 1], e2[m - 1]), rel=1e-6)
    assert D.estimate_m_cao(curve).first().m in (1, 2)


def test_meta_space(spark):
    df = spark.createDataFrame([(1, w, float(w % 6), 1.0, None if w == 9 else float(w)) for w in range(40)], "subject long, window int, a double, same double, b double")
    for how in M.SCALINGS:
        got = M.meta_space(df, ["a", "same", "b"], how).orderBy("i").collect()
        assert len(got) == 39 and got[0].asDict().keys() == {"subject", "i", "a", "b"}
        if how == "zscore":
            assert np.std([r.a for r in got]) == pytest.approx(1) and np.mean([r.b for r in got]) == pytest.approx(0, abs=1e-9)
        if how == "rank":
            assert max(r.b for r in got) == 1 and min(r.b for r in got) == 0
    assert M.meta_theiler(10, 4) == 3
    assert M.meta_recurrence(df, ["a", "same"], 10, 5, 0.1).first().DET > 0.5


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 3).alias("subject"), F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.when(F.col("id") != 7, F.sin("id")).alias("v"), F.cos("id").alias("p"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    measures = W.channel_measures("v") | {"plv": S.plv("p", "v")}
    stream = W.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["subject"], measures, "20 minutes", "10 minutes")
    q = stream.writeStream.format("memory").queryName("measured").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    key = lambda r: (r.subject, r.start)
    got = sorted(spark.table("measured").collect(), key=key)
    want = sorted(W.windowed(df, "ts", ["subject"], measures, "20 minutes", "10 minutes").collect(), key=key)
    assert len(got) == len(want) > 10
    for a, b in zip(got, want, strict=True):
        assert tuple(a)[:5] == tuple(b)[:5] and a["mean"] == pytest.approx(b["mean"]) and a["plv"] == pytest.approx(b["plv"])
