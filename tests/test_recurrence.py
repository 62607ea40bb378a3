import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoplot.functions import kernels
from echoplot.operators import recurrence as R
from echoplot.operators import series as S
from echoplot.records import CapabilityError, ParameterError, Record


def naive(x, eps, theiler):
    """Histograms of a dense matrix, cell by cell."""
    n = len(x)
    hit = np.array([[abs(i - j) >= theiler and np.round(kernels.gap(x[i], x[j]), 9) <= eps for j in range(n)] for i in range(n)])
    out = {"diagonal": {}, "vertical": {}, "white_vertical": {}}

    def lines(kind, cells):
        run = 0
        for c in [*cells, False]:
            if c:
                run += 1
            elif run:
                out[kind][run] = out[kind].get(run, 0) + 1
                run = 0

    for k in range(-n + 1, n):
        lines("diagonal", [hit[i, i + k] for i in range(n) if 0 <= i + k < n])
    for j in range(n):
        lines("vertical", hit[:, j])
        i = 0
        while i < n:
            k = i
            while k < n and not hit[k, j] and abs(k - j) >= theiler:
                k += 1
            left = i > 0 and abs(i - 1 - j) < theiler
            right = k < n and abs(k - j) < theiler
            if k > i and not left and not right:
                out["white_vertical"][k - i] = out["white_vertical"].get(k - i, 0) + 1
            i = k + 1
    return out, int(hit.sum())


@pytest.mark.parametrize("n,theiler", [(5, 0), (17, 1), (40, 3)])
def test_paths_agree_with_the_dense_matrix(spark, n, theiler):
    x = np.round(np.random.default_rng(n).normal(size=(n, 2)), 2)
    eps = kernels.pair_quantile(x, 0.2, theiler, "euclidean")
    want, total = naive(x, eps, theiler)
    got = kernels.recurrence_histogram(x, 0.2, theiler)
    assert got == kernels.recurrence_histogram(x, 0.2, theiler, columns=7, dense=0)
    for kind in want:
        assert {a: c for k, a, c, _ in got if k == kind} == want[kind]
    assert next(c for k, _, c, _ in got if k == "recurrent") == total
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(x)], "subject long, i long, x double, y double")
    pair = R.pairs(df, ["x", "y"], theiler)
    rec = R.recurrent(pair, R.threshold(pair, "target_rr", 0.2))
    rows = R.line_histogram(rec, R.unit_sizes(df), theiler).collect()
    for kind in want:
        assert {r.length: r.cnt for r in rows if r.kind == kind} == want[kind]


@pytest.mark.parametrize("theiler,q", [(0, 0.03), (1, 0.05), (2, 0.999), (1, 0.0), (1, 1.0)])
def test_quantile_in_bins_equals_the_sorted_one(theiler, q):
    for x in (np.random.default_rng(2).normal(size=(90, 2)), np.repeat([[0.0], [1.0], [1.5]], 30, axis=0)):
        d = [np.round(kernels.gap(x[i], x[j]), 9) for i in range(90) for j in range(90) if abs(i - j) >= theiler]
        assert kernels.pair_quantile(x, q, theiler, "euclidean", most=50) == pytest.approx(np.quantile(d, q), abs=2e-9)


def test_lines_hold_all_recurrent_points():
    x = np.random.default_rng(1).normal(size=(60, 3))
    h = kernels.recurrence_histogram(x, 0.1)
    assert sum(a * c for k, a, c, _ in h if k == "diagonal") == next(c for k, _, c, _ in h if k == "recurrent")


def test_determinism_order(spark):
    def det(x):
        h = kernels.recurrence_histogram(x, 0.05)
        total = next(c for k, _, c, _ in h if k == "recurrent")
        return sum(a * c for k, a, c, _ in h if k == "diagonal" and a >= 2) / total

    t = np.arange(800)
    sine = np.column_stack([np.sin(t / 9.7), np.cos(t / 9.7)])
    assert det(np.random.default_rng(0).normal(size=(800, 1))) == pytest.approx(1 - 0.95**2, rel=0.25)
    assert det(sine) > 0.9 and det(kernels.integrate("lorenz", 800)) > 0.9


def test_windows_and_record(spark):
    df = spark.range(50).select(F.lit(1).alias("subject"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    w = S.into_windows(df, 20, 10).groupBy("window").count().collect()
    assert sorted((r["window"], r["count"]) for r in w) == [(0, 20), (1, 20), (2, 20), (3, 20)]
    r = Record(df, 2.0, {"v": "raw"})
    assert r.window(10, 30).df.count() == 20 and r.subsample(5).df.count() == 10 and r.window(10, 30).t0 == 5.0
    with pytest.raises(CapabilityError):
        r.require("phase")
    with pytest.raises(ParameterError):
        Record(df, 1.0, {"v": "nonsense"})


def test_kernels():
    assert kernels.lempel_ziv(np.random.default_rng(0).normal(size=4000)) == pytest.approx(1, abs=0.15)
    assert kernels.lempel_ziv(np.sin(np.arange(4000) / 20)) < 0.2
    x = np.sin(2 * np.pi * 10 * np.arange(1000) / 200) + np.sin(2 * np.pi * 50 * np.arange(1000) / 200)
    y = kernels.zero_phase(x, kernels.bandpass_taps(8, 12, 200))
    assert np.corrcoef(y[200:-200], np.sin(2 * np.pi * 10 * np.arange(1000) / 200)[200:-200])[0, 1] > 0.99
    phase, amplitude = kernels.hilbert(np.cos(2 * np.pi * 5 * np.arange(1000) / 200))
    assert amplitude[100:-100].mean() == pytest.approx(1, abs=0.02) and math.isfinite(phase.sum())
    assert kernels.coloured_noise(2000, 1.0, np.random.default_rng(0)).std() == pytest.approx(1)


def test_entry_imports():
    import __spark_entry__ as e

    q = e.queries()
    assert "rqa_all" in q and set(e.oracle_sql()) <= set(q)


def test_spread_units_agree_with_whole_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, float(a), float(b)) for s, n in ((0, 90), (1, 401), (2, 7), (3, 1)) for i, (a, b) in enumerate(np.round(rng.normal(size=(n, 2)).cumsum(0) if s else rng.integers(0, 4, (n, 2)), 2))]
    df = spark.createDataFrame(rows, "subject long, i long, a double, b double").repartition(3)
    told = lambda d: sorted(tuple(r) for r in d.where("cnt > 0").collect())
    for theiler, rr in ((1, 0.1), (0, 0.05), (3, 0.3)):
        whole = told(R.kernel_histogram(df.where("subject <> 3"), ["a", "b"], rr, theiler))
        assert told(R.spread_histogram(df.where("subject <> 3"), ["a", "b"], rr, theiler, strips=5)) == whole


def test_tiles_give_the_same_pairs(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(s, i, float(v)) for s, n in ((0, 23), (1, 8), (2, 1)) for i, v in enumerate(rng.normal(size=n))], "subject long, i long, a double")
    other = df.where("i < 11").withColumn("a", F.col("a") * 2)
    told = lambda d: sorted(tuple(r) for r in d.collect())
    assert told(R.pairs(df, ["a"], 2, tile=5)) == told(R.pairs(df, ["a"], 2))
    assert told(R.pairs(df, ["a"], other=other, tile=5)) == told(R.pairs(df, ["a"], other=other))
