"""Operators that have no SQL: filters by their response, generators, sinks, sources, classification."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoplot import cli, config
from echoplot.functions import kernels as K
from echoplot.operators import comparability as CMP
from echoplot.operators import coupling as C
from echoplot.operators import dynamics as D
from echoplot.operators import inference as I
from echoplot.operators import preprocess as P
from echoplot.operators import series as S
from echoplot.operators import spaces as SS
from echoplot.operators import windowed as W
from echoplot.plans import figures
from echoplot.records import BudgetError, Capability, CapabilityError, Caveat, ParameterError, QualityError, Record, Step, capabilities_from_roles, check_length_for, require
from echoplot.sinks import images, tables
from echoplot.sources import generators as G
from echoplot.sources import memory


def tone(spark, n=600, fs=100.0, parts=((5.0, 1.0), (20.0, 1.0)), subjects=2):
    t = np.arange(n) / fs
    rows = [(s, i, float(sum(a * np.sin(2 * np.pi * f * t[i] + s) for f, a in parts))) for s in range(subjects) for i in range(n)]
    return Record(spark.createDataFrame(rows, "subject long, i long, value double").repartition(3), fs, {"value": "raw"})


def column(df, c, subject=0):
    return np.array([r[0] for r in df.where(F.col("subject") == subject).orderBy("i").select(c).collect()], float)


def response(sections, f, fs):
    z = np.exp(2j * np.pi * np.asarray(f) / fs)
    h = 1
    for b, a in sections:
        h = h * np.polyval(b, z) / np.polyval(a, z)
    return np.abs(h)


def test_filters_pass_their_band(spark):
    rec = tone(spark)
    slow = np.sin(2 * np.pi * 5 * np.arange(600) / 100)
    for method in ("fir", "iir"):
        got = P.filterbank(rec, {"slow": (3.0, 8.0), "fast": (15.0, 25.0)}, method=method)
        assert got.by_role("band") == ["slow", "fast"] and got.meta["bands"]["slow"] == (3.0, 8.0)
        x = column(got.df, "slow")[150:450]
        # the gain is one at an FIR filter's centre only
        assert np.corrcoef(x, slow[150:450])[0, 1] > 0.995 and 0.9 < x.std() / slow.std() < 1.1
        assert abs(np.corrcoef(column(got.df, "fast")[150:450], slow[150:450])[0, 1]) < 0.05
    assert np.abs(column(P.notch(rec, 20.0).df, "value")[150:450] - slow[150:450]).max() < 0.05
    fs = 100.0
    assert response(K.butter_sections(4, fs, high=10.0), [0, 10, 45], fs) == pytest.approx([1, 2**-0.5, 0], abs=1e-3)
    assert response(K.butter_sections(4, fs, 8.0, 12.0), [8, np.sqrt(96), 12], fs) == pytest.approx([2**-0.5, 1, 2**-0.5], abs=2e-2)
    assert response([K.notch_section(20.0, fs)], [0, 20, 20 * (1 + 1 / 60), 49], fs) == pytest.approx([1, 0, 2**-0.5, 1], abs=2e-2)
    with pytest.raises(ParameterError):
        P.design_bandpass((10, 5), fs)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        P.design_bandpass((0.5, 40.0), 100.0)
        assert any(issubclass(w.category, Caveat) for w in seen)
    nothing = Record(rec.df.limit(0), fs, {"value": "raw"})
    assert P.bandpass(nothing, (3.0, 8.0)).df.count() == 0


def test_resampling_and_analytic_signals(spark):
    rec = tone(spark, parts=((5.0, 1.0),))
    half = P.resample(rec, 50.0)
    assert half.fs == 50.0 and np.abs(column(half.df, "value")[20:-20] - column(rec.df, "value")[::2][20:-20]).max() < 1e-2
    more = P.resample(rec, 200.0, "fourier")
    assert np.abs(column(more.df, "value")[::2] - column(rec.df, "value")).max() < 1e-9
    a = P.analytic(rec, ["value"], "none")
    assert set(a.channels) >= {"phase_value", "amp_value", "ifreq_value"} and a.roles["phase_value"] == "phase"
    assert np.median(column(a.df, "ifreq_value")) == pytest.approx(5.0, abs=1e-6) and np.median(column(a.df, "amp_value")) == pytest.approx(1.0, abs=1e-6)
    cut = P.analytic(rec, ["value"], "trim", 50)
    assert cut.df.where("subject = 0").count() == 500 and cut.t0 == pytest.approx(0.5)
    for policy in ("mirror", "taper"):
        assert P.analytic(rec, ["value"], policy, 50).df.count() == 1200
    with pytest.raises(ParameterError):
        P.analytic(rec, ["value"], "other")


def test_smoothing_halves_at_the_cutoff(spark):
    for method in ("gaussian", "butterworth"):
        df = tone(spark, 1200, 100.0, ((5.0, 1.0),)).df
        x = column(SS.smooth(df, ["value"], 5.0, 100.0, method), "value")[300:900]
        assert x.std() / column(df, "value")[300:900].std() == pytest.approx(0.5, abs=0.02)


def test_spaces_of_bands(spark):
    made = G.generate_cfc(spark, 3, duration=4.0, fs=200.0, f_high=40.0)
    rec = made.record.select("raw")
    space = SS.from_bands(rec, {"slow": (4.0, 8.0, "phase"), "fast": (30.0, 50.0, "amplitude")})
    assert space.coords == ["cos_phase_slow", "sin_phase_slow", "amp_fast"] and space.df.count() > 500
    assert {r.block: round(r.variance_share, 3) for r in space.weights().collect()} == {"phase_slow": 0.5, "amp_fast": 0.5}
    assert space.reduce(2).coords == ["pc1", "pc2"] and space.split(["amp_fast"]).dim == 1
    with pytest.raises(ParameterError):
        space.block("other")
    with pytest.raises(ParameterError):
        space.rescale("weighted")
    with pytest.raises(CapabilityError):
        SS.phase_circle(rec)
    assert SS.band_center(made.record, "phase_low") == 6.0 and SS.pick_by_frequency(made.record, "phase", "slowest") == "phase_low"
    with pytest.raises(ParameterError):
        SS.takens(tone(spark, 10), "value", 6, 2)


def test_coupling_is_found_where_it_was_made(spark):
    made = G.generate_corpus(spark, {"alpha": [0.0, 0.9]}, 2, 1, duration=8.0, fs=200.0, f_high=40.0, snr_db=30.0)
    again = G.generate_corpus(spark, {"alpha": [0.0, 0.9]}, 2, 1, duration=8.0, fs=200.0, f_high=40.0, snr_db=30.0)
    df = made.record.df
    assert df.exceptAll(again.record.df).count() == 0 and made.truth.count() == 4
    got = {r.subject: r for r in C.coupling_indices(df, "phase_low", "amp_high").collect()}
    assert max(got[s].mi_tort for s in ("0000-000", "0000-001")) < min(got[s].mi_tort for s in ("0001-000", "0001-001"))
    assert abs(got["0001-000"].preferred_phase) < 0.6
    p = {r.subject: r for r in C.surrogate_significance(df, "phase_low", "amp_high", 50).collect()}
    assert p["0001-000"].p == pytest.approx(1 / 51) and p["0001-000"].z > 5
    for modality in G.MODALITIES:
        assert G.generate_cfc(spark, 0, modality=modality, duration=1.0, fs=200.0, f_high=40.0, artifacts=G.ARTIFACTS).record.df.count() == 200
    assert sorted(column(C.shuffled(df.where("subject = '0000-000'").withColumn("subject", F.lit(0)), "raw"), "raw")) == sorted(column(df.where("subject = '0000-000'").withColumn("subject", F.lit(0)), "raw"))
    with pytest.raises(ParameterError):
        G.cfc_signal(np.random.default_rng(0), other=1)
    for shape in G.SHAPES:
        w = G.modulation_window(np.linspace(-np.pi, np.pi, 101), shape)
        assert w.max() == pytest.approx(1) and w.min() == pytest.approx(0, abs=1e-9)
    for profile in G.PROFILES:
        assert np.abs(G.alpha_profile(0.5, 100, profile)).max() == pytest.approx(0.5, abs=0.02)


def test_noise_and_systems(spark):
    pink = column(G.generate_noise(spark, 1, 4096, "pink", 5), "value")
    power = np.abs(np.fft.rfft(pink)[1:]) ** 2
    f = np.arange(1, len(power) + 1)
    assert np.polyfit(np.log(f), np.log(power), 1)[0] == pytest.approx(-1, abs=0.15) and pink.std() == pytest.approx(1)
    df = tone(spark, 4000).df
    noisy = column(G.add_noise_at_snr(df, "value", 10.0), "value") - column(df, "value")
    assert 20 * np.log10(column(df, "value").std() / noisy.std()) == pytest.approx(10, abs=0.5)
    assert np.abs(K.noise_at_snr(np.sin(np.arange(500.0)), 0.0, np.random.default_rng(0))).max() > 1
    assert G.generate_system(spark, "rossler", 50).columns == ["subject", "i", "x", "y", "z"]
    with pytest.raises(ParameterError):
        G.generate_system(spark, "other")


def test_known_invariants(spark):
    x = G.generate_system(spark, "henon", 700).select(F.lit(0).alias("subject"), "i", "x", "y")
    curve = D.divergence_curve(x, ["x", "y"], 8, 5)
    assert curve.count() == 8
    lam = D.lyapunov_max(x, ["x", "y"], 6, 5).first()
    assert lam.lambda_1 == pytest.approx(0.42, abs=0.12)
    assert D.lyapunov_max(x, ["x", "y"], 8, 5, region="auto").count() == 1
    d2 = D.region_of(D.correlation_sum(x, ["x", "y"], 20, 5).where("c > 0 and c < 0.1").select("subject", F.log("radius").alias("u"), F.log("c").alias("v")), "u", "v").first()
    assert d2.slope == pytest.approx(1.2, abs=0.2)
    noise = np.random.default_rng(0).normal(size=3000)
    assert K.dfa_exponent(noise) == pytest.approx(0.5, abs=0.07) and K.dfa_exponent(np.cumsum(noise)) == pytest.approx(1.5, abs=0.12)
    assert K.higuchi_dimension(noise) == pytest.approx(2, abs=0.05) and K.permutation_entropy(noise, 4) > 0.99
    assert K.fine_scale(np.repeat(noise[:400], 8)) > 1
    y = x.select("subject", "i", F.col("x").alias("value"))
    assert S.svd_entropy(y, "value", 5).first().svd == pytest.approx(K.svd_entropy(column(y, "value")), abs=1e-9)
    assert D.estimate_embedding(y, "value", "ami", "cao", 6, 3).columns == ["subject", "tau", "m"]
    for how in ("median", "max", "mean", "mode"):
        assert D.estimate_embedding_multi(y, "value", how, max_lag=5, m_max=2).count() == 1
    with pytest.raises(ParameterError):
        D.estimate_embedding(y, "value", "other")


def test_exact_tails_by_counting():
    from itertools import combinations

    for a, b in ((3, 4), (5, 5), (2, 8)):
        ranks = range(1, a + b + 1)
        us = [sum(c) - b * (b + 1) / 2 for c in combinations(ranks, b)]
        for u in set(us):
            far = abs(u - a * b / 2)
            assert CMP.exact_tail(a, b, u) == pytest.approx(min(1, np.mean([abs(v - a * b / 2) >= far for v in us])))


def test_small_groups_have_exact_tails(spark):
    df = spark.createDataFrame([(s, 0, s % 2, float(s + 10 * (s % 2))) for s in range(10)], "subject long, window int, g int, m double")
    r = CMP.group_comparison(df, ["m"], "g").first()
    assert r.auc == 1.0 and r.p == pytest.approx(2 / 252) and r.p_bonferroni == pytest.approx(2 / 252)


def test_contracts(spark):
    units = CMP.describe_units(spark.createDataFrame([("a", 100.0), ("b", 103.0), ("c", 150.0)], "subject string, n_samples double"), fs=2.0)
    contract = CMP.contract_from(units, "a", ("n_samples", "fs"), theiler=1)
    assert contract.declared == ["n_samples", "fs", "theiler"] and contract.with_(fs=3.0).values["fs"] == 3.0
    got = {r.axis: (r.status, r.n_offenders) for r in CMP.check_comparability(units, contract).collect()}
    assert got["n_samples"] == ("violated", 1) and got["fs"] == ("ok", 0) and got["theiler"] == ("absent", 0)
    with pytest.raises(CMP.ContractViolation):
        CMP.raise_if_violated(CMP.check_comparability(units, contract))
    with pytest.raises(ParameterError):
        CMP.ComparabilityContract({"other": 1})


def test_classification_over_time(spark):
    rng = np.random.default_rng(0)
    rows = [(s, w, s % 2, float(rng.normal() + 4 * (s % 2) * (w == 1)), float(rng.normal())) for s in range(24) for w in range(2)]
    df = spark.createDataFrame(rows, "subject long, window int, label int, RR double, DET double")
    got = {r.window: r for r in I.classify_timecourse(df, ["RR", "DET"], min_per_group=5, n_splits=2).collect()}
    assert got[1].peak and got[1].score > 0.9 and not got[0].peak
    one = I.permuted_scores(df.where("window = 1"), ["RR"], 3, n_splits=2).first()
    assert one.observed > 0.9 and one.p == pytest.approx(0.25)
    rings = [(s, s % 2, float(r * np.cos(a)), float(r * np.sin(a))) for s in range(60) for r, a in [((1.0 if s % 2 else 4.0), rng.uniform(0, 6.28))]]
    ring = spark.createDataFrame(rings, "subject long, label int, x double, y double")
    auc = {m: np.mean([r.auc for r in I.classify_groups(ring, ["x", "y"], m, 2).collect()]) for m in ("linear_svm", "rbf_svm")}
    assert auc["rbf_svm"] > 0.95 > auc["linear_svm"]
    assert I.importances(df.where("window = 1"), ["RR", "DET"]).first().feature == "RR"
    assert I.select_features(["RR", "DET", "window", "mvl", "katz", "other"], "both") == ["RR", "DET", "mvl"] and I.select_features(["katz", "RR"], "dynamics") == ["katz"]
    with pytest.raises(ParameterError):
        I.select_features([], "other")


def test_windows_that_cannot_be(spark):
    for bad in ({}, {"size": 10, "n_windows": 2}, {"size": 10, "step": 5, "overlap": 0.5}, {"size": 10, "overlap": 1.0}, {"size": 10, "unit": "hours"}):
        with pytest.raises(ParameterError):
            W.WindowSpec(**bad)
    n = spark.createDataFrame([(0, 100), (1, 15)], "subject long, n long")
    assert W.WindowSpec(size=2.0, overlap=0.5, unit="seconds").grid(n, 10.0).count() == 9
    assert W.WindowSpec(n_windows=3, overlap=0.0).grid(n).where("subject = 0").count() == 3
    assert W.resolve_windows(20, n).count() == 5 and W.is_bookkeeping("t_start") and not W.is_bookkeeping("DET")
    wr = W.windowed_recurrence(tone(spark, 60, 100.0).df, ["value"], 20, 0.2, 1, "global")
    assert wr.thresholds().select("subject", "eps").distinct().count() == 2 and wr.metrics(rqa=True).count() == 6
    assert wr.metrics_by_window().columns == ["subject", "w0", "w1", "w2"]


def test_records_and_memory(spark, tmp_path):
    rec = memory.ingest(spark, {"x": np.arange(50.0), "z": np.exp(1j * np.linspace(0, 6, 50)), "m": np.ones((50, 2))}, 10.0, subject="s", meta={"site": 1}, units={"x": "uV"})
    assert rec.channels == ["x", "phase_z", "amp_z", "m_0", "m_1"] and rec.roles["phase_z"] == "phase" and rec.roles["amp_z"] == "amplitude" and rec.meta == {"site": 1}
    assert rec.capabilities == Capability.RAW | Capability.PHASE | Capability.AMPLITUDE == capabilities_from_roles(["raw", "phase", "amplitude"])
    codes = {(r.channel, r.code) for r in memory.quality_report(rec).collect()}
    assert ("m_0", "CONSTANT") in codes and not any(c == "x" for c, _ in codes)
    assert memory.ingest(spark, (np.zeros(5), np.ones(5)), 1.0).channels == ["phase", "amp"] and memory.ingest(spark, rec) is rec
    assert memory.ingest(spark, rec.df, 10.0).channels == rec.channels and memory.ingest(spark, np.zeros((9, 2)), 1.0).channels == ["ch0", "ch1"]
    for bad in (np.zeros((2, 9)), np.zeros(5, complex)):
        with pytest.raises(ParameterError):
            memory.ingest(spark, bad, 1.0)
    with pytest.raises(ParameterError):
        memory.ingest(spark, np.zeros(5))
    with pytest.raises(QualityError):
        memory.ingest(spark, np.full(5, np.nan), 1.0, strict=True)
    with pytest.raises(QualityError):
        memory.ingest(spark, {"a": np.zeros(4), "b": np.zeros(5)}, 1.0)
    with pytest.raises(CapabilityError, match="BANDS"):
        require("stage", Capability.RAW, Capability.BANDS)
    assert check_length_for(10, 3, 2) == 6 and issubclass(BudgetError, Exception)
    step = Step("a", {"b": 1}).with_caveat("c")
    assert rec.with_step(step).provenance(spark).collect()[-1].caveats == ["c"]
    table = {r.channel: r for r in rec.channel_frame().collect()}
    assert table["x"].unit == "uV" and table["x"].duration == 5.0 and table["m_0"].digest == {r.channel: r for r in rec.channel_frame().collect()}["m_0"].digest
    assert rec.with_channels(w=F.col("x") * 2, keep=["x"]).channels == ["x", "w"]


def test_sinks(spark, tmp_path, capsys):
    before = config.get_config().output_dir
    try:
        tables.set_output_dir(str(tmp_path))
        rec = tone(spark, 60)
        path = tables.export_frame(rec.df, "frame", steps=[Step("a")])
        assert spark.read.csv(path, header=True).count() == 120 and spark.read.csv(path + "_environment", header=True).count() >= 5
        assert len(tables.export_recording(rec, include_timeseries=True)) == 3
        kept = tables.CsvExporter("rows").add(spark, a=1).add(spark, a=2, b="x")
        assert len(kept) == 2 and spark.read.csv(kept.write(), header=True).count() == 2
        report = tables.RunReport("Run").parameter("p", 1).section("Part").note("text").result("r", 2).warn("w")
        report.table(rec.df.limit(3), "part")
        text = (tmp_path / report.write(spark).rsplit("/", 1)[-1]).read_text()
        assert all(x in text for x in ("Run", "p = 1", "text", "r = 2", "w", "part")) and report.artifact_frame(spark).count() == 1
        pairs = spark.createDataFrame([(0, i, j) for i in range(8) for j in range(8) if i != j], "subject long, i long, j long")
        sizes = spark.createDataFrame([(0, 8)], "subject long, n long")
        pixels = images.recurrence_image(pairs, sizes, 4)
        assert {(r.row, r.col): r.value for r in pixels.collect()}[0, 0] == 0.5 and pixels.where("row <> col").agg(F.min("value")).first()[0] == 1.0
        for fmt, head in (("png", b"\x89PNG"), ("npy", b"\x93NUMPY")):
            out = images.export_recurrence_images(pairs, sizes, f"im_{fmt}", 4, fmt=fmt).collect()
            assert open(out[0].file, "rb").read(6).startswith(head)
        got = np.load(out[0].file)
        assert got.shape == (4, 4) and got[0, 1] == 1 and got[0, 0] == 0.5
        assert images.export_attractor_images(rec.df.withColumn("y", F.col("value") * 2), ("value", "y"), size=8).count() == 2
        assert figures.save_figure(rec.df, "figure").endswith("figure")
    finally:
        config.set_config(output_dir=before)
    assert figures.choose_pooling(8, 0.05) == "mean" and figures.choose_pooling(2, 0.05) == "max" and "attractor" in figures.list_figures()
    assert cli.main(["figures"]) == 0 and cli.main(["doctor"]) == 0 and cli.main(["generate", str(tmp_path / "gen"), "--duration", "1", "--fs", "200"]) == 0
    assert spark.read.parquet(str(tmp_path / "gen")).count() == 200 and "pyarrow: there" in capsys.readouterr().out


def test_configuration(spark):
    with pytest.raises(AttributeError):
        config.set_config(other=1)
    assert config.resolve_jobs(spark, 3) == 3 and config.resolve_jobs(spark, -1) == spark.sparkContext.defaultParallelism
    a, b = config.spawn_rngs(7, 2)
    assert a.random() == config.spawn_rng(7, 0).random() and b.random() != config.spawn_rng(7, 0).random()
    x = np.arange(6.0)
    assert config.array_digest(x) == config.array_digest(x.copy()) != config.array_digest(x.reshape(2, 3)) and config.resolve_rng(a) is a
    assert config.available_backends()["pyarrow"] and config.doctor(spark).count() == len(config.BACKENDS)


def test_surrogates_by_hand(spark):
    """Against every shift one by one, with missing samples; neither a join nor a row for each surrogate and sample."""
    rng = np.random.default_rng(3)
    shapes = {0: 64, 1: 5, 2: 40, 3: 30, 4: 1}
    rows = [(s, i, float(rng.uniform(-np.pi, np.pi)), float(rng.gamma(2.0))) for s, n in shapes.items() for i in range(n)]
    rows = [(s, i, None if s == 2 and i % 9 == 4 else p, None if s == 2 and i % 7 == 3 else 0.0 if s == 3 else a) for s, i, p, a in rows]
    df = spark.createDataFrame(rows, "subject long, i long, phase double, amp double")
    out = C.surrogate_significance(df, "phase", "amp", 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    got = {r.subject: r for r in out.collect()}
    assert set(got) == set(shapes) and got[3].observed is None and got[3].p is None
    for s in (0, 1, 2, 4):
        p, a = (np.array([r[k] for r in rows if r[0] == s], float) for k in (2, 3))
        n = len(a)
        v = [round(float(abs(np.nanmean([x * np.exp(1j * y) if x == x and y == y else np.nan for x, y in zip(np.roll(a, k), p, strict=True)])) / np.nanmean(a)), 9) for k in [0, *(n // 10 + int(u * (n - 2 * (n // 10))) for u in C.shift_shares(20))]]
        r, null = got[s], np.array(v[1:])
        assert (r.observed, r.null_mean, r.null_std) == pytest.approx((v[0], null.mean(), null.std()), abs=1e-8)
        assert r.p == pytest.approx((1 + (null >= v[0]).sum()) / 21) and r.z == pytest.approx((v[0] - null.mean()) / null.std() if null.std() > 1e-12 else 0, abs=1e-5)
