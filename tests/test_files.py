import numpy as np
import pytest

from echoplot.functions import kernels
from echoplot.operators import dynamics as D
from echoplot.records import EngineError, ParameterError, QualityError, Record
from echoplot.sources import files


def edf(signals, fs, seconds, unit="uV", labels=None, notes=(), wide=False):
    """Bytes of an EDF (BDF) file of one-second records."""
    width = 3 if wide else 2
    labels = labels or [f"c{k}" for k in range(len(signals))]
    top = 2 ** (8 * width - 1)
    kinds = [*labels, "EDF Annotations"]
    per = [*([fs] * len(signals) if np.isscalar(fs) else fs), 40]
    n = len(kinds)
    f = lambda x, w: str(x).ljust(w).encode("latin-1")
    head = (b"\xff" + b"BIOSEMI" if wide else f("0", 8)) + f("someone", 80) + f("", 80) + f("01.01.20", 8) + f("00.00.00", 8) + f(256 * (n + 1), 8) + f("", 44) + f(seconds, 8) + f(1, 8) + f(n, 4)
    for values, w in ((kinds, 16), ([""] * n, 80), ([unit] * n, 8), ([-100] * n, 8), ([100] * n, 8), ([-top] * n, 8), ([top - 1] * n, 8), ([""] * n, 80), (per, 8), ([""] * n, 32)):
        head += b"".join(f(v, w) for v in values)
    body = b""
    for s in range(seconds):
        for x, r in zip(signals, per, strict=False):
            d = np.round((np.asarray(x[s * r : (s + 1) * r]) + 100) / 200 * (2 * top - 1) - top).astype(int)
            body += b"".join(int(v).to_bytes(width, "little", signed=True) for v in d)
        tal = f"+{s}\x14\x14\x00".encode() + (f"+{notes[0][0]}\x15{notes[0][1]}\x14{notes[0][2]}\x14\x00".encode() if notes and s == 0 else b"")
        body += tal.ljust(40 * width, b"\x00")
    return head + body


@pytest.mark.parametrize("wide", [False, True])
def test_edf_round_trip(spark, tmp_path, wide):
    x = [50 * np.sin(np.arange(30)), np.linspace(-90, 90, 30)]
    (tmp_path / "sub-01.edf").write_bytes(edf(x, 10, 3, labels=["Fz", "Cz"], notes=[(0.5, 1.5, "seen")], wide=wide))
    rec = files.read_file(spark, str(tmp_path / "sub-01.edf"))
    got = rec.df.orderBy("i").toPandas()
    assert rec.fs == 10 and set(rec.channels) == {"Fz", "Cz"} and list(got["i"]) == list(range(30))
    for name, want in zip(("Fz", "Cz"), x, strict=True):
        assert np.abs(got[name] - want).max() <= 200 / (2 ** (24 if wide else 16) - 1)
    assert [tuple(r) for r in files.annotations(spark, str(tmp_path)).collect()] == [("sub-01", 0.5, 1.5, "seen")]
    assert files.read_file(spark, str(tmp_path / "sub-01.edf"), exclude=["Cz"]).channels == ["Fz"]


def test_edf_of_mixed_rates_is_refused(spark, tmp_path):
    content = edf([np.zeros(20), np.zeros(10)], [10, 5], 2)
    with pytest.raises(QualityError):
        list(files.edf_signals(content))
    assert [s[0] for s in files.edf_signals(content, ["c1"])] == ["c1"]
    with pytest.raises(ParameterError):
        list(files.edf_signals(content, ["none"]))


def test_arrays(spark, tmp_path):
    x = np.arange(12.0).reshape(2, 6)
    x[0, 3] = np.nan
    np.save(tmp_path / "a.npy", x)
    rec = files.read_file(spark, str(tmp_path / "a.npy"), fs=4)
    got = rec.df.orderBy("i").collect()
    assert rec.channels == ["ch0", "ch1"] and rec.fs == 4
    assert [r.ch0 for r in got] == [0, 1, 2, None, 4, 5] and [r.ch1 for r in got] == list(range(6, 12))
    np.savez(tmp_path / "b.npz", amp_gamma=np.arange(5.0), phase=np.arange(5.0), fs=250.0)
    rec = files.read_file(spark, str(tmp_path / "b.npz"))
    assert rec.fs == 250 and rec.roles == {"amp_gamma": "amplitude", "phase": "phase"}
    (tmp_path / "c.npy").write_bytes(b"no array")
    with pytest.raises(Exception, match=r"c\.npy"):
        files.samples(spark, str(tmp_path / "c.npy"), fs=1).collect()


def test_csv_rows_keep_their_order(spark, tmp_path):
    (tmp_path / "r.csv").write_text("time,x,amp\n" + "".join(f"{1 + k / 50},{k * k},\n" for k in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        rec = files.read_file(spark, str(tmp_path / "r.csv"))
        rows = rec.df.orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rec.fs == pytest.approx(50) and rec.t0 == 1 and rec.channels == ["x", "amp"]
    assert [r.x for r in rows] == [k * k for k in range(400)] and [r.i for r in rows] == list(range(400))
    assert {r.amp for r in rows} == {None} and {r.subject for r in rows} == {"r"}
    with pytest.raises(ParameterError):
        (tmp_path / "n.csv").write_text("x\n1\n2\n")
        files.read_csv(spark, str(tmp_path / "n.csv"))


def test_corpus(spark, tmp_path):
    for s in ("sub-01", "sub-02"):
        (tmp_path / s).mkdir()
        (tmp_path / s / f"{s}_task.edf").write_bytes(b"0")
    people = spark.createDataFrame([("sub-01", "a"), ("sub-03", "b")], "participant_id string, group string")
    got = {r.subject: (r.label, r.has_file, r.has_row) for r in files.read_corpus(spark, str(tmp_path), participants=people).collect()}
    assert got == {"sub-01": ("a", True, True), "sub-02": (None, True, False), "sub-03": ("b", False, True)}
    with pytest.raises(ParameterError):
        files.read_corpus(spark, str(tmp_path), participants=people.select("participant_id"))


def test_formats_and_export(spark, tmp_path):
    assert files.sniff_format("x/Y.EDF") == "edf"
    with pytest.raises(ParameterError):
        files.sniff_format("x.mat")
    df = spark.range(3).selectExpr("'s' as subject", "id as i", "double(id) as x")
    path = files.export_frame(df, str(tmp_path), "out", Record(df).subsample(2))
    assert spark.read.csv(path, header=True).count() == 3
    assert [r.name for r in spark.read.csv(path + "_provenance", header=True).collect()] == ["subsample"]
    assert issubclass(ParameterError, EngineError)


def test_dimension_of_the_lorenz_system(spark):
    x = kernels.integrate("lorenz", 1500)
    df = spark.createDataFrame([("s", k, *map(float, p)) for k, p in enumerate(x[:, :3])], "subject string, i long, x double, y double, z double")
    radii = [float(r) for r in np.geomspace(0.5, 20, 24)]
    got = D.correlation_dimension(df, ["x", "y", "z"], radii, theiler=15).collect()
    assert len(got) == 1 and 1.7 < got[0].d2 < 2.3
    noise = np.random.default_rng(3).normal(size=400)
    n = spark.createDataFrame([("n", k, float(v)) for k, v in enumerate(noise)], "subject string, i long, x double")
    wave = spark.createDataFrame([("w", k, float(np.sin(0.37 * k))) for k in range(400)], "subject string, i long, x double")
    fnn = {r.subject: r.fnn for r in D.false_neighbours(n.union(wave), "x", 2).collect()}
    assert fnn["w"] < 0.02 < fnn["n"]
    assert D.estimate_m(wave, "x", 4, 3).first().m == 2


def test_no_rows_and_single_points(spark):
    none = spark.createDataFrame([], "subject string, i long, x double")
    one = spark.createDataFrame([("a", 0, 1.0)], "subject string, i long, x double")
    for df in (none, one):
        assert D.false_neighbours(df, "x", 2).collect() == []
        assert D.correlation_dimension(df, ["x"], [1.0, 2.0]).collect() == []
        assert D.neighbour_agreement(df, ["x"], ["x"], 2).collect() == []
    assert kernels.scaling_region(np.arange(3.0), np.arange(3.0)) is None
    assert D.theiler_window(1000, 5) == 10 and D.theiler_window(100, 50) == 5
