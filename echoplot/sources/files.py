"""Signal files as records: CSV by Spark's reader, npy / npz / hdf5 / EDF / BDF by binary files.

Binary formats give one row a sample: subject (file stem), channel, unit, fs, i, value. A
file is decoded in one task and sent on in slices, so its task holds the file once; many
files spread over many tasks.
"""

from __future__ import annotations

import io
import re
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..records import EngineError, ParameterError, QualityError, Record, present

FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "npy": "npy", "npz": "npz", "h5": "hdf5", "hdf5": "hdf5", "edf": "edf", "bdf": "edf", "parquet": "parquet"}
TIME_NAMES = ("time", "t", "Time", "timestamp")
SLICE = 1 << 18
SAMPLES = "subject string, channel string, unit string, fs double, i long, value double"
ANNOTATIONS = "subject string, onset_s double, duration_s double, label string"


def sniff_format(path: str) -> str:
    kind = FORMATS.get(path.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ParameterError(f"no reader for {path!r}")
    return kind


#: parts of names that tell a role (fixed values)
ROLE_PARTS = {"phase": ("phase", "phi", "ph"), "amplitude": ("amp", "amplitude", "env", "envelope"), "inst_freq": ("freq", "ifreq", "instfreq"), "state": ("cos", "sin")}


def guess_role(name: str) -> str:
    """Role by the parts of a channel's name between underscores; raw where they tell nothing."""
    parts = set(name.lower().split("_"))
    return next((role for role, known in ROLE_PARTS.items() if parts & set(known)), "raw")


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _arrays(content: bytes, kind: str) -> tuple[dict[str, np.ndarray], float | None]:
    """Named one-dimensional arrays of an array file and its rate, if it says one."""
    if kind == "npy":
        got, fs = {"ch": np.load(io.BytesIO(content), allow_pickle=False)}, None
    elif kind == "npz":
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            got = {n: z[n] for n in z.files}
        fs = float(got.pop("fs")) if "fs" in got else None
    else:
        import h5py  # optional

        with h5py.File(io.BytesIO(content), "r") as f:
            fs = next((float(f.attrs[a]) for a in ("fs", "sfreq", "sampling_rate") if a in f.attrs), None)
            got = {n: f[n][()] for n in f if hasattr(f[n], "shape")}
    out = {}
    for name, x in got.items():
        if np.iscomplexobj(x):
            raise QualityError(f"{name}: complex samples; give phase and amplitude")
        if x.ndim == 1:
            out[f"{name}0" if kind == "npy" else name] = x
        elif x.ndim == 2:
            # few long rows are channels, else columns are
            rows = x if x.shape[0] <= 512 and x.shape[0] < x.shape[1] else x.T
            out |= {f"{name}{k}": r for k, r in enumerate(rows)}
        else:
            raise QualityError(f"{name}: {x.ndim} dimensions")
    return out, fs


def edf_header(content: bytes) -> dict:
    """The fixed-width header of an EDF or BDF file."""
    text = lambda a, b: content[a:b].decode("latin-1").strip()
    n = int(text(252, 256))
    at, fields = 256, {}
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("per_record", 8), ("reserved", 32)):
        fields[name] = [text(at + k * width, at + (k + 1) * width) for k in range(n)]
        at += n * width
    for name in ("pmin", "pmax", "dmin", "dmax"):
        fields[name] = [float(x or 0) for x in fields[name]]
    fields["per_record"] = [int(x) for x in fields["per_record"]]
    width = 3 if content[:1] == b"\xff" else 2
    size, records = sum(fields["per_record"]) * width, int(text(236, 244))
    body = (len(content) - int(text(184, 192))) // max(1, size)
    return fields | {"patient": text(8, 88), "start": text(168, 184), "header": int(text(184, 192)), "records": body if records < 0 else min(records, body), "duration": float(text(244, 252)), "width": width}


def _edf_body(content: bytes, h: dict) -> np.ndarray:
    size = sum(h["per_record"]) * h["width"]
    return np.frombuffer(content, np.uint8, h["records"] * size, h["header"]).reshape(h["records"], size)


def edf_signals(content: bytes, channels: list[str] | None = None, exclude: list[str] = ()):
    """(label, unit, fs, samples in physical units) of each signal; kept signals must share one rate."""
    h = edf_header(content)
    body = _edf_body(content, h)
    at = np.concatenate([[0], np.cumsum(h["per_record"])]) * h["width"]
    kept = [k for k, c in enumerate(h["label"]) if "Annotations" not in c and c not in exclude and (channels is None or c in channels)]
    missing = set(channels or ()) - set(h["label"])
    if missing:
        raise ParameterError(f"no such channels: {sorted(missing)}")
    rates = {h["label"][k]: h["per_record"][k] / h["duration"] for k in kept}
    if len(set(rates.values())) > 1:
        raise QualityError(f"channels of different rates: {rates}; choose channels of one")
    for k in kept:
        part = np.ascontiguousarray(body[:, at[k] : at[k + 1]])
        if h["width"] == 2:
            raw = part.view("<i2").reshape(-1).astype(float)
        else:
            b = part.reshape(-1, 3).astype(np.int32)
            raw = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(float)
        span = h["dmax"][k] - h["dmin"][k]
        gain = (h["pmax"][k] - h["pmin"][k]) / span if span else 1.0
        yield h["label"][k], h["unit"][k], rates[h["label"][k]], (raw - h["dmin"][k]) * gain + h["pmin"][k]


def edf_annotations(content: bytes) -> list[tuple[float, float | None, str]]:
    """Onset, duration and label of each annotation; record time stamps carry no label and are left out."""
    h = edf_header(content)
    body = _edf_body(content, h)
    at = np.concatenate([[0], np.cumsum(h["per_record"])]) * h["width"]
    out = []
    for k, c in enumerate(h["label"]):
        if "Annotations" not in c:
            continue
        for record in body[:, at[k] : at[k + 1]]:
            for tal in record.tobytes().split(b"\x00"):
                head, *labels = tal.split(b"\x14")
                onset, _, duration = head.partition(b"\x15")
                out += [(float(onset), float(duration) if duration else None, x.decode("utf-8", "replace")) for x in labels if x]
    return out


def _binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def samples(spark: SparkSession, path: str, fs: float | None = None, fmt: str | None = None, pattern: str | None = None, channels: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """All samples of npy, npz, hdf5, EDF or BDF files under path, a row each. An unreadable file is an error with its name."""
    kind = fmt or sniff_format(pattern or path)
    if kind not in ("npy", "npz", "hdf5", "edf"):
        raise ParameterError(f"{kind} is not a binary signal format")

    def decode(content: bytes):
        if kind == "edf":
            yield from edf_signals(content, channels, exclude)
            return
        got, rate = _arrays(content, kind)
        if (rate or fs) is None:
            raise ParameterError("the file has no sampling rate: give fs")
        for name, x in got.items():
            if (channels is None or name in channels) and name not in exclude:
                yield name, None, fs or rate, np.asarray(x, float)

    def run(batches):
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for name, unit, rate, x in decode(content.as_py()):
                        for a in range(0, len(x), SLICE):
                            v = x[a : a + SLICE]
                            same = lambda value, t, n=len(v): pa.repeat(pa.scalar(value, t), n)
                            yield pa.RecordBatch.from_arrays([same(_stem(path_), pa.string()), same(name, pa.string()), same(unit, pa.string()), same(rate, pa.float64()), pa.array(np.arange(a, a + len(v))), pa.array(v, mask=np.isnan(v))], ["subject", "channel", "unit", "fs", "i", "value"])
                except (ValueError, KeyError, IndexError, OSError, zipfile.BadZipFile) as e:
                    raise EngineError(f"{path_}: {e}") from e

    return _binary(spark, path, pattern).mapInArrow(run, SAMPLES)


def annotations(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Annotations of EDF or BDF files, a row each."""

    def run(batches):
        for batch in batches:
            rows = [(_stem(p), *a) for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for a in edf_annotations(c.as_py())]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.string())], ["subject", "onset_s", "duration_s", "label"])

    return _binary(spark, path, pattern).mapInArrow(run, ANNOTATIONS)


def wide(long: DataFrame, roles: dict[str, str] | None = None) -> Record:
    """A record of sample rows; all files must share one rate. One small action finds channels and rate."""
    found = long.groupBy("channel").agg(F.min("fs").alias("a"), F.max("fs").alias("b")).collect()  # a row a channel
    rates = {r for f in found for r in (f.a, f.b)}
    if len(rates) != 1:
        raise QualityError(f"files of different rates: {sorted(rates)}")
    names = sorted(f.channel for f in found)
    df = long.groupBy("subject", "i").pivot("channel", names).agg(F.first("value"))
    return Record(df, rates.pop(), {n: guess_role(n) for n in names} | (roles or {}))


def read_csv(spark: SparkSession, path: str, fs: float | None = None, time_column: str | None = None, sep: str | None = None, roles: dict[str, str] | None = None) -> Record:
    """Rows are samples in file order, columns channels; a time column gives the rate and the start.

    Rows are numbered block by block: counts of a file's blocks are summed up, so no task
    sorts a whole file."""
    sep = sep or ("\t" if path.endswith((".tsv", ".txt")) else ",")
    raw = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
    names = raw.columns
    time_column = time_column or next((c for c in TIME_NAMES if c in names), None)
    block = raw.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names], F.col("_metadata.file_path").alias("__p"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    count = block.groupBy("__p", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = count.select("__p", "__b", (F.sum("__n").over(Window.partitionBy("__p").orderBy("__b")) - F.col("__n")).alias("__before"))
    at = (F.row_number().over(Window.partitionBy("__p", "__b").orderBy("__m")) - 1 + F.col("__before")).cast("long")
    df = block.join(before, ["__p", "__b"]).select(F.regexp_extract("__p", r"([^/]+?)(\.[^./]*)?$", 1).alias("subject"), at.alias("i"), *names)
    t0 = 0.0
    if time_column:
        step = F.lead(time_column).over(Window.partitionBy("subject").orderBy("i")) - F.col(time_column)
        each = df.select("subject", "i", time_column, step.alias("dt")).groupBy("subject").agg(F.median("dt").alias("dt"), F.min_by(time_column, "i").alias("t0"))
        got = each.agg(F.min("dt").alias("a"), F.max("dt").alias("b"), F.min("t0").alias("t0")).first()
        if fs is None and got.a:
            if abs(got.a - got.b) > 1e-9 * got.b:
                raise QualityError("files of different rates: read them one by one or give fs")
            fs = 1 / got.a
        t0 = got.t0 or 0.0
    if not fs or fs <= 0:
        raise ParameterError("no time column and no fs")
    channels = [c for c in names if c != time_column]
    return Record(df.select("subject", "i", *[present(c).alias(c) for c in channels]), fs, {c: guess_role(c) for c in channels} | (roles or {}), t0)


def read_file(spark: SparkSession, path: str, fs: float | None = None, fmt: str | None = None, **options) -> Record:
    """A record of a file or a folder of files of one format."""
    kind = fmt or sniff_format(options.get("pattern") or path)
    if kind == "csv":
        return read_csv(spark, path, fs, **options)
    if kind == "parquet":
        df = spark.read.parquet(path)  # columns subject and i, the rest channels
        if fs is None:
            raise ParameterError("give fs")
        channels = [c for c in df.columns if c not in ("subject", "i")]
        return Record(df, fs, {c: guess_role(c) for c in channels})
    return wide(samples(spark, path, fs, kind, **options))


def read_corpus(spark: SparkSession, root: str, pattern: str = "*.edf", participants: DataFrame | None = None, label_column: str | None = None, subject_column: str = "participant_id", subject_from: str = "bids") -> DataFrame:
    """subject, path, label, has_file, has_row: files matched with participants; both sides' unmatched rows stay. No content is read; files of no bytes are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    rules = {"bids": r"(sub-[A-Za-z0-9]+)", "stem": r"([^/]+?)\.[^./]+$", "parent": r"([^/]+)/[^/]+$"}
    files = files.select(F.regexp_extract("path", rules.get(subject_from, subject_from), 1).alias("subject"), "path")
    if participants is None:
        return files.select("subject", "path", F.lit(None).cast("string").alias("label"), F.lit(True).alias("has_file"), F.lit(False).alias("has_row"))
    if label_column is None:
        known = [c for c in participants.columns if c.lower() in ("group", "diagnosis", "condition", "label", "cohort")]
        if len(known) != 1:
            raise ParameterError(f"label column is not clear: {known}")
        label_column = known[0]
    rows = participants.select(F.col(subject_column).cast("string").alias("subject"), F.col(label_column).cast("string").alias("label"), F.lit(True).alias("__r"))
    return files.join(rows, "subject", "full").select("subject", "path", "label", F.col("path").isNotNull().alias("has_file"), F.coalesce("__r", F.lit(False)).alias("has_row"))


def export_frame(df: DataFrame, root: str, name: str, record: Record | None = None) -> str:
    """df as CSV under root/name, with the record's steps beside it; returns the path."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").option("header", "true").csv(path)
    if record is not None:
        steps = record.provenance(df.sparkSession)
        steps.select(*[F.to_json(c).alias(c) if t.startswith("array") else c for c, t in steps.dtypes]).coalesce(1).write.mode("overwrite").option("header", "true").csv(path + "_provenance")
    return path
