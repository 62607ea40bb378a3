"""Records from what is in memory already: arrays, mappings, pairs, pandas frames, DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as S
from ..records import ParameterError, QualityError, Record, Step, present
from . import files


def as_channels(data, labels: list[str] | None = None, prefix: str = "ch") -> dict[str, np.ndarray]:
    """Named one-dimensional arrays of a vector, a matrix (samples x channels), a mapping or a (phase, amplitude) pair.
    Complex entries of a mapping become phase_ and amp_ channels."""
    if isinstance(data, tuple) and len(data) == 2 and all(np.ndim(x) == 1 for x in data):
        return {"phase": np.asarray(data[0], float), "amp": np.asarray(data[1], float)}
    if isinstance(data, dict):
        out = {}
        for name, x in data.items():
            x = np.asarray(x)
            if np.iscomplexobj(x):
                out |= {f"phase_{name}": np.angle(x), f"amp_{name}": np.abs(x)}
            elif x.ndim == 2:
                out |= {f"{name}_{k}": x[:, k].astype(float) for k in range(x.shape[1])}
            else:
                out[name] = x.astype(float)
        return out
    x = np.asarray(data)
    if np.iscomplexobj(x):
        raise ParameterError("name complex channels in a mapping")
    x = x[:, None] if x.ndim == 1 else x
    if x.ndim != 2 or x.shape[1] > x.shape[0]:
        raise ParameterError(f"an array of samples x channels, not {x.shape}")
    labels = labels or [f"{prefix}{k}" for k in range(x.shape[1])]
    if len(labels) != x.shape[1] or len(set(labels)) < len(labels):
        raise ParameterError("a label for each channel, all different")
    return {n: x[:, k].astype(float) for k, n in enumerate(labels)}


def ingest(spark: SparkSession, source, fs: float | None = None, labels: list[str] | None = None, kind: str = "auto", roles: dict[str, str] | None = None, units: dict[str, str] | None = None, t0: float = 0.0, meta: dict | None = None, subject: str = "0", validate: bool = True, strict: bool = False, **reader) -> Record:
    """A record of anything: a record, a path, a DataFrame (subject, i, channels), a pandas frame or arrays.

    Roles are the given ones, else the names', else raw (or `kind`). Channels of one record have one length."""
    if isinstance(source, Record):
        return source
    if isinstance(source, str):
        rec = files.read_file(spark, source, fs, roles=roles, **reader) if files.sniff_format(source) != "parquet" else files.read_file(spark, source, fs)
    elif isinstance(source, DataFrame):
        if fs is None:
            raise ParameterError("give fs")
        names = [c for c in source.columns if c not in ("subject", "i")]
        df = source.select("subject", F.col("i").cast("long").alias("i"), *[present(n).cast("double").alias(n) for n in names])
        rec = Record(df, fs, {n: files.guess_role(n) for n in names} | (roles or {}), t0)
    else:
        if hasattr(source, "to_numpy") and hasattr(source, "columns"):  # pandas
            source = {str(c): source[c].to_numpy() for c in source.columns}
        channels = as_channels(source, labels)
        sizes = {len(x) for x in channels.values()}
        if len(sizes) != 1 or 0 in sizes:
            raise QualityError(f"channels of lengths {sorted(sizes)}")
        if fs is None:
            raise ParameterError("give fs")
        n = sizes.pop()
        table = pa.table({"subject": [subject] * n, "i": np.arange(n), **channels})
        df = spark.createDataFrame(table)
        default = "raw" if kind == "auto" else kind
        guessed = {c: (r if (r := files.guess_role(c)) != "raw" else default) for c in channels}
        rec = Record(df.select("subject", "i", *[present(c).alias(c) for c in channels]), fs, guessed | (roles or {}), t0)
    rec = rec.with_step(Step("ingest", {"fs": rec.fs}, outputs=tuple(rec.channels))).with_meta(**(meta or {}))
    rec = Record(rec.df, rec.fs, rec.roles, rec.t0, rec.steps, rec.units | (units or {}), rec.meta)
    if validate and strict:
        raise_if_error(quality_report(rec))
    return rec


ISSUES = (("nonfinite_error", "NONFINITE", "error"), ("all_missing", "ALL_NONFINITE", "error"), ("constant", "CONSTANT", "warning"), ("saturation", "SATURATION", "warning"))


def quality_report(rec: Record) -> DataFrame:
    """subject, channel, code, severity of every issue found: missing samples (over a hundredth), no sample at all, a
    constant channel, an extreme that is met too often."""
    q = S.quality(rec.long()).withColumn("all_missing", F.col("n_missing") == F.col("n_samples"))
    found = F.array(*[F.when(F.col(c), F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for c, code, level in ISSUES])
    return q.select("subject", "channel", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("subject", "channel", "x.*")


def raise_if_error(report: DataFrame) -> None:
    first = report.where("severity = 'error'").limit(5).collect()
    if first:
        raise QualityError("; ".join(f"{r.subject}/{r.channel}: {r.code}" for r in first))
