"""Coupling of phases and amplitudes: all indices of a pair in one aggregation, and their surrogates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.units import per_unit
from ..records import ParameterError
from . import series as S


def finite_pairs(df: DataFrame, *channels: str) -> DataFrame:
    """Rows in which all channels are finite numbers."""
    for c in channels:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    return df


def negative_envelopes(df: DataFrame, amplitude: str) -> DataFrame:
    """subject, n, n_negative, ok: an amplitude has no negative values."""
    return df.groupBy("subject").agg(F.count(amplitude).alias("n"), F.count_if(F.col(amplitude) < 0).alias("n_negative")).withColumn("ok", F.col("n_negative") == 0)


def aac_index(df: DataFrame, a: str, b: str, method: str = "spearman") -> DataFrame:
    """subject, rho of two amplitudes."""
    df = finite_pairs(df, a, b)
    if method == "spearman":
        return S.spearman(df, a, b)
    if method != "pearson":
        raise ParameterError(f"unknown method {method!r}")
    return df.groupBy("subject").agg(F.corr(a, b).alias("rho"))


def coupling_indices(df: DataFrame, phase: str, amplitude: str, phase2: str | None = None, amp2: str | None = None, n_bins: int = 18, nm: tuple[int, int] = (1, 1)) -> DataFrame:
    """subject, mvl, mi_tort, mod_contrast ((highest - lowest) / (highest + lowest) binned mean amplitude),
    preferred_phase (centre of the highest bin), and plv, aac with a second phase or amplitude."""
    df = finite_pairs(df, phase, amplitude, *[c for c in (phase2, amp2) if c])
    g = S.modulogram(df, phase, amplitude, n_bins)
    shape = g.groupBy("subject").agg(F.max("mean").alias("hi"), F.min("mean").alias("lo"), F.max(F.struct(F.round("mean", 9).alias("m"), (-F.col("bin")).alias("b")))["b"].alias("b"))
    shape = shape.select("subject", F.when(F.col("hi") + F.col("lo") > 0, (F.col("hi") - F.col("lo")) / (F.col("hi") + F.col("lo"))).alias("mod_contrast"), ((0.5 - F.col("b")) * (2 * math.pi / n_bins) - math.pi).alias("preferred_phase"))
    more = [S.plv(phase, phase2, *nm).alias("plv")] if phase2 else []
    out = df.groupBy("subject").agg(S.mvl(phase, amplitude).alias("mvl"), *more)
    out = out.join(S.modulation_index(df, phase, amplitude, n_bins).withColumnRenamed("mi", "mi_tort"), "subject", "left").join(shape, "subject", "left")
    return out.join(aac_index(df, amplitude, amp2).withColumnRenamed("rho", "aac"), "subject", "left") if amp2 else out


def shift_shares(n_surrogates: int, seed: int = 0) -> list[float]:
    """Where in the admissible range each surrogate's shift lies."""
    return [round(float(u), 9) for u in np.random.default_rng(seed).random(n_surrogates)]


def surrogate_significance(df: DataFrame, phase: str, amplitude: str, n_surrogates: int = 200, seed: int = 0) -> DataFrame:
    """subject, observed, null_mean, null_std, z, p of the mean vector length against circular shifts of the amplitude by
    a tenth of the record to nine tenths; p = (1 + those that reach the observed one) / (1 + n). A subject whose mean vector
    length is not defined (no amplitudes, or a mean of 0) has nulls.

    All surrogates of a subject are made where its samples lie: neither they nor a join leave the kernel."""
    shares = np.array(shift_shares(n_surrogates, seed))

    def run(x):
        low = len(x) // 10
        shifts = np.concatenate([[0], low + np.floor(shares * (len(x) - 2 * low))]).astype(np.int64)
        v = np.round(kernels.shifted_mvl(x[:, 0], x[:, 1], shifts), kernels.DIGITS)
        if not np.isfinite(v).all():
            return [(None,) * 5]
        null, sd = v[1:], float(v[1:].std())
        z = (v[0] - null.mean()) / sd if sd > 0 else 0.0
        return [(float(v[0]), float(null.mean()), sd, float(z), float((1 + (null >= v[0]).sum()) / (1 + n_surrogates)))]

    return per_unit(df, ("subject",), [phase, amplitude], run, "observed double, null_mean double, null_std double, z double, p double")


def shuffled(df: DataFrame, c: str, seed: int = 0) -> DataFrame:
    """subject, i, the channel in an order that seed and place decide: the null of no order in time."""
    order = F.row_number().over(S.over("__h", "i")) - 1
    return df.select("subject", "i", F.xxhash64(F.lit(seed), "subject", "i").alias("__h"), c).withColumn("__o", order.cast("long")).select("subject", F.col("__o").alias("i"), c)
