"""Filters, analytic signals, resampling and scaling of records.

Filters need a whole series: each is a kernel over one subject's channel, dealt over all
partitions. Scaling and its reports are aggregates.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.units import per_series
from ..records import Capability, Caveat, ParameterError, Record, Step, require
from . import recurrence as R
from . import series as S

EDGES = ("trim", "mirror", "taper", "none")


@dataclass(frozen=True)
class FilterDesign:
    """Taps of an FIR filter, or second-order sections, and how many samples its ends spoil."""

    band: tuple[float, float]
    fs: float
    taps: np.ndarray | None = None
    sections: tuple = ()
    edge_samples: int = 0

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Zero-phase filtering; a series with missing samples stays missing as a whole."""
        if len(x) < 2 or not np.isfinite(x).all():
            return np.full(len(x), np.nan)
        return kernels.zero_phase(x, self.taps) if self.taps is not None else kernels.zero_phase_recursive(x, list(self.sections))


def design_bandpass(band: tuple[float, float], fs: float, method: str = "fir", order: int | str = "auto", min_cycles: float = 3.0) -> FilterDesign:
    low, high = float(band[0]), float(band[1])
    if not 0 < low < high < fs / 2:
        raise ParameterError(f"band {band} does not lie within 0 and {fs / 2}")
    if method == "iir":
        n = 4 if order == "auto" else int(order)
        return FilterDesign((low, high), fs, None, tuple(kernels.butter_sections(n, fs, low, high)), int(np.ceil(min_cycles * fs / low)))
    if method != "fir":
        raise ParameterError(f"unknown method {method!r}")
    n, held = kernels.bandpass_order(low, fs, min_cycles) if order == "auto" else (int(order) | 1, False)
    if held:
        warnings.warn(f"a filter for {band} at {fs} is held to {n} taps", Caveat, stacklevel=2)
    return FilterDesign((low, high), fs, kernels.bandpass_taps(low, high, fs, n=n), (), (n - 1) // 2)


def _sources(rec: Record, source: str | None) -> str:
    require("a filter", rec.capabilities, Capability.RAW, "ingest a raw channel")
    names = [source] if source else rec.by_role("raw")
    if len(names) != 1:
        raise ParameterError(f"name the channel to be filtered; there are {names}")
    rec._known(names)
    return names[0]


def filterbank(rec: Record, bands: dict[str, tuple[float, float]], source: str | None = None, role: str = "band", **design) -> Record:
    """A channel for each band, all from one pass over the source channel."""
    source = _sources(rec, source)
    made = {name: design_bandpass(b, rec.fs, **design) for name, b in bands.items()}
    filters = list(made.values())
    found = per_series(rec.df, ("subject",), [source], lambda x: np.column_stack([f.apply(x[:, 0]) for f in filters]), list(made))
    step = Step("filterbank", {"bands": {n: f.band for n, f in made.items()}, "edge_samples": max(f.edge_samples for f in filters)}, (source,), tuple(made))
    numbered = rec.df.drop(*made)
    return rec.replaced(numbered.join(found, ["subject", "i"]), roles=dict.fromkeys(made, role), step=step, bands={n: f.band for n, f in made.items()})


def bandpass(rec: Record, band: tuple[float, float], source: str | None = None, name: str | None = None, role: str = "band", **design) -> Record:
    """A channel with one band of the source."""
    return filterbank(rec, {name or f"band_{band[0]:g}_{band[1]:g}": band}, source, role, **design)


def notch(rec: Record, freq: float, source: str | None = None, name: str | None = None, q: float = 30.0) -> Record:
    """The source without a narrow line, zero-phase; in its place unless named."""
    source = _sources(rec, source)
    name = name or source
    section = kernels.notch_section(freq, rec.fs, q)
    found = per_series(rec.df, ("subject",), [source], lambda x: kernels.zero_phase_recursive(x[:, 0], [section])[:, None], [name])
    step = Step("notch", {"freq": freq, "q": q}, (source,), (name,))
    return rec.replaced(rec.df.drop(name).join(found, ["subject", "i"]), roles={name: "raw"}, step=step)


def resample(rec: Record, fs_new: float, method: str = "poly") -> Record:
    """All channels at another rate."""
    names, ratio = rec.channels, fs_new / rec.fs
    part = Fraction(ratio).limit_denominator(1000)
    if method == "poly":
        run = lambda x: np.column_stack([kernels.resample_poly(x[:, k], part.numerator, part.denominator) for k in range(x.shape[1])])
    elif method == "fourier":
        run = lambda x: np.column_stack([kernels.resample_fourier(x[:, k], max(1, int(round(len(x) * ratio)))) for k in range(x.shape[1])])
    else:
        raise ParameterError(f"unknown method {method!r}")
    fs = rec.fs * part.numerator / part.denominator if method == "poly" else fs_new
    return rec.replaced(per_series(rec.df, ("subject",), names, run, names), step=Step("resample", {"fs": fs, "method": method}, tuple(names), tuple(names)), fs=fs)


def edge_samples(rec: Record) -> int:
    """How many samples at an end the filters so far have spoilt."""
    return max([s.params.get("edge_samples", 0) for s in rec.steps], default=0)


def analytic(rec: Record, sources: list[str] | None = None, edge_policy: str = "trim", edge: int | None = None, keep: tuple[str, ...] = ("phase", "amplitude", "inst_freq"), unwrap: bool = False) -> Record:
    """phase_, amp_ and ifreq_ channels of each source; `trim` takes the filters' ends off both sides."""
    if edge_policy not in EDGES:
        raise ParameterError(f"edge_policy must be one of {EDGES}")
    sources = sources or rec.by_role("band") or rec.by_role("raw")
    rec._known(sources)
    edge = edge_samples(rec) if edge is None else edge
    prefix = {"phase": "phase_", "amplitude": "amp_", "inst_freq": "ifreq_"}
    out = [prefix[k] + c for c in sources for k in prefix]
    fs, kind = rec.fs, edge_policy if edge_policy in ("mirror", "taper") else "none"

    def run(x):
        return np.column_stack([kernels.hilbert_components(x[:, k], fs, kind, edge, unwrap) if np.isfinite(x[:, k]).all() else np.full((len(x), 3), np.nan) for k in range(x.shape[1])])

    found = per_series(rec.df, ("subject",), sources, run, out)
    wanted = [prefix[k] + c for c in sources for k in keep]
    df = rec.df.drop(*wanted).join(found.select("subject", "i", *wanted), ["subject", "i"])
    t0 = rec.t0
    if edge_policy == "trim" and edge > 0:
        n = R.unit_sizes(rec.df).withColumnRenamed("n", "__n")
        df = df.join(n, "subject").where((F.col("i") >= edge) & (F.col("i") < F.col("__n") - edge)).withColumn("i", F.col("i") - edge).drop("__n")
        t0 += edge / rec.fs
    roles = {prefix[k] + c: k for c in sources for k in keep}
    bands = {prefix[k] + c: b for c in sources for k in keep if (b := rec.meta.get("bands", {}).get(c))}
    return rec.replaced(df, roles=roles, step=Step("analytic", {"edge_policy": edge_policy, "edge_samples": 0, "trimmed": edge if edge_policy == "trim" else 0}, tuple(sources), tuple(wanted)), t0=t0, bands=bands)


def rms_pairwise_distance(df: DataFrame, coords: list[str]) -> DataFrame:
    """subject, rms: root mean square distance of different points, exact from the variances."""
    v = sum((F.var_pop(c) for c in coords), F.lit(0.0))
    n = F.count(F.lit(1))
    return df.groupBy("subject").agg(F.when(n > 1, F.sqrt(2 * v * n / (n - 1))).alias("rms"))


def shape_stats(df: DataFrame, coords: list[str]) -> DataFrame:
    """subject, tail_ratio (the 0.999 quantile of pair distances over their root mean square), max_ratio, skewness
    (mean of the coordinates')."""
    pair = R.pairs(df, coords, 1).groupBy("subject").agg(F.percentile("d", F.lit(0.999)).alias("q"), F.max("d").alias("m"))
    skew = df.groupBy("subject").agg((sum((F.coalesce(F.skewness(c), F.lit(0.0)) for c in coords), F.lit(0.0)) / len(coords)).alias("skewness"))
    out = pair.join(rms_pairwise_distance(df, coords), "subject").join(skew, "subject")
    ratio = lambda c: F.when(F.col("rms") > 0, F.col(c) / F.col("rms")).otherwise(0.0)
    return out.select("subject", ratio("q").alias("tail_ratio"), ratio("m").alias("max_ratio"), "skewness")


POLICIES = ("rms_balanced", "weighted", "custom", "none")


def fit_weights(df: DataFrame, blocks: dict[str, list[str]], policy: str = "rms_balanced", lambda_: float | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """subject, block, rms, weight, variance_share of each block of coordinates.

    rms_balanced: one over the mean square distance, normalised to sum to the number of blocks; weighted: these times
    2 (1 - lambda) and 2 lambda of two blocks; custom: as given; none: 1."""
    if policy not in POLICIES:
        raise ParameterError(f"policy must be one of {POLICIES}")
    if policy == "weighted" and (len(blocks) != 2 or lambda_ is None or not 0 <= lambda_ <= 1):
        raise ParameterError("weighted needs two blocks and lambda_ within 0 and 1")
    if policy == "custom" and set(weights or {}) != set(blocks):
        raise ParameterError("custom needs a weight for each block")
    each = S.balanced_weights(df, blocks)
    if policy == "weighted":
        first, _ = blocks
        each = each.withColumn("weight", F.col("weight") * F.when(F.col("block") == first, 2 * (1 - lambda_)).otherwise(2 * lambda_))
    elif policy == "custom":
        given = F.create_map(*[F.lit(x) for b, w in weights.items() for x in (b, float(w))])
        each = each.withColumn("weight", F.element_at(given, F.col("block")))
    elif policy == "none":
        each = each.withColumn("weight", F.lit(1.0))
    part = F.col("weight") * F.col("rms") * F.col("rms")
    total = F.sum(part).over(S.everything())
    return each.withColumn("variance_share", F.when(total > 0, part / total).otherwise(0.0))


def scale_report(df: DataFrame, blocks: dict[str, list[str]], **policy) -> DataFrame:
    """fit_weights plus tail_ratio and skewness of each block, dominant (over 0.9 of the variance) and uneven_tails
    (tail ratios of the subject's blocks differ by more than 1.6 times)."""
    shapes = None
    for b, cs in blocks.items():
        one = shape_stats(df, cs).select("subject", F.lit(b).alias("block"), "tail_ratio", "skewness")
        shapes = one if shapes is None else shapes.union(one)
    out = fit_weights(df, blocks, **policy).join(shapes, ["subject", "block"])
    low, high = F.min("tail_ratio").over(S.everything()), F.max("tail_ratio").over(S.everything())
    return out.withColumn("dominant", F.col("variance_share") > 0.9).withColumn("uneven_tails", F.coalesce(high / F.when(low > 0, low) > 1.6, F.lit(False)))
