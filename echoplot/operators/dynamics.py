"""Embedding choice, invariants and comparisons of state spaces.

Neighbours are found by the pair join of a subject's points (`recurrence.pairs`); curves
are small and their fits are aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..records import ParameterError
from . import recurrence as R
from . import series as S


def attractor_size(df: DataFrame, coords: list[str]) -> DataFrame:
    return df.groupBy("subject").agg(F.sqrt(sum((F.var_pop(c) for c in coords), F.lit(0.0))).alias("size"))


def nearest_distinct(df: DataFrame, coords: list[str]) -> DataFrame:
    """subject, i, j, d, size: the nearest other point that does not coincide; ties go to the smaller j."""
    pair = R.pairs(df, coords, 1).join(attractor_size(df, coords), "subject").where(F.col("d") > 1e-9 * F.col("size"))
    near = pair.groupBy("subject", "i").agg(F.min(F.struct("d", "j")).alias("near"), F.first("size").alias("size"))
    return near.select("subject", "i", "near.j", "near.d", "size")


def false_neighbours(df: DataFrame, c: str, m: int, tau: int = 1, rtol: float = 10.0, atol: float = 2.0) -> DataFrame:
    """Share of nearest neighbours in m dimensions that one more dimension pulls apart."""
    e = S.embed(df, c, m + 1, tau)
    near = nearest_distinct(e.drop(f"x{m}"), [f"x{k}" for k in range(m)])
    last = e.select("subject", "i", F.col(f"x{m}").alias("u"))
    far = near.join(last, ["subject", "i"]).join(last.select("subject", F.col("i").alias("j"), F.col("u").alias("v")), ["subject", "j"])
    more = F.hypot(F.col("d"), F.col("u") - F.col("v"))
    false = (F.round((more - F.col("d")) / F.col("d"), 9) > rtol) | (F.round(more / F.col("size"), 9) > atol)
    return far.groupBy("subject").agg(F.lit(m).alias("m"), F.avg(false.cast("double")).alias("fnn"))


def estimate_m(df: DataFrame, c: str, tau: int = 1, m_max: int = 6, limit: float = 0.01) -> DataFrame:
    """The first dimension whose share of false neighbours is at most `limit`, else the one with the least."""
    curve = None
    for m in range(1, m_max + 1):
        one = false_neighbours(df, c, m, tau)
        curve = one if curve is None else curve.union(one)
    return curve.groupBy("subject").agg(F.coalesce(F.min(F.when(F.col("fnn") <= limit, F.col("m"))), F.min(F.struct("fnn", "m"))["m"]).alias("m"))


def estimate_tau(df: DataFrame, c: str, max_lag: int = 20) -> DataFrame:
    """The first lag with an autocorrelation of at most 1/e, else the lag of the least one."""
    acf = S.autocorrelation(df, c, max_lag).where("lag > 0").withColumn("acf", F.round("acf", 9))
    return acf.groupBy("subject").agg(F.coalesce(F.min(F.when(F.col("acf") <= math.exp(-1), F.col("lag"))), F.min(F.struct("acf", "lag"))["lag"]).alias("tau"))


def ami_curve(df: DataFrame, c: str, lags: list[int], n_bins: int = 32) -> DataFrame:
    """subject, lag, ami (nats): mutual information of a channel with itself, every lag from one pass over the
    samples; 0 with under four samples a bin."""
    w = Window.partitionBy("subject", "lag")
    later = df.select("subject", F.col(c).alias("a"), *[F.lead(c, k).over(S.over()).alias(f"__b{k}") for k in lags])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__b{k}").alias("b")) for k in lags]))
    x = later.select("subject", "a", pairs.alias("x")).select("subject", "a", "x.*").where("b is not null")
    cell = lambda k: F.least(F.floor(F.coalesce(F.try_divide(F.col(k) - F.min(k).over(w), F.max(k).over(w) - F.min(k).over(w)), F.lit(0.0)) * n_bins), F.lit(n_bins - 1)).cast("int")
    cells = x.withColumns({"p": cell("a"), "q": cell("b")}).groupBy("subject", "lag", "p", "q").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumns({"np": F.sum("n").over(Window.partitionBy("subject", "lag", "p")), "nq": F.sum("n").over(Window.partitionBy("subject", "lag", "q")), "t": F.sum("n").over(w)})
    info = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("np") * F.col("nq"))))
    return cells.groupBy("subject", "lag").agg(F.when(F.max("t") >= 4 * n_bins, info).otherwise(0.0).alias("ami"))


def estimate_tau_ami(df: DataFrame, c: str, max_lag: int = 20, n_bins: int = 32) -> DataFrame:
    """The first lag whose mutual information is under the one before and not over the next, else the lag of the least."""
    w = Window.partitionBy("subject").orderBy("lag")
    curve = ami_curve(df, c, list(range(1, max_lag + 1)), n_bins).withColumn("ami", F.round("ami", 9))
    dip = (F.col("ami") < F.lag("ami").over(w)) & (F.col("ami") <= F.lead("ami").over(w))
    return curve.withColumn("dip", dip).groupBy("subject").agg(F.coalesce(F.min(F.when(F.col("dip"), F.col("lag"))), F.min(F.struct("ami", "lag"))["lag"]).alias("tau"))


def estimate_tau_zero(df: DataFrame, c: str, max_lag: int = 20) -> DataFrame:
    """The first lag with an autocorrelation of at most zero, else the lag of the least one."""
    acf = S.autocorrelation(df, c, max_lag).where("lag > 0").withColumn("acf", F.round("acf", 9))
    return acf.groupBy("subject").agg(F.coalesce(F.min(F.when(F.col("acf") <= 0, F.col("lag"))), F.min(F.struct("acf", "lag"))["lag"]).alias("tau"))


def estimate_embedding(df: DataFrame, c: str, tau_method: str = "acf", m_method: str = "fnn", max_lag: int = 20, m_max: int = 6) -> DataFrame:
    """subject, tau, m: the delay by `tau_method` (acf, ami, first_zero), then the dimension at the subjects' median delay."""
    methods = {"acf": estimate_tau, "ami": estimate_tau_ami, "first_zero": estimate_tau_zero}
    if tau_method not in methods or m_method not in ("fnn", "cao"):
        raise ParameterError(f"unknown method {tau_method!r} or {m_method!r}")
    tau = methods[tau_method](df, c, max_lag)
    middle = int(tau.agg(F.percentile("tau", F.lit(0.5))).first()[0] or 1)
    m = estimate_m(df, c, middle, m_max) if m_method == "fnn" else estimate_m_cao(cao(df, c, middle, m_max)).select("subject", "m")
    return tau.join(m, "subject")


def estimate_embedding_multi(df: DataFrame, c: str, aggregate: str = "median", **options) -> DataFrame:
    """tau and m over all subjects; subjects are never joined end to end."""
    each = estimate_embedding(df, c, **options)
    of = {"median": lambda x: F.ceil(F.percentile(x, F.lit(0.5))), "max": F.max, "mean": lambda x: F.ceil(F.avg(x)), "mode": lambda x: F.mode(x, True)}
    if aggregate not in of:
        raise ParameterError(f"aggregate must be one of {sorted(of)}")
    return each.agg(*[of[aggregate](x).cast("int").alias(x) for x in ("tau", "m")])


def theiler_window(n: int, span: int) -> int:
    """A hundredth of the record, the embedding's span at least, a twentieth of the record at most."""
    return min(max(span, n // 100), n // 20)


def correlation_curve(df: DataFrame, coords: list[str], radii: list[float], theiler: int = 1, counts: bool = False) -> DataFrame:
    """subject, radius, c (and n with `counts`): share and number of admissible pairs within each radius, in one pass over the pairs."""
    pair = R.pairs(df, coords, theiler).groupBy("subject").agg(F.count(F.lit(1)).alias("t"), *[F.count_if(F.col("d") <= r).alias(f"n{k}") for k, r in enumerate(radii)])
    at = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"n{k}").alias("n"), (F.col(f"n{k}") / F.col("t")).alias("c")) for k, r in enumerate(radii)]))
    out = pair.select("subject", at.alias("x")).select("subject", "x.*")
    return out if counts else out.drop("n")


def slope_within(curve: DataFrame, lo: float, hi: float) -> DataFrame:
    """Slope, intercept and r2 of log c on log radius in a fixed region; D2 where the curve is a correlation sum."""
    x, y = F.log("radius"), F.log("c")
    kept = curve.where((F.col("radius") >= lo) & (F.col("radius") <= hi) & (F.col("c") > 0))
    return kept.groupBy("subject").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def correlation_dimension(df: DataFrame, coords: list[str], radii: list[float], theiler: int = 1, min_points: int = 8, max_c: float = 0.05) -> DataFrame:
    """subject, d2, lo, hi, cv: slope in the straightest region of the curve's part with c <= max_c; null without one."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf[(pdf["c"] > 0) & (pdf["c"] <= max_c)].sort_values("radius")
        got = kernels.scaling_region(np.log(pdf["radius"].to_numpy()), np.log(pdf["c"].to_numpy()), min_points)
        if got is None:
            return pd.DataFrame({"d2": [], "lo": [], "hi": [], "cv": []}, dtype=float)
        a, b, slope, cv = got
        r = pdf["radius"].to_numpy()
        return pd.DataFrame({"d2": [slope], "lo": [r[a]], "hi": [r[b]], "cv": [cv]})

    def keyed(key, pdf):
        out = run(pdf)
        out.insert(0, "subject", [key[0]] * len(out))
        return out

    curve = correlation_curve(df, coords, radii, theiler)
    kind = dict(df.dtypes)["subject"]
    found = curve.groupBy("subject").applyInPandas(keyed, f"subject {kind}, d2 double, lo double, hi double, cv double")
    return curve.select("subject").distinct().join(found, "subject", "left")


def k2(hist: DataFrame, l_min: int = 2, fs: float = 1.0) -> DataFrame:
    """Minus the slope of the log number of diagonal lines of at least a length, a second; null under three lengths."""
    more = Window.partitionBy("subject").orderBy(F.col("length").desc())
    d = hist.where((F.col("kind") == "diagonal") & (F.col("length") >= l_min)).withColumn("least", F.sum("cnt").over(more))
    out = d.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.log("least"), F.col("length").cast("double")).alias("s"))
    return out.select("subject", F.when(F.col("n") >= 3, -F.col("s") * fs).alias("k2"))


def neighbours(df: DataFrame, coords: list[str], k: int) -> DataFrame:
    w = Window.partitionBy("subject", "i").orderBy("d", "j")
    return R.pairs(df, coords, 1).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).select("subject", "i", "j")


def neighbour_agreement(df: DataFrame, a: list[str], b: list[str], k: int = 8) -> DataFrame:
    """Mean share of the k nearest neighbours that two sets of coordinates agree on."""
    both = neighbours(df, a, k).join(neighbours(df, b, k), ["subject", "i", "j"]).groupBy("subject").agg(F.count(F.lit(1)).alias("hits"))
    n = R.unit_sizes(df).join(both, "subject", "left")
    return n.where(F.col("n") > k).select("subject", (F.coalesce("hits", F.lit(0)) / (F.col("n") * k)).alias("agreement"))


def comodulogram(df: DataFrame, phases: list[str], amplitudes: list[str], index: str = "mvl", n_bins: int = 18) -> DataFrame:
    """subject, phase_band, amplitude_band, value for every pair of channels."""
    if index == "mvl":
        cells = [(p, a) for p in phases for a in amplitudes]
        one = df.groupBy("subject").agg(*[S.mvl(p, a).alias(f"v{k}") for k, (p, a) in enumerate(cells)])
        rows = F.array(*[F.struct(F.lit(p).alias("phase_band"), F.lit(a).alias("amplitude_band"), F.col(f"v{k}").alias("value")) for k, (p, a) in enumerate(cells)])
        return one.select("subject", F.explode(rows).alias("x")).select("subject", "x.*")
    if index != "mi":
        raise ParameterError(f"unknown index {index!r}")
    out = None
    for p in phases:
        for a in amplitudes:
            one = S.modulation_index(df, p, a, n_bins).select("subject", F.lit(p).alias("phase_band"), F.lit(a).alias("amplitude_band"), F.col("mi").alias("value"))
            out = one if out is None else out.union(one)
    return out


def instantaneous_rate(df: DataFrame, phase: str, fs: float = 1.0) -> DataFrame:
    """subject, i, rate: central differences of the unwrapped phase over 2 pi; one-sided at the ends."""
    w = S.over()
    turn = F.col(phase) - F.lag(phase).over(w)
    x = df.select("subject", "i", F.coalesce(turn - 2 * math.pi * F.round(turn / (2 * math.pi), 0), F.lit(0.0)).alias("step"))
    after = F.lead("step").over(w)
    first, last = F.col("i") == F.min("i").over(S.everything()), after.isNull()
    rate = F.when(first & last, 0.0).when(first, after).when(last, F.col("step")).otherwise((F.col("step") + after) / 2)
    return x.select("subject", "i", (rate * fs / (2 * math.pi)).alias("rate"))


def cao_ratios(df: DataFrame, c: str, m: int, tau: int = 1) -> DataFrame:
    """subject, m, e, s: mean growth of nearest-neighbour distances by one more dimension, and mean gap of the added coordinate."""
    e = S.embed(df, c, m + 1, tau)
    last = e.select("subject", "i", F.col(f"x{m}").alias("u"))
    far = nearest_distinct(e.drop(f"x{m}"), [f"x{k}" for k in range(m)]).join(last, ["subject", "i"]).join(last.select("subject", F.col("i").alias("j"), F.col("u").alias("v")), ["subject", "j"])
    apart = F.abs(F.col("u") - F.col("v"))
    return far.groupBy("subject").agg(F.lit(m).alias("m"), F.avg(F.hypot(F.col("d"), apart) / F.col("d")).alias("e"), F.avg(apart).alias("s"))


def cao(df: DataFrame, c: str, tau: int = 1, m_max: int = 6) -> DataFrame:
    """subject, m, e1, e2: e1 levels off at a sufficient dimension, e2 stays at 1 for noise."""
    curve = None
    for m in range(1, m_max + 2):
        one = cao_ratios(df, c, m, tau)
        curve = one if curve is None else curve.union(one)
    w = Window.partitionBy("subject").orderBy("m")
    up = lambda x: F.try_divide(F.lead(x).over(w), F.col(x))
    return curve.select("subject", "m", up("e").alias("e1"), up("s").alias("e2"), F.lead("m").over(w).alias("next")).where("next = m + 1").drop("next")


def estimate_m_cao(curve: DataFrame, tol: float = 0.05) -> DataFrame:
    """subject, m, looks_stochastic: the first m whose e1 differs by less than `tol` from the one before, else that of the largest e1."""
    w = Window.partitionBy("subject").orderBy("m")
    at = curve.withColumn("step", F.round(F.abs(F.col("e1") - F.lag("e1").over(w)), 9))
    m = F.coalesce(F.min(F.when(F.col("step") < tol, F.col("m"))), -F.max(F.struct("e1", -F.col("m")))["col2"])
    return at.groupBy("subject").agg(m.alias("m"), (F.max(F.round(F.abs(F.col("e2") - 1), 9)) < tol).alias("looks_stochastic"))


# invariants


def correlation_radii(df: DataFrame, coords: list[str], n_radii: int = 40, theiler: int = 1, lo: float = 0.0002, hi: float = 0.5) -> DataFrame:
    """subject, k, radius: radii evenly spaced in their logarithm between two quantiles of the pair distances; zero
    distances do not count towards the lower one."""
    q = R.pairs(df, coords, theiler).where("d > 0").groupBy("subject").agg(F.percentile("d", F.array(F.lit(lo), F.lit(hi))).alias("q"))
    step = F.log(F.col("q")[1] / F.col("q")[0]) / (n_radii - 1)
    return q.where("q[1] > q[0]").select("subject", F.explode(F.sequence(F.lit(0), F.lit(n_radii - 1))).alias("k"), "q", step.alias("s")).select("subject", "k", F.round(F.col("q")[0] * F.exp(F.col("s") * F.col("k")), 9).alias("radius"))


def correlation_sum(df: DataFrame, coords: list[str], n_radii: int = 40, theiler: int = 1, **quantiles) -> DataFrame:
    """subject, k, radius, c: share of admissible pairs within each of the subject's own radii. A pair is counted at the
    first radius that holds it, and counts are summed up over the radii, so a pair is one row."""
    radii = correlation_radii(df, coords, n_radii, theiler, **quantiles)
    own = radii.groupBy("subject").agg(F.array_sort(F.collect_list("radius")).alias("r"))  # n_radii numbers a subject
    pair = R.pairs(df, coords, theiler).join(own, "subject")
    first = F.size(F.filter("r", lambda x: x < F.col("d")))
    count = pair.groupBy("subject", first.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = count.groupBy("subject").agg(F.sum("n").alias("t"))
    grid = radii.join(total, "subject").join(count, ["subject", "k"], "left")
    upto = Window.partitionBy("subject").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("subject", "k", "radius", (F.coalesce(F.sum("n").over(upto), F.lit(0)) / F.col("t")).alias("c"))


def region_of(curve: DataFrame, x: str, y: str, min_points: int = 8, max_cv: float = 0.25) -> DataFrame:
    """subject, slope, lo, hi, cv, r2, ok: the straightest stretch of each subject's curve (a few points), else a flagged
    fit of all of it."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(x)
        u, v = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        keep = np.isfinite(u) & np.isfinite(v)
        u, v = u[keep], v[keep]
        got = kernels.scaling_region(u, v, min_points, max_cv)
        if got is None:
            if len(u) < 2:
                return pd.DataFrame({"subject": [], "slope": [], "lo": [], "hi": [], "cv": [], "r2": [], "ok": []})
            a, b, slope, cv = 0, len(u) - 1, float(np.polyfit(u, v, 1)[0]), float("nan")
        else:
            a, b, slope, cv = got
        r = np.corrcoef(u[a : b + 1], v[a : b + 1])[0, 1] if b > a else np.nan
        return pd.DataFrame({"subject": [key[0]], "slope": [slope], "lo": [u[a]], "hi": [u[b]], "cv": [cv], "r2": [r * r], "ok": [got is not None]})

    kind = dict(curve.dtypes)["subject"]
    return curve.select("subject", x, y).groupBy("subject").applyInPandas(run, f"subject {kind}, slope double, lo double, hi double, cv double, r2 double, ok boolean")


def divergence_curve(df: DataFrame, coords: list[str], steps: int = 10, theiler: int = 1, method: str = "rosenstein", radius: float | None = None, min_neighbours: int = 5) -> DataFrame:
    """subject, step, log_distance, n: mean log distance of neighbours `step` samples on.

    rosenstein: of every point and its nearest distinct neighbour outside the Theiler band; kantz: the log of a point's
    mean distance to all neighbours within `radius`, of points with `min_neighbours` or more. Neighbours must have
    `steps` samples after them."""
    if method not in ("rosenstein", "kantz"):
        raise ParameterError(f"unknown method {method!r}")
    n = R.unit_sizes(df)
    pair = R.pairs(df, coords, max(theiler, 1)).join(n, "subject").where(F.greatest("i", "j") + (steps - 1) < F.col("n")).where("d > 0")
    if method == "rosenstein":
        near = pair.groupBy("subject", "i").agg(F.min(F.struct("d", "j"))["j"].alias("j"))
    else:
        near = pair.where(F.col("d") <= radius).select("subject", "i", "j")
        near = near.join(near.groupBy("subject", "i").count().where(F.col("count") >= min_neighbours).select("subject", "i"), ["subject", "i"])
    ahead = near.select("subject", F.col("i").alias("i0"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"), (F.col("i") + F.col("step")).alias("i"), (F.col("j") + F.col("step")).alias("j"))
    other = df.select("subject", F.col("i").alias("j"), *[F.col(c).alias(f"{c}_2") for c in coords])
    both = ahead.join(df.select("subject", "i", *coords), ["subject", "i"]).join(other, ["subject", "j"])
    d = F.round(R.distance([F.col(c) for c in coords], [F.col(f"{c}_2") for c in coords]), R.DIGITS)
    each = both.select("subject", "i0", "step", d.alias("d")).where("d > 0")
    if method == "kantz":
        each = each.groupBy("subject", "i0", "step").agg(F.avg("d").alias("d"))
    return each.groupBy("subject", "step").agg(F.avg(F.log("d")).alias("log_distance"), F.count(F.lit(1)).alias("n"))


def lyapunov_max(df: DataFrame, coords: list[str], steps: int = 10, theiler: int = 1, fs: float = 1.0, lo: int = 0, hi: int | None = None, region: str = "fixed", **curve) -> DataFrame:
    """subject, lambda_1 (a second), r2, saturated, n_steps: slope of the divergence curve from step lo to hi, or in its
    straightest stretch (region="auto"). saturated: the second half of the stretch rises at under a quarter of the first."""
    d = divergence_curve(df, coords, steps, theiler, **curve)
    if region == "auto":
        got = region_of(d.withColumn("step", F.col("step").cast("double")), "step", "log_distance", min(15, max(4, steps // 2)))
        return got.select("subject", (F.col("slope") * fs).alias("lambda_1"), "r2", F.lit(None).cast("boolean").alias("saturated"), (F.col("hi") - F.col("lo") + 1).cast("long").alias("n_steps"))
    hi = steps - 1 if hi is None else hi
    x, y, mid = F.col("step").cast("double"), F.col("log_distance"), (lo + hi) / 2
    kept = d.where((F.col("step") >= lo) & (F.col("step") <= hi))
    first, last = F.col("step") <= mid, F.col("step") >= mid
    out = kept.groupBy("subject").agg(F.regr_slope(y, x).alias("s"), F.regr_r2(y, x).alias("r2"), F.regr_slope(F.when(first, y), F.when(first, x)).alias("a"), F.regr_slope(F.when(last, y), F.when(last, x)).alias("b"), F.count(F.lit(1)).alias("n_steps"))
    return out.select("subject", (F.col("s") * fs).alias("lambda_1"), "r2", (F.col("b") < 0.25 * F.col("a")).alias("saturated"), "n_steps")


def invariants_from_series(df: DataFrame, c: str, m: int = 3, tau: int = 1, theiler: int = 1, fs: float = 1.0, steps: int = 10, lo: float = 0.01, hi: float = 0.2) -> DataFrame:
    """subject, D2 (slope of the correlation sum while lo <= c <= hi), lambda_1 of a channel's delay embedding."""
    e = S.embed(df, c, m, tau)
    coords = [f"x{k}" for k in range(m)]
    curve = correlation_sum(e, coords, 20, theiler).where((F.col("c") >= lo) & (F.col("c") <= hi))
    d2 = curve.groupBy("subject").agg(F.regr_slope(F.log("c"), F.log("radius")).alias("D2"))
    return d2.join(lyapunov_max(e, coords, steps, theiler, fs).select("subject", "lambda_1"), "subject", "full")


# complexity from curves


def higuchi_dimension(df: DataFrame, c: str, k_max: int = 20, tolerance: float = 0.25) -> DataFrame:
    """subject, higuchi: slope of log length on log 1/k from k = 1 on, while the slope of each step stays within
    `tolerance` of the first one; three values of k at least."""
    w = Window.partitionBy("subject").orderBy("k")
    curve = S.higuchi_lengths(df, c, k_max).where("length > 0").select("subject", "k", F.log(1 / F.col("k")).alias("u"), F.log("length").alias("v"))
    local = curve.withColumn("s", (F.col("v") - F.lag("v").over(w)) / (F.col("u") - F.lag("u").over(w)))
    first = F.max(F.when(F.col("k") == 2, F.col("s"))).over(Window.partitionBy("subject"))
    # the k of the first step that turns off ends the stretch
    off = F.round(F.abs(F.col("s") - first) - tolerance * F.greatest(F.abs(first), F.lit(1e-12)), 9) > 0
    end = F.min(F.when(off, F.col("k"))).over(Window.partitionBy("subject"))
    kept = local.withColumn("end", end).where(F.col("end").isNull() | (F.col("k") < F.greatest(F.col("end"), F.lit(4))))
    return kept.groupBy("subject").agg(F.when(F.count(F.lit(1)) >= 3, F.regr_slope("v", "u")).alias("higuchi"))


def dfa_exponent(df: DataFrame, c: str, scales: list[int] | None = None) -> DataFrame:
    """subject, alpha, n_scales: slope of log fluctuation on log scale; null with under three scales. Without `scales`,
    distinct whole numbers from 8 to a quarter of the longest record."""
    if scales is None:
        longest = R.unit_sizes(df).agg(F.max("n")).first()[0] or 0
        scales = [int(s) for s in kernels.log_scales(longest)] if longest >= 36 else [4, 8]
    f = S.dfa_fluctuations(df, c, scales).where("fluctuation > 0")
    return f.groupBy("subject").agg(F.when(F.count(F.lit(1)) >= 3, F.regr_slope(F.log("fluctuation"), F.log("scale"))).alias("alpha"), F.count(F.lit(1)).alias("n_scales"))


def hurst_exponent(df: DataFrame, c: str, scales: list[int] | None = None) -> DataFrame:
    """subject, hurst: the exponent of detrended fluctuations of a stationary series."""
    return dfa_exponent(df, c, scales).select("subject", F.col("alpha").alias("hurst"))


def fine_scale_factor(df: DataFrame, c: str, target: float = 2.0, least: int = 64) -> DataFrame:
    """subject, factor: decimation that leaves about `target` samples a turn and `least` samples or more."""
    t = S.turns(df, c)
    return t.select("subject", F.greatest(F.lit(1), F.least(F.floor(F.col("samples_per_turn") / target), F.floor(F.col("n") / least))).cast("int").alias("factor"))


DEFAULT_MEASURES = ("mobility", "complexity", "petrosian", "katz", "permutation", "sample", "higuchi", "dfa")


def block_series(space) -> DataFrame:
    """subject, i and one series for each block: a circle's unwrapped turning a sample, else the first column."""
    df, out = space.df, []
    for b in space.blocks:
        if b.kind == "phase_circle":
            df = df.withColumn(f"__p_{b.label}", F.atan2(F.col(b.columns[1]), F.col(b.columns[0])))
            turn = instantaneous_rate(df.select("subject", "i", f"__p_{b.label}"), f"__p_{b.label}", 2 * math.pi).withColumnRenamed("rate", f"__r_{b.label}")
            df = df.join(turn, ["subject", "i"])
            out.append(F.col(f"__r_{b.label}").alias(b.label))
        else:
            out.append(F.col(b.columns[0]).alias(b.label))
    return df.select("subject", "i", *out)


def dynamics_measures(df: DataFrame, channels: list[str], measures: tuple[str, ...] = DEFAULT_MEASURES) -> DataFrame:
    """subject, channel, and a column for each measure, of each channel or block series. All channels are measured in
    the same passes: subject and channel together are the unit."""
    unknown = set(measures) - set(DEFAULT_MEASURES)
    if unknown:
        raise ParameterError(f"unknown measures {sorted(unknown)}")
    unit = F.struct("subject", "channel").alias("subject")
    long = df.select("subject", "i", *channels).unpivot(["subject", "i"], channels, "channel", "value").where("value is not null").select(unit, "i", "value")
    parts = {
        "mobility": lambda: S.hjorth(long, "value").select("subject", "mobility"),
        "complexity": lambda: S.hjorth(long, "value").select("subject", "complexity"),
        "petrosian": lambda: S.turns(long, "value").select("subject", "petrosian"),
        "katz": lambda: S.katz(long, "value"),
        "permutation": lambda: S.permutation_entropy(long, "value").withColumnRenamed("pe", "permutation"),
        "sample": lambda: S.sample_entropy(long, "value").select("subject", F.col("sampen").alias("sample")),
        "higuchi": lambda: higuchi_dimension(long, "value", 8),
        "dfa": lambda: dfa_exponent(long, "value", [4, 6, 8, 12, 16]).select("subject", F.col("alpha").alias("dfa")),
    }
    out = long.select("subject").distinct()
    for m in measures:
        out = out.join(parts[m](), "subject", "left")
    return out.select("subject.subject", "subject.channel", *measures)


# comparing spaces


def geometry_descriptors(df: DataFrame, coords: list[str], theiler: int = 1, shares: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1, 0.2)) -> DataFrame:
    """subject, nn_mean, nn_cv (nearest neighbours), corr_slope (log share of pairs on log radius at quantiles), extent
    (root of the summed variances), in one pass over the pairs."""
    pair = R.pairs(df, coords, theiler)
    near = pair.groupBy("subject", "i").agg(F.min("d").alias("d")).groupBy("subject").agg(F.avg("d").alias("nn_mean"), F.stddev_pop("d").alias("s"))
    q = pair.groupBy("subject").agg(F.percentile("d", F.array(*[F.lit(x) for x in shares])).alias("q"))
    rows = F.explode(F.array(*[F.struct(F.col("q")[k].alias("r"), F.lit(x).alias("c")) for k, x in enumerate(shares)]))
    slope = q.select("subject", rows.alias("x")).where("x.r > 0").groupBy("subject").agg(F.regr_slope(F.log("x.c"), F.log("x.r")).alias("corr_slope"))
    extent = attractor_size(df, coords).withColumnRenamed("size", "extent")
    out = near.join(slope, "subject", "left").join(extent, "subject")
    return out.select("subject", "nn_mean", F.when(F.col("nn_mean") > 0, F.col("s") / F.col("nn_mean")).alias("nn_cv"), "corr_slope", "extent")


def compare_routes(spaces: dict, reference: str | None = None, k: int = 8) -> DataFrame:
    """route, subject and the geometry of each space; with a reference, the share of neighbours that it agrees on.
    spaces: route -> StateSpace, or a function that makes one; a route that cannot be made has one row with its error."""
    out, made = None, {}
    for route, space in spaces.items():
        try:
            made[route] = space() if callable(space) else space
        except ParameterError as e:
            made[route] = str(e)
    spark = next(s for s in made.values() if not isinstance(s, str)).df.sparkSession
    for route, space in made.items():
        if isinstance(space, str):
            one = spark.createDataFrame([(route, space)], "route string, error string")
        else:
            one = geometry_descriptors(space.weighted_coords(), space.coords).withColumn("route", F.lit(route)).withColumn("dim", F.lit(space.dim))
            if reference and route != reference:
                other = made[reference]
                both = space.weighted_coords().toDF("subject", "i", *[f"a{j}" for j in range(space.dim)]).join(other.weighted_coords().toDF("subject", "i", *[f"b{j}" for j in range(other.dim)]), ["subject", "i"])
                one = one.join(neighbour_agreement(both, [f"a{j}" for j in range(space.dim)], [f"b{j}" for j in range(other.dim)], k), "subject", "left")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def lambda_sweep(space, grid: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """subject, lambda, the geometry of the space at that weight of its second block, and how far nn_cv lies under the
    straight line between the ends of the grid (deficit). All weights are rows of one table: subject and lambda together
    are the unit of one pass."""
    first, second = space.blocks
    base = space.rescale("rms_balanced").weighted_coords()
    unit = base.withColumn("lambda", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    a, b = F.sqrt(2 * (1 - F.col("lambda"))), F.sqrt(2 * F.col("lambda"))
    unit = unit.select(F.struct("subject", "lambda").alias("subject"), "i", *[(F.col(c) * a).alias(c) for c in first.columns], *[(F.col(c) * b).alias(c) for c in second.columns])
    got = geometry_descriptors(unit, space.coords).select("subject.subject", "subject.lambda", "nn_mean", "nn_cv", "corr_slope", "extent")
    w = Window.partitionBy("subject")
    lo, hi = F.min_by("nn_cv", "lambda").over(w), F.max_by("nn_cv", "lambda").over(w)
    at = (F.col("lambda") - min(grid)) / (max(grid) - min(grid))
    return got.withColumn("deficit", lo + (hi - lo) * at - F.col("nn_cv"))
