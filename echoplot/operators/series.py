"""Relational operators on records: quality, scaling, embedding, windows, coupling, complexity, groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.units import per_unit
from ..records import ParameterError


def over(*order: str, by: str = "subject"):
    return Window.partitionBy(by).orderBy(*(order or ("i",)))


def everything(by: str = "subject"):
    return Window.partitionBy(by)


def channel_stats(long: DataFrame, by: tuple[str, ...] = ("subject", "channel")) -> DataFrame:
    return long.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def quality(long: DataFrame, flat: float = 0.05) -> DataFrame:
    """Issues of each channel: missing samples, a constant channel, saturation at an extreme."""
    s = channel_stats(long)
    ends = long.join(s.select("subject", "channel", "min", "max"), ["subject", "channel"]).groupBy("subject", "channel").agg(F.count_if(F.col("value") == F.col("min")).alias("at_min"), F.count_if(F.col("value") == F.col("max")).alias("at_max"))
    s = s.join(ends, ["subject", "channel"])
    limit = F.greatest(F.lit(3.0), F.col("n_samples") * flat)
    full = F.greatest("at_min", "at_max")
    return s.select("subject", "channel", "n_samples", "n_missing", (F.col("n_missing") > 0.01 * F.col("n_samples")).alias("nonfinite_error"), (F.col("std") == 0).alias("constant"), ((full > limit) & (F.col("std") > 0)).alias("saturation"))


def scaled(df: DataFrame, c: str, policy: str) -> DataFrame:
    """df plus `scaled`; a spread of zero divides by 1."""
    one = lambda x: F.when(x > 1e-12, x).otherwise(1.0)
    w = everything()
    if policy == "zscore":
        return df.withColumn("scaled", (F.col(c) - F.avg(c).over(w)) / one(F.stddev_pop(c).over(w)))
    if policy == "minmax":
        low = F.min(c).over(w)
        return df.withColumn("scaled", (F.col(c) - low) / one(F.max(c).over(w) - low))
    if policy == "rank":
        r = F.rank().over(over(c)) + (F.count(F.lit(1)).over(Window.partitionBy("subject", c)) - 1) / 2
        return df.withColumn("scaled", (r - 0.5) / F.count(F.lit(1)).over(w))
    if policy == "robust":
        mid = df.groupBy("subject").agg(F.median(c).alias("mid"))
        df = df.join(mid, "subject")
        mad = df.groupBy("subject").agg(F.median(F.abs(F.col(c) - F.col("mid"))).alias("mad"))
        return df.join(mad, "subject").withColumn("scaled", (F.col(c) - F.col("mid")) / one(1.4826 * F.col("mad"))).drop("mid", "mad")
    if policy == "none":
        return df.withColumn("scaled", F.col(c))
    raise ParameterError(f"unknown policy {policy!r}")


def balanced_weights(df: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """Weight 1 / rms^2 of each block, normalised to sum to the number of blocks, and its share of the variance."""
    each = df.groupBy("subject").agg(*[(2 * sum((F.var_pop(c) for c in cs), F.lit(0.0))).alias(b) for b, cs in blocks.items()])
    long = each.unpivot("subject", list(blocks), "block", "ms")
    inverse = F.when(F.col("ms") > 0, 1 / F.col("ms")).otherwise(0.0)
    w = everything()
    out = long.withColumn("weight", F.when(F.sum(inverse).over(w) > 0, inverse * len(blocks) / F.sum(inverse).over(w)).otherwise(0.0))
    return out.select("subject", "block", F.sqrt("ms").alias("rms"), "weight")


def embed(df: DataFrame, c: str, m: int = 3, tau: int = 1) -> DataFrame:
    """subject, i, x0..x(m-1): delay coordinates; the incomplete end is dropped."""
    out = df.select("subject", "i", F.col(c).alias("x0"), *[F.lead(c, k * tau).over(over()).alias(f"x{k}") for k in range(1, m)])
    return out.where(F.col(f"x{m - 1}").isNotNull()) if m > 1 else out


def circle(df: DataFrame, phase: str) -> DataFrame:
    return df.withColumns({"cos_" + phase: F.cos(phase), "sin_" + phase: F.sin(phase)})


def autocorrelation(df: DataFrame, c: str, max_lag: int) -> DataFrame:
    x = df.select("subject", "i", (F.col(c) - F.avg(c).over(everything())).alias("v"))
    lags = x.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).select("subject", "lag", (F.col("i") + F.col("lag")).alias("k"), F.col("v").alias("u"))
    y = lags.join(x.withColumnRenamed("i", "k"), ["subject", "k"]).groupBy("subject", "lag").agg(F.sum(F.col("u") * F.col("v")).alias("s"))
    return y.join(x.groupBy("subject").agg(F.sum(F.col("v") * F.col("v")).alias("ss")), "subject").select("subject", "lag", (F.col("s") / F.col("ss")).alias("acf"))


def mutual_information(df: DataFrame, c: str, lag: int, n_bins: int = 8) -> DataFrame:
    """Nats between a channel and itself `lag` later, on equal-width bins."""
    w = everything()
    x = df.select("subject", F.col(c).alias("a"), F.lead(c, lag).over(over()).alias("b")).where("b is not null")
    bin_ = lambda k: F.least(F.floor((F.col(k) - F.min(k).over(w)) / (F.max(k).over(w) - F.min(k).over(w)) * n_bins), F.lit(n_bins - 1)).cast("int")
    cells = x.withColumns({"p": bin_("a"), "q": bin_("b")}).groupBy("subject", "p", "q").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(w)
    cells = cells.withColumns({"np": F.sum("n").over(Window.partitionBy("subject", "p")), "nq": F.sum("n").over(Window.partitionBy("subject", "q")), "t": total})
    return cells.groupBy("subject").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("np") * F.col("nq")))).alias("ami"))


def windows_by_size(sizes: DataFrame, size: int, step: int) -> DataFrame:
    """Window grid of each unit: subject, window, start, stop."""
    grid = sizes.where(F.col("n") >= size).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - size, F.lit(step).cast("long"))))
    return grid.select("subject", F.expr(f"int(start div {step})").alias("window"), "start", (F.col("start") + size).alias("stop"))


def windows_by_count(sizes: DataFrame, k: int, overlap: float = 0.5) -> DataFrame:
    """Exactly k windows; starts and size rounded half to even."""
    size = F.bround(F.col("n") / (1 + (k - 1) * (1 - overlap))).cast("long")
    grid = sizes.withColumn("size", size).withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.bround((F.col("n") - F.col("size")) * F.col("window") / max(1, k - 1)).cast("long")
    return grid.withColumn("start", start).select("subject", "window", "start", (F.col("start") + F.col("size")).alias("stop"))


def into_windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """Points with the windows that hold them, by arithmetic on i: no join. i is counted in the window."""
    n = df.withColumn("__n", F.count(F.lit(1)).over(everything()))
    first = F.greatest(F.ceil((F.col("i") - size + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("__n") - size) / step))
    out = n.where((F.col("__n") >= size)).withColumn("__f", first).withColumn("__l", last).where("__l >= __f").withColumn("window", F.explode(F.sequence(F.col("__f").cast("int"), F.col("__l").cast("int"))))
    return out.withColumn("i", F.col("i") - F.col("window") * step).drop("__n", "__f", "__l")


# coupling


def mvl(p: str, a: str) -> Column:
    return F.hypot(F.avg(F.col(a) * F.cos(p)), F.avg(F.col(a) * F.sin(p))) / F.avg(a)


def plv(p: str, q: str, n: int = 1, m: int = 1) -> Column:
    d = F.lit(n) * F.col(p) - F.lit(m) * F.col(q)
    return F.hypot(F.avg(F.cos(d)), F.avg(F.sin(d)))


def modulogram(df: DataFrame, p: str, a: str, n_bins: int = 18) -> DataFrame:
    b = F.least(F.floor((F.col(p) + math.pi) / (2 * math.pi) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.withColumn("bin", b).groupBy("subject", "bin").agg(F.avg(a).alias("mean"), (F.stddev_samp(a) / F.sqrt(F.count(a))).alias("sem"), F.count(a).alias("n"))


def modulation_index(df: DataFrame, p: str, a: str, n_bins: int = 18) -> DataFrame:
    """Divergence of the binned mean amplitude from uniform, over log bins; null under 4 samples a bin."""
    g = modulogram(df, p, a, n_bins)
    share = g.withColumn("s", F.col("mean") / F.sum("mean").over(everything()))
    out = share.groupBy("subject").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("s") > 0, F.col("s") * F.log("s"))).alias("h"))
    return out.select("subject", F.when(F.col("n") >= 4 * n_bins, (math.log(n_bins) + F.col("h")) / math.log(n_bins)).alias("mi"))


def average_rank(c: str, by: str = "subject") -> Column:
    return F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(by, c)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select("subject", average_rank(a).alias("a"), average_rank(b).alias("b")).groupBy("subject").agg(F.corr("a", "b").alias("rho"))


def shifted_mvl(df: DataFrame, p: str, a: str, shifts: list[int]) -> DataFrame:
    """MVL under circular shifts of the amplitude, and the share of shifts that reach the observed one."""
    n = df.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    moved = df.select("subject", "i", F.col(a).alias("amp")).join(n, "subject").withColumn("shift", F.explode(F.array(*[F.lit(s) for s in [0, *shifts]]))).select("subject", "shift", ((F.col("i") + F.col("shift")) % F.col("n")).alias("i"), "amp")
    each = moved.join(df.select("subject", "i", F.col(p).alias("ph")), ["subject", "i"]).groupBy("subject", "shift").agg(mvl("ph", "amp").alias("v"))
    each = each.withColumn("v", F.round("v", 9))
    observed = each.where("shift = 0").select("subject", F.col("v").alias("observed"))
    out = each.where("shift > 0").join(observed, "subject").groupBy("subject").agg(F.first("observed").alias("observed"), ((1 + F.count_if(F.col("v") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"))
    return out


# complexity


def hjorth(df: DataFrame, c: str) -> DataFrame:
    d = df.select("subject", "i", F.col(c).alias("x"), (F.col(c) - F.lag(c).over(over())).alias("d1"))
    d = d.withColumn("d2", F.col("d1") - F.lag("d1").over(over()))
    v = d.groupBy("subject").agg(F.var_pop("x").alias("a"), F.var_pop("d1").alias("b"), F.var_pop("d2").alias("c"))
    mobility = F.when(F.col("a") > 0, F.sqrt(F.col("b") / F.col("a"))).otherwise(0.0)
    return v.select("subject", F.col("a").alias("activity"), mobility.alias("mobility"), F.when((F.col("b") > 0) & (F.col("a") > 0), F.sqrt(F.col("c") / F.col("b")) / mobility).otherwise(0.0).alias("complexity"))


def turns(df: DataFrame, c: str) -> DataFrame:
    """n, sign changes of the difference, Petrosian dimension, samples a turn."""
    d = df.select("subject", "i", (F.lead(c).over(over()) - F.col(c)).alias("d"))
    d = d.withColumn("e", F.lead("d").over(over()))
    out = d.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") * F.col("e") < 0).alias("changes"))
    n = F.col("n")
    return out.select("subject", "n", "changes", (F.log10(n) / (F.log10(n) + F.log10(n / (n + 0.4 * F.col("changes"))))).alias("petrosian"), F.when(F.col("changes") > 0, n / F.col("changes")).otherwise(n.cast("double")).alias("samples_per_turn"))


def katz(df: DataFrame, c: str) -> DataFrame:
    z = scaled(df, c, "zscore").select("subject", "i", F.col("scaled").alias("z"))
    z = z.withColumn("step", F.abs(F.col("z") - F.lag("z").over(over()))).withColumn("far", F.abs(F.col("z") - F.first("z").over(over())))
    s = z.groupBy("subject").agg(F.sum("step").alias("length"), F.max("far").alias("d"), F.count("step").alias("n"))
    return s.where("length > 0 and d > 0").select("subject", (F.log10("n") / (F.log10("n") + F.log10(F.col("d") / F.col("length")))).alias("katz"))


def permutation_entropy(df: DataFrame, c: str) -> DataFrame:
    """Order 3, delay 1; ties keep their order."""
    x = df.select("subject", F.col(c).alias("a"), F.lead(c, 1).over(over()).alias("b"), F.lead(c, 2).over(over()).alias("d")).where("d is not null")
    code = F.concat((F.col("a") <= F.col("b")).cast("int").cast("string"), (F.col("b") <= F.col("d")).cast("int").cast("string"), (F.col("a") <= F.col("d")).cast("int").cast("string"))
    n = x.groupBy("subject", code.alias("code")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(everything()))
    return n.groupBy("subject").agg((F.sum(-F.col("p") * F.log("p")) / math.log(6)).alias("pe"))


def higuchi_lengths(df: DataFrame, c: str, k_max: int = 4) -> DataFrame:
    """Mean normalised curve length at each k."""
    n = df.withColumn("n", F.count(F.lit(1)).over(everything()))
    parts = None
    for k in range(1, k_max + 1):
        d = n.select("subject", "n", (F.col("i") % k).alias("m"), F.abs(F.lead(c, k).over(over()) - F.col(c)).alias("d")).where("d is not null")
        one = d.groupBy("subject", "m").agg((F.sum("d") * (F.first("n") - 1) / F.count("d") / k / k).alias("len")).groupBy("subject").agg(F.avg("len").alias("length")).select("subject", F.lit(k).alias("k"), "length")
        parts = one if parts is None else parts.union(one)
    return parts


def dfa_fluctuations(df: DataFrame, c: str, scales=(4, 8, 16)) -> DataFrame:
    """Root mean square residual of straight lines in segments of the profile, at each scale."""
    w = over().rowsBetween(Window.unboundedPreceding, 0)
    x = df.select("subject", "i", (F.col(c) - F.avg(c).over(everything())).alias("v"), F.count(F.lit(1)).over(everything()).alias("n"))
    y = x.withColumn("y", F.sum("v").over(w)).withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).withColumn("segment", F.expr("i div scale")).where("(segment + 1) * scale <= n")
    each = y.groupBy("subject", "scale", "segment").agg(F.var_pop("y").alias("vy"), F.var_pop("i").alias("vi"), F.covar_pop("i", "y").alias("c"))
    return each.groupBy("subject", "scale").agg(F.sqrt(F.avg(F.greatest(F.col("vy") - F.col("c") * F.col("c") / F.col("vi"), F.lit(0.0)))).alias("fluctuation"))


def sample_entropy(df: DataFrame, c: str, r: float = 0.2) -> DataFrame:
    """m = 2: matches of 2 and 3 samples within r standard deviations (self matches left out)."""
    e = embed(df, c, 3, 1).join(df.groupBy("subject").agg(F.round(r * F.stddev_pop(c), 9).alias("tol")), "subject")
    o = e.select("subject", F.col("i").alias("j"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(3)])
    d = [F.round(F.abs(F.col(f"x{k}") - F.col(f"y{k}")), 9) <= F.col("tol") for k in range(3)]
    n = e.join(o, "subject").where("i <> j").groupBy("subject").agg(F.count_if(d[0] & d[1]).alias("b"), F.count_if(d[0] & d[1] & d[2]).alias("a"))
    return n.select("subject", "a", "b", F.when((F.col("a") > 0) & (F.col("b") > 0), -F.log(F.col("a") / F.col("b"))).alias("sampen"))


def kernel_measures(df: DataFrame, c: str) -> DataFrame:
    """Measures that are sequential or spectral, by a grouped kernel."""

    run = lambda x: [(kernels.lempel_ziv(x[:, 0]), kernels.spectral_entropy(x[:, 0]), kernels.svd_entropy(x[:, 0]))]
    return per_unit(df, ("subject",), [c], run, "lz double, spectral double, svd double")


def svd_entropy(df: DataFrame, c: str, m: int = 5, tau: int = 1) -> DataFrame:
    """subject, svd: entropy of the singular values of the delay embedding, over log m. The Gram matrix is an aggregate;
    only its m x m numbers a subject meet a kernel."""
    import pandas as pd

    e = embed(df, c, m, tau)
    cells = [F.sum(F.col(f"x{a}") * F.col(f"x{b}")) for a in range(m) for b in range(m)]
    gram = e.groupBy("subject").agg(F.array(*cells).alias("g"), F.count(F.lit(1)).alias("n"))

    def entropy(g: pd.Series) -> pd.Series:
        import numpy as np

        values = np.linalg.eigvalsh(np.stack(g.to_list()).reshape(-1, m, m))
        s = np.sqrt(np.maximum(values, 0))
        p = s / np.maximum(s.sum(1, keepdims=True), 1e-300)
        return pd.Series(-(p * np.log(np.where(p > 0, p, 1))).sum(1) / np.log(m))

    entropy.__annotations__ = {"g": pd.Series, "return": pd.Series}
    return gram.where(F.col("n") >= m).select("subject", F.pandas_udf(entropy, "double")("g").alias("svd"))


# groups


def rank_auc(df: DataFrame, value: str, group: str, by: str) -> DataFrame:
    """For each `by`: sizes, means, Cohen's d and rank AUC of group 1 against group 0."""
    d = df.where(F.col(value).isNotNull()).withColumn("r", average_rank(value, by))
    g = lambda k, x: F.when(F.col(group) == k, F.col(x))
    s = d.groupBy(by).agg(F.count(g(0, value)).alias("n_a"), F.count(g(1, value)).alias("n_b"), F.avg(g(0, value)).alias("mean_a"), F.avg(g(1, value)).alias("mean_b"), F.var_samp(g(0, value)).alias("va"), F.var_samp(g(1, value)).alias("vb"), F.sum(g(1, "r")).alias("rb"))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("va") + (F.col("n_b") - 1) * F.col("vb")) / (F.col("n_a") + F.col("n_b") - 2))
    u = F.col("rb") - F.col("n_b") * (F.col("n_b") + 1) / 2
    return s.where("n_a >= 2 and n_b >= 2").select(by, "n_a", "n_b", "mean_a", "mean_b", ((F.col("mean_b") - F.col("mean_a")) / pooled).alias("cohens_d"), (u / (F.col("n_a") * F.col("n_b"))).alias("auc"))
