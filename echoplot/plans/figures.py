"""What figures show, as tables: one function a figure, drawn by whatever draws."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import output_path
from ..operators import coupling as C
from ..operators import dynamics as D
from ..operators import recurrence as R
from ..operators import series as S
from ..sinks import images
from ..sinks.tables import export_frame
from ..sources.memory import quality_report


def expected_saturation(factor, rate):
    """Share of pixels that hold a recurrent cell, if cells fall at random; numbers or columns."""
    return 1 - (1 - rate) ** (factor * factor)


def choose_pooling(factor: int, rate: float) -> str:
    """mean where a picture of maxima would be mostly black, else max."""
    return "mean" if expected_saturation(factor, rate) > 0.35 else "max"


def pool_matrix(rec: DataFrame, sizes: DataFrame, max_size: int = 1200, method: str = "max") -> DataFrame:
    """subject, row, col, value of blocks of whole cells, so that no side has over max_size of them."""
    f = F.ceil(F.col("n") / max_size)
    cells = rec.join(sizes, "subject").withColumn("__f", f)
    out = cells.groupBy("subject", "__f", "n", F.floor(F.col("i") / F.col("__f")).alias("row"), F.floor(F.col("j") / F.col("__f")).alias("col")).agg(F.count(F.lit(1)).alias("hits"))
    side = lambda c: F.least(F.col("__f"), F.col("n") - F.col(c) * F.col("__f"))
    value = F.lit(1.0) if method == "max" else F.col("hits") / (side("row") * side("col"))
    return out.select("subject", "row", "col", value.alias("value"))


def render_recurrence(rec: DataFrame, sizes: DataFrame, max_size: int = 1200, pooling: str = "auto") -> DataFrame:
    """The picture of each subject; `auto` takes the pooling that suits the whole batch's rate and size."""
    if pooling == "auto":
        n, cells = sizes.agg(F.max("n"), F.sum(F.col("n") * F.col("n"))).first()
        pooling = choose_pooling(max(1, math.ceil((n or 1) / max_size)), rec.count() / (cells or 1))
    return pool_matrix(rec, sizes, max_size, pooling)


def density_profile(rec: DataFrame, sizes: DataFrame, n_bins: int = 64, theiler: int = 1) -> DataFrame:
    """subject, band, first, stop, density: share of recurrent cells in bands of rows (edges of an even grid, cut to whole rows)."""
    edge = lambda k: F.floor(k * F.col("n") / F.least(F.lit(n_bins), F.col("n")))
    bands = sizes.withColumn("band", F.explode(F.sequence(F.lit(0), F.least(F.lit(n_bins), F.col("n")).cast("int") - 1))).select("subject", "n", "band", edge(F.col("band")).alias("first"), edge(F.col("band") + 1).alias("stop"))
    rows = rec.groupBy("subject", "i").agg(F.count(F.lit(1)).alias("hits"))
    # a row has n cells less those of the band around the identity
    at = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).join(rows, ["subject", "i"], "left")
    cells = F.col("n") - F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("i") + (theiler - 1)) - F.greatest(F.lit(0), F.col("i") - (theiler - 1)) + 1) if theiler > 0 else F.col("n")
    at = at.withColumn("cells", cells).withColumn("band", (F.ceil((F.col("i") + 1) * F.least(F.lit(n_bins), F.col("n")) / F.col("n")) - 1).cast("int"))
    sums = at.groupBy("subject", "band").agg(F.sum("hits").alias("hits"), F.sum("cells").alias("cells"))
    return bands.join(sums, ["subject", "band"]).select("subject", "band", "first", "stop", F.when(F.col("cells") > 0, F.coalesce("hits", F.lit(0)) / F.col("cells")).otherwise(0.0).alias("density"))


def histogram(df: DataFrame, c: str, n_bins: int = 64) -> DataFrame:
    """subject, bin, lo, hi, n of a column in even bins between its ends."""
    w = S.everything()
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col(c) - lo, hi - lo), F.lit(0.0)) * n_bins), F.lit(n_bins - 1)).cast("int")
    out = df.withColumns({"__lo": lo, "__s": (hi - lo) / n_bins, "bin": b}).groupBy("subject", "bin").agg(F.first("__lo").alias("__lo"), F.first("__s").alias("__s"), F.count(F.lit(1)).alias("n"))
    return out.select("subject", "bin", (F.col("__lo") + F.col("bin") * F.col("__s")).alias("lo"), (F.col("__lo") + (F.col("bin") + 1) * F.col("__s")).alias("hi"), "n")


def threshold_diagnostics(pair: DataFrame, eps: DataFrame, n_bins: int = 64) -> DataFrame:
    """Histogram of each subject's pair distances with its threshold and the rate it achieves."""
    rate = R.rate(pair, eps).select("subject", "eps", F.col("rr").alias("achieved_rr"))
    return histogram(pair, "d", n_bins).join(rate, "subject").withColumn("below", F.col("hi") <= F.col("eps"))


def joint_overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """subject, i, j, kind of cells recurrent in a, in b or in both."""
    one, two = a.withColumn("__a", F.lit(1)), b.withColumn("__b", F.lit(1))
    kind = F.when(F.col("__a").isNull(), "b").when(F.col("__b").isNull(), "a").otherwise("both")
    return one.join(two, ["subject", "i", "j"], "full").select("subject", "i", "j", kind.alias("kind"))


def line_distributions(hist: DataFrame, l_min: int = 2) -> DataFrame:
    """subject, kind, length, cnt, share of lines of each kind from l_min on."""
    kept = hist.where((F.col("length") >= l_min) & F.col("kind").isin("diagonal", "vertical", "white_vertical"))
    return kept.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("subject", "kind"))).select("subject", "kind", "length", "cnt", "share")


def profile_in_seconds(profile: DataFrame, fs: float = 1.0, min_cells: int = 10) -> DataFrame:
    return profile.where(F.col("cells") > min_cells).withColumn("lag_s", F.col("k") / F.lit(fs))


def recurrence_panel(rec: DataFrame, sizes: DataFrame, points: DataFrame, channels: list[str], measures: DataFrame, max_size: int = 1200) -> dict[str, DataFrame]:
    """The picture, the traces at its margins and the measures beside it."""
    return {"image": render_recurrence(rec, sizes, max_size), "traces": points.unpivot(["subject", "i"], channels, "channel", "value"), "measures": measures}


def rqa_summary(rec: DataFrame, sizes: DataFrame, hist: DataFrame, max_size: int = 1000) -> dict[str, DataFrame]:
    return {"image": render_recurrence(rec, sizes, max_size), "lines": line_distributions(hist)}


def window_coverage(grid: DataFrame, sizes: DataFrame) -> DataFrame:
    """Windows as shares of their record."""
    return grid.join(sizes, "subject").select("subject", "window", "start", "stop", (F.col("start") / F.col("n")).alias("from_share"), (F.col("stop") / F.col("n")).alias("to_share"))


def window_panel(metrics: DataFrame, columns: tuple[str, ...] = ("epsilon", "recurrence_rate")) -> DataFrame:
    """subject, window, t_center, measure, value of several measures over windows."""
    return metrics.unpivot(["subject", "window", "t_center"], list(columns), "measure", "value")


def scale_factor(df: DataFrame, coords: list[str]) -> DataFrame:
    """subject, scale: root mean square distance from the centre, by which trajectories are made alike."""
    return D.attractor_size(df, coords).withColumnRenamed("size", "scale")


def shared_limits(df: DataFrame, coords: list[str], quantiles: tuple[float, float] = (0.002, 0.998), normalise: bool = True) -> DataFrame:
    """coord, lo, hi that hold all subjects' trajectories: the widest of their quantiles, scaled and centred if asked."""
    q = df.groupBy("subject").agg(*[F.percentile(c, F.array(*[F.lit(x) for x in quantiles])).alias(f"q_{c}") for c in coords], *[F.avg(c).alias(f"m_{c}") for c in coords])
    if normalise:
        q = q.join(scale_factor(df, coords), "subject")
        at = lambda c, k: (F.col(f"q_{c}")[k] - F.col(f"m_{c}")) / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    else:
        at = lambda c, k: F.col(f"q_{c}")[k]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("coord"), at(c, 0).alias("lo"), at(c, 1).alias("hi")) for c in coords]))
    return q.select(rows.alias("x")).groupBy("x.coord").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))


def attractor(space, max_points: int = 6000, weighted: bool = True) -> DataFrame:
    """subject, t and the coordinates of a view, at most max_points of a subject by an even stride."""
    thin = space.subsample(max_points=max_points)
    df = thin.weighted_coords() if weighted else thin.df.select("subject", "i", *thin.coords)
    return df.withColumn("t", F.lit(thin.t0) + F.col("i") / F.lit(thin.fs))


def save_attractor(space, name: str, **options) -> str:
    return export_frame(attractor(space, **options), name)


def embedding_diagnostics(df: DataFrame, c: str, max_lag: int = 20, m_max: int = 4, tau: int = 1) -> dict[str, DataFrame]:
    """Curves behind the choice of delay and dimension."""
    fnn = None
    for m in range(1, m_max + 1):
        one = D.false_neighbours(df, c, m, tau)
        fnn = one if fnn is None else fnn.union(one)
    return {"acf": S.autocorrelation(df, c, max_lag), "ami": D.ami_curve(df, c, list(range(1, max_lag + 1)), 8), "fnn": fnn}


def quality(rec) -> dict[str, DataFrame]:
    return {"channels": rec.channel_frame(), "issues": quality_report(rec)}


def phase_amplitude(df: DataFrame, phase: str, amplitude: str, n_bins: int = 18) -> dict[str, DataFrame]:
    return {"bins": S.modulogram(df, phase, amplitude, n_bins), "indices": C.coupling_indices(df, phase, amplitude, n_bins=n_bins)}


def signal(rec, channels: list[str] | None = None, start: float = 0.0, seconds: float | None = None) -> DataFrame:
    """subject, t, channel, value of a stretch of a record."""
    names = channels or rec.channels
    df = rec.times().where(F.col("t") >= start)
    df = df if seconds is None else df.where(F.col("t") < start + seconds)
    return df.unpivot(["subject", "t"], names, "channel", "value")


def envelope_pair(df: DataFrame, a: str, b: str, max_points: int = 6000) -> DataFrame:
    """subject, i, both amplitudes, at most max_points of a subject by an even stride."""
    n = R.unit_sizes(df).select(F.col("subject").alias("__s"), F.ceil(F.col("n") / max_points).alias("__f"))
    return df.join(n, F.col("subject").eqNullSafe(F.col("__s"))).where(F.col("i") % F.col("__f") == 0).select("subject", "i", a, b)


def side_by_side(frames: dict[str, DataFrame]) -> DataFrame:
    """Tables of panels as one, each row with its panel's name: attractors, modulograms, pictures, series of several results."""
    out = None
    for name, df in frames.items():
        one = df.withColumn("panel", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def compare_attractors(spaces: dict, max_points: int = 4000) -> DataFrame:
    return side_by_side({n: attractor(s, max_points) for n, s in spaces.items()})


def compare_phase_amplitude(records: dict, phase: str, amplitude: str, n_bins: int = 18) -> DataFrame:
    return side_by_side({n: S.modulogram(r.df, phase, amplitude, n_bins) for n, r in records.items()})


def compare_scale_policies(space, policies: tuple[str, ...] = ("none", "rms_balanced")) -> DataFrame:
    """Shares of the variance that blocks have under each policy."""
    return side_by_side({p: space.rescale(p).weights() for p in policies})


def compare_recurrence(matrices: dict, sizes: DataFrame, max_size: int = 700, pooling: str = "max") -> DataFrame:
    return side_by_side({n: pool_matrix(m, sizes, max_size, pooling) for n, m in matrices.items()})


def compare_thresholds(pair: DataFrame, thresholds: dict[str, DataFrame]) -> DataFrame:
    """subject, panel (mode), eps and the rate that it achieves."""
    return side_by_side({n: R.rate(pair, e).select("subject", "eps", "rr") for n, e in thresholds.items()})


def compare_window_series(results: dict, column: str = "recurrence_rate") -> DataFrame:
    return side_by_side({n: w.series(column) for n, w in results.items()})


def save_figure(df: DataFrame, name: str, subdir: str | None = None) -> str:
    """A figure's table under the output folder."""
    return export_frame(df, name, subdir)


#: figures and what they show
FIGURES = {
    "recurrence": (render_recurrence, "a structure's picture"),
    "density_profile": (density_profile, "density of recurrence in bands of rows"),
    "threshold_diagnostics": (threshold_diagnostics, "a threshold in the distances"),
    "line_histogram": (line_distributions, "lengths of lines"),
    "diagonal_profile": (profile_in_seconds, "density by offset"),
    "recurrence_panel": (recurrence_panel, "picture, traces and measures"),
    "joint_recurrence": (joint_overlay, "parts of a joint structure"),
    "rqa_summary": (rqa_summary, "picture and lengths of lines"),
    "window_coverage": (window_coverage, "where windows lie"),
    "window_panel": (window_panel, "measures over windows"),
    "attractor": (attractor, "a trajectory"),
    "attractor_image": (images.attractor_image, "where a trajectory dwells"),
    "embedding_diagnostics": (embedding_diagnostics, "curves behind delay and dimension"),
    "quality": (quality, "channels and issues"),
    "phase_amplitude": (phase_amplitude, "amplitude by phase"),
    "signal": (signal, "series"),
    "envelope_pair": (envelope_pair, "two amplitudes"),
    "compare_attractors": (compare_attractors, "trajectories side by side"),
    "compare_phase_amplitude": (compare_phase_amplitude, "modulograms side by side"),
    "compare_scale_policies": (compare_scale_policies, "shares under policies"),
    "compare_recurrence": (compare_recurrence, "pictures side by side"),
    "compare_thresholds": (compare_thresholds, "thresholds and rates"),
    "compare_window_series": (compare_window_series, "series side by side"),
    "compare_series": (side_by_side, "any tables side by side"),
}


def list_figures() -> str:
    return "\n".join(f"{n}: {what}" for n, (_, what) in FIGURES.items())


def figure_path(name: str) -> str:
    return output_path(name, "figures")
