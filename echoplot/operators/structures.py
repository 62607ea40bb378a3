"""Whole structures: cross and joint ones with all their measures, reports of thresholds, samples of pairs, and the choice of a path."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import get_config
from ..records import BudgetError, ParameterError
from . import recurrence as R


@dataclass(frozen=True)
class ThresholdSpec:
    """How a threshold is to be found; a structure takes its metric and band from it unless told otherwise."""

    mode: str = "target_rr"
    value: float | None = None
    target_rr: float = 0.05
    percentile: float | None = None
    factor: float = 0.1
    k: int = 20
    metric: str = "euclidean"
    theiler: int = 1

    def __post_init__(self):
        if self.mode not in R.MODES or self.metric not in R.METRICS:
            raise ParameterError(f"unknown mode {self.mode!r} or metric {self.metric!r}")
        if self.mode == "fixed" and self.value is None or self.mode == "percentile" and self.percentile is None:
            raise ParameterError(f"{self.mode} needs its number")
        if not 0 < self.target_rr < 1:
            raise ParameterError("target_rr lies within 0 and 1")

    def of(self, pair: DataFrame, points: DataFrame | None = None, coords: list[str] | None = None) -> DataFrame:
        return R.threshold(pair, self.mode, self.target_rr, self.value, self.percentile, self.factor, self.k, points, coords)


def resolve_threshold(threshold) -> ThresholdSpec:
    """A spec of itself, a number, the name of a mode, or nothing."""
    if isinstance(threshold, ThresholdSpec):
        return threshold
    if threshold is None:
        return ThresholdSpec()
    if isinstance(threshold, str):
        return ThresholdSpec(threshold)
    return ThresholdSpec("fixed", float(threshold))


def reconcile(spec: ThresholdSpec, metric: str | None = None, theiler: int | None = None) -> tuple[str, int]:
    """Metric and band of a structure: its threshold's; another metric than the threshold's is an error."""
    if metric is not None and metric != spec.metric:
        raise ParameterError(f"the threshold was found in {spec.metric}, not {metric}")
    return spec.metric, spec.theiler if theiler is None else theiler


def structure(points: DataFrame, coords: list[str], threshold=None, metric: str | None = None, theiler: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, thresholds, recurrent pairs) of each subject's points."""
    spec = resolve_threshold(threshold)
    metric, theiler = reconcile(spec, metric, theiler)
    pair = R.pairs(points, coords, theiler, metric)
    eps = spec.of(pair, points, coords)
    return pair, eps, R.recurrent(pair, eps)


def threshold_report(pair: DataFrame, eps: DataFrame, points: DataFrame, coords: list[str]) -> DataFrame:
    """subject, eps, achieved_rr, extent (of the cloud of points), at_rounding: a threshold so small that rounding decides."""
    extent = points.groupBy("subject").agg(F.sqrt(sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in coords), F.lit(0.0))).alias("extent"))
    return R.rate(pair, eps).join(extent, "subject").select("subject", "eps", F.col("rr").alias("achieved_rr"), "extent", (F.col("eps") <= 1e-9 * F.col("extent")).alias("at_rounding"))


def describe(pair: DataFrame, eps: DataFrame, sizes: DataFrame, dim: int, theiler: int = 1, kind: str = "rp") -> DataFrame:
    """One row a subject: kind, n_points, dim, theiler, eps, recurrence_rate."""
    return R.rate(pair, eps).join(sizes, "subject").select("subject", F.lit(kind).alias("kind"), F.col("n").alias("n_points"), F.lit(dim).alias("dim"), F.lit(theiler).alias("theiler"), "eps", F.col("rr").alias("recurrence_rate"))


def dense(rec: DataFrame, sizes: DataFrame, most_gb: float | None = None) -> DataFrame:
    """subject, i, row: every row of each matrix as an array of 0 and 1; an error where the matrices pass the budget."""
    most = get_config().memory_budget_gb if most_gb is None else most_gb
    cells = sizes.agg(F.max(F.col("n") * F.col("n"))).first()[0] or 0
    if cells > most * 2**30:
        raise BudgetError(f"a matrix of {cells / 2**30:.1f} GB passes the budget of {most} GB; keep pairs, or use the spread path")
    rows = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    hits = rec.groupBy("subject", "i").agg(F.collect_set("j").alias("__j"))
    one = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: F.array_contains(F.coalesce("__j", F.array().cast("array<bigint>")), j).cast("int"))
    return rows.join(hits, ["subject", "i"], "left").select("subject", "i", one.alias("row"))


def joint(points: DataFrame, blocks: dict[str, list[str]], target_rr: float = 0.05, theiler: int = 1) -> DataFrame:
    """subject, i, j of cells recurrent in every block, each at its own threshold, from one join of the points."""
    pair = R.block_pairs(points, blocks, theiler)
    eps = pair.groupBy("subject").agg(*[F.round(F.percentile(b, F.lit(target_rr)), R.DIGITS).alias(f"__{b}") for b in blocks])
    every = F.lit(True)
    for b in blocks:
        every = every & (F.col(b) <= F.col(f"__{b}"))
    return pair.join(eps, "subject").where(every).select("subject", "i", "j")


def cross_rqa(points: DataFrame, other: DataFrame, coords: list[str], target_rr: float = 0.05, metric: str = "euclidean", l_min: int = 2, v_min: int = 2, w_min: int = 2, max_offset: int | None = None, fs: float = 1.0) -> DataFrame:
    """The line measures of the cross structure of two trajectories, and where its diagonals match best: peak_offset,
    peak_lag_s, peak_density, asymmetry (density ahead less behind, over both). Offsets of ten cells or fewer do not count."""
    pair = R.pairs(points, coords, metric=metric, other=other)
    eps = R.threshold(pair, "target_rr", target_rr)
    rec = R.recurrent(pair, eps)
    sizes = R.unit_sizes(points).join(R.unit_sizes(other).withColumnRenamed("n", "m"), "subject")
    measures = R.quantify(R.line_histogram(rec, sizes, 0), R.rate(pair, eps).select("subject", "n_pairs", "n_recurrent"), l_min, v_min, w_min)
    if max_offset is None:
        max_offset = int(sizes.agg(F.max(F.greatest("n", "m"))).first()[0] or 1) - 1
    d = R.diagonal_profile(rec, sizes, max_offset).where("cells > 10").withColumn("density", F.round("density", R.DIGITS))
    side = lambda sign: F.coalesce(F.sum(F.when(F.col("k") * sign > 0, F.col("density"))), F.lit(0.0))
    best = F.max(F.struct("density", (-F.col("k")).alias("k")))
    peak = d.groupBy("subject").agg(best.alias("b"), side(1).alias("p"), side(-1).alias("n"))
    peak = peak.select("subject", (-F.col("b.k")).alias("peak_offset"), (-F.col("b.k") / F.lit(fs)).alias("peak_lag_s"), F.col("b.density").alias("peak_density"), F.when(F.col("p") + F.col("n") > 0, (F.col("p") - F.col("n")) / (F.col("p") + F.col("n"))).otherwise(0.0).alias("asymmetry"))
    return measures.join(peak, "subject", "left")


# samples


def _unit_interval(*keys):
    return (F.pmod(F.xxhash64(*keys), F.lit(2**52)).cast("double") + 0.5) / 2**52


def sample_pair_distances(points: DataFrame, coords: list[str], n_samples: int = 200_000, theiler: int = 0, metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """subject, sample, i, j, d of n_samples ordered pairs of each subject, drawn evenly and with repeats outside the band;
    seed, subject and number decide. Subjects without such a pair have no rows."""
    n = R.unit_sizes(points).where(F.col("n") > max(theiler, 1))
    draws = n.withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(max(0, (n_samples - 1) // 4096))))).withColumn("sample", F.explode(F.expr(f"sequence(__run * 4096, least(__run * 4096 + 4096, {n_samples}) - 1)")))
    u, v, side = (_unit_interval(F.lit(seed), F.lit(k), "subject", "sample") for k in range(3))
    # offsets k from the band on have n - k cells: the place of an even draw among them, by the root of their sum
    low = max(theiler, 1)
    m = F.col("n") - low  # of the first offset
    cells = m * (m + 1) / 2
    down = F.floor((F.sqrt(8 * F.floor(u * cells) + 1) - 1) / 2)  # cells of later offsets, counted from the corner
    a = F.least(F.floor(v * (down + 1)), down)
    b = a + F.col("n") - 1 - down
    if theiler == 0:  # the identity has its share, too
        own = side * F.col("n") < 1
        a, b = F.when(own, F.floor(v * F.col("n"))).otherwise(a), F.when(own, F.floor(v * F.col("n"))).otherwise(b)
    flip = _unit_interval(F.lit(seed), F.lit(3), "subject", "sample") < 0.5
    drawn = draws.select("subject", F.col("sample").cast("long").alias("sample"), F.when(flip, a).otherwise(b).cast("long").alias("i"), F.when(flip, b).otherwise(a).cast("long").alias("j"))
    return _distances(drawn, points, points, coords, metric)


def sample_cross_distances(points: DataFrame, other: DataFrame, coords: list[str], n_samples: int = 200_000, metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """subject, sample, i, j, d of n_samples pairs across two trajectories, drawn evenly and with repeats."""
    n = R.unit_sizes(points).join(R.unit_sizes(other).withColumnRenamed("n", "m"), "subject")
    draws = n.withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(max(0, (n_samples - 1) // 4096))))).withColumn("sample", F.explode(F.expr(f"sequence(__run * 4096, least(__run * 4096 + 4096, {n_samples}) - 1)")))
    at = lambda k, c: F.floor(_unit_interval(F.lit(seed), F.lit(k), "subject", "sample") * F.col(c)).cast("long")
    return _distances(draws.select("subject", F.col("sample").cast("long").alias("sample"), at(0, "n").alias("i"), at(1, "m").alias("j")), points, other, coords, metric)


def _distances(drawn: DataFrame, points: DataFrame, other: DataFrame, coords: list[str], metric: str) -> DataFrame:
    right = other.select("subject", F.col("i").alias("j"), *[F.col(c).alias(f"{c}_2") for c in coords])
    d = R.distance([F.col(c) for c in coords], [F.col(f"{c}_2") for c in coords], metric)
    return drawn.join(points.select("subject", "i", *coords), ["subject", "i"]).join(right, ["subject", "j"]).select("subject", "sample", "i", "j", F.round(d, R.DIGITS).alias("d"))


def subsample_points(points: DataFrame, max_points: int, seed: int = 0) -> DataFrame:
    """At most max_points points of each subject, those whose hashes are least; i stays."""
    r = F.row_number().over(Window.partitionBy("subject").orderBy(F.xxhash64(F.lit(seed), "subject", "i"), "i"))
    return points.withColumn("__r", r).where(F.col("__r") <= max_points).drop("__r")


# the choice of a path


@dataclass(frozen=True)
class Plan:
    """How a structure is to be computed: path, strips a unit, and what it holds (GB)."""

    path: str
    strips: int
    matrix_gb: float
    pairs_gb: float
    note: str


def plan(n_points: int, n_units: int = 1, dim: int = 1, estimated_rr: float = 0.05, n_tasks: int = 8, budget_gb: float | None = None, path: str = "auto") -> Plan:
    """The relational path for a few small units whose pairs are wanted as rows; the kernel path where units are small or
    many; the spread path where one unit is many cells. A relational plan over the budget is an error."""
    budget = get_config().memory_budget_gb if budget_gb is None else budget_gb
    cells = float(n_points) ** 2
    matrix, pairs = cells / 2**30, cells * n_units * estimated_rr * 24 / 2**30
    if path == "auto":
        path = "spread" if cells > 2e8 or cells > 2e7 and n_units < n_tasks else "kernel"
    if path not in ("kernel", "spread", "relational"):
        raise ParameterError(f"unknown path {path!r}")
    if path == "relational" and cells * n_units * 24 / 2**30 > budget * n_tasks:
        raise BudgetError(f"{cells * n_units:.3g} pairs pass the budget; use the kernel or spread path, windows, or fewer points")
    strips = 1 if path != "spread" else max(n_tasks, min(4096, math.ceil(cells / 5e7)))
    return Plan(path, strips, matrix, pairs, f"{n_units} units of {n_points} points in {dim} dimensions")


def tile_size(budget_gb: float | None = None, item: int = 1) -> int:
    """Side of a square of distances and flags that takes a quarter of the budget, 128 to 8192."""
    budget = get_config().memory_budget_gb if budget_gb is None else budget_gb
    return int(min(8192, max(128, math.sqrt(max(0.25 * budget * 2**30, 8 * 2**20) / (8 + item)))))


def theiler_cells(n: int, m: int, theiler: int) -> int:
    """Cells of an n x m matrix within the band around the identity."""
    return sum(min(n, m - k) - max(0, -k) for k in range(-theiler + 1, theiler) if min(n, m - k) > max(0, -k))
