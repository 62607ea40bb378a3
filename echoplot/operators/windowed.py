"""Windows of records and the recurrence structures in them, one unit a subject and window."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..records import ParameterError
from . import coupling as C
from . import dynamics as D
from . import meta as M
from . import recurrence as R
from . import series as S

UNITS = ("samples", "seconds")
KEYS = ("subject", "window")
SCOPES = ("per_window", "global")


@dataclass(frozen=True)
class WindowSpec:
    """size with step or overlap, or a number of windows with overlap; in samples or seconds. drop_last=False pulls a
    last window back to the record's end."""

    size: float | None = None
    step: float | None = None
    overlap: float | None = None
    n_windows: int | None = None
    unit: str = "samples"
    drop_last: bool = True

    def __post_init__(self):
        if (self.size is None) == (self.n_windows is None):
            raise ParameterError("give size or n_windows")
        if self.unit not in UNITS:
            raise ParameterError(f"unit must be one of {UNITS}")
        if self.overlap is not None and not 0 <= self.overlap < 1:
            raise ParameterError("overlap lies within 0 and 1")
        if self.step is not None and self.overlap is not None:
            raise ParameterError("give step or overlap")

    def with_(self, **changes) -> WindowSpec:
        return replace(self, **changes)

    def samples(self, fs: float = 1.0) -> tuple[int, int]:
        """Size and step in samples, halves to even."""
        scale = fs if self.unit == "seconds" else 1.0
        size = int(round(self.size * scale))
        step = int(round(self.step * scale)) if self.step is not None else int(round(size * (1 - (self.overlap or 0.0))))
        if size < 2 or step < 1:
            raise ParameterError(f"windows of {size} samples every {step}")
        return size, step

    def grid(self, sizes: DataFrame, fs: float = 1.0, t0: float = 0.0) -> DataFrame:
        """subject, window, start, stop, label, t_start, t_stop, t_center of each unit. sizes: subject, n."""
        if self.n_windows is not None:
            out = S.windows_by_count(sizes, self.n_windows, 0.5 if self.overlap is None else self.overlap)
        else:
            size, step = self.samples(fs)
            out = S.windows_by_size(sizes, size, step)
            if not self.drop_last:
                last = sizes.where((F.col("n") >= size) & ((F.col("n") - size) % step != 0))
                out = out.union(last.select("subject", F.expr(f"int((n - {size}) div {step} + 1)"), (F.col("n") - size), F.col("n")))
        at = lambda c: F.lit(t0) + c / F.lit(fs)
        return out.select("subject", "window", "start", "stop", F.concat(F.lit("w"), F.lpad(F.col("window").cast("string"), 3, "0")).alias("label"), at(F.col("start")).alias("t_start"), at(F.col("stop")).alias("t_stop"), at((F.col("start") + F.col("stop")) / 2).alias("t_center"))

    def describe(self, sizes: DataFrame, fs: float = 1.0) -> DataFrame:
        """The grid plus n_samples, the step from the window before and the samples shared with it."""
        w = Window.partitionBy("subject").orderBy("window")
        return self.grid(sizes, fs).withColumns({"n_samples": F.col("stop") - F.col("start"), "step_samples": F.col("start") - F.lag("start").over(w), "overlap_samples": F.greatest(F.lag("stop").over(w) - F.col("start"), F.lit(0))})


def resolve_windows(spec, sizes: DataFrame, fs: float = 1.0, t0: float = 0.0) -> DataFrame:
    """The grid of a WindowSpec, a size in samples, or explicit (start, stop) pairs that lie within a record."""
    if isinstance(spec, WindowSpec):
        return spec.grid(sizes, fs, t0)
    if isinstance(spec, int):
        return WindowSpec(size=spec, overlap=0.0).grid(sizes, fs, t0)
    pairs = sizes.sparkSession.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(spec)], "window int, start long, stop long")
    out = sizes.crossJoin(F.broadcast(pairs)).where("start >= 0 and stop <= n and start < stop")  # a fixed list of windows
    at = lambda c: F.lit(t0) + c / F.lit(fs)
    return out.select("subject", "window", "start", "stop", F.concat(F.lit("w"), F.lpad(F.col("window").cast("string"), 3, "0")).alias("label"), at(F.col("start")).alias("t_start"), at(F.col("stop")).alias("t_stop"), at((F.col("start") + F.col("stop")) / 2).alias("t_center"))


def in_windows(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Points with their windows; i counts from the window's start. A subject's grid is one array beside its points."""
    own = grid.groupBy("subject").agg(F.collect_list(F.struct("window", "start", "stop")).alias("__w"))
    got = df.join(own, "subject").withColumn("__x", F.explode(F.filter("__w", lambda w: (w["start"] <= F.col("i")) & (F.col("i") < w["stop"]))))
    return got.withColumns({"window": F.col("__x.window"), "i": F.col("i") - F.col("__x.start")}).drop("__w", "__x")


def _unit(df: DataFrame) -> DataFrame:
    return df.withColumn("subject", F.struct("subject", "window")).drop("window")


def _apart(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "subject"]
    return df.select(F.col("subject.subject").alias("subject"), F.col("subject.window").alias("window"), *rest)


def windowed_cross_recurrence(points: DataFrame, other: DataFrame, coords: list[str], grid: DataFrame, target_rr: float = 0.05, metric: str = "euclidean") -> DataFrame:
    """subject, window, eps, n_pairs, n_recurrent, rr of the cross structure of two trajectories in each window. other:
    the second trajectory's points under the subjects of the first."""
    a, b = _unit(in_windows(points.select("subject", "i", *coords), grid)), _unit(in_windows(other.select("subject", "i", *coords), grid))
    pair = R.pairs(a, coords, metric=metric, other=b)
    return _apart(R.rate(pair, R.threshold(pair, "target_rr", target_rr)))


def windowed_joint_recurrence(points: DataFrame, blocks: dict[str, list[str]], grid: DataFrame, target_rr: float = 0.05, theiler: int = 1) -> DataFrame:
    """subject, window, rr_joint, rr_<block>..., independence_ratio of the joint structure in each window."""
    w = _unit(in_windows(points.select("subject", "i", *[c for cs in blocks.values() for c in cs]), grid))
    pair = R.block_pairs(w, blocks, theiler)
    names = list(blocks)
    eps = pair.groupBy("subject").agg(*[F.round(F.percentile(x, F.lit(target_rr)), R.DIGITS).alias(f"__{x}") for x in names])
    hit = [F.col(x) <= F.col(f"__{x}") for x in names]
    every = hit[0]
    for h in hit[1:]:
        every = every & h
    n = pair.join(eps, "subject").groupBy("subject").agg(F.avg(every.cast("double")).alias("rr_joint"), *[F.avg(h.cast("double")).alias(f"rr_{x}") for x, h in zip(names, hit, strict=True)])
    product = F.lit(1.0)
    for x in names:
        product = product * F.col(f"rr_{x}")
    return _apart(n.withColumn("independence_ratio", F.when(product > 0, F.col("rr_joint") / product)))


@dataclass(frozen=True)
class WindowedRecurrence:
    """The structures of all windows of all subjects: one table of points by subject and window, measured lazily."""

    points: DataFrame
    coords: tuple[str, ...]
    grid: DataFrame
    target_rr: float = 0.05
    theiler: int = 1
    scope: str = "per_window"
    fs: float = 1.0

    def __post_init__(self):
        if self.scope not in SCOPES:
            raise ParameterError(f"scope must be one of {SCOPES}")

    def windows(self) -> DataFrame:
        return in_windows(self.points, self.grid)

    def window_frame(self) -> DataFrame:
        return self.grid

    def pairs(self) -> DataFrame:
        return R.pairs(_unit(self.windows().select("subject", "window", "i", *self.coords)), list(self.coords), self.theiler)

    def thresholds(self) -> DataFrame:
        """subject, window, eps: of each window's own pairs, or of the whole record's."""
        if self.scope == "per_window":
            return _apart(R.threshold(self.pairs(), "target_rr", self.target_rr))
        whole = R.threshold(R.pairs(self.points, list(self.coords), self.theiler), "target_rr", self.target_rr)
        return self.grid.select("subject", "window").join(whole, "subject")

    def matrices(self) -> DataFrame:
        """subject, window, i, j of all recurrent pairs."""
        return _apart(self.pairs()).join(self.thresholds(), list(KEYS)).where("d <= eps").select(*KEYS, "i", "j")

    def matrix(self, window: int) -> DataFrame:
        """subject, i, j of one window; only its points are paired."""
        one = replace(self, grid=self.grid.where(F.col("window") == window))
        return one.matrices().select("subject", "i", "j")

    def metrics(self, rqa: bool = False, classical: tuple[str, str] | None = None, dynamics: tuple[str, ...] = (), l_min: int = 2, v_min: int = 2, w_min: int = 2) -> DataFrame:
        """One row for each subject and window: place, epsilon, recurrence_rate; with `rqa` the line measures, with
        `classical` (phase, amplitude) the coupling indices, with `dynamics` the complexity measures of the first coordinate."""
        pair = _apart(self.pairs())
        out = self.grid.join(R.rate(pair, self.thresholds(), KEYS).select(*KEYS, F.col("eps").alias("epsilon"), F.col("rr").alias("recurrence_rate")), list(KEYS))
        if rqa:
            hist = R.line_histogram(self.matrices(), R.unit_sizes(self.windows(), KEYS), self.theiler, KEYS)
            totals = R.rate(pair, self.thresholds(), KEYS).select(*KEYS, "n_pairs", "n_recurrent")
            out = out.join(R.quantify(hist, totals, l_min, v_min, w_min, KEYS).drop("RR"), list(KEYS), "left")
        if classical:
            out = out.join(_apart(C.coupling_indices(_unit(self.windows().select(*KEYS, "i", *classical)), *classical, n_bins=6)), list(KEYS), "left")
        if dynamics:
            first = _unit(self.windows().select(*KEYS, "i", F.col(self.coords[0]).alias("value")))
            out = out.join(_apart(D.dynamics_measures(first, ["value"], dynamics).drop("channel")), list(KEYS), "left")
        return out

    def series(self, column: str = "recurrence_rate", **options) -> DataFrame:
        """subject, window, t_center and one measure."""
        return self.metrics(**options).select("subject", "window", "t_center", column)

    def describe(self, columns: tuple[str, ...] = ("epsilon", "recurrence_rate"), **options) -> DataFrame:
        """subject, n_windows, and mean, std, min, max of measures over windows; epsilon_cv tells how far thresholds differ."""
        m = self.metrics(**options)
        out = m.groupBy("subject").agg(F.count(F.lit(1)).alias("n_windows"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
        return out.withColumn("epsilon_cv", F.when(F.col("epsilon_mean") > 0, F.col("epsilon_std") / F.col("epsilon_mean"))) if "epsilon" in columns else out

    def line_length_sweep(self, floors=(2, 3, 4, 6, 8)) -> DataFrame:
        """DET and LAM of each window at several line floors, from one histogram."""
        hist = R.line_histogram(self.matrices(), R.unit_sizes(self.windows(), KEYS), self.theiler, KEYS)
        return R.sweep(hist, R.rate(_apart(self.pairs()), self.thresholds(), KEYS), floors, KEYS)

    def metrics_by_window(self, value: str = "recurrence_rate", **options) -> DataFrame:
        """One row a subject, one column a window."""
        m = self.metrics(**options)
        numbers = sorted(r.window for r in self.grid.select("window").distinct().collect())  # columns of the result
        wide = m.groupBy("subject").pivot("window", numbers).agg(F.avg(value))
        return wide.select("subject", *[F.col(str(w)).alias(f"w{w}") for w in numbers])

    def meta_recurrence(self, metrics: list[str], size: int, step: int, target_rr: float = 0.05, **options) -> DataFrame:
        return M.meta_recurrence(self.metrics(rqa=True, **options), metrics, size, step, target_rr)


def windowed_recurrence(points: DataFrame, coords: list[str], spec, target_rr: float = 0.05, theiler: int = 1, scope: str = "per_window", fs: float = 1.0, t0: float = 0.0) -> WindowedRecurrence:
    """Structures of the windows of all subjects; a batch of subjects is the same table."""
    return WindowedRecurrence(points, tuple(coords), resolve_windows(spec, R.unit_sizes(points), fs, t0), target_rr, theiler, scope, fs)


# names that describe a row and are no measures (fixed values)
BOOKKEEPING = ("subject", "window", "start", "stop", "label", "t_start", "t_stop", "t_center", "n_samples", "i", "group")
BOOKKEEPING_ENDS = ("_ok", "_n", "_unit")


def is_bookkeeping(name: str) -> bool:
    return name in BOOKKEEPING or name.endswith(BOOKKEEPING_ENDS) or name.startswith("target_")
