"""State spaces: blocks of coordinates with weights, and the ways to build them from records.

A space is a DataFrame (subject, i, coordinates) and the blocks that its columns fall into.
Weights belong to a subject's block; the weighted coordinates are the coordinates times the
root of the weight, so that plain Euclidean distance on them is the grouped distance.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.units import per_series
from ..records import CapabilityError, Caveat, ParameterError, Record, Step, check_length_for
from . import dynamics as D
from . import preprocess as P
from . import recurrence as R
from . import series as S

KINDS = ("phase_circle", "amplitude", "delay", "raw", "inst_freq", "derived")
ROUTES = ("observable", "delay", "hybrid", "external")


@dataclass(frozen=True)
class Block:
    """Columns that belong together."""

    label: str
    columns: tuple[str, ...]
    kind: str = "derived"
    source: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ParameterError(f"unknown kind {self.kind!r}")

    @property
    def dim(self) -> int:
        return len(self.columns)


def make_blocks(specs: list[tuple]) -> tuple[Block, ...]:
    """Blocks of (label, columns[, kind[, source]]); a column belongs to one block."""
    blocks = tuple(Block(s[0], tuple(s[1]), *s[2:]) for s in specs)
    names = [c for b in blocks for c in b.columns]
    if len(set(names)) < len(names) or len({b.label for b in blocks}) < len(blocks):
        raise ParameterError("blocks must differ in labels and columns")
    return blocks


@dataclass(frozen=True)
class StateSpace:
    df: DataFrame
    blocks: tuple[Block, ...]
    fs: float = 1.0
    t0: float = 0.0
    route: str = "observable"
    policy: dict | None = None
    steps: tuple = ()

    def __post_init__(self):
        if self.route not in ROUTES:
            raise ParameterError(f"route must be one of {ROUTES}")
        missing = [c for b in self.blocks for c in b.columns if c not in self.df.columns]
        if missing or not self.blocks:
            raise ParameterError(f"no such coordinates: {missing}")

    @property
    def coords(self) -> list[str]:
        return [c for b in self.blocks for c in b.columns]

    @property
    def labels(self) -> list[str]:
        return [b.label for b in self.blocks]

    @property
    def dim(self) -> int:
        return len(self.coords)

    def block(self, label: str) -> DataFrame:
        """subject, i and the columns of one block."""
        return self.df.select("subject", "i", *self._block(label).columns)

    def split(self, labels: list[str]) -> StateSpace:
        return replace(self, df=self.df.select("subject", "i", *[c for x in labels for c in self._block(x).columns]), blocks=tuple(self._block(x) for x in labels), policy=None)

    def _block(self, label: str) -> Block:
        for b in self.blocks:
            if b.label == label:
                return b
        raise ParameterError(f"no block {label!r}")

    def columns(self) -> dict[str, list[str]]:
        return {b.label: list(b.columns) for b in self.blocks}

    def weights(self) -> DataFrame:
        """subject, block, rms, weight, variance_share."""
        return P.fit_weights(self.df, self.columns(), **(self.policy or {"policy": "none"}))

    def rescale(self, policy: str = "rms_balanced", lambda_: float | None = None, weights: dict | None = None) -> StateSpace:
        p = {"policy": policy} | ({"lambda_": lambda_} if lambda_ is not None else {}) | ({"weights": weights} if weights else {})
        P.fit_weights(self.df, self.columns(), **p)  # says at once what does not fit
        return replace(self, policy=p, steps=(*self.steps, Step("rescale", p)))

    def reweight(self, lambda_: float) -> StateSpace:
        return self.rescale("weighted", lambda_)

    def weighted_coords(self) -> DataFrame:
        """subject, i and the coordinates times the root of their block's weight."""
        if self.policy is None or self.policy["policy"] == "none":
            return self.df.select("subject", "i", *self.coords)
        wide = self.weights().groupBy("subject").pivot("block", self.labels).agg(F.first("weight"))
        wide = wide.select(F.col("subject").alias("__s"), *[F.sqrt(F.col(f"`{b}`")).alias(f"__w{k}") for k, b in enumerate(self.labels)])
        # one row a subject on the right side
        out = self.df.join(wide, F.col("subject").eqNullSafe(F.col("__s")))
        return out.select("subject", "i", *[(F.col(c) * F.col(f"__w{k}")).alias(c) for k, b in enumerate(self.blocks) for c in b.columns])

    def scale_frame(self) -> DataFrame:
        return P.scale_report(self.df, self.columns(), **(self.policy or {"policy": "none"}))

    def window(self, start: int, stop: int) -> StateSpace:
        df = self.df.where((F.col("i") >= start) & (F.col("i") < stop)).withColumn("i", F.col("i") - start)
        return replace(self, df=df, t0=self.t0 + start / self.fs, steps=(*self.steps, Step("window", {"start": start, "stop": stop})))

    def subsample(self, factor: int | None = None, indices: list[int] | None = None, max_points: int | None = None) -> StateSpace:
        """Every factor-th point; or at most `max_points` of each subject by the least stride; or those at `indices`."""
        if sum(x is not None for x in (factor, indices, max_points)) != 1:
            raise ParameterError("give one of factor, indices, max_points")
        if indices is not None:
            at = self.df.sparkSession.createDataFrame([(int(k), n) for n, k in enumerate(sorted(set(indices)))], "__i long, __n long")
            df = self.df.join(F.broadcast(at), F.col("i") == F.col("__i")).withColumn("i", F.col("__n")).select(*self.df.columns)
            return replace(self, df=df, steps=(*self.steps, Step("subsample", {"indices": len(set(indices))})))
        if max_points is not None:
            n = R.unit_sizes(self.df).select(F.col("subject").alias("__s"), F.ceil(F.col("n") / max_points).alias("__f"))
            df = self.df.join(n, F.col("subject").eqNullSafe(F.col("__s"))).where(F.col("i") % F.col("__f") == 0).withColumn("i", F.expr("i div __f")).select(*self.df.columns)
            return replace(self, df=df, steps=(*self.steps, Step("subsample", {"max_points": max_points})))
        df = self.df.where(F.col("i") % factor == 0).withColumn("i", F.expr(f"i div {factor}"))
        return replace(self, df=df, fs=self.fs / factor, steps=(*self.steps, Step("subsample", {"factor": factor})))

    def reduce(self, n_components: int = 3) -> StateSpace:
        """Principal components pc1, pc2... of the weighted coordinates of each subject; the largest loading of a
        component is positive."""
        k = min(n_components, self.dim)

        def run(x):
            y = x - x.mean(0)
            values, vectors = np.linalg.eigh(y.T @ y)
            v = vectors[:, np.argsort(values)[::-1][:k]]
            return y @ (v * np.sign(v[np.abs(v).argmax(0), np.arange(k)]))

        names = [f"pc{j + 1}" for j in range(k)]
        df = per_series(self.weighted_coords(), ("subject",), self.coords, run, names)
        return replace(self, df=df, blocks=make_blocks([("pca", names)]), policy=None, steps=(*self.steps, Step("reduce", {"n_components": k})))

    def times(self) -> DataFrame:
        return self.df.withColumn("t", F.lit(self.t0) + F.col("i") / F.lit(self.fs))

    def describe(self) -> DataFrame:
        n = R.unit_sizes(self.df)
        return n.select("subject", F.col("n").alias("n_points"), F.lit(self.dim).alias("dim"), F.lit(len(self.blocks)).alias("n_blocks"), F.lit(self.route).alias("route"), (F.col("n") / self.fs).alias("duration"))


def aligned(blocks: list[DataFrame]) -> DataFrame:
    """Blocks joined on their last points: what is shorter stands at the end of what is longer."""
    out = None
    for b in blocks:
        n = R.unit_sizes(b)
        back = b.join(n, "subject").withColumn("__k", F.col("n") - 1 - F.col("i")).drop("i", "n")
        out = back if out is None else out.join(back, ["subject", "__k"])
    n = out.groupBy("subject").agg(F.max("__k").alias("__m"))
    return out.join(n, "subject").withColumn("i", F.col("__m") - F.col("__k")).drop("__k", "__m")


def smooth(df: DataFrame, columns: list[str], cutoff: float, fs: float, method: str = "gaussian") -> DataFrame:
    """Zero-phase low-pass of columns; the gain at the cut-off is one half."""
    if method == "gaussian":
        run = lambda x: np.column_stack([kernels.gaussian_smooth(x[:, k], cutoff, fs) for k in range(x.shape[1])])
    elif method == "butterworth":
        # forward and backward: half power each way gives half the amplitude
        sections = kernels.butter_sections(4, fs, high=cutoff)
        run = lambda x: np.column_stack([kernels.zero_phase_recursive(x[:, k], sections) for k in range(x.shape[1])])
    else:
        raise ParameterError(f"unknown method {method!r}")
    return df.drop(*columns).join(per_series(df, ("subject",), columns, run, columns), ["subject", "i"])


def build(rec: Record, spec: list[dict], scaling: str | None = "rms_balanced", lambda_: float | None = None, weights: dict | None = None, route: str = "observable", name: str = "build") -> StateSpace:
    """A space from a list of blocks: {kind, source[, label, smooth, smooth_method, scale, m, tau]}.

    phase_circle gives cosine and sine; amplitude, raw and inst_freq the channel itself, smoothed and scaled if asked;
    delay an embedding, whose shorter rows are met at their ends by the others."""
    parts, blocks = [], []
    for k, b in enumerate(spec):
        kind, source = b.get("kind"), b.get("source")
        if kind not in ("phase_circle", "amplitude", "raw", "inst_freq", "phase_raw", "delay"):
            raise ParameterError(f"unknown kind {kind!r}")
        rec._known([source])
        df, label = rec.df.select("subject", "i", F.col(source).alias(f"__b{k}")), b.get("label", source)
        if b.get("smooth"):
            df = smooth(df, [f"__b{k}"], b["smooth"], rec.fs, b.get("smooth_method", "gaussian"))
        if b.get("scale"):
            df = S.scaled(df, f"__b{k}", b["scale"]).select("subject", "i", F.col("scaled").alias(f"__b{k}"))
        if kind == "phase_circle":
            columns = [f"cos_{label}", f"sin_{label}"]
            df = df.select("subject", "i", F.cos(f"__b{k}").alias(columns[0]), F.sin(f"__b{k}").alias(columns[1]))
        elif kind == "delay":
            m, tau = b.get("m", 3), b.get("tau", 1)
            columns = [f"{label}_{j}" for j in range(m)]
            df = S.embed(df, f"__b{k}", m, tau).toDF("subject", "i", *columns)
        else:
            columns = [label]
            df = df.select("subject", "i", F.col(f"__b{k}").alias(label))
        parts.append((kind, df, columns))
        blocks.append((label, columns, {"phase_raw": "raw"}.get(kind, kind), source))
    if any(kind == "delay" for kind, *_ in parts):
        df = aligned([p for _, p, _ in parts])
    else:  # one row of the record gives one row of the space
        df = parts[0][1]
        for _, p, _ in parts[1:]:
            df = df.join(p, ["subject", "i"])
    space = StateSpace(df.select("subject", "i", *[c for *_, cs in parts for c in cs]), make_blocks(blocks), rec.fs, rec.t0, route, None, (*rec.steps, Step(name, {"spec": spec, "scaling": scaling})))
    return space.rescale(scaling, lambda_, weights) if scaling and scaling != "none" else space


def band_edges(rec: Record, channel: str) -> tuple[float, float] | None:
    """The band of a channel, or of the one that it was derived from."""
    bands = rec.meta.get("bands", {})
    plain = next((channel[len(p) :] for p in ("phase_", "amp_", "ifreq_") if channel.startswith(p)), channel)
    return bands.get(channel) or bands.get(plain)


def band_center(rec: Record, channel: str) -> float | None:
    edges = band_edges(rec, channel)
    return sum(edges) / 2 if edges else None


def resolve(rec: Record, name: str | None, role: str) -> str:
    """The named channel, or the only one of a role."""
    if name is not None:
        rec._known([name])
        return name
    found = rec.by_role(role)
    if not found:
        raise CapabilityError(f"no channel has the role {role!r}")
    if len(found) > 1:
        raise ParameterError(f"several channels have the role {role!r}: {found}")
    return found[0]


def pick_by_frequency(rec: Record, role: str, which: str) -> str:
    """The slowest or fastest channel of a role by the centres of their bands."""
    found = rec.by_role(role)
    if len(found) == 1:
        return found[0]
    centres = {c: band_center(rec, c) for c in found}
    if not found or None in centres.values():
        raise ParameterError(f"bands of {found} are not known; name the channel")
    return (min if which == "slowest" else max)(sorted(centres), key=lambda c: centres[c])


def _circle(source: str) -> dict:
    return {"kind": "phase_circle", "source": source}


def phase_circle(rec: Record, phase: str | None = None, **kw) -> StateSpace:
    return build(rec, [_circle(resolve(rec, phase, "phase"))], name="phase_circle", **kw)


def pac_space(rec: Record, phase: str | None = None, amplitude: str | None = None, embed_amplitude: int | None = None, tau: int = 1, smooth: float | None = None, smooth_method: str = "gaussian", scale_amplitude: str | None = None, **kw) -> StateSpace:
    """The slow phase's circle and the fast amplitude, or its embedding."""
    phase = phase or pick_by_frequency(rec, "phase", "slowest")
    amplitude = amplitude or pick_by_frequency(rec, "amplitude", "fastest")
    slow, fast = band_edges(rec, phase), band_edges(rec, amplitude)
    if slow and fast and fast[1] - fast[0] < 2 * slow[1]:
        warnings.warn("the amplitude band is under twice the phase's upper edge: its envelope cannot follow the phase", Caveat, stacklevel=2)
    if smooth and slow and smooth < slow[1]:
        warnings.warn("smoothing takes the phase's rhythm off the amplitude", Caveat, stacklevel=2)
    amp = {"kind": "amplitude", "source": amplitude, "smooth": smooth, "smooth_method": smooth_method, "scale": scale_amplitude}
    if embed_amplitude:
        amp |= {"kind": "delay", "m": embed_amplitude, "tau": tau}
    return build(rec, [_circle(phase), amp], name="pac_space", route="hybrid" if embed_amplitude else "observable", **kw)


def ppc_space(rec: Record, phase1: str | None = None, phase2: str | None = None, **kw) -> StateSpace:
    """Two circles, the slower first."""
    first = phase1 or pick_by_frequency(rec, "phase", "slowest")
    second = phase2 or next(iter([c for c in rec.by_role("phase") if c != first]), None)
    if second is None or first == second:
        raise ParameterError("two phases are needed")
    return build(rec, [_circle(first), _circle(second)], name="ppc_space", **kw)


def envelope_space(rec: Record, amplitudes: list[str] | None = None, embed: int | None = None, tau: int = 1, **kw) -> StateSpace:
    names = amplitudes or rec.by_role("amplitude")
    kind = {"kind": "delay", "m": embed, "tau": tau} if embed else {"kind": "amplitude"}
    return build(rec, [kind | {"source": a} for a in names], name="envelope_space", route="hybrid" if embed else "observable", **kw)


def ppa_space(rec: Record, phase1: str, phase2: str, amplitude: str, **kw) -> StateSpace:
    return build(rec, [_circle(phase1), _circle(phase2), {"kind": "amplitude", "source": amplitude}], name="ppa_space", **kw)


def nested_space(rec: Record, hierarchy: list[str], **kw) -> StateSpace:
    """Channels from slow to fast: phases as circles, others as they are."""
    return build(rec, [_circle(c) if rec.roles.get(c) == "phase" else {"kind": "amplitude", "source": c} for c in hierarchy], name="nested_space", **kw)


def freq_amp_space(rec: Record, inst_freq: str | None = None, amplitude: str | None = None, **kw) -> StateSpace:
    return build(rec, [{"kind": "inst_freq", "source": resolve(rec, inst_freq, "inst_freq")}, {"kind": "amplitude", "source": resolve(rec, amplitude, "amplitude")}], name="freq_amp_space", **kw)


def channels(rec: Record, names: list[str] | None = None, scaling: str = "rms_balanced", **kw) -> StateSpace:
    return build(rec, [{"kind": "raw", "source": c} for c in names or rec.channels], scaling, name="channels", **kw)


def custom(rec: Record, fn: Callable[[np.ndarray], np.ndarray], columns: list[str], sources: list[str] | None = None, kind: str = "derived", scaling: str = "none", **kw) -> StateSpace:
    """A space by a function of a subject's samples (samples x sources -> points x columns)."""
    df = per_series(rec.df, ("subject",), sources or rec.channels, fn, columns)
    space = StateSpace(df, make_blocks([("custom", columns, kind)]), rec.fs, rec.t0, kw.get("route", "external"), None, (*rec.steps, Step("custom", {"columns": columns})))
    return space.rescale(scaling) if scaling != "none" else space


def takens(rec: Record, source: str | None = None, m: int | str = 3, tau: int | str = 1, scaling: str = "none") -> StateSpace:
    return takens_multivariate(rec, [source or resolve(rec, None, "raw")], m, tau, scaling)


def takens_multivariate(rec: Record, sources: list[str] | None = None, m: int | str = 3, tau: int | str = 1, scaling: str = "rms_balanced") -> StateSpace:
    """Embeddings of several channels side by side; `auto` takes the median of the subjects' estimates."""
    sources = sources or rec.by_role("raw")
    if "auto" in (m, tau):
        found = D.estimate_embedding_multi(rec.df, sources[0]).first()
        m, tau = (int(found.m) if m == "auto" else m), (int(found.tau) if tau == "auto" else tau)
    least = R.unit_sizes(rec.df).agg(F.min("n")).first()[0]
    check_length_for(least or 0, m, tau, "takens")
    df = rec.df.select("subject", "i", *sources)
    blocks = []
    for c in sources:
        names = [f"{c}_{j}" for j in range(m)]
        df = df.withColumns({x: F.lead(c, j * tau).over(S.over()) for j, x in enumerate(names)})
        blocks.append((c, names, "delay", c))
    df = df.withColumn("__last", F.lead("i", (m - 1) * tau).over(S.over())).where("__last is not null")
    space = StateSpace(df.select("subject", "i", *[c for b in blocks for c in b[1]]), make_blocks(blocks), rec.fs, rec.t0, "delay", None, (*rec.steps, Step("takens", {"m": m, "tau": tau, "sources": sources})))
    return space.rescale(scaling) if scaling != "none" else space


def from_bands(rec: Record, spec: dict[str, tuple], source: str | None = None, scaling: str = "rms_balanced", edge_policy: str = "trim", **design) -> StateSpace:
    """spec: channel -> (low, high, "phase" or "amplitude"): filters, analytic signals and the space in one call."""
    rec = P.filterbank(rec, {n: b[:2] for n, b in spec.items()}, source, **design)
    rec = P.analytic(rec, list(spec), edge_policy)
    return build(rec, [_circle(f"phase_{n}") if b[2] == "phase" else {"kind": "amplitude", "source": f"amp_{n}"} for n, b in spec.items()], scaling, name="from_bands", route="observable")
