"""Records: ordered multichannel series as DataFrames (subject, i, channels...).

NULL and NaN both mean missing; NaN becomes NULL at ingest. Sample numbers start at 0 in
each subject.
"""

from __future__ import annotations

import datetime
import enum
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.units import dealt

# the fixed vocabulary of channel roles
ROLES = ("raw", "band", "phase", "amplitude", "inst_freq", "state")


class Capability(enum.Flag):
    """What a record or what was made from it offers to later stages."""

    RAW = enum.auto()
    BANDS = enum.auto()
    PHASE = enum.auto()
    AMPLITUDE = enum.auto()
    INST_FREQ = enum.auto()
    STATESPACE = enum.auto()
    THRESHOLD = enum.auto()
    RECURRENCE = enum.auto()


OFFERS = {"raw": Capability.RAW, "band": Capability.BANDS, "phase": Capability.PHASE, "amplitude": Capability.AMPLITUDE, "inst_freq": Capability.INST_FREQ, "state": Capability.STATESPACE}


def capabilities_from_roles(roles) -> Capability:
    out = Capability(0)
    for r in roles:
        out |= OFFERS[r]
    return out


class EngineError(Exception):
    """Root of this library's errors."""


class ParameterError(EngineError, ValueError):
    pass


class CapabilityError(EngineError):
    pass


class QualityError(EngineError):
    pass


class BudgetError(EngineError):
    pass


class Caveat(UserWarning):
    """A choice that a reader of the result should know of."""


def require(stage: str, available: Capability, needed: Capability, hint: str = "") -> None:
    """Names what a stage lacks."""
    lacks = needed & ~available
    if lacks:
        names = ", ".join(c.name for c in Capability if c in lacks)
        raise CapabilityError(f"{stage} needs {names}" + (f": {hint}" if hint else ""))


def check_length_for(n_samples: int, m: int, tau: int, label: str = "embedding") -> int:
    """Number of embedded points; an error under three."""
    left = n_samples - (m - 1) * tau
    if left <= 2:
        raise ParameterError(f"{label}: {n_samples} samples are too few for m={m}, tau={tau}")
    return left


def present(c: str):
    return F.when(~F.isnan(F.col(c)), F.col(c))


@dataclass(frozen=True)
class Step:
    """One step of how a record came about."""

    name: str
    params: dict = field(default_factory=dict)
    inputs: tuple = ()
    outputs: tuple = ()
    at: str = field(default_factory=lambda: datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"))
    notes: str = ""
    caveats: tuple = ()

    def with_caveat(self, text: str) -> Step:
        return replace(self, caveats=(*self.caveats, text))

    def row(self, order: int) -> tuple:
        return order, self.name, json.dumps(self.params, default=str, sort_keys=True), list(self.inputs), list(self.outputs), self.at, self.notes, list(self.caveats)


STEP = "step int, name string, params string, inputs array<string>, outputs array<string>, at string, notes string, caveats array<string>"


def provenance_frame(spark: SparkSession, steps) -> DataFrame:
    return spark.createDataFrame([s.row(k) for k, s in enumerate(steps)], STEP)


@dataclass(frozen=True)
class Record:
    """A wide DataFrame (subject, i, channels) with its sampling rate, channel roles and the steps that made it.

    meta holds what is known of the record, `bands` among it: channel -> (low, high)."""

    df: DataFrame
    fs: float = 1.0
    roles: dict[str, str] = field(default_factory=dict)
    t0: float = 0.0
    steps: tuple = ()
    units: dict[str, str] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.fs or not 0 < self.fs < float("inf"):
            raise QualityError(f"sampling rate {self.fs!r} is none")
        for c, r in self.roles.items():
            if r not in ROLES:
                raise ParameterError(f"unknown role {r!r} of channel {c!r}")

    @property
    def channels(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("subject", "i", "t")]

    @property
    def capabilities(self) -> Capability:
        return capabilities_from_roles({self.roles.get(c, "raw") for c in self.channels})

    def by_role(self, role: str) -> list[str]:
        return [c for c in self.channels if self.roles.get(c, "raw") == role]

    def require(self, role: str) -> None:
        if not self.by_role(role):
            raise CapabilityError(f"no channel has the role {role!r}")

    def get(self, name: str) -> DataFrame:
        """subject, i, value of one channel."""
        self._known([name])
        return self.df.select("subject", "i", F.col(name).alias("value"))

    def select(self, *names: str) -> Record:
        self._known(names)
        return self._with(self.df.select("subject", "i", *names), "select", names=names)

    def as_array(self, *names: str) -> DataFrame:
        """subject, i, coords: the channels of a sample as one array."""
        names = names or tuple(self.channels)
        self._known(names)
        return self.df.select("subject", "i", F.array(*names).alias("coords"))

    def with_channels(self, columns: dict | None = None, *, roles: dict | None = None, units: dict | None = None, step: Step | None = None, keep: list[str] | None = None, **more) -> Record:
        """Adds or replaces channels by expressions; `keep` leaves only those of the old ones."""
        new = (columns or {}) | more
        df = self.df.withColumns(new)
        if keep is not None:
            df = df.select("subject", "i", *[c for c in df.columns if c in keep or c in new])
        step = step or Step("with_channels", {"names": list(new)}, outputs=tuple(new))
        return self._made(df, step, roles, units)

    def replaced(self, df: DataFrame, *, roles: dict | None = None, units: dict | None = None, step: Step, fs: float | None = None, t0: float | None = None, bands: dict | None = None) -> Record:
        """Another table in this one's place, of other length or rate if need be."""
        out = self._made(df, step, roles, units)
        meta = self.meta | ({"bands": self.meta.get("bands", {}) | bands} if bands else {})
        return replace(out, fs=fs or self.fs, t0=self.t0 if t0 is None else t0, meta=meta)

    def with_meta(self, **values) -> Record:
        return replace(self, meta=self.meta | values)

    def with_step(self, step: Step) -> Record:
        return replace(self, steps=(*self.steps, step))

    def window(self, start: int, stop: int) -> Record:
        df = self.df.where((F.col("i") >= start) & (F.col("i") < stop)).withColumn("i", F.col("i") - start)
        return replace(self, df=df, t0=self.t0 + start / self.fs, steps=(*self.steps, Step("window", {"start": start, "stop": stop})))

    def subsample(self, factor: int) -> Record:
        df = self.df.where(F.col("i") % factor == 0).withColumn("i", F.expr(f"i div {factor}"))
        return replace(self, df=df, fs=self.fs / factor, steps=(*self.steps, Step("subsample", {"factor": factor})))

    def times(self) -> DataFrame:
        return self.df.withColumn("t", F.lit(self.t0) + F.col("i") / F.lit(self.fs))

    def to_frame(self, *names: str) -> DataFrame:
        names = names or tuple(self.channels)
        self._known(names)
        return self.times().select("subject", "t", *names)

    def long(self) -> DataFrame:
        return self.df.unpivot(["subject", "i"], self.channels, "channel", "value")

    def channel_frame(self) -> DataFrame:
        """One row for each subject and channel: role, unit, n_samples, n_missing, mean, std, min, max, duration, digest.
        The digest does not depend on how rows lie: a sum of hashes of places and values."""
        digest = F.hex(F.sum(F.xxhash64("i", "value").cast("decimal(38,0)")).cast("string"))
        stats = self.long().groupBy("subject", "channel").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), digest.alias("digest"))
        told = lambda known, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in self.channels for x in (c, known.get(c, other))]), F.col("channel")), F.lit(other))
        return stats.withColumns({"role": told(self.roles, "raw"), "unit": told(self.units, ""), "duration": F.col("n_samples") / F.lit(self.fs)})

    def provenance(self, spark: SparkSession) -> DataFrame:
        return provenance_frame(spark, self.steps)

    def _known(self, names) -> None:
        missing = [n for n in names if n not in self.channels]
        if missing:
            raise ParameterError(f"no such channels: {missing}")

    def _made(self, df: DataFrame, step: Step, roles: dict | None, units: dict | None) -> Record:
        there = lambda known: {c: v for c, v in known.items() if c in df.columns}
        return replace(self, df=df, roles=there(self.roles | (roles or {})), units=there(self.units | (units or {})), steps=(*self.steps, step))

    def _with(self, df: DataFrame, name: str, **params) -> Record:
        return self._made(df, Step(name, params), None, None)


def from_table(df: DataFrame, subject: str, order: list[str], channels: dict[str, str]) -> Record:
    """A record from any table: rows of a subject are numbered in the given order."""
    w = Window.partitionBy(subject).orderBy(*order)
    picked = df.where(F.col(subject).isNotNull()).select(F.col(subject).alias("subject"), (F.row_number().over(w) - 1).cast("long").alias("i"), *[F.expr(e).cast("double").alias(c) for c, e in channels.items()])
    return Record(picked.select("subject", "i", *[present(c).alias(c) for c in channels]))


def events(spark: SparkSession, sf_dir: str) -> Record:
    """Events of each user: value, seconds since the one before, time of day as a phase."""
    us = "unix_micros(cast(ts as timestamp))"
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value")
    df = dealt(df, "user_id")  # once: what follows by subject keeps this partitioning
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = df.withColumn("us", F.expr(us)).withColumn("step", F.coalesce((F.col("us") - F.lag("us").over(w)) / 1e6, F.lit(0.0)))
    return from_table(df, "user_id", ["ts", "event_id"], {"value": "value", "gap": "step", "phase": "2 * pi() * ((us % 86400000000) / 86400000000.0D) - pi()"})
