"""Synthetic records: noise, dynamical systems, and signals with known cross-frequency coupling.

Each unit is made in one task from its own random stream (seed and position), so a corpus is
the same on every cluster and grows by units.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import spawn_rng
from ..functions import kernels
from ..records import ParameterError, Record, Step

# names that a caller may give (fixed vocabulary)
MODALITIES = ("pac", "ppc", "aac", "ppa", "none")
SHAPES = ("hanning", "vonmises", "sine", "square")
PROFILES = ("constant", "transient", "ramp", "intermittent", "switching")
ARTIFACTS = ("spike", "drift", "saturation", "blink")

DEFAULTS = {"modality": "pac", "duration": 20.0, "fs": 500.0, "f_low": 6.0, "f_high": 60.0, "bandwidth_low": 4.0, "bandwidth_high": 20.0, "alpha": 0.6, "preferred_phase": 0.0, "concentration": 2.0, "shape": "hanning", "n": 1, "m": 1, "correlation": None, "profile": "constant", "onset": 0.25, "offset": 0.75, "noise_beta": 1.0, "snr_db": 10.0, "harmonics": 0.0, "artifacts": (), "n_extra": 0}


def modulation_window(phase: np.ndarray, shape: str = "hanning", preferred: float = 0.0, concentration: float = 2.0) -> np.ndarray:
    """From 0 to 1 over the phase, 1 at the preferred one."""
    c = np.cos(phase - preferred)
    if shape in ("hanning", "sine"):
        # a raised cosine; the sine's is its square, so it is narrower
        return (1 + c) / 2 if shape == "hanning" else ((1 + c) / 2) ** 2
    if shape == "vonmises":
        low, high = np.exp(-concentration), np.exp(concentration)
        return (np.exp(concentration * c) - low) / (high - low)
    if shape == "square":
        return (c > 0).astype(float)
    raise ParameterError(f"shape must be one of {SHAPES}")


def alpha_profile(alpha: float, n: int, profile: str = "constant", onset: float = 0.25, offset: float = 0.75, periods: int = 4) -> np.ndarray:
    """Strength of the coupling over the record; onset and offset are shares of it."""
    at = np.arange(n) / max(n, 1)
    inside = (at >= onset) & (at < offset)
    if profile == "constant":
        return np.full(n, alpha)
    if profile == "transient":
        return np.where(inside, alpha, 0.0)
    if profile == "ramp":
        return alpha * np.clip((at - onset) / max(offset - onset, 1e-12), 0, 1)
    if profile == "intermittent":
        return np.where(np.floor(at * 2 * periods) % 2 == 1, alpha, 0.0)
    if profile == "switching":
        return np.where(at < (onset + offset) / 2, alpha, -alpha)
    raise ParameterError(f"profile must be one of {PROFILES}")


def band_component(n: int, fs: float, low: float, high: float, rng: np.random.Generator, beta: float = 1.0) -> np.ndarray:
    """Noise of one band, unit variance."""
    f = np.fft.rfftfreq(n, 1 / fs)
    z = rng.standard_normal(len(f)) + 1j * rng.standard_normal(len(f))
    inside = (f >= low) & (f <= high)
    if not inside.any():
        inside[np.argmin(np.abs(f - (low + high) / 2))] = True
    x = np.fft.irfft(np.where(inside, z * np.maximum(f, f[1] if n > 1 else 1) ** (-beta / 2), 0), n)
    return x / (x.std() or 1.0)


def add_artifacts(x: np.ndarray, kinds, fs: float, rng: np.random.Generator, strength: float = 5.0) -> np.ndarray:
    x, n, scale = x.copy(), len(x), strength * x.std()
    for kind in kinds:
        if kind == "spike":
            at = rng.choice(n, max(1, n // 2000), replace=False)
            x[at] += scale * rng.choice([-1.0, 1.0], len(at))
        elif kind == "drift":
            x += scale * np.sin(2 * np.pi * np.arange(n) / n * rng.uniform(0.25, 0.75))
        elif kind == "saturation":
            top = np.quantile(np.abs(x), 0.9)
            x = np.clip(x, -top, top)
        elif kind == "blink":
            width = max(2, int(0.3 * fs))
            for at in rng.integers(0, max(1, n - width), max(1, int(n / fs / 5))):
                x[at : at + width] += scale * np.hanning(min(width, n - at))
        else:
            raise ParameterError(f"artifacts are {ARTIFACTS}")
    return x


def cfc_signal(rng: np.random.Generator, **options) -> dict[str, np.ndarray]:
    """raw and the components that made it: low, high, phase_low, amp_high, alpha."""
    o = DEFAULTS | options
    unknown = set(options) - set(DEFAULTS)
    if unknown or o["modality"] not in MODALITIES:
        raise ParameterError(f"unknown options {sorted(unknown)} or modality {o['modality']!r}")
    fs, n = o["fs"], int(round(o["duration"] * o["fs"]))
    if not o["f_high"] + o["bandwidth_high"] / 2 < fs / 2:
        raise ParameterError("the fast band does not fit under half the sampling rate")
    low = band_component(n, fs, max(0.1, o["f_low"] - o["bandwidth_low"] / 2), o["f_low"] + o["bandwidth_low"] / 2, rng)
    phase, amp_low = kernels.hilbert(low)
    alpha = alpha_profile(o["alpha"], n, o["profile"], o["onset"], o["offset"])
    carrier = band_component(n, fs, o["f_high"] - o["bandwidth_high"] / 2, o["f_high"] + o["bandwidth_high"] / 2, rng)
    phase_high, amp_high = kernels.hilbert(carrier)
    a, window = np.abs(alpha), modulation_window(phase, o["shape"], o["preferred_phase"], o["concentration"])
    if o["modality"] in ("pac", "ppa"):
        window = np.where(alpha < 0, 1 - window, window)
        amp_high = amp_high * (1 - a + a * window)
    if o["modality"] == "aac":
        r = o["correlation"] if o["correlation"] is not None else a
        amp_high = (1 - r) * amp_high + r * amp_low * amp_high.mean() / amp_low.mean()
    if o["modality"] in ("ppc", "ppa"):
        locked = np.unwrap(phase) * o["n"] / o["m"] + 2 * np.pi * (o["f_high"] - o["f_low"] * o["n"] / o["m"]) * np.arange(n) / fs
        phase_high = (1 - a) * np.unwrap(phase_high) + a * locked
    high = amp_high * np.cos(phase_high)
    if o["harmonics"]:
        low = low + o["harmonics"] * np.cos(2 * phase) * amp_low
    clean = low + high / (high.std() or 1.0) * 0.5
    raw = kernels.noise_at_snr(clean, o["snr_db"], rng, o["noise_beta"])
    out = {"raw": add_artifacts(raw, o["artifacts"], fs, rng), "low": low, "high": high, "phase_low": phase, "amp_high": amp_high, "alpha": alpha}
    return out | {f"extra_{k}": kernels.coloured_noise(n, o["noise_beta"], rng) for k in range(o["n_extra"])}


@dataclass(frozen=True)
class SyntheticSignal:
    """A made record and what is true of its units: subject and the options that differ."""

    record: Record
    truth: DataFrame
    options: dict = field(default_factory=dict)


ROLE_OF = {"raw": "raw", "low": "band", "high": "band", "phase_low": "phase", "amp_high": "amplitude", "alpha": "raw"}


def generate_corpus(spark: SparkSession, grid: dict[str, list], n_per_cell: int = 1, seed: int = 0, **fixed) -> SyntheticSignal:
    """Every cell of a grid of options, n_per_cell times: subject is cell-copy; truth holds the cells' options."""
    names = list(grid)
    cells = [dict(zip(names, values, strict=True)) for values in itertools.product(*grid.values())]
    units = [(k * n_per_cell + c, k, f"{k:04d}-{c:03d}") for k in range(len(cells)) for c in range(n_per_cell)]
    fs = fixed.get("fs", DEFAULTS["fs"])
    if "fs" in names:
        raise ParameterError("all units of a record have one rate")
    channels = [*ROLE_OF, *[f"extra_{k}" for k in range(fixed.get("n_extra", 0))]]

    def run(batches):
        for batch in batches:
            for position, cell, subject in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = cfc_signal(spawn_rng(seed, position), **(fixed | cells[cell]))
                n = len(made["raw"])
                for at in range(0, n, 1 << 16):
                    to = min(n, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([subject] * (to - at)), pa.array(np.arange(at, to)), *(pa.array(made[c][at:to].astype(float)) for c in channels)], ["subject", "i", *channels])

    table = spark.createDataFrame(units, "position long, cell int, subject string").repartition(min(len(units), 4096), "position")
    df = table.mapInArrow(run, "subject string, i long, " + ", ".join(f"`{c}` double" for c in channels))
    truth = spark.createDataFrame([(s, cell, str(cells[cell])) for _, cell, s in units], "subject string, cell int, options string")
    roles = {c: ROLE_OF.get(c, "raw") for c in channels}
    o = DEFAULTS | fixed
    bands = {c: (o[f"f_{b}"] - o[f"bandwidth_{b}"] / 2, o[f"f_{b}"] + o[f"bandwidth_{b}"] / 2) for c, b in (("low", "low"), ("high", "high"), ("phase_low", "low"), ("amp_high", "high"))}
    return SyntheticSignal(Record(df, fs, roles, 0.0, (Step("generate_corpus", {"grid": grid, "seed": seed} | fixed),), meta={"bands": bands}), truth, fixed)


def generate_cfc(spark: SparkSession, seed: int = 0, **options) -> SyntheticSignal:
    """One record with known coupling."""
    return generate_corpus(spark, {"modality": [options.pop("modality", DEFAULTS["modality"])]}, 1, seed, **options)


NOISES = {"white": 0.0, "pink": 1.0}


def generate_noise(spark: SparkSession, n_units: int, n: int, beta: float | str = 1.0, seed: int = 0) -> DataFrame:
    """subject, i, value: noise whose power falls with frequency to the beta ("white" 0, "pink" 1), unit variance."""
    b = NOISES[beta] if isinstance(beta, str) else float(beta)
    return _units(spark, n_units, lambda k: kernels.coloured_noise(n, b, spawn_rng(seed, k))[:, None], ["value"])


def _units(spark: SparkSession, n_units: int, make, columns: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                x = make(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k)), pa.array(np.arange(len(x))), *(pa.array(c.astype(float)) for c in x.T)], ["subject", "i", *columns])

    return spark.range(0, n_units, 1, min(n_units, 4096)).mapInArrow(run, "subject long, i long, " + ", ".join(f"{c} double" for c in columns))


def add_noise_at_snr(df: DataFrame, c: str, snr_db: float, seed: int = 0) -> DataFrame:
    """df with white noise on a channel, its power snr_db under the channel's; the noise hangs on seed, subject and place."""
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "subject", "i"), F.lit(2**52)).cast("double") + 0.5) / 2**52
    noise = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * np.pi * uniform(1))
    from ..operators import series as S

    return df.withColumn(c, F.col(c) + noise * F.stddev_pop(c).over(S.everything()) * 10 ** (-snr_db / 20))


MAPS = {"henon": (kernels.henon, ["x", "y"]), "mackey_glass": (kernels.mackey_glass, ["x"])}


def generate_system(spark: SparkSession, name: str, n: int = 10_000, **options) -> DataFrame:
    """subject (the name), i and the coordinates of a trajectory: lorenz, rossler, van_der_pol, henon or mackey_glass."""
    if name in MAPS:
        make, columns = MAPS[name]
        run = lambda k: make(n, **options)
    elif name in kernels.SYSTEMS:
        columns = ["x", "y", "z"][: len(kernels.SYSTEMS[name][2])]
        run = lambda k: kernels.integrate(name, n, **options)
    else:
        raise ParameterError(f"systems are {sorted([*MAPS, *kernels.SYSTEMS])}")
    return _units(spark, 1, run, columns).withColumn("subject", F.lit(name))
