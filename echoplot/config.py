"""Settings, random streams and what is known of the environment."""

from __future__ import annotations

import hashlib
import importlib
import os
import platform
from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: optional modules and what they serve
BACKENDS = {"pyarrow": "kernels and files", "pandas": "grouped functions", "h5py": "HDF5 files", "duckdb": "oracle queries", "pyspark.ml": "classification"}


@dataclass(frozen=True)
class Config:
    """memory_budget_gb bounds what one task may hold of a matrix; strict_quality makes quality errors fatal."""

    memory_budget_gb: float = 4.0
    warn_on_caveat: bool = True
    output_dir: str = "out"
    n_jobs: int | None = None
    strict_quality: bool = False


_current = Config()


def get_config() -> Config:
    return _current


def set_config(**values) -> Config:
    """Changes settings; an unknown name is an AttributeError."""
    global _current
    known = {f.name for f in fields(Config)}
    for name in values:
        if name not in known:
            raise AttributeError(f"no such setting: {name}")
    _current = replace(_current, **values)
    return _current


def output_path(name: str, subdir: str | None = None) -> str:
    return "/".join(p.rstrip("/") for p in (_current.output_dir, subdir, name) if p)


def resolve_jobs(spark: SparkSession, n_jobs: int | None = None) -> int:
    """Tasks at a time: as asked, as set, or as the cluster has cores."""
    n = n_jobs or _current.n_jobs or spark.sparkContext.defaultParallelism
    return spark.sparkContext.defaultParallelism if n < 0 else max(1, int(n))


def resolve_rng(seed=None) -> np.random.Generator:
    return seed if isinstance(seed, np.random.Generator) else np.random.default_rng(seed)


def spawn_rng(seed: int, position: int) -> np.random.Generator:
    """The stream of one unit: it depends on the seed and the unit's position, never on where it runs."""
    return np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(int(position),)))


def spawn_rngs(seed: int, n: int) -> list[np.random.Generator]:
    return [spawn_rng(seed, k) for k in range(n)]


def available_backends() -> dict[str, bool]:
    found = {}
    for name in BACKENDS:
        try:
            importlib.import_module(name)
            found[name] = True
        except ImportError:
            found[name] = False
    return found


def doctor(spark: SparkSession) -> DataFrame:
    """backend, available, serves."""
    return spark.createDataFrame([(n, ok, BACKENDS[n]) for n, ok in available_backends().items()], "backend string, available boolean, serves string")


def environment_stamp(spark: SparkSession, extra: dict | None = None) -> DataFrame:
    """key, value of the versions that a result depends on."""
    import pyarrow

    known = {"python": platform.python_version(), "spark": spark.version, "numpy": np.__version__, "pyarrow": pyarrow.__version__, "platform": platform.platform(), "cpus": str(os.cpu_count())}
    known |= {k: str(v) for k, v in (extra or {}).items()}
    return spark.createDataFrame(sorted(known.items()), "key string, value string")


def array_digest(x: np.ndarray, n_bytes: int = 8) -> str:
    """A hash of an array's bytes, shape and type."""
    x = np.ascontiguousarray(x)
    h = hashlib.blake2b(digest_size=n_bytes)
    h.update(x.tobytes())
    h.update(str(x.shape).encode())
    h.update(str(x.dtype).encode())
    return h.hexdigest()
