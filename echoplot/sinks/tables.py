"""Result tables with what they depend on beside them, and a report of a run."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import environment_stamp, get_config, output_path, set_config
from ..records import Record, provenance_frame
from ..sources.memory import quality_report


def set_output_dir(path: str) -> str:
    set_config(output_dir=path)
    return path


def _csv(df: DataFrame, path: str, one: bool = False) -> str:
    """Arrays, maps and structs become JSON text, as CSV has none."""
    df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes])
    (df.coalesce(1) if one else df).write.mode("overwrite").option("header", "true").csv(path)
    return path


def stamp_frame(spark: SparkSession, extra: dict | None = None) -> DataFrame:
    """key, value of the environment and what else is told."""
    return environment_stamp(spark, extra)


def export_frame(df: DataFrame, name: str, subdir: str | None = None, steps=None, extra: dict | None = None, fmt: str = "csv") -> str:
    """df under the output folder, with the environment and, if given, the steps beside it; returns the path."""
    path = output_path(name, subdir)
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        _csv(df, path)
    _csv(stamp_frame(df.sparkSession, extra), path + "_environment", True)
    if steps:
        _csv(provenance_frame(df.sparkSession, steps), path + "_provenance", True)
    return path


def export_recording(rec: Record, name: str = "recording", subdir: str | None = None, include_timeseries: bool = False) -> list[str]:
    """Tables of channels and issues, and the series if asked."""
    out = [export_frame(rec.channel_frame(), f"{name}_channels", subdir, rec.steps), export_frame(quality_report(rec), f"{name}_quality", subdir)]
    return [*out, export_frame(rec.to_frame(), f"{name}_timeseries", subdir, fmt="parquet")] if include_timeseries else out


@dataclass(frozen=True)
class CsvExporter:
    """Tables gathered by name and column, written at once. Adding gives a new exporter."""

    name: str
    subdir: str | None = None
    parts: tuple = ()

    def add_frame(self, df: DataFrame) -> CsvExporter:
        return replace(self, parts=(*self.parts, df))

    def add(self, spark: SparkSession, **row) -> CsvExporter:
        return self.add_frame(spark.createDataFrame([tuple(row.values())], list(row)))

    def frame(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def __len__(self) -> int:
        return len(self.parts)

    def write(self) -> str:
        return export_frame(self.frame(), self.name, self.subdir)


@dataclass
class RunReport:
    """What a run was told, found and wrote: a text and a table of its artifacts."""

    title: str
    parameters: dict = field(default_factory=dict)
    sections: list[tuple[str, list[str]]] = field(default_factory=list)
    results: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    artifacts: list[tuple[str, str, str]] = field(default_factory=list)
    begun: float = field(default_factory=time.time)

    def parameter(self, name: str, value) -> RunReport:
        self.parameters[name] = value
        return self

    def section(self, name: str) -> RunReport:
        self.sections.append((name, []))
        return self

    def note(self, text: str) -> RunReport:
        if not self.sections:
            self.section("Notes")
        self.sections[-1][1].append(text)
        return self

    def result(self, name: str, value) -> RunReport:
        self.results[name] = value
        return self

    def warn(self, text: str) -> RunReport:
        self.warnings.append(text)
        return self

    def table(self, df: DataFrame, name: str, subdir: str | None = None) -> RunReport:
        return self.file(export_frame(df, name, subdir), "table", name)

    def file(self, path: str, kind: str = "file", name: str | None = None) -> RunReport:
        self.artifacts.append((name or path.rsplit("/", 1)[-1], kind, path))
        return self

    @property
    def elapsed(self) -> float:
        return time.time() - self.begun

    def artifact_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.artifacts, "name string, kind string, path string")

    def render(self) -> str:
        lines = [self.title, "=" * len(self.title), ""]
        for head, rows in (("Parameters", [f"{k} = {v}" for k, v in self.parameters.items()]), *self.sections, ("Results", [f"{k} = {v}" for k, v in self.results.items()]), ("Warnings", self.warnings), ("Artifacts", [f"{kind} {name}: {path}" for name, kind, path in self.artifacts])):
            if rows:
                lines += [head, "-" * len(head), *[f"  {r}" for r in rows], ""]
        return "\n".join([*lines, f"{self.elapsed:.1f} s", ""])

    def write(self, spark: SparkSession, name: str = "report") -> str:
        """The text as name.txt and the artifacts as a table, under the output folder."""
        path = output_path(f"{name}.txt")
        write_file(spark, path, self.render().encode())
        _csv(self.artifact_frame(spark), output_path(f"{name}_artifacts"), True)
        return path

    def __str__(self) -> str:
        return self.render()


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file through Hadoop's file systems, so any store that Spark reaches will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def current_output_dir() -> str:
    return get_config().output_dir
