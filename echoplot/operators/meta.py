"""Recurrence of a table of window measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..records import ParameterError
from . import recurrence as R
from . import series as S

SCALINGS = ("zscore", "rank", "robust", "none")


def meta_theiler(size: int, step: int) -> int:
    """Windows nearer than this share samples."""
    return max(1, -(-size // step)) if step > 0 else 1


def meta_space(table: DataFrame, metrics: list[str], scaling: str = "zscore", window: str = "window") -> DataFrame:
    """subject, i and the scaled measures of each window; windows with a missing measure go, and so do
    measures that are constant over the table. i counts the windows that stay."""
    if scaling not in SCALINGS:
        raise ParameterError(f"scaling must be one of {SCALINGS}")
    kept = table.select("subject", window, *metrics).dropna(subset=metrics)
    ends = kept.agg(*[(F.max(m) > F.min(m)).alias(m) for m in metrics]).first()
    varied = [m for m in metrics if ends[m]]
    if not varied:
        raise ParameterError("no measure varies")
    df = kept.withColumn("i", (F.row_number().over(Window.partitionBy("subject").orderBy(window)) - 1).cast("long")).select("subject", "i", *varied)
    every = S.everything()
    n = F.count(F.lit(1)).over(every)
    if scaling == "robust":
        q = df.groupBy("subject").agg(*[F.percentile(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__{m}") for m in varied])
        df = df.join(q, "subject")
    for m in varied:
        x = F.col(m).cast("double")
        if scaling == "zscore":
            sd = F.stddev_pop(m).over(every)
            df = df.withColumn(m, (x - F.avg(m).over(every)) / F.when(sd > 0, sd).otherwise(1.0))
        elif scaling == "rank":
            df = df.withColumn(m, (S.average_rank(m) - 1) / F.greatest(n - 1, F.lit(1)))
        elif scaling == "robust":
            span = F.col(f"__{m}")[2] - F.col(f"__{m}")[0]
            df = df.withColumn(m, (x - F.col(f"__{m}")[1]) / F.when(span > 0, span).otherwise(1.0))
    # rounded, so that ties of distances fall alike on every engine
    return df.select("subject", "i", *[F.round(m, R.DIGITS).alias(m) for m in varied])


def meta_recurrence(table: DataFrame, metrics: list[str], size: int, step: int, target_rr: float = 0.05, scaling: str = "zscore", l_min: int = 2) -> DataFrame:
    """Measures of the recurrence structure of each subject's windows."""
    space = meta_space(table, metrics, scaling)
    return R.rqa(space, [c for c in space.columns if c not in ("subject", "i")], target_rr, meta_theiler(size, step), l_min)
