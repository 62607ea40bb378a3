"""What units must have in common before their measures are compared, and group differences with tests."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..records import EngineError, ParameterError

# the axes on which units may agree, and what agreement on them licenses (fixed vocabulary)
AXES = ("n_samples", "fs", "duration", "dim", "route", "scaling", "embedding_m", "embedding_tau", "metric", "theiler", "threshold_mode", "target_rr", "window_size", "window_step", "n_windows")
NUMERIC = ("n_samples", "fs", "duration", "dim", "embedding_m", "embedding_tau", "theiler", "target_rr", "window_size", "window_step", "n_windows")
NEEDS = {
    "recurrence_rate": ("metric", "theiler", "threshold_mode", "scaling"),
    "determinism": ("target_rr", "theiler", "fs", "window_size"),
    "line_lengths": ("fs", "window_size", "theiler", "target_rr"),
    "entropy": ("window_size", "fs", "target_rr"),
    "coupling": ("fs", "window_size"),
    "invariants": ("fs", "embedding_m", "embedding_tau", "theiler"),
}


@dataclass(frozen=True)
class ComparabilityContract:
    """Values that units shall have (None: whatever, but the same), and the relative tolerance of numbers."""

    values: dict = field(default_factory=dict)
    tolerance: float = 0.05
    strict: bool = False

    def __post_init__(self):
        unknown = set(self.values) - set(AXES)
        if unknown:
            raise ParameterError(f"unknown axes {sorted(unknown)}")

    def with_(self, **values) -> ComparabilityContract:
        return replace(self, values=self.values | values)

    @property
    def declared(self) -> list[str]:
        return [a for a in AXES if a in self.values]


def describe_units(units: DataFrame, **constants) -> DataFrame:
    """units (subject and any axes as columns) with all axes: constants for what all units share, null for what is not known."""
    unknown = set(constants) - set(AXES)
    if unknown:
        raise ParameterError(f"unknown axes {sorted(unknown)}")
    kind = lambda a: "double" if a in NUMERIC else "string"
    value = lambda a: F.col(a) if a in units.columns else F.lit(constants.get(a))
    return units.select("subject", *[value(a).cast(kind(a)).alias(a) for a in AXES])


def contract_from(units: DataFrame, subject, axes: tuple[str, ...] = AXES, **overrides) -> ComparabilityContract:
    """The contract that one unit keeps."""
    row = units.where(F.col("subject") == subject).select(*axes).first()
    if row is None:
        raise ParameterError(f"no unit {subject!r}")
    return ComparabilityContract({a: row[a] for a in axes if row[a] is not None} | overrides)


class ContractViolation(EngineError):
    pass


def check_comparability(units: DataFrame, contract: ComparabilityContract | None = None, axes: tuple[str, ...] = AXES) -> DataFrame:
    """axis, status (ok, violated, absent), n_values, least, most, expected, n_offenders. units: as describe_units gives them.

    Numbers agree if their span, or their distance from the contract's value, is within the tolerance of the largest one."""
    contract = contract or ComparabilityContract()
    unknown = set(axes) - set(AXES)
    if unknown:
        raise ParameterError(f"unknown axes {sorted(unknown)}")
    text = units.select(*[F.col(a).cast("double").cast("string").alias(a) if a in NUMERIC else F.col(a) for a in axes]).unpivot([], list(axes), "axis", "value")
    wanted = {a: (str(float(contract.values[a])) if a in NUMERIC else str(contract.values[a])) for a in axes if contract.values.get(a) is not None}
    told = F.create_map(*[F.lit(x) for a in axes for x in (a, wanted.get(a))])
    number = F.col("axis").isin(*NUMERIC)
    x = F.when(number, F.col("value").cast("double"))
    rows = text.withColumn("expected", F.element_at(told, F.col("axis"))).withColumn("x", x).withColumn("e", F.when(number, F.col("expected").cast("double")))
    far = F.abs(F.col("x") - F.col("e")) > contract.tolerance * F.greatest(F.abs("x"), F.abs("e"))
    off = F.col("expected").isNotNull() & F.when(number, far).otherwise(F.col("value") != F.col("expected"))
    g = rows.groupBy("axis").agg(F.count("value").alias("known"), F.count_distinct("value").alias("n_values"), F.min("x").alias("least"), F.max("x").alias("most"), F.first("expected").alias("expected"), F.count_if(off).alias("n_offenders"))
    span = F.when(F.col("least").isNotNull(), F.col("most") - F.col("least") <= contract.tolerance * F.greatest(F.abs("most"), F.abs("least"))).otherwise(F.col("n_values") <= 1)
    status = F.when(F.col("known") == 0, "absent").when(span & (F.col("n_offenders") == 0), "ok").otherwise("violated")
    return g.select("axis", status.alias("status"), "n_values", "least", "most", "expected", "n_offenders")


def metric_validity(report: DataFrame) -> DataFrame:
    """family, valid, lacking: the families of measures that the agreement licenses. report: of check_comparability."""
    needs = report.sparkSession.createDataFrame([(f, a) for f, axes in NEEDS.items() for a in axes], "family string, axis string")
    lacks = F.col("status").isNull() | (F.col("status") != "ok")
    got = F.broadcast(needs).join(report, "axis", "left").groupBy("family").agg(F.array_sort(F.collect_list(F.when(lacks, F.col("axis")))).alias("lacking"))
    return got.select("family", (F.size("lacking") == 0).alias("valid"), F.array_join("lacking", ",").alias("lacking"))


def raise_if_violated(report: DataFrame) -> None:
    bad = [r.axis for r in report.where("status = 'violated'").collect()]  # at most one row an axis
    if bad:
        raise ContractViolation(f"units differ in {', '.join(sorted(bad))}")


def normal_tail(z: Column) -> Column:
    """Probability that a standard normal number is at least z (z >= 0), within 1.2e-7 of itself (a published
    Chebyshev fit of erfc; fixed values)."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    series = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = series * t + c
    return t * F.exp(-x * x + series) / 2


def exact_tail(n_a: int, n_b: int, u: float) -> float:
    """Two-sided probability of a rank sum at least as far from its middle, by counting arrangements."""
    import numpy as np

    counts = np.zeros(n_a * n_b + 1)
    counts[0] = 1
    for k in range(1, n_a + 1):
        # multiply by (1 - q^(n_b + k)) and divide by (1 - q^k)
        if n_b + k < len(counts):
            counts[n_b + k :] -= counts[: -(n_b + k)].copy()
        for j in range(k, len(counts)):
            counts[j] += counts[j - k]
    far = max(u, n_a * n_b - u)
    return float(min(1.0, 2 * counts[int(math.ceil(far)) :].sum() / counts.sum()))


def group_tests(df: DataFrame, metrics: list[str], group: str, by: str = "window", min_per_group: int = 2) -> DataFrame:
    """metric, by, n_a, n_b, mean_a, mean_b, std_a, std_b, diff, cohens_d, u, auc, p, p_bonferroni of group 1 against 0.

    p is two-sided, from the rank sum: exact where a group has eight or fewer and no values tie, else by the normal law
    with corrections for ties and continuity. Bonferroni counts all rows of the result."""
    long = df.unpivot([by, group], metrics, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    w = Window.partitionBy("metric", by)
    same = F.count(F.lit(1)).over(Window.partitionBy("metric", by, "value"))
    r = F.rank().over(w.orderBy("value")) + (same - 1) / 2
    g = lambda k, x: F.when(F.col(group) == k, F.col(x))
    ranked = long.withColumns({"r": r, "same": same})
    s = ranked.groupBy("metric", by).agg(
        *[f(g(k, "value")).alias(f"{n}_{x}") for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp)) for k, x in ((0, "a"), (1, "b"))],
        F.sum(g(1, "r")).alias("rb"), F.sum(F.col("same") * F.col("same") - 1).cast("double").alias("ties"),
    ).where((F.col("n_a") >= min_per_group) & (F.col("n_b") >= min_per_group))
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n, u = a + b, F.col("rb") - b * (b + 1) / 2
    pooled = F.sqrt(((a - 1) * F.col("std_a") * F.col("std_a") + (b - 1) * F.col("std_b") * F.col("std_b")) / (n - 2))
    sd = F.sqrt(a * b / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - a * b / 2) - 0.5, F.lit(0.0)) / F.when(sd > 0, sd)
    out = s.withColumns({"diff": F.col("mean_b") - F.col("mean_a"), "cohens_d": (F.col("mean_b") - F.col("mean_a")) / F.when(pooled > 0, pooled), "u": u, "auc": u / (a * b), "p_normal": F.coalesce(F.least(2 * normal_tail(z), F.lit(1.0)), F.lit(1.0))})
    return out.select("metric", by, "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b", "diff", "cohens_d", "u", "auc", "p_normal", "ties")


def group_comparison(df: DataFrame, metrics: list[str], group: str, by: str = "window", min_per_group: int = 2) -> DataFrame:
    """group_tests with p, exact where groups are small, and p_bonferroni."""
    import pandas as pd

    def exact(n_a: pd.Series, n_b: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([exact_tail(int(a), int(b), float(x)) for a, b, x in zip(n_a, n_b, u, strict=True)], dtype=float)

    exact.__annotations__ = {"n_a": pd.Series, "n_b": pd.Series, "u": pd.Series, "return": pd.Series}
    tail = F.pandas_udf(exact, "double")
    t = group_tests(df, metrics, group, by, min_per_group)
    small = (F.least("n_a", "n_b") <= 8) & (F.col("ties") == 0)
    few = t.where(small).withColumn("p", tail("n_a", "n_b", "u"))
    out = few.union(t.where(~small).withColumn("p", F.col("p_normal")))
    every = Window.partitionBy(F.lit(0))  # a row for each metric and window
    return out.drop("p_normal", "ties").withColumn("p_bonferroni", F.least(F.col("p") * F.count(F.lit(1)).over(every), F.lit(1.0)))


def rank_metrics(comparison: DataFrame, by: str = "auc") -> DataFrame:
    """metric, mean_auc, max_auc (as distance from chance plus a half), min_p, place: the strongest first."""
    if by not in ("auc", "max_auc", "p"):
        raise ParameterError(f"unknown order {by!r}")
    far = F.abs(F.col("auc") - 0.5) + 0.5
    p = "p" if "p" in comparison.columns else "p_normal"
    out = comparison.groupBy("metric").agg(F.avg(far).alias("mean_auc"), F.max(far).alias("max_auc"), F.min(p).alias("min_p"))
    first = {"auc": F.col("mean_auc").desc(), "max_auc": F.col("max_auc").desc(), "p": F.col("min_p").asc()}[by]
    return out.withColumn("place", F.row_number().over(Window.orderBy(first, "metric"))).orderBy("place")


def feature_matrix(table: DataFrame, value: str, index: str = "subject", columns: str = "window") -> DataFrame:
    """One row an index, one column for each window number present (their mean)."""
    numbers = sorted(r[0] for r in table.select(columns).distinct().where(F.col(columns).isNotNull()).collect())  # columns of the result
    wide = table.groupBy(index).pivot(columns, numbers).agg(F.avg(value))
    return wide.select(index, *[F.col(f"`{w}`").alias(f"w{w}") for w in numbers])


