"""Kernels over whole units, many units to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over all shuffle partitions. The number is given, since work on units grows faster
    than their bytes and adaptive execution would put small bytes into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def whole_units(batches: Iterator, keys: tuple[str, ...]) -> Iterator:
    """Tables of whole units and where units begin and end in them, of batches that come sorted by their keys."""

    def units(tables: list):
        import pyarrow as pa
        import pyarrow.compute as pc

        t = pa.Table.from_batches(tables).combine_chunks()
        if not t.num_rows:
            return t, np.zeros(1, np.int64)
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            codes = pc.dictionary_encode(t[k].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return t, np.concatenate([[0], np.flatnonzero(new), [t.num_rows]])

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1][k][-1].as_py() == batch[k][0].as_py() == batch[k][-1].as_py() for k in keys):
            held.append(batch)  # still within one unit
            continue
        t, cuts = units([*held, batch])
        if len(cuts) > 2:
            yield t.slice(0, cuts[-2]), cuts[:-1]
        held = t.slice(cuts[-2]).to_batches()
    if held:
        yield units(held)


def per_series(df: DataFrame, keys: tuple[str, ...], cols: list[str], run: Callable[[np.ndarray], np.ndarray], out: list[str]) -> DataFrame:
    """keys, i (from 0) and the double columns `out` from run(points x cols) -> points' x out of each unit."""

    def columns(x):
        y = np.asarray(run(x), float)
        return [np.arange(len(y)), *y.T]

    return per_unit(df, keys, cols, columns, ", ".join(["i long", *[f"`{c}` double" for c in out]]), columnar=True)


def per_unit(df: DataFrame, keys: tuple[str, ...], cols: list[str], run: Callable[[np.ndarray], list], fields: str, columnar: bool = False) -> DataFrame:
    """keys and `fields` (DDL) from run(points x cols) of each unit, in the order of `i`. run returns rows, or
    with `columnar` an array for each field.

    Partitions are sorted by unit, and one pass cuts them at the units' ends: memory is a batch or the
    largest unit, and there is no call of pandas for each unit. Null keys are a unit of their own;
    null values arrive as NaN.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + fields
    names = [f.split()[0].strip("`") for f in fields.split(", ")]

    def results(t, cuts):
        import pyarrow as pa

        x = np.column_stack([t[c].to_numpy().astype(float) for c in cols])
        if columnar:
            parts = [run(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            at = pa.array(np.repeat(cuts[:-1], [len(p[0]) for p in parts]))
            out = {k: t[k].take(at) for k in keys} | {n: pa.array(np.concatenate([p[j] for p in parts]), arrow[j]) for j, n in enumerate(names)}
            return pa.table(out).to_batches()
        rows, at = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            got = run(x[a:b])
            rows += got
            at += [a] * len(got)
        at = pa.array(at, pa.int64())
        out = {k: t[k].take(at) for k in keys} | {n: pa.array([r[j] for r in rows], arrow[j]) for j, n in enumerate(names)}
        return pa.table(out).to_batches()

    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    arrow = [kinds[f.split()[1]] for f in fields.split(", ")]

    def walk(batches: Iterator) -> Iterator:
        for t, cuts in whole_units(batches, keys):
            yield from results(t, cuts)

    return dealt(df.select(*keys, "i", *cols), *keys).sortWithinPartitions(*keys, "i").mapInArrow(walk, schema)
