"""Sharding by a keyed permutation of global row numbers.

Every row gets a number 0..N-1; a Feistel network over the smallest balanced
domain that holds N, walked along its cycles until it is back under N, permutes
the numbers. Permuted number p goes to shard p mod S, slot p div S, so shards
differ by one row at most, slots have no gaps, and shard and slot of a row number
can be computed without the data (`locate`).

Row numbers come from hash buckets of (id, text CRC), at most 65,536 of them,
ordered inside by id: one slim shuffle, no global sort, and no dependence on
partitioning. Rows equal in id and text are interchangeable.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, mix, read, without

SEED, ROUNDS, MAX_BUCKETS = 20250131, 6, 65536


def feistel(x: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The permutation of 0..n-1 at x. Cycle walking: values past n go round again."""
    if n <= 1:
        return np.zeros_like(np.asarray(x, np.int64))
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    out = np.asarray(x, np.int64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, rounds + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed % 2**63))
        while len(todo):
            left, right = out[todo] // b, out[todo] % b
            for r in range(rounds):  # the halves have sizes a and b in turn
                if r % 2 == 0:
                    left = (left + (mix(right.astype(U) + keys[r]) >> U(1)).astype(np.int64) % a) % a
                else:
                    right = (right + (mix(left.astype(U) + keys[r]) >> U(1)).astype(np.int64) % b) % b
            out[todo] = left * b + right
            todo = todo[out[todo] >= n]
    return out


def locate(row_number, n_rows: int, n_shards: int, seed: int = SEED):
    """(shard, slot) of global row numbers."""
    p = feistel(np.atleast_1d(row_number), n_rows, seed)
    return p % n_shards, p // n_shards


def shard(docs: DataFrame, n_shards: int = 40, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus row_number, shard int, slot long; columns of these names are replaced.

    Null ids and texts are values like any other; an empty table gives an empty
    result; repeated rows get places of their own.
    """
    docs = without(docs, "row_number", "shard", "slot")
    n = docs.count()
    buckets = min(MAX_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, n / 64)))))
    keyed = docs.withColumn("__crc", F.crc32(F.coalesce(F.col(text_col), F.lit("")))).withColumn("__bucket", F.pmod(F.xxhash64(F.col(id_col), F.col("__crc")), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # at most MAX_BUCKETS rows, so this window and this broadcast are bounded
    offsets = counts.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    numbered = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("__bucket").orderBy(id_col, "__crc")))

    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), n, seed))

    placed = numbered.join(F.broadcast(offsets), "__bucket").withColumn("row_number", F.col("__before") + F.col("__rank") - 1)
    placed = placed.withColumn("__p", permuted("row_number"))
    return placed.select(*docs.columns, "row_number", (F.col("__p") % n_shards).cast("int").alias("shard"), F.expr(f"__p div {n_shards}").alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """Law `rows`: shard sizes differ by one row at most."""
    docs = read(spark, sf_dir, "documents")
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    # the row numbers need the CRC alone of the text
    placed = shard(slim.withColumn("text", F.col("text_crc32").cast("string")), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_feistel_sharding": op4_sharding}
ORACLES: dict[str, str] = {}
