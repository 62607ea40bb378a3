"""Document blocks: whole documents packed a few MB at a time, and keyed lookups for them.

Operators that need a corpus-wide answer for every distinct key of a text (a word, a
context, a byte string) ask once per block and key: a block sends its sorted distinct
keys, dealt to buckets; each bucket merges what all blocks sent and answers every block in
the order it asked; answers and blocks meet by block id. So a key that fills the corpus
costs one entry a block, and what is shuffled is packed.

Tables: blocks (block long, kind int = 0, bucket int, data binary); messages alike with
kinds above 0. A message is a list of numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, chunks, release, written

BLOCK_BYTES = 6 << 20
MESSAGE = "block long, kind int, bucket int, data binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message."""
    parts = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str.encode().ljust(8), len(a).to_bytes(8, "little"), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 4
    for _ in range(int.from_bytes(raw[:4], "little")):
        kind, n = np.dtype(raw[at : at + 8].decode().strip()), int.from_bytes(raw[at + 8 : at + 16], "little")
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def squeezed(sorted_keys: np.ndarray, width: int = 7) -> np.ndarray:
    """Sorted numbers under 2**(8 * width) as the low bytes of their differences."""
    d = np.diff(sorted_keys, prepend=U(0))
    return d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.ravel()


def unsqueezed(data: np.ndarray, width: int = 7) -> np.ndarray:
    n = len(data) // width
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = data.reshape(width, n).T
    return np.cumsum(full.view("<u8").ravel(), dtype=U)


def message(block: int, kind: int, bucket: int, data: bytes) -> tuple:
    return block, kind, bucket, data


def batch(rows: list[tuple]) -> pa.RecordBatch:
    b, k, u, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(u, pa.int32()), pa.array(d, pa.binary())], ["block", "kind", "bucket", "data"])


class Block:
    """ids (null: the largest number, `missing` marks it), bytes and offsets of a block's documents."""

    def __init__(self, data: bytes):
        self.ids, self.missing, self.raw, self.off = unpacked(data)

    def pieces(self, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of whole documents of about `limit` bytes."""
        at, n = 0, len(self.off) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.off, self.off[at] + limit, "right")) - 1)
            yield at, to
            at = to


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) packed into blocks, written to the shared folder."""

    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal n, held, size
            if not held:
                return
            ids = np.concatenate([h[0] for h in held])
            missing = np.concatenate([h[1] for h in held])
            off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[3]) for h in held]))])
            data = packed(ids, missing, np.concatenate([h[2] for h in held]), off.astype(np.int64))
            n, held, size = n + 1, [], 0
            yield batch([message((task << 24) + n, 0, 0, data)])

        for rows, raw, off in chunks(batches, "text"):
            ids = rows.column(0)
            if size and size + len(raw) > block_bytes:
                yield from flush()
            held.append((ids.fill_null(2**63 - 1).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), raw.copy(), off))
            size += len(raw)
        yield from flush()

    return written(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, MESSAGE), "blocks")


def ask(table: DataFrame, fn: Callable[[int, Block], list[tuple]]) -> DataFrame:
    """Messages that every block sends."""

    def run(batches):
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                yield batch(fn(block, Block(data.as_py())))

    return table.mapInArrow(run, MESSAGE)


def groups(batches, column: int):
    """Rows (lists of block, kind, bucket, data) of one value of a column after another; batches come sorted by it."""
    held, key = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[column] != key:
                if held:
                    yield held
                held, key = [], row[column]
            held.append(row)
    if held:
        yield held


def partition_keys(spark, n: int) -> list[int]:
    """For each of n partitions a number that hash partitioning deals to it."""
    found: dict[int, int] = {}
    top = 0
    while len(found) < n:
        rows = spark.range(top, top + 16 * n).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p"))
        for r in rows.groupBy("p").agg(F.min("k").alias("k")).collect():
            found.setdefault(r.p, r.k)
        top += 16 * n
    return [found[p] for p in range(n)]


def by_bucket(messages: DataFrame, n_buckets: int) -> DataFrame:
    """Messages dealt so that every bucket has a task of its own: hashed, buckets would fall together in some tasks."""
    keys = F.array(*[F.lit(k) for k in partition_keys(messages.sparkSession, n_buckets)])
    return messages.repartition(n_buckets, F.element_at(keys, F.col("bucket") + 1)).sortWithinPartitions("bucket", "kind", "block")


def answer(messages: DataFrame, n_buckets: int, fn: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """Every bucket's messages, merged by fn into answers; written to the shared folder."""
    dealt = by_bucket(messages, n_buckets)

    def run(batches):
        for rows in groups(batches, 2):
            yield batch(fn(rows))

    out = written(dealt.mapInArrow(run, MESSAGE), "answers")
    release(out.sparkSession)
    return out


def meet(table: DataFrame, answers: DataFrame, n: int, fn: Callable[[int, Block, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Blocks together with their answers: fn(block, Block, {kind: [data by bucket]})."""
    dealt = table.union(answers.where("block >= 0")).repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")

    def run(batches):
        for rows in groups(batches, 0):
            by: dict[int, dict[int, bytes]] = {}
            for _, kind, bucket, data in rows[1:]:
                by.setdefault(kind, {})[bucket] = data
            yield from fn(rows[0][0], Block(rows[0][3]), by)

    return dealt.mapInArrow(run, schema)


def bucket_count(table: DataFrame, blocks_a_bucket: int = 8) -> int:
    """Buckets for a table of blocks: the shuffle partitions, or more if a bucket would merge more than
    about `blocks_a_bucket` blocks' worth of messages, so that its memory does not grow with the input."""
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-table.count() // blocks_a_bucket))
