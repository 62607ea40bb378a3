"""Shared pieces of the training-data operators.

Texts are handled as UTF-8 bytes in numpy, a few MB at a time, straight from
Arrow buffers; a null text is an empty one.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
WORD_JAVA = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20

U = np.uint64
#: is this byte white space of the word rule
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240611))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 2**64))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where none is named, a local master, which
    is one machine, takes a temporary folder; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="echoplot-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors. All tables of an
    application lie in one folder, which goes when the application ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/echoplot/{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    own = spark._jvm.org.apache.hadoop.fs.Path(folder)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for df in tables:
        _forget(df)


def _forget(df: DataFrame) -> None:
    spark = df.sparkSession
    for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/echoplot/" in p:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """(rows, bytes, offsets) of at most about `limit` bytes of text; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse for i up to n; kept for the chunks to come, up to a few MB."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        made = []
        for base in (BASE, BASE_INV):
            x = np.full(size, base, U)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            made.append(x)
        if size > 4 * CHUNK_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


class RollingHash:
    """Hashes of any substrings of one buffer by prefix sums of code[byte] * base^position."""

    def __init__(self, raw: np.ndarray, codes: np.ndarray = BYTE_CODE):
        n = len(raw)
        self.power, self.inverse = powers(n)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(codes[raw] * self.power[:n], out=self.prefix[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.prefix[stop] - self.prefix[start]) * self.inverse[start] + (stop - start).astype(U))

    def grams(self, k: int) -> np.ndarray:
        """Of the k bytes from each position on."""
        n = len(self.prefix) - k
        return mix((self.prefix[k:] - self.prefix[:-k]) * self.inverse[:n] + U(k)) if n > 0 else np.zeros(0, U)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of every word; words end where texts end."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edge = off[1:-1]
    edge = edge[edge < len(raw)]
    first[edge] = ink[edge]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    tail = edge - 1
    tail = tail[tail >= 0]
    last[tail] = ink[tail]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(off, start, "right") - 1


def row_counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def shingles(word_hash: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the distinct k-word shingles, ordered by row and hash; a
    text of 1 to k - 1 words has its whole sequence as one, one without words none."""
    count = row_counts(row, n_rows)
    begin = np.concatenate([[0], np.cumsum(count)])
    n = len(word_hash)
    out, at = np.zeros(0, U), np.zeros(0, np.int64)
    if n >= k:
        h = np.full(n - k + 1, U(k))
        for j in range(k):
            h = mix(h * BASE + word_hash[j : n - k + 1 + j])
        whole = row[: n - k + 1] == row[k - 1 :]
        out, at = h[whole], row[: n - k + 1][whole]
    for r in np.flatnonzero((count > 0) & (count < k)):
        h = U(count[r])
        for x in word_hash[begin[r] : begin[r + 1]]:
            h = mix(np.array([h * BASE + x], U))[0]
        out, at = np.append(out, h), np.append(at, r)
    order = np.lexsort((out, at))
    out, at = out[order], at[order]
    if len(out):
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (at[1:] != at[:-1])
        out, at = out[new], at[new]
    return out, at


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that a result column is about to take the name of."""
    gone = [c for c in df.columns if c in names]
    return df.drop(*gone) if gone else df
