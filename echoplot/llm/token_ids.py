"""Token ids as Parquet lists.

Documents are dealt out by ranges of doc_id, sorted, encoded and written: one row per
document with its ids as a list column, an end id after each document. Ids are
dictionary-encoded (a file has few distinct ids, so a value takes its bit width), the
other columns delta- or dictionary-encoded; row groups and pages have a set size and
pages are indexed, so ids of a few documents, or the counts alone, are read without the
rest. Files follow each other in doc_id order and `file_no` names their place.

Null and empty texts are written as the end id alone; null ids come first; rows that
repeat an id stand next to each other, ordered by length and text, and `row_no` tells
their places; a text of any length is one list; other columns of the input are left out;
an empty table gives an empty folder. The tokenizer file is a parameter, read on the
executors.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, read, written
from .tokens import encoder

ROW_GROUP, PAGE = 16 << 20, 1 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, row_group: int = ROW_GROUP, page: int = PAGE) -> DataFrame:
    """Encodes and writes docs; the table as read back: doc_id, file_no int, row_no long (place in the file),
    n_tokens long, ids array<int>."""
    tokenizer = tokenizer or tokenizer_path()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        encode, written_rows = encoder(tokenizer), 0
        for rows, raw, off in chunks(batches, "text"):
            ids, cut = encode(raw, off)
            # the end id goes in at the end of each document
            full = np.insert(ids, cut[1:], end_id).astype(np.int32)
            cut = cut + np.arange(len(cut))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(full))
            place = np.arange(written_rows, written_rows + rows.num_rows)
            written_rows += rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(place), pa.array(np.diff(cut).astype(np.int64)), lists], ["doc_id", "row_no", "n_tokens", "ids"])

    dealt = docs.selectExpr("cast(doc_id as long) as doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.octet_length("text"), "text")
    done = dealt.mapInArrow(run, "doc_id long, row_no long, n_tokens long, ids array<int>").withColumn("file_no", F.spark_partition_id())
    options = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0", "parquet.dictionary.page.size": 2 << 20}
    return written(done.select("doc_id", "file_no", "row_no", "n_tokens", "ids"), "token-ids", **{k: str(v) for k, v in options.items()})


def digests(table: DataFrame) -> DataFrame:
    """From the written ids alone: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat, cut = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy()
            cut = cut - (cut[0] if len(cut) else 0)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(cut).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file_no", "row_no", "n_tokens", "ids_crc32"])

    slim = table.select("doc_id", "file_no", "row_no", "ids").mapInArrow(run, "doc_id long, file_no int, row_no long, n_tokens long, ids_crc32 long")
    # a row for each file
    sums = table.groupBy("file_no").agg(F.sum("n_tokens").alias("__n"))
    before = sums.select(F.col("file_no").alias("__f"), (F.sum("__n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = slim.withColumn("__in", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return rows.join(before, F.col("file_no") == F.col("__f")).select("doc_id", (F.col("__before") + F.col("__in")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    return digests(write_tokens(read(spark, sf_dir, "documents")))


QUERIES = {"op7_token_ids": op7_token_ids}
ORACLES: dict[str, str] = {}
