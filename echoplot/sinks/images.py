"""Images of recurrence structures and attractors: pixels are grouped counts, a batch shares its brightness."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import output_path
from ..operators import recurrence as R
from ..records import ParameterError
from .tables import _csv, write_file


def recurrence_image(rec: DataFrame, sizes: DataFrame, size: int = 256, pooling: str = "mean") -> DataFrame:
    """subject, row, col, value: share of recurrent cells in each pixel (mean), or whether there is one (max). rec: subject,
    i, j; sizes: subject, n. Pixels without a recurrent cell have no row."""
    if pooling not in ("mean", "max"):
        raise ParameterError("pooling is mean or max")
    # points whose pixel is k: those from ceil(k n / size) to below ceil((k + 1) n / size)
    first = lambda k: F.ceil(k * F.col("n") / size)
    wide = lambda k: first(F.col(k) + 1) - first(F.col(k))
    out = R.image(rec, sizes, size).join(sizes, "subject")
    share = F.col("hits") / (wide("row") * wide("col"))
    return out.select("subject", "row", "col", (share if pooling == "mean" else F.lit(1.0)).alias("value"))


def attractor_image(df: DataFrame, coords: tuple[str, str], size: int = 256, density: bool = True) -> DataFrame:
    """subject, row, col, value: how often a trajectory is in each pixel (or 1), between the 0.001 and 0.999 quantiles of
    each subject's coordinates; points beyond them are in the outer pixels."""
    q = df.groupBy("subject").agg(*[F.percentile(c, F.array(F.lit(0.001), F.lit(0.999))).alias(f"__{k}") for k, c in enumerate(coords)])
    cell = lambda c, k: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(k)[0], F.col(k)[1] - F.col(k)[0]), F.lit(0.0)) * size))).cast("int")
    out = df.join(q, "subject").groupBy("subject", (size - 1 - cell(coords[1], "__1")).alias("row"), cell(coords[0], "__0").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return out if density else out.withColumn("value", F.lit(1.0))


def shared_scale(pixels: DataFrame, quantiles: tuple[float, float] = (0.01, 0.999)) -> tuple[float, float]:
    """Brightness limits of a whole batch."""
    lo, hi = pixels.agg(F.percentile("value", F.array(*[F.lit(q) for q in quantiles]))).first()[0] or (0.0, 1.0)
    return float(lo), float(hi) if hi > lo else float(lo) + 1.0


def png(gray: np.ndarray) -> bytes:
    """A matrix of bytes as a grey PNG."""
    h, w = gray.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def encoded(value: np.ndarray, fmt: str, lo: float, hi: float) -> bytes:
    if fmt == "png":
        return png(np.round(np.clip((value - lo) / (hi - lo), 0, 1) * 255))
    out = io.BytesIO()
    np.save(out, value.astype(np.float32))
    return out.getvalue()


def files_of(pixels: DataFrame, size: int, fmt: str, lo: float, hi: float) -> DataFrame:
    """subject, content: one file an image, made where its pixels meet."""
    if fmt not in ("png", "npy"):
        raise ParameterError("fmt is png or npy")
    kind = dict(pixels.dtypes)["subject"]
    packed = pixels.groupBy("subject").agg(F.collect_list("row").alias("r"), F.collect_list("col").alias("c"), F.collect_list("value").alias("v"))  # size x size at most

    def run(batches):
        for batch in batches:
            out = []
            for r, c, v in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                image = np.zeros((size, size))
                image[np.array(r.as_py()), np.array(c.as_py())] = v.as_py()
                out.append(encoded(image, fmt, lo, hi))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["subject", "content"])

    return packed.mapInArrow(run, f"subject {kind}, content binary")


def export_images(pixels: DataFrame, name: str, size: int = 256, fmt: str = "png", vmin: float | None = None, vmax: float | None = None, quantiles: tuple[float, float] = (0.01, 0.999), labels: DataFrame | None = None) -> DataFrame:
    """Writes an image file for each subject and a table of them; returns the table: subject, file, vmin, vmax, label.
    Files go through the driver one after another."""
    lo, hi = shared_scale(pixels, quantiles)
    lo, hi = (lo if vmin is None else vmin), (hi if vmax is None else vmax)
    spark = pixels.sparkSession
    rows = []
    for r in files_of(pixels, size, fmt, lo, hi).toLocalIterator():
        path = output_path(f"{r.subject}.{fmt}", name)
        write_file(spark, path, bytes(r.content))
        rows.append((str(r.subject), path, lo, hi))
    table = spark.createDataFrame(rows, "subject string, file string, vmin double, vmax double")
    if labels is not None:
        table = table.join(labels.select(F.col("subject").cast("string").alias("subject"), "label"), "subject", "left")
    _csv(table, output_path("images", name), True)
    return table


def export_recurrence_images(rec: DataFrame, sizes: DataFrame, name: str = "recurrence", size: int = 256, pooling: str = "mean", decimate: int = 1, **options) -> DataFrame:
    """Images of all subjects' structures; decimate keeps every so many-th point."""
    if decimate > 1:
        rec = rec.where((F.col("i") % decimate == 0) & (F.col("j") % decimate == 0)).withColumns({"i": F.expr(f"i div {decimate}"), "j": F.expr(f"j div {decimate}")})
        sizes = sizes.withColumn("n", F.ceil(F.col("n") / decimate))
    return export_images(recurrence_image(rec, sizes, size, pooling), name, size, **options)


def export_attractor_images(df: DataFrame, coords: tuple[str, str], name: str = "attractors", size: int = 256, density: bool = True, **options) -> DataFrame:
    return export_images(attractor_image(df, coords, size, density), name, size, **({"quantiles": (0.0, 0.999)} | options))
