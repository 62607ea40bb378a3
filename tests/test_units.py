import numpy as np
from pyspark.sql import functions as F

from echoplot.functions.units import per_unit


def test_units_are_whole_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(120).select(F.when(F.col("id") % 5 < 3, F.col("id") % 5).alias("subject"), (-F.col("id")).alias("i"), F.when(F.col("id") != 4, F.col("id").cast("double")).alias("v"))
        run = lambda x: [(len(x), float(np.nansum(x)), bool((np.diff(x[~np.isnan(x[:, 0]), 0]) < 0).all()) * 1)]
        got = sorted(per_unit(df, ("subject",), ["v"], run, "n long, s double, falls long").collect(), key=str)
        want = sorted(df.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.lit(1).alias("falls")).collect(), key=str)
        assert [tuple(r) for r in got] == [tuple(r) for r in want]
        assert per_unit(df.limit(0), ("subject",), ["v"], run, "n long, s double, falls long").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
