"""Headline queries on local[BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ("rqa_all", "rqa_relational", "rqa_sweep", "windowed_rqa_per_window", "eps_target_rr", "jrp_independence", "crp_profile", "sample_entropy", "mi_tort", "dfa_fluct", "corr_sum", "kernel_measures", "group_comparison")


def scale_runs(spark) -> list:
    """Structures at published sizes: one trajectory of 15,000 points, and 19 windows of one of 34,000. Trajectories are made beforehand."""
    from echoplot.operators import recurrence as R
    from echoplot.operators import windowed as W
    from echoplot.sources import generators as G

    folder = tempfile.mkdtemp(prefix="bench-")
    G.generate_system(spark, "lorenz", 34_000, transient=1000).write.parquet(folder + "/lorenz")
    df, xyz = spark.read.parquet(folder + "/lorenz"), ["x", "y", "z"]
    short = df.where("i < 15000")
    windows = lambda: W.in_windows(df, W.WindowSpec(n_windows=19, overlap=0.5).grid(R.unit_sizes(df)))
    return [("rqa_15000_points", lambda: R.rqa(short, xyz, 0.05, l_min=8, v_min=8, path="spread")), ("rqa_34000_points_19_windows", lambda: R.rqa(windows(), xyz, 0.05, l_min=8, v_min=8, keys=("subject", "window"), path="spread"))]


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from echoplot.plans import catalogue

    out = {}
    for name, run in [(n, lambda n=n: catalogue.QUERIES[n](spark, sf_dir)) for n in HEADLINE] + scale_runs(spark):
        begun = time.time()
        run().write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - begun, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
