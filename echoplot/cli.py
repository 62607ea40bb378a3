"""python -m echoplot.cli doctor | figures | generate"""

from __future__ import annotations

import argparse

from . import config


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="echoplot")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor", help="what is installed")
    sub.add_parser("figures", help="figures and what they show")
    g = sub.add_parser("generate", help="a synthetic corpus as Parquet")
    g.add_argument("path")
    g.add_argument("--modality", default="pac")
    g.add_argument("--units", type=int, default=1)
    g.add_argument("--duration", type=float, default=20.0)
    g.add_argument("--fs", type=float, default=500.0)
    g.add_argument("--seed", type=int, default=0)
    a = top.parse_args(argv)
    if a.command == "figures":
        from .plans import figures

        print(figures.list_figures())
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("echoplot").getOrCreate()
    if a.command == "doctor":
        for r in config.doctor(spark).collect():
            print(f"{r.backend}: {'there' if r.available else 'missing'} ({r.serves})")
        return 0
    from .sources import generators

    made = generators.generate_corpus(spark, {"modality": [a.modality]}, a.units, a.seed, duration=a.duration, fs=a.fs)
    made.record.df.write.mode("overwrite").parquet(a.path)
    made.truth.write.mode("overwrite").parquet(a.path.rstrip("/") + "_truth")
    print(a.path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
