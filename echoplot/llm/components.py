"""Connected components of a link table by alternating large and small stars.

Every round is two grouped minima and two joins on the link table alone; it is written
to the shared folder, and nothing but a checksum comes to the driver. Rounds grow with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


HUBS, HUB = 100_000, 256
#: edges a written part holds, about: small tables then have few tasks a round
PART = 20_000


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """edges plus m of their node a. least: u, m, degree. Nodes of many edges would be hot keys of the
    join: they are sent to all tasks instead. At most HUBS nodes can have so many, whatever the input."""
    limit = max(HUB, 2 * n_edges // HUBS)
    hubs = F.broadcast(least.where(F.col("degree") > limit).select(F.col("u").alias("h"), F.col("m").alias("hm")))
    told = edges.join(hubs, F.col("a") == F.col("h"), "left")
    near = told.where("h is null").select("a", "b").join(least.where(F.col("degree") <= limit).select("u", "m").hint("merge"), F.col("a") == F.col("u")).select("a", "b", "m")
    return near.union(told.where("h is not null").select("a", "b", F.col("hm").alias("m")))


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """edges (a, b), a > b. Large: a node's larger neighbours go to its least neighbour;
    small: it and its smaller neighbours do."""
    degree = F.count(F.lit(1)).alias("degree")
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), degree).select(F.col("a").alias("u"), "m", "degree")
        out = _with_least(both.where("b > a"), least, n_edges).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), degree).select(F.col("a").alias("u"), "m", "degree")
        out = _with_least(edges, least, n_edges).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least member) for every node of links (a, b); null ends are dropped."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n_tasks, before = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        # a large star makes no more edges than it is given
        parts = int(min(n_tasks, -(-now[0] // PART)))
        half = written(_star(edges, True, now[0]).coalesce(parts), "edges")
        new = written(_star(half, False, now[0]).coalesce(parts), "edges")
        forget(edges, half)
        edges, before = new, now
    # a star for each component: every node but the centre points to it
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
