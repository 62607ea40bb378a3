"""Recurrence structures as similarity self-joins, and their quantification.

Relational path: pairs are an equi-join on the subject with the Theiler band as a residual
condition, thresholds are grouped quantiles, lines are gaps and islands. Kernel path: one
grouped numpy kernel a subject, which never holds a pair table (see functions.kernels).
Spread path: the same kernels over strips of a subject, for records of very many points.
All give the same histograms. Distances are rounded at 9 digits before they are compared,
so that ties fall alike on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.units import dealt, per_unit, whole_units
from ..records import ParameterError

METRICS = ("euclidean", "chebyshev", "manhattan", "cosine")
DIGITS = 9


def distance(a: list[Column], b: list[Column], metric: str = "euclidean") -> Column:
    if metric not in METRICS:
        raise ParameterError(f"metric must be one of {METRICS}")
    d = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    if metric == "chebyshev":
        return F.greatest(*d) if len(d) > 1 else d[0]
    if metric == "manhattan":
        return sum(d[1:], d[0])
    if metric == "cosine":
        dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
        norm = F.sqrt(sum((x * x for x in a), F.lit(0.0))) * F.sqrt(sum((y * y for y in b), F.lit(0.0)))
        return F.when(norm > 0, 1 - dot / norm).otherwise(1.0)
    return F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0])) if len(d) > 1 else d[0]


def array_distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Between array columns."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    add = lambda s, v: s + v
    if metric == "chebyshev":
        return F.array_max(diff)
    if metric == "manhattan":
        return F.aggregate(diff, F.lit(0.0), add)
    if metric == "cosine":
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
        norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
        return F.when((norm(a) > 0) & (norm(b) > 0), 1 - dot / (norm(a) * norm(b))).otherwise(1.0)
    return F.sqrt(F.aggregate(F.transform(diff, lambda x: x * x), F.lit(0.0), add))


def pairs(points: DataFrame, coords: list[str], theiler: int = 1, metric: str = "euclidean", other: DataFrame | None = None, tile: int | None = None) -> DataFrame:
    """subject, i, j, d of all admissible ordered pairs; `other` makes it a cross structure without a band.

    With `tile`, squares of tile x tile pairs are the keys of the join, so that a long record spreads over tasks; each
    point is sent once for each of its record's tiles."""
    second = other if other is not None else points
    right = second.select(F.col("subject").alias("s2"), F.col("i").alias("j"), *[F.col(c).alias(f"{c}_2") for c in coords])
    left = points.select("subject", "i", *coords)
    on = F.col("subject") == F.col("s2")
    if tile:
        top = lambda df: df.groupBy(F.col("subject").alias("__s")).agg(F.expr(f"int(max(i) div {tile})").alias("__top"))
        every = lambda df, key, tops: df.join(tops, F.col(key) == F.col("__s")).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__top")))).drop("__s", "__top")
        left = every(left, "subject", top(second)).withColumn("__a", F.expr(f"int(i div {tile})")).withColumnRenamed("__o", "__b")
        right = every(right, "s2", top(points)).withColumn("__d", F.expr(f"int(j div {tile})")).withColumnRenamed("__o", "__c")
        on = on & (F.col("__a") == F.col("__c")) & (F.col("__b") == F.col("__d"))
    if other is None and theiler > 0:
        on = on & (F.abs(F.col("i") - F.col("j")) >= theiler)
    d = distance([F.col(c) for c in coords], [F.col(f"{c}_2") for c in coords], metric)
    return left.join(right, on).select("subject", "i", "j", F.round(d, DIGITS).alias("d"))


def cosine_pairs(vectors: DataFrame, key: str, index: str, vector: str, digits: int = 6, block: int = 1024, cells: int = 1 << 16) -> DataFrame:
    """i, j, d: the cosine distance of every two rows of a key, i < j, rounded half up; null where a vector is missing, holds
    a null, or the two have different lengths.

    Keys of more than `block` rows are dealt into blocks of about that many, and each two blocks meet in a unit of their own:
    a row is sent once for each block of its key, and neither a key nor its pairs are held by one task."""
    import numpy as np
    import pyarrow as pa

    kind = dict(vectors.dtypes)[index]
    rows = vectors.where(F.col(key).isNotNull() & F.col(index).isNotNull()).select(F.col(key).alias("k"), F.col(index).alias("i"), F.col(vector).alias("x"))
    # at most rows / block keys
    large = rows.groupBy(F.col("k").alias("__k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("__k", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    told = rows.join(F.broadcast(large), F.col("k") == F.col("__k"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    told = told.withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = told.select("k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "i", "x")
    unit = ("k", "p", "q")

    def by_length(x, at):
        """length -> rows and their vectors; rows of no use are of length -1."""
        x = x.take(pa.array(at))
        size = x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        if x.values.null_count:
            size = np.array([-1 if v is None or None in v else len(v) for v in x.to_pylist()])
        out = {}
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            out[int(n)] = at[own], x.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), n) if n >= 0 else None
        return out

    def distances(one, two, same):
        """Rows r, s and d of the pairs of two tables, some rows of the first at a time."""
        for n, (r, a) in one.items():
            for m, (s, b) in two.items():
                step = max(1, cells // len(s))
                for at in range(0, len(r), step):
                    low = at if same and n == m else 0  # rows come in the order of their ids
                    to = min(len(r), at + step)
                    d = kernels.cosine_square(a[at:to], b[low:]) if n == m >= 0 else None
                    yield r[at:to], s[low:], None if d is None else np.floor(d * 10**digits + 0.5) / 10**digits

    def run(batches):
        for t, cuts in whole_units(batches, unit):
            ids, own, p, q = (t[c].to_numpy() for c in ("i", "own", "p", "q"))
            x = t["x"].combine_chunks()
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                here, same = np.arange(at, to), p[at] == q[at]
                one = by_length(x, here[own[at:to] == p[at]])
                two = one if same else by_length(x, here[own[at:to] == q[at]])
                for r, s, d in distances(one, two, same):
                    i, j = ids[r][:, None], ids[s][None, :]
                    wanted = i < j if same else i != j
                    count = int(wanted.sum())
                    d = pa.nulls(count, pa.float64()) if d is None else pa.array(d[wanted])
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)[wanted]), pa.array(np.maximum(i, j)[wanted]), d], ["i", "j", "d"])

    return dealt(met, *unit).sortWithinPartitions(*unit, "own", "i").mapInArrow(run, f"i {kind}, j {kind}, d double")


MODES = ("fixed", "target_rr", "percentile", "std_fraction", "maxdist_fraction", "fan", "adaptive_dim")


def threshold(pair: DataFrame, mode: str = "target_rr", target_rr: float = 0.05, value: float | None = None, percentile: float | None = None, factor: float = 0.1, k: int = 20, points: DataFrame | None = None, coords: list[str] | None = None, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """eps for each key (for `fan`, for each point as well)."""
    if mode not in MODES:
        raise ParameterError(f"mode must be one of {MODES}")
    by = pair.groupBy(*keys)
    if mode == "fixed":
        return by.agg(F.lit(float(value)).alias("eps"))
    if mode in ("target_rr", "percentile", "adaptive_dim"):
        q = target_rr if mode != "percentile" else percentile / 100
        out = by.agg(F.round(F.percentile("d", F.lit(q)), DIGITS).alias("eps"))
        if mode == "adaptive_dim":  # how much of the cloud's extent the threshold spans
            radius = points.groupBy(*keys).agg(F.sqrt(sum((F.var_pop(c) for c in coords), F.lit(0.0))).alias("radius"))
            out = out.join(radius, list(keys)).withColumn("eps_over_radius", F.when(F.col("radius") > 0, F.col("eps") / F.col("radius")))
        return out
    if mode == "maxdist_fraction":
        return by.agg(F.round(F.max("d") * factor, DIGITS).alias("eps"))
    if mode == "std_fraction":
        return points.groupBy(*keys).agg(F.round(factor * F.sqrt(sum((F.var_pop(c) for c in coords), F.lit(0.0))), DIGITS).alias("eps"))
    rank = F.row_number().over(Window.partitionBy(*keys, "i").orderBy("d", "j"))
    return pair.where("i <> j").withColumn("r", rank).where(F.col("r") == k).select(*keys, "i", F.col("d").alias("eps"))


def recurrent(pair: DataFrame, eps: DataFrame, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Pairs with d <= eps."""
    on = [*keys, "i"] if "i" in eps.columns else list(keys)
    return pair.join(eps.select(*on, "eps"), on).where("d <= eps").select(*keys, "i", "j")


def rate(pair: DataFrame, eps: DataFrame, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    return pair.join(eps, list(keys)).groupBy(*keys).agg(F.first("eps").alias("eps"), F.count(F.lit(1)).alias("n_pairs"), F.sum((F.col("d") <= F.col("eps")).cast("long")).alias("n_recurrent")).withColumn("rr", F.col("n_recurrent") / F.col("n_pairs"))


def joint(parts: list[DataFrame], keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Pairs recurrent in every part."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, [*keys, "i", "j"])
    return out


def _islands(rec: DataFrame, keys: list[str], along: str) -> DataFrame:
    g = F.col(along) - F.row_number().over(Window.partitionBy(*keys).orderBy(along))
    return rec.withColumn("g", g).groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("length"))


def block_pairs(points: DataFrame, blocks: dict[str, list[str]], theiler: int = 1, metric: str = "euclidean") -> DataFrame:
    """subject, i, j and one distance for each block of coordinates: one join for a joint structure."""
    cs = [c for b in blocks.values() for c in b]
    right = points.select(F.col("subject").alias("s2"), F.col("i").alias("j"), *[F.col(c).alias(f"{c}_2") for c in cs])
    on = F.col("subject") == F.col("s2")
    if theiler > 0:
        on = on & (F.abs(F.col("i") - F.col("j")) >= theiler)
    d = [F.round(distance([F.col(c) for c in b], [F.col(f"{c}_2") for c in b], metric), DIGITS).alias(name) for name, b in blocks.items()]
    return points.select("subject", "i", *cs).join(right, on).select("subject", "i", "j", *d)


def joint_rates(pair: DataFrame, blocks: tuple[str, str], target_rr: float, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """keys, n, a, b, c: pairs, recurrent pairs of each block at its own threshold, and of both."""
    u, v = blocks
    eps = pair.groupBy(*keys).agg(*[F.round(F.percentile(x, F.lit(target_rr)), DIGITS).alias(f"__{x}") for x in blocks])
    a, b = F.col(u) <= F.col(f"__{u}"), F.col(v) <= F.col(f"__{v}")
    return pair.join(eps, list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a & b).alias("c"))


def line_histogram(rec: DataFrame, sizes: DataFrame, theiler: int = 1, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """keys, kind, length, cnt. sizes: keys and n (points of the unit)."""
    k = list(keys)
    diagonal = _islands(rec.withColumn("k", F.col("j") - F.col("i")), [*k, "k"], "i").groupBy(*k, "length").agg(F.count(F.lit(1)).alias("cnt")).withColumn("kind", F.lit("diagonal"))
    vertical = _islands(rec, [*k, "j"], "i").groupBy(*k, "length").agg(F.count(F.lit(1)).alias("cnt")).withColumn("kind", F.lit("vertical"))
    # white lines: gaps between markers of a column; one that touches the band is none
    width = F.col("m") if "m" in sizes.columns else F.col("n")  # a cross structure has columns of its own
    column = sizes.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), width - 1)))
    marks = rec.select(*k, "i", "j", F.lit(0).alias("band"))
    marks = marks.union(column.select(*k, F.lit(-1).cast("long"), "j", F.lit(0))).union(column.select(*k, F.col("n"), "j", F.lit(0)))
    if theiler > 0:
        marks = marks.union(column.select(*k, F.greatest(F.col("j") - (theiler - 1), F.lit(0)), "j", F.lit(1))).union(column.select(*k, F.least(F.col("j") + (theiler - 1), F.col("n") - 1), "j", F.lit(1)))
    w = Window.partitionBy(*k, "j").orderBy("i", "band")
    # dealt anew: the parts of the union may lie apart though each is dealt by the keys
    gaps = marks.repartition(*k, "j").withColumn("length", F.lead("i").over(w) - F.col("i") - 1).withColumn("next", F.lead("band").over(w)).where("length > 0 and band = 0 and next = 0")
    white = gaps.groupBy(*k, "length").agg(F.count(F.lit(1)).alias("cnt")).withColumn("kind", F.lit("white_vertical"))
    return diagonal.unionByName(vertical).unionByName(white).select(*k, "kind", F.col("length").cast("long"), "cnt")


def _line_stats(l_min: int, v_min: int, w_min: int) -> list[Column]:
    """Aggregates of histogram rows: points, lines, longest and entropy of each kind, at its floor."""
    out = []
    for kind, a, low in (("diagonal", "d", l_min), ("vertical", "v", v_min), ("white_vertical", "w", w_min)):
        of = lambda x, kind=kind, low=low: F.when((F.col("kind") == kind) & (F.col("length") >= low), x)
        lines = F.sum(of(F.col("cnt")))
        # -sum(p ln p) with p = cnt / lines, in one pass
        entropy = F.greatest(F.log(lines) - F.sum(of(F.col("cnt") * F.log("cnt"))) / lines, F.lit(0.0))
        out += [F.sum(of(F.col("length") * F.col("cnt"))).alias(f"{a}_points"), lines.alias(f"{a}_lines"), F.max(of(F.col("length"))).alias(f"{a}_longest"), entropy.alias(f"{a}_entropy")]
    return out


def quantify(hist: DataFrame, sizes: DataFrame | None = None, l_min: int = 2, v_min: int = 2, w_min: int = 2, keys: tuple[str, ...] = ("subject",), identity: DataFrame | None = None) -> DataFrame:
    """The measures of each unit, in one aggregation of its histogram. sizes: keys, n_pairs, n_recurrent;
    without it, the histogram's rows of kind `pairs` and `recurrent` tell them. identity (keys, n): DET and LAM are
    shares of the recurrent cells and the n cells of the line of identity, which the band leaves out."""
    k = list(keys)
    stats = _line_stats(l_min, v_min, w_min)
    if sizes is None:
        stats += [F.sum(F.when(F.col("kind") == kind, F.col("cnt"))).alias(f"n_{kind}") for kind in ("pairs", "recurrent")]
    out = hist.groupBy(*k).agg(*stats)
    if sizes is not None:
        out = sizes.join(out, k, "left")
    whole = F.col("n_recurrent")
    if identity is not None:
        out, whole = out.join(identity.select(*k, F.col("n").alias("__n")), k), F.col("n_recurrent") + F.col("__n")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    spread = lambda c, low: F.when(z(f"{c}_longest") - low + 1 > 1, z(f"{c}_entropy") / F.log(z(f"{c}_longest") - low + 1)).otherwise(0.0)
    return out.select(
        *k,
        F.when(F.col("n_pairs") > 0, F.col("n_recurrent") / F.col("n_pairs")).alias("RR"),  # no pairs, no rate
        ratio(z("d_points"), whole).alias("DET"),
        ratio(z("d_points"), z("d_lines")).alias("L"),
        z("d_longest").alias("Lmax"),
        F.when(z("d_longest") > 0, 1 / z("d_longest")).otherwise(F.lit(float("inf"))).alias("DIV"),
        z("d_entropy").alias("ENTR"),
        spread("d", l_min).alias("ENTR_norm"),
        ratio(z("v_points"), whole).alias("LAM"),
        ratio(z("v_points"), z("v_lines")).alias("TT"),
        z("v_longest").alias("Vmax"),
        ratio(z("w_points"), z("w_lines")).alias("W"),
        z("w_longest").alias("Wmax"),
        z("w_entropy").alias("ENTW"),
        spread("w", w_min).alias("RTE"),
    )


def unit_sizes(points: DataFrame, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def kernel_threshold(points: DataFrame, coords: list[str], target_rr: float = 0.05, theiler: int = 1, keys: tuple[str, ...] = ("subject",), metric: str = "euclidean") -> DataFrame:
    """keys, eps by the kernel: the exact quantile of a unit's pair distances, no pair of which is a row."""
    run = lambda x: [(kernels.pair_quantile(x, target_rr, theiler, metric),)] if len(x) > max(theiler, 1) else []
    return per_unit(points, keys, coords, run, "eps double")


def kernel_histogram(points: DataFrame, coords: list[str], target_rr: float = 0.05, theiler: int = 1, keys: tuple[str, ...] = ("subject",), metric: str = "euclidean") -> DataFrame:
    """Kernel path: keys, kind, length, cnt, and rows of kind `pairs` and `recurrent` with their counts; eps on each row."""
    run = lambda x: kernels.recurrence_histogram(x, target_rr, theiler, metric)
    return per_unit(points, keys, coords, run, "kind string, length long, cnt long, eps double")


def _strips(points: DataFrame, coords: list[str], keys: tuple[str, ...], strips: int, run, fields: str, beside: DataFrame | None = None) -> DataFrame:
    """keys and `fields` from run(points x coords, strip, row of `beside`) of each unit and strip. A unit's points are one row,
    which goes to as many tasks as there are strips."""
    import numpy as np
    import pyarrow as pa

    whole = points.select(*keys, "i", *coords).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", *coords))).alias("__x"))
    extra = []
    if beside is not None:
        extra = [c for c in beside.columns if c not in keys]
        whole = whole.join(beside, list(keys))
    dealt = whole.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))).select(*keys, "__s", *extra, "__x")
    n_tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n_tasks, "__s", *keys)
    types = dict(points.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + fields
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    arrow = [kinds[f.split()[1]] for f in fields.split(", ")]
    n_keys, n_extra = len(keys), len(extra)

    def walk(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column(n_keys + 1 + n_extra)[r].values
                x = np.column_stack([own.field(c).to_numpy(zero_copy_only=False).astype(float) for c in coords])
                told = {c: batch.column(n_keys + 1 + k)[r].as_py() for k, c in enumerate(extra)}
                got = run(x, batch.column(n_keys)[r].as_py(), told)
                at = pa.array(np.full(len(got[0]), r))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(n_keys)), *(pa.array(g, t) for g, t in zip(got, arrow, strict=True))], [*keys, *names])

    return dealt.mapInArrow(walk, schema)


def spread_threshold(points: DataFrame, coords: list[str], target_rr: float, theiler: int = 1, keys: tuple[str, ...] = ("subject",), metric: str = "euclidean", strips: int = 32, bins: int = 1 << 16) -> DataFrame:
    """keys, eps: the exact quantile of the admissible pairs' distances, each unit's diagonals dealt over strips. Counts
    in even bins up to the widest distance that the coordinates allow find the bins that hold the quantile; distances in
    these are then counted one by one."""
    import numpy as np

    low = max(theiler, 1)
    k = list(keys)

    def spans(x, strip):
        for d in range(low + strip, len(x), strips):
            yield np.round(kernels.gap(x[d:], x[:-d], metric), DIGITS)

    def widest(x):
        if metric == "cosine":
            return 2.0
        return float(kernels.gap(x.max(0)[None], x.min(0)[None], metric)[0]) * (1 + 1e-9) + 10.0**-DIGITS

    def count(x, strip, _):
        width, found = widest(x) / bins, np.zeros(bins, np.int64)
        for d in spans(x, strip):
            found += 2 * np.bincount(np.minimum((d / width).astype(np.int64), bins - 1), minlength=bins)
        if theiler == 0 and strip == 0:
            found[0] += len(x)
        at = np.flatnonzero(found)
        return at, found[at], np.full(len(at), width)

    counts = _strips(points, coords, keys, strips, count, "bin long, n long, width double").groupBy(*k, "bin").agg(F.sum("n").alias("n"), F.first("width").alias("width"))
    upto = Window.partitionBy(*k).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*k)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(every)})
    at = F.lit(target_rr) * (F.col("total") - 1)
    first = F.floor(at)
    ranked = ranked.withColumns({"first": first, "last": F.least(first + 1, F.col("total") - 1), "share": at - first})
    holds = lambda r: (F.col("upto") > F.col(r)) & (F.col("upto") - F.col("n") <= F.col(r))
    wanted = ranked.groupBy(*k).agg(F.min(F.when(holds("first"), F.col("bin"))).alias("lo"), F.max(F.when(holds("last"), F.col("bin"))).alias("hi"), F.min(F.when(holds("first"), F.col("upto") - F.col("n"))).alias("below"), F.first("first").alias("first"), F.first("last").alias("last"), F.first("share").alias("share"), F.first("width").alias("width"))

    def inside(x, strip, told):
        found: dict[float, int] = {}
        for d in spans(x, strip):
            b = np.minimum((d / told["width"]).astype(np.int64), bins - 1)
            for v, c in zip(*np.unique(d[(b >= told["lo"]) & (b <= told["hi"])], return_counts=True), strict=True):
                found[v] = found.get(v, 0) + 2 * int(c)
        if theiler == 0 and strip == 0 and told["lo"] == 0:
            found[0.0] = found.get(0.0, 0) + len(x)
        return list(found), list(found.values())

    values = _strips(points, coords, keys, strips, inside, "d double, n long", wanted.select(*k, "lo", "hi", "width")).groupBy(*k, "d").agg(F.sum("n").alias("n"))
    placed = values.withColumn("upto", F.sum("n").over(Window.partitionBy(*k).orderBy("d").rowsBetween(Window.unboundedPreceding, 0))).join(wanted, k).withColumn("upto", F.col("upto") + F.col("below"))
    got = placed.groupBy(*k).agg(F.min(F.when(F.col("upto") > F.col("first"), F.col("d"))).alias("a"), F.min(F.when(F.col("upto") > F.col("last"), F.col("d"))).alias("b"), F.first("share").alias("share"))
    return got.select(*k, F.round(F.col("a") + (F.col("b") - F.col("a")) * F.col("share"), DIGITS).alias("eps"))


def spread_histogram(points: DataFrame, coords: list[str], target_rr: float = 0.05, theiler: int = 1, keys: tuple[str, ...] = ("subject",), metric: str = "euclidean", strips: int = 32) -> DataFrame:
    """The same rows as kernel_histogram, with each unit's diagonals and columns dealt over `strips` tasks: for units of so
    many points that one task would take long. A task holds a unit's points and some columns, never a matrix."""
    import numpy as np

    eps = spread_threshold(points, coords, target_rr, theiler, keys, metric, strips)

    def lines(x, strip, told):
        n, e = len(x), told["eps"]
        diagonal, recurrent = kernels.diagonal_histogram(x, range(max(theiler, 1) + strip, n, strips), e, metric)
        if theiler == 0 and strip == 0:
            recurrent += n
            diagonal[n] += 1
        vertical, white = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        width = kernels.strip_width(n, x.shape[1])
        for at in range(strip * width, n, strips * width):
            v, w = kernels.column_histogram(x, at, min(n, at + width), e, theiler, metric)
            vertical += v
            white += w
        cells = n * n - sum((n if d == 0 else 2 * (n - d)) for d in range(min(theiler, n))) if strip == 0 else 0
        kinds, lengths, counts = [], [], []
        for kind, h in (("diagonal", diagonal), ("vertical", vertical), ("white_vertical", white)):
            at = np.flatnonzero(h)
            at = at[at > 0]
            kinds += [kind] * len(at)
            lengths += at.tolist()
            counts += h[at].tolist()
        return [*kinds, "pairs", "recurrent"], [*lengths, 0, 0], [*counts, cells, recurrent]

    each = _strips(points, coords, keys, strips, lines, "kind string, length long, cnt long", eps)
    return each.groupBy(*keys, "kind", "length").agg(F.sum("cnt").alias("cnt")).join(eps, list(keys)).select(*keys, "kind", "length", "cnt", "eps")


def rqa(points: DataFrame, coords: list[str], target_rr: float = 0.05, theiler: int = 1, l_min: int = 2, v_min: int = 2, w_min: int = 2, keys: tuple[str, ...] = ("subject",), path: str = "kernel", denominator: str = "theiler_corrected") -> DataFrame:
    """Threshold by recurrence rate, histograms, measures. denominator="all" counts the line of identity as recurrent,
    where the band leaves it out."""
    if denominator not in ("theiler_corrected", "all"):
        raise ParameterError(f"unknown denominator {denominator!r}")
    identity = unit_sizes(points, keys) if denominator == "all" and theiler > 0 else None
    if path in ("kernel", "spread"):
        hist = kernel_histogram if path == "kernel" else spread_histogram
        return quantify(hist(points, coords, target_rr, theiler, keys), None, l_min, v_min, w_min, keys, identity)
    pair = pairs(points, coords, theiler)
    eps = threshold(pair, "target_rr", target_rr, keys=keys)
    hist = line_histogram(recurrent(pair, eps, keys), unit_sizes(points, keys), theiler, keys)
    return quantify(hist, rate(pair, eps, keys).select(*keys, "n_pairs", "n_recurrent"), l_min, v_min, w_min, keys, identity)


def sweep(hist: DataFrame, totals: DataFrame | None = None, floors=(2, 3, 4, 6, 8), keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """DET and LAM at several line floors from one histogram, with their headroom. totals: keys,
    n_recurrent; without it, the histogram's rows of kind `recurrent` tell it."""
    of = lambda kind, f: F.sum(F.when((F.col("kind") == kind) & (F.col("length") >= f), F.col("length") * F.col("cnt")).otherwise(0))
    cells = [F.struct(F.lit(f).alias("floor"), of("diagonal", f).alias("d"), of("vertical", f).alias("v")) for f in floors]
    total = F.sum(F.when(F.col("kind") == "recurrent", F.col("cnt")))
    out = hist.groupBy(*keys).agg(F.array(*cells).alias("x"), *([total.alias("n_recurrent")] if totals is None else []))
    if totals is not None:
        out = out.join(totals.select(*keys, "n_recurrent"), list(keys))
    out = out.where("n_recurrent > 0").select(*keys, "n_recurrent", F.explode("x").alias("x")).select(*keys, "n_recurrent", "x.*")
    det, lam = F.col("d") / F.col("n_recurrent"), F.col("v") / F.col("n_recurrent")
    return out.select(*keys, "floor", det.alias("DET"), lam.alias("LAM"), F.least(det, 1 - det).alias("DET_headroom"))


def diagonal_profile(rec: DataFrame, n_rows: DataFrame, max_offset: int, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Recurrence density at each offset j - i of a cross structure. n_rows: keys, n, m."""
    offsets = n_rows.withColumn("k", F.explode(F.sequence(F.lit(-max_offset), F.lit(max_offset)))).withColumn("cells", F.least(F.col("n"), F.col("m") - F.col("k")) - F.greatest(F.lit(0), -F.col("k"))).where("cells > 0")
    count = rec.withColumn("k", (F.col("j") - F.col("i")).cast("int")).groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("hits"))
    return offsets.join(count, [*keys, "k"], "left").select(*keys, "k", "cells", (F.coalesce("hits", F.lit(0)) / F.col("cells")).alias("density"))


def image(rec: DataFrame, sizes: DataFrame, size: int = 16, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Density of recurrence in size x size cells of each unit's square."""
    cell = lambda c: F.expr(f"({c} * {size}) div n").cast("int")
    return rec.join(sizes, list(keys)).groupBy(*keys, cell("i").alias("row"), cell("j").alias("col")).agg(F.count(F.lit(1)).alias("hits"))
