"""Queries by name and the SQL that each must agree with."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import comparability as K
from ..operators import dynamics as D
from ..operators import inference as I
from ..operators import meta as M
from ..operators import recurrence as R
from ..operators import series as S
from ..records import events
from ..streaming import windows as W

QUERIES: dict = {}
ORACLES: dict = {}
RR, FLOORS, SHIFTS, SIZE, STEP = 0.10, (2, 3, 4, 6, 8), [7, 13, 21, 29], 20, 10

_PTS = """pts AS (SELECT user_id AS subject, CAST(row_number() OVER w - 1 AS BIGINT) AS i, value, epoch_us(ts) AS us,
 coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0.0) AS gap,
 2 * pi() * ((epoch_us(ts) % 86400000000) / 86400000000.0::DOUBLE) - pi() AS phase
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_PAIRS = "pairs AS (SELECT a.subject, a.i, b.i AS j, round(abs(a.value - b.value), 9) AS d FROM pts a JOIN pts b ON a.subject = b.subject AND abs(a.i - b.i) >= 1)"
_EPS = f"eps AS (SELECT subject, round(quantile_cont(d, {RR}), 9) AS eps FROM pairs GROUP BY subject)"
_REC = "rec AS (SELECT p.subject, p.i, p.j FROM pairs p JOIN eps e USING (subject) WHERE p.d <= e.eps)"
_DIAG = "dg AS (SELECT subject, count(*) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY subject, j - i ORDER BY i) AS g FROM rec) GROUP BY subject, j - i, g)"
_VERT = "vt AS (SELECT subject, count(*) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY subject, j ORDER BY i) AS g FROM rec) GROUP BY subject, j, g)"
_WHITE = """sz AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), cl AS (SELECT p.subject, p.i AS j, n FROM pts p JOIN sz USING (subject)),
mk AS (SELECT subject, i, j, 0 AS band FROM rec UNION ALL SELECT subject, -1, j, 0 FROM cl UNION ALL SELECT subject, n, j, 0 FROM cl UNION ALL SELECT subject, j, j, 1 FROM cl UNION ALL SELECT subject, j, j, 1 FROM cl),
wh AS (SELECT subject, length FROM (SELECT subject, band, lead(i) OVER w - i - 1 AS length, lead(band) OVER w AS nb FROM mk WINDOW w AS (PARTITION BY subject, j ORDER BY i, band)) WHERE length > 0 AND band = 0 AND nb = 0)"""
_CORE = f"WITH {_PTS}, {_PAIRS}, {_EPS}, {_REC}"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def rounded(df, digits: int = 6):
    """Doubles at a set number of digits, as results of different engines are compared."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def points(spark, d):
    return events(spark, d).df


def parts(spark, d):
    """Points, pairs, thresholds, recurrent pairs of the value channel."""
    pts = points(spark, d)
    pair = R.pairs(pts, ["value"], 1)
    eps = R.threshold(pair, "target_rr", RR)
    return pts, pair, eps, R.recurrent(pair, eps)


def simple(name: str, sql: str, build):
    query(name, f"WITH {_PTS} {sql}")(lambda spark, d: rounded(build(points(spark, d))))


simple("channel_stats", "SELECT subject, 'value' AS channel, count(*) AS n_samples, CAST(sum((value IS NULL)::INT) AS BIGINT) AS n_missing, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM pts GROUP BY subject", lambda p: S.channel_stats(p.select("subject", "i", "value").unpivot(["subject", "i"], ["value"], "channel", "value")))
simple("quality_check", """, s AS (SELECT subject, count(*) AS n, count(*) - count(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM pts GROUP BY subject),
e AS (SELECT p.subject, sum((value = lo)::INT) AS a, sum((value = hi)::INT) AS b FROM pts p JOIN s USING (subject) GROUP BY p.subject)
SELECT subject, 'value' AS channel, n AS n_samples, m AS n_missing, m > 0.01 * n AS nonfinite_error, sd = 0 AS constant, greatest(a, b) > greatest(3.0, n * 0.05) AND sd > 0 AS saturation FROM s JOIN e USING (subject)""", lambda p: S.quality(p.select("subject", "i", "value").unpivot(["subject", "i"], ["value"], "channel", "value")))
@query("infer_fs", f"WITH {_PTS} SELECT subject, round(1 / quantile_cont(gap, 0.5), 9) AS fs, round(stddev_pop(gap) / avg(gap), 6) AS jitter FROM pts WHERE i > 0 GROUP BY subject HAVING quantile_cont(gap, 0.5) > 0")
def _fs(spark, d):
    g = points(spark, d).where("i > 0").groupBy("subject")
    out = g.agg(F.percentile("gap", F.lit(0.5)).alias("gap"), F.round(F.stddev_pop("gap") / F.avg("gap"), 6).alias("jitter"))
    return out.where("gap > 0").select("subject", F.round(1 / F.col("gap"), 9).alias("fs"), "jitter")


simple("scale_zscore", "SELECT subject, i, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN stddev_pop(value) OVER w ELSE 1 END, 6) AS scaled FROM pts WINDOW w AS (PARTITION BY subject)", lambda p: S.scaled(p.select("subject", "i", "value"), "value", "zscore").drop("value"))
simple("scale_minmax", "SELECT subject, i, round((value - min(value) OVER w) / CASE WHEN max(value) OVER w - min(value) OVER w > 1e-12 THEN max(value) OVER w - min(value) OVER w ELSE 1 END, 6) AS scaled FROM pts WINDOW w AS (PARTITION BY subject)", lambda p: S.scaled(p.select("subject", "i", "value"), "value", "minmax").drop("value"))
simple("scale_rank", "SELECT subject, i, round((rank() OVER (PARTITION BY subject ORDER BY value) + (count(*) OVER (PARTITION BY subject, value) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY subject), 6)::DOUBLE AS scaled FROM pts", lambda p: S.scaled(p.select("subject", "i", "value"), "value", "rank").drop("value"))
simple("scale_robust", ", m AS (SELECT subject, median(value) AS mid FROM pts GROUP BY subject), a AS (SELECT subject, median(abs(value - mid)) AS mad FROM pts JOIN m USING (subject) GROUP BY subject) SELECT subject, i, round((value - mid) / CASE WHEN 1.4826 * mad > 1e-12 THEN 1.4826 * mad ELSE 1 END, 6)::DOUBLE AS scaled FROM pts JOIN m USING (subject) JOIN a USING (subject)", lambda p: S.scaled(p.select("subject", "i", "value"), "value", "robust").drop("value"))
simple("scaler_rms_balanced", ", s AS (SELECT subject, 2 * var_pop(value) AS v, 2 * var_pop(gap) AS g FROM pts GROUP BY subject), u AS (SELECT subject, 'value' AS block, v AS ms FROM s UNION ALL SELECT subject, 'gap', g FROM s), x AS (SELECT *, CASE WHEN ms > 0 THEN 1 / ms ELSE 0 END AS inv FROM u) SELECT subject, block, round(sqrt(ms), 6) AS rms, round(CASE WHEN sum(inv) OVER (PARTITION BY subject) > 0 THEN inv * 2 / sum(inv) OVER (PARTITION BY subject) ELSE 0 END, 6) AS weight FROM x", lambda p: S.balanced_weights(p, {"value": ["value"], "gap": ["gap"]}))
simple("takens_embed", "SELECT * FROM (SELECT subject, i, value AS x0, lead(value, 1) OVER w AS x1, lead(value, 2) OVER w AS x2 FROM pts WINDOW w AS (PARTITION BY subject ORDER BY i)) WHERE x2 IS NOT NULL", lambda p: S.embed(p, "value", 3, 1))
simple("phase_circle", "SELECT subject, i, round(cos(phase), 6) AS cos_phase, round(sin(phase), 6) AS sin_phase FROM pts", lambda p: S.circle(p.select("subject", "i", "phase"), "phase").drop("phase"))
simple("pac_space", "SELECT subject, i, round(cos(phase), 6) AS cos_phase, round(sin(phase), 6) AS sin_phase, value FROM pts", lambda p: S.circle(p.select("subject", "i", "phase", "value"), "phase").select("subject", "i", "cos_phase", "sin_phase", "value"))
query("subsample", f"WITH {_PTS} SELECT subject, CAST(i // 4 AS BIGINT) AS i, value FROM pts WHERE i % 4 = 0")(lambda spark, d: events(spark, d).select("value").subsample(4).df)
query("window_slice", f"WITH {_PTS} SELECT subject, i - 10 AS i, value FROM pts WHERE i >= 10 AND i < 30")(lambda spark, d: events(spark, d).select("value").window(10, 30).df)
simple("acf_curve", ", x AS (SELECT subject, i, value - avg(value) OVER (PARTITION BY subject) AS v FROM pts), l AS (SELECT unnest(range(0, 9))::INT AS lag), s AS (SELECT a.subject, l.lag, sum(a.v * b.v) AS s FROM x a CROSS JOIN l JOIN x b ON a.subject = b.subject AND b.i = a.i + l.lag GROUP BY 1, 2), q AS (SELECT subject, sum(v * v) AS ss FROM x GROUP BY 1) SELECT subject, lag, round(s / ss, 6) AS acf FROM s JOIN q USING (subject)", lambda p: S.autocorrelation(p, "value", 8))
simple("ami_curve", ", x AS (SELECT subject, value AS a, lead(value, 1) OVER (PARTITION BY subject ORDER BY i) AS b FROM pts), y AS (SELECT *, CAST(least(floor((a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) * 8), 7) AS INT) AS p, CAST(least(floor((b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) * 8), 7) AS INT) AS q FROM x WHERE b IS NOT NULL WINDOW w AS (PARTITION BY subject)), c AS (SELECT subject, p, q, count(*) AS n FROM y GROUP BY ALL), e AS (SELECT subject, n, sum(n) OVER (PARTITION BY subject, p) AS np, sum(n) OVER (PARTITION BY subject, q) AS nq, sum(n) OVER (PARTITION BY subject) AS t FROM c) SELECT subject, round(sum(n::DOUBLE / t * ln(n::DOUBLE * t / (np::DOUBLE * nq))), 6) AS ami FROM e GROUP BY subject", lambda p: S.mutual_information(p, "value", 1))
simple("hjorth", ", d AS (SELECT subject, i, value AS x, value - lag(value) OVER (PARTITION BY subject ORDER BY i) AS d1 FROM pts), e AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY subject ORDER BY i) AS d2 FROM d), v AS (SELECT subject, var_pop(x) AS a, var_pop(d1) AS b, var_pop(d2) AS c FROM e GROUP BY subject) SELECT subject, round(a, 6) AS activity, round(CASE WHEN a > 0 THEN sqrt(b / a) ELSE 0 END, 6) AS mobility, round(CASE WHEN a > 0 AND b > 0 THEN sqrt(c / b) / sqrt(b / a) ELSE 0 END, 6) AS complexity FROM v", lambda p: S.hjorth(p, "value"))
simple("petrosian", ", d AS (SELECT subject, i, lead(value) OVER (PARTITION BY subject ORDER BY i) - value AS d FROM pts), e AS (SELECT *, lead(d) OVER (PARTITION BY subject ORDER BY i) AS e FROM d), s AS (SELECT subject, count(*) AS n, CAST(sum(CASE WHEN d * e < 0 THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM e GROUP BY subject) SELECT subject, n, changes, round(log10(n) / (log10(n) + log10(n / (n + 0.4::DOUBLE * changes))), 6) AS petrosian, round(CASE WHEN changes > 0 THEN n::DOUBLE / changes ELSE n END, 6) AS samples_per_turn FROM s", lambda p: S.turns(p, "value"))
simple("katz", ", z AS (SELECT subject, i, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN stddev_pop(value) OVER w ELSE 1 END AS z FROM pts WINDOW w AS (PARTITION BY subject)), e AS (SELECT subject, abs(z - lag(z) OVER o) AS step, abs(z - first_value(z) OVER o) AS far FROM z WINDOW o AS (PARTITION BY subject ORDER BY i)), s AS (SELECT subject, sum(step) AS len, max(far) AS d, count(step) AS n FROM e GROUP BY subject) SELECT subject, round(log10(n) / (log10(n) + log10(d / len)), 6) AS katz FROM s WHERE len > 0 AND d > 0", lambda p: S.katz(p, "value"))
simple("perm_entropy", ", x AS (SELECT subject, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c FROM pts WINDOW w AS (PARTITION BY subject ORDER BY i)), n AS (SELECT subject, (a <= b)::INT AS p, (b <= c)::INT AS q, (a <= c)::INT AS r, count(*) AS n FROM x WHERE c IS NOT NULL GROUP BY ALL), s AS (SELECT subject, n::DOUBLE / sum(n) OVER (PARTITION BY subject) AS p FROM n) SELECT subject, round(sum(-p * ln(p)) / ln(6), 6) AS pe FROM s GROUP BY subject", lambda p: S.permutation_entropy(p, "value"))
simple("higuchi_lengths", ", k AS (SELECT unnest([1, 2, 3, 4])::INT AS k), n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), d AS (SELECT a.subject, k, n, a.i % k AS m, abs(b.value - a.value) AS d FROM pts a CROSS JOIN k JOIN pts b ON a.subject = b.subject AND b.i = a.i + k JOIN n ON n.subject = a.subject), l AS (SELECT subject, k, m, sum(d) * (min(n) - 1) / count(*) / k / k AS len FROM d GROUP BY subject, k, m) SELECT subject, k, round(avg(len) + 1e-7, 3) AS length FROM l GROUP BY subject, k", lambda p: S.higuchi_lengths(p, "value").withColumn("length", F.round(F.col("length") + 1e-7, 3)))
simple("dfa_fluct", ", x AS (SELECT subject, i, value - avg(value) OVER (PARTITION BY subject) AS v, count(*) OVER (PARTITION BY subject) AS n FROM pts), y AS (SELECT subject, i, n, sum(v) OVER (PARTITION BY subject ORDER BY i) AS y FROM x), s AS (SELECT *, i // scale AS seg FROM y CROSS JOIN (SELECT unnest([4, 8, 16])::INT AS scale)), e AS (SELECT subject, scale, seg, greatest(var_pop(y) - covar_pop(i, y) * covar_pop(i, y) / var_pop(i), 0) AS r FROM s WHERE (seg + 1) * scale <= n GROUP BY subject, scale, seg) SELECT subject, scale, round(sqrt(avg(r)), 5) AS fluctuation FROM e GROUP BY subject, scale", lambda p: S.dfa_fluctuations(p, "value").withColumn("fluctuation", F.round("fluctuation", 5)))
simple("sample_entropy", ", t AS (SELECT subject, round(0.2 * stddev_pop(value), 9) AS tol FROM pts GROUP BY subject), e AS (SELECT * FROM (SELECT subject, i, value AS x0, lead(value, 1) OVER w AS x1, lead(value, 2) OVER w AS x2 FROM pts WINDOW w AS (PARTITION BY subject ORDER BY i)) WHERE x2 IS NOT NULL), n AS (SELECT a.subject, CAST(sum((round(abs(a.x0 - b.x0), 9) <= tol AND round(abs(a.x1 - b.x1), 9) <= tol)::INT) AS BIGINT) AS b, CAST(sum((round(abs(a.x0 - b.x0), 9) <= tol AND round(abs(a.x1 - b.x1), 9) <= tol AND round(abs(a.x2 - b.x2), 9) <= tol)::INT) AS BIGINT) AS a FROM e a JOIN e b ON a.subject = b.subject AND a.i <> b.i JOIN t ON t.subject = a.subject GROUP BY a.subject) SELECT subject, a, b, round(CASE WHEN a > 0 AND b > 0 THEN -ln(a::DOUBLE / b) END, 6) AS sampen FROM n", lambda p: S.sample_entropy(p, "value"))
query("kernel_measures")(lambda spark, d: rounded(S.kernel_measures(points(spark, d), "value")))

simple("mvl", "SELECT subject, round(sqrt(pow(avg(value * cos(phase)), 2) + pow(avg(value * sin(phase)), 2)) / avg(value), 6) AS mvl FROM pts GROUP BY subject", lambda p: p.groupBy("subject").agg(S.mvl("phase", "value").alias("mvl")))
simple("plv", "SELECT subject, round(sqrt(pow(avg(cos(phase - value)), 2) + pow(avg(sin(phase - value)), 2)), 6) AS plv FROM pts GROUP BY subject", lambda p: p.groupBy("subject").agg(S.plv("phase", "value").alias("plv")))
_BIN = "CAST(least(floor((phase + pi()) / (2 * pi()) * 6), 5) AS INT)"
simple("modulogram", f"SELECT subject, {_BIN} AS bin, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, count(value) AS n FROM pts GROUP BY subject, bin", lambda p: S.modulogram(p, "phase", "value", 6))
simple("mi_tort", f", g AS (SELECT subject, {_BIN} AS bin, avg(value) AS mean, count(value) AS n FROM pts GROUP BY subject, bin), s AS (SELECT subject, n, mean / sum(mean) OVER (PARTITION BY subject) AS s FROM g) SELECT subject, round(CASE WHEN sum(n) >= 24 THEN (ln(6) + sum(CASE WHEN s > 0 THEN s * ln(s) END)) / ln(6) END, 6) AS mi FROM s GROUP BY subject", lambda p: S.modulation_index(p, "phase", "value", 6))
simple("aac_spearman", ", r AS (SELECT subject, rank() OVER (PARTITION BY subject ORDER BY value) + (count(*) OVER (PARTITION BY subject, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY subject ORDER BY gap) + (count(*) OVER (PARTITION BY subject, gap) - 1) / 2.0 AS b FROM pts) SELECT subject, round(corr(a, b), 6) AS rho FROM r GROUP BY subject", lambda p: S.spearman(p, "value", "gap"))
simple("surrogates_shift", f", n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), m AS (SELECT p.subject, shift, (p.i + shift) % n AS i, p.value AS a FROM pts p JOIN n USING (subject) CROSS JOIN (SELECT unnest({[0, *SHIFTS]})::INT AS shift)), v AS (SELECT m.subject, shift, round(sqrt(pow(avg(a * cos(phase)), 2) + pow(avg(a * sin(phase)), 2)) / avg(a), 9) AS v FROM m JOIN pts q ON q.subject = m.subject AND q.i = m.i GROUP BY 1, 2) SELECT x.subject, round(min(o.v), 6) AS observed, round((1 + sum((x.v >= o.v)::INT))::DOUBLE / (1 + count(*)), 6) AS p FROM v x JOIN v o ON o.subject = x.subject AND o.shift = 0 WHERE x.shift > 0 GROUP BY x.subject", lambda p: S.shifted_mvl(p, "phase", "value", SHIFTS))

simple("window_grid_size", f", n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), g AS (SELECT subject, unnest(range(0, n - {SIZE} + 1, {STEP})) AS start FROM n WHERE n >= {SIZE}) SELECT subject, CAST(start // {STEP} AS INT) AS \"window\", start, start + {SIZE} AS stop FROM g", lambda p: S.windows_by_size(R.unit_sizes(p), SIZE, STEP))
simple("window_grid_count", ", n AS (SELECT subject, count(*) AS n, round_even(count(*) / 2.5, 0)::BIGINT AS size FROM pts GROUP BY subject), g AS (SELECT *, unnest([0, 1, 2, 3])::INT AS w FROM n), h AS (SELECT subject, w, size, round_even((n - size) * w / 3.0, 0)::BIGINT AS start FROM g) SELECT subject, w AS \"window\", start, start + size AS stop FROM h", lambda p: S.windows_by_count(R.unit_sizes(p), 4))

# distances, thresholds, structures
for _m, _e in {"euclidean": "list_distance(a, b)", "chebyshev": "list_max(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2])))", "manhattan": "list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2])))", "cosine": "1 - list_cosine_similarity(a, b)"}.items():

    def _dist(spark, d, m=_m):
        e = spark.read.parquet(f"{d}/embeddings.parquet")
        if m == "cosine":
            return R.cosine_pairs(e, "label", "vec_id", "embedding")
        a, b = e.select("label", F.col("vec_id").alias("i"), F.col("embedding").alias("a")), e.select("label", F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
        return a.join(b, "label").where("i < j").select("i", "j", F.round(R.array_distance(F.col("a"), F.col("b"), m), 6).alias("d"))

    query(f"dist_{_m}", f"WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT i, j, round({_e}, 6)::DOUBLE AS d FROM (SELECT x.vec_id AS i, y.vec_id AS j, x.v AS a, y.v AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id < y.vec_id)")(_dist)


def _eps(name: str, sql: str, **kw):
    def run(spark, d):
        pts = points(spark, d)
        return rounded(R.threshold(R.pairs(pts, ["value"], 1), points=pts, coords=["value"], **kw))

    query(name, f"WITH {_PTS}, {_PAIRS} {sql}")(run)


_RATE_SQL = f"SELECT subject, round(quantile_cont(d, {RR}), 6) AS eps FROM pairs GROUP BY subject"
_eps("eps_relational", _RATE_SQL, mode="target_rr", target_rr=RR)
query("eps_target_rr", f"WITH {_PTS}, {_PAIRS} {_RATE_SQL}")(lambda spark, d: rounded(R.kernel_threshold(points(spark, d), ["value"], RR)))
query("eps_spread", f"WITH {_PTS}, {_PAIRS} {_RATE_SQL}")(lambda spark, d: rounded(R.spread_threshold(points(spark, d), ["value"], RR, strips=4)))
query("rp_tiled", f"{_CORE} SELECT subject, count(*) AS n, CAST(sum(i * 31 + j) AS BIGINT) AS s FROM rec GROUP BY subject")(lambda spark, d: (lambda pair: R.recurrent(pair, R.threshold(pair, "target_rr", RR)).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i") * 31 + F.col("j")).alias("s")))(R.pairs(points(spark, d), ["value"], tile=16)))
_eps("eps_percentile", "SELECT subject, round(quantile_cont(d, 0.25), 6) AS eps FROM pairs GROUP BY subject", mode="percentile", percentile=25)
_eps("eps_fixed", "SELECT DISTINCT subject, 1.5::DOUBLE AS eps FROM pairs", mode="fixed", value=1.5)
_eps("eps_std", "SELECT subject, round(0.1 * sqrt(var_pop(value)), 6) AS eps FROM pts GROUP BY subject", mode="std_fraction")
_eps("eps_maxdist", "SELECT subject, round(max(d) * 0.1, 6)::DOUBLE AS eps FROM pairs GROUP BY subject", mode="maxdist_fraction")
_eps("eps_fan", "SELECT subject, i, d AS eps FROM (SELECT *, row_number() OVER (PARTITION BY subject, i ORDER BY d, j) AS r FROM pairs) WHERE r = 5", mode="fan", k=5)
_eps("eps_adaptive", f", e AS (SELECT subject, round(quantile_cont(d, {RR}), 9) AS eps FROM pairs GROUP BY subject), r AS (SELECT subject, sqrt(var_pop(value)) AS radius FROM pts GROUP BY subject) SELECT subject, round(eps, 6) AS eps, round(radius, 6) AS radius, round(eps / radius, 6) AS eps_over_radius FROM e JOIN r USING (subject)", mode="adaptive_dim", target_rr=RR)


@query("eps_per_block", f"WITH {_PTS}, p AS (SELECT a.subject, round(abs(a.value - b.value), 9) AS dv, round(abs(a.gap - b.gap), 9) AS dg FROM pts a JOIN pts b ON a.subject = b.subject AND a.i <> b.i) SELECT subject, round(quantile_cont(dv, {RR}), 6) AS eps_value, round(quantile_cont(dg, {RR}), 3) AS eps_gap FROM p GROUP BY subject")
def _per_block(spark, d):
    pts = points(spark, d)
    one, two = (R.threshold(R.pairs(pts, [c], 1), "target_rr", RR).withColumnRenamed("eps", f"eps_{c}") for c in ("value", "gap"))
    return rounded(one.join(two, "subject").withColumn("eps_gap", F.round("eps_gap", 3)))


@query("rp_rate", f"{_CORE} SELECT p.subject, round(min(eps), 6) AS eps, count(*) AS n_pairs, CAST(sum((d <= eps)::INT) AS BIGINT) AS n_recurrent, round(sum((d <= eps)::INT)::DOUBLE / count(*), 6) AS rr FROM pairs p JOIN eps USING (subject) GROUP BY p.subject")
def _rate(spark, d):
    _, pair, eps, _ = parts(spark, d)
    return rounded(R.rate(pair, eps))


@query("density_profile", f"{_CORE}, n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject) SELECT subject, CAST(i * 4 // n AS INT) AS band, count(*) AS hits FROM rec JOIN n USING (subject) GROUP BY 1, 2")
def _density(spark, d):
    pts, _, _, rec = parts(spark, d)
    return rec.join(R.unit_sizes(pts), "subject").groupBy("subject", F.expr("int(i * 4 div n)").alias("band")).agg(F.count(F.lit(1)).alias("hits"))


@query("rp_image", f"{_CORE}, n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject) SELECT subject, CAST(i * 8 // n AS INT) AS row, CAST(j * 8 // n AS INT) AS col, count(*) AS hits FROM rec JOIN n USING (subject) GROUP BY 1, 2, 3")
def _image(spark, d):
    pts, _, _, rec = parts(spark, d)
    return R.image(rec, R.unit_sizes(pts), 8)


_CROSS = f"WITH {_PTS}, pairs AS (SELECT a.subject, a.i, b.i AS j, round(abs(a.value - b.value), 9) AS d FROM pts a JOIN pts b ON b.subject = a.subject + 1), {_EPS}"


def _cross(spark, d):
    pts = points(spark, d)
    other = pts.withColumn("subject", F.col("subject") - 1)
    pair = R.pairs(pts, ["value"], other=other)
    return pts, other, pair, R.threshold(pair, "target_rr", RR)


query("cross_eps", f"{_CROSS} SELECT subject, round(eps, 6) AS eps FROM eps")(lambda spark, d: rounded(_cross(spark, d)[3]))
_PROFILE = f"""{_CROSS}, {_REC}, n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), z AS (SELECT a.subject, a.n, b.n AS m FROM n a JOIN n b ON b.subject = a.subject + 1), o AS (SELECT *, least(n, m - k) - greatest(0, -k) AS cells FROM z CROSS JOIN (SELECT unnest(range(-10, 11))::INT AS k)),
h AS (SELECT subject, j - i AS k, count(*) AS hits FROM rec GROUP BY 1, 2), prof AS (SELECT o.subject, o.k, cells, coalesce(hits, 0)::DOUBLE / cells AS density FROM o LEFT JOIN h ON h.subject = o.subject AND h.k = o.k WHERE cells > 0)"""


def _profile(spark, d):
    pts, other, pair, eps = _cross(spark, d)
    n = R.unit_sizes(pts).join(R.unit_sizes(other).withColumnRenamed("n", "m"), "subject")
    return R.diagonal_profile(R.recurrent(pair, eps), n, 10)


query("crp_profile", f"{_PROFILE} SELECT subject, k, cells, round(density, 6) AS density FROM prof")(lambda spark, d: rounded(_profile(spark, d)))
query("crqa_peak", f"{_PROFILE} SELECT subject, k AS peak_offset, round(density, 6) AS peak_density FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(density, 9) DESC, k) AS r FROM prof WHERE cells > 10) WHERE r = 1")(lambda spark, d: rounded(_profile(spark, d).where("cells > 10").groupBy("subject").agg(F.max(F.struct(F.round("density", 9).alias("density"), (-F.col("k")).alias("k"))).alias("x")).select("subject", (-F.col("x.k")).alias("peak_offset"), F.col("x.density").alias("peak_density"))))


@query("jrp_independence", f"""{_CORE}, p2 AS (SELECT a.subject, a.i, b.i AS j, round(abs(a.gap - b.gap), 9) AS d FROM pts a JOIN pts b ON a.subject = b.subject AND a.i <> b.i), e2 AS (SELECT subject, round(quantile_cont(d, {RR}), 9) AS eps FROM p2 GROUP BY subject), r2 AS (SELECT p2.subject, i, j FROM p2 JOIN e2 USING (subject) WHERE d <= eps),
n AS (SELECT subject, count(*)::DOUBLE AS n FROM pairs GROUP BY subject), a AS (SELECT subject, count(*) AS a FROM rec GROUP BY subject), b AS (SELECT subject, count(*) AS b FROM r2 GROUP BY subject), c AS (SELECT subject, count(*) AS c FROM rec JOIN r2 USING (subject, i, j) GROUP BY subject)
SELECT subject, round(coalesce(c, 0) / n, 6) AS rr_joint, round((coalesce(c, 0) / n) / ((a / n) * (b / n)), 6) AS independence_ratio FROM n JOIN a USING (subject) JOIN b USING (subject) LEFT JOIN c USING (subject)""")
def _joint(spark, d):
    # both distances on one pair row: one join serves both thresholds and the joint count
    pair = R.block_pairs(points(spark, d), {"a": ["value"], "b": ["gap"]}, 1)
    out = R.joint_rates(pair, ("a", "b"), RR)
    rr = F.coalesce("c", F.lit(0)) / F.col("n")
    return rounded(out.select("subject", rr.alias("rr_joint"), (rr / (F.col("a") / F.col("n") * F.col("b") / F.col("n"))).alias("independence_ratio")))


def _hist(kind):
    def run(spark, d):
        pts, _, _, rec = parts(spark, d)
        return R.line_histogram(rec, R.unit_sizes(pts), 1).where(F.col("kind") == kind).select("subject", "length", "cnt")

    return run


query("hist_diagonal", f"{_CORE}, {_DIAG} SELECT subject, length, count(*) AS cnt FROM dg GROUP BY 1, 2")(_hist("diagonal"))
query("hist_vertical", f"{_CORE}, {_VERT} SELECT subject, length, count(*) AS cnt FROM vt GROUP BY 1, 2")(_hist("vertical"))
query("hist_white", f"{_CORE}, {_WHITE} SELECT subject, length, count(*) AS cnt FROM wh GROUP BY 1, 2")(_hist("white_vertical"))


def _measures(core: str, white: str) -> str:
    """All measures at floors of 2, from scratch in SQL."""
    stat = lambda t: f"SELECT subject, sum(length * c)::DOUBLE AS points, sum(c)::DOUBLE AS lines, max(length)::DOUBLE AS longest, sum(-(c::DOUBLE / t) * ln(c::DOUBLE / t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY subject) AS t FROM (SELECT subject, length, count(*) AS c FROM {t} WHERE length >= 2 GROUP BY 1, 2)) GROUP BY subject"
    r = lambda x, n: f"round({x}, 6)::DOUBLE AS {n}"
    z = lambda x: f"coalesce({x}, 0)"
    norm = lambda a: f"CASE WHEN {z(a + '.longest')} - 1 > 1 THEN {a}.h / ln({a}.longest - 1) ELSE 0 END"
    return f"""{core}, {_DIAG}, {_VERT}, {white}, d AS ({stat("dg")}), v AS ({stat("vt")}), w AS ({stat("wh")}), q AS (SELECT p.subject, count(*) AS n, sum((d <= eps)::INT) AS k FROM pairs p JOIN eps USING (subject) GROUP BY p.subject)
SELECT q.subject, {r("k::DOUBLE / n", "RR")}, {r("CASE WHEN k > 0 THEN coalesce(d.points, 0) / k ELSE 0 END", "DET")}, {r(z("d.points / d.lines"), "L")}, {r(z("d.longest"), "Lmax")}, CASE WHEN d.longest > 0 THEN round(1 / d.longest, 6) ELSE 'inf'::DOUBLE END AS DIV, {r(z("d.h"), "ENTR")}, {r(norm("d"), "ENTR_norm")},
{r("CASE WHEN k > 0 THEN coalesce(v.points, 0) / k ELSE 0 END", "LAM")}, {r(z("v.points / v.lines"), "TT")}, {r(z("v.longest"), "Vmax")}, {r(z("w.points / w.lines"), "W")}, {r(z("w.longest"), "Wmax")}, {r(z("w.h"), "ENTW")}, {r(norm("w"), "RTE")} FROM q LEFT JOIN d ON d.subject = q.subject LEFT JOIN v ON v.subject = q.subject LEFT JOIN w ON w.subject = q.subject"""


query("rqa_all", _measures(_CORE, _WHITE))(lambda spark, d: rounded(R.rqa(points(spark, d), ["value"], RR)))
query("rqa_spread", _measures(_CORE, _WHITE))(lambda spark, d: rounded(R.quantify(R.spread_histogram(points(spark, d), ["value"], RR, strips=4))))
query("rqa_relational", _measures(_CORE, _WHITE))(lambda spark, d: rounded(R.rqa(points(spark, d), ["value"], RR, path="relational")))


@query("rqa_sweep", f"{_CORE}, {_DIAG}, {_VERT}, k AS (SELECT subject, count(*)::DOUBLE AS k FROM rec GROUP BY subject), l AS (SELECT unnest({list(FLOORS)})::INT AS floor), d AS (SELECT subject, floor, sum(CASE WHEN length >= floor THEN length ELSE 0 END) AS d FROM dg CROSS JOIN l GROUP BY 1, 2), v AS (SELECT subject, floor, sum(CASE WHEN length >= floor THEN length ELSE 0 END) AS v FROM vt CROSS JOIN l GROUP BY 1, 2) SELECT subject, floor, round(d / k, 6) AS DET, round(v / k, 6) AS LAM, round(least(d / k, 1 - d / k), 6) AS DET_headroom FROM d JOIN v USING (subject, floor) JOIN k USING (subject)")
def _sweep(spark, d):
    return rounded(R.sweep(R.kernel_histogram(points(spark, d), ["value"], RR), floors=FLOORS))


_WIN = f"""WITH {_PTS}, n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), g AS (SELECT subject, unnest(range(0, n - {SIZE} + 1, {STEP})) AS s FROM n WHERE n >= {SIZE}), wp AS (SELECT p.subject, g.s // {STEP} AS win, p.i - g.s AS i, p.value FROM pts p JOIN g ON g.subject = p.subject AND p.i >= g.s AND p.i < g.s + {SIZE}),
pairs AS (SELECT a.subject, a.win, a.i, b.i AS j, round(abs(a.value - b.value), 9) AS d FROM wp a JOIN wp b ON a.subject = b.subject AND a.win = b.win AND a.i <> b.i)"""
_WSTAT = "rec AS (SELECT p.* FROM pairs p JOIN eps e ON p.subject = e.subject {on} WHERE d <= eps), dg AS (SELECT subject, win, count(*) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY subject, win, j - i ORDER BY i) AS g FROM rec) GROUP BY subject, win, j - i, g), t AS (SELECT subject, win, count(*) AS n FROM pairs GROUP BY 1, 2), k AS (SELECT subject, win, sum(length)::DOUBLE AS k, sum(CASE WHEN length >= 2 THEN length ELSE 0 END) AS p, max(CASE WHEN length >= 2 THEN length ELSE 0 END) AS m FROM dg GROUP BY 1, 2)"
_WOUT = 'SELECT t.subject, CAST(t.win AS INT) AS "window", round(coalesce(k, 0) / n, 6) AS RR, round(coalesce(p / k, 0), 6) AS DET, coalesce(m, 0)::DOUBLE AS Lmax FROM t LEFT JOIN k ON k.subject = t.subject AND k.win = t.win'


@query("windowed_rqa_per_window", f"{_WIN}, eps AS (SELECT subject, win, round(quantile_cont(d, {RR}), 9) AS eps FROM pairs GROUP BY 1, 2), {_WSTAT.format(on='AND p.win = e.win')} {_WOUT}")
def _windowed(spark, d):
    w = S.into_windows(points(spark, d).select("subject", "i", "value"), SIZE, STEP)
    return rounded(R.rqa(w, ["value"], RR, keys=("subject", "window")).select("subject", "window", "RR", "DET", "Lmax"))


@query("windowed_rqa_global", f"{_WIN}, pg AS (SELECT a.subject, round(abs(a.value - b.value), 9) AS d FROM pts a JOIN pts b ON a.subject = b.subject AND a.i <> b.i), eps AS (SELECT subject, round(quantile_cont(d, {RR}), 9) AS eps FROM pg GROUP BY 1), {_WSTAT.format(on='')} {_WOUT}")
def _windowed_global(spark, d):
    pts = points(spark, d).select("subject", "i", "value")
    eps = R.threshold(R.pairs(pts, ["value"], 1), "target_rr", RR)
    w = S.into_windows(pts, SIZE, STEP)
    keys = ("subject", "window")
    unit = w.withColumn("u", F.struct("subject", "window")).select(F.col("u").alias("subject"), "i", "value")
    pair = R.pairs(unit, ["value"], 1).select(F.col("subject.subject").alias("subject"), F.col("subject.window").alias("window"), "i", "j", "d")
    rec = pair.join(eps, "subject").where("d <= eps").select(*keys, "i", "j")
    totals = pair.join(eps, "subject").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("d") <= F.col("eps")).alias("n_recurrent"))
    out = R.quantify(R.line_histogram(rec, R.unit_sizes(w, keys), 1, keys), totals, keys=keys)
    return rounded(out.select(*keys, "RR", "DET", "Lmax"))


@query("feature_matrix", f"WITH {_PTS}, f AS (SELECT subject, i // 20 AS w, avg(value) AS m FROM pts GROUP BY 1, 2) SELECT subject, " + ", ".join(f"round(max(CASE WHEN w = {w} THEN m END), 6) AS w{w}" for w in range(5)) + " FROM f GROUP BY subject")
def _features(spark, d):
    """Every window of every subject; a column for each window number present."""
    table = points(spark, d).groupBy("subject", F.expr("int(i div 20)").alias("window")).agg(F.avg("value").alias("value"))
    return rounded(K.feature_matrix(table, "value"))


@query("build_features", f"WITH {_PTS} SELECT subject, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, round(regr_slope(value, i), 6) AS value_trend FROM pts GROUP BY subject")
def _build(spark, d):
    return rounded(points(spark, d).groupBy("subject").agg(F.avg("value").alias("value_mean"), F.stddev_samp("value").alias("value_std"), F.regr_slope("value", F.col("i").cast("double")).alias("value_trend")))


_GROUP = f"""WITH {_PTS}, f AS (SELECT subject, CAST(i // 20 AS INT) AS win, round(avg(value), 9) AS v, CAST(subject % 2 AS INT) AS g FROM pts GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY win ORDER BY v) + (count(*) OVER (PARTITION BY win, v) - 1) / 2.0 AS r FROM f), s AS (SELECT win, count(v) FILTER (g = 0) AS n_a, count(v) FILTER (g = 1) AS n_b, avg(v) FILTER (g = 0) AS mean_a, avg(v) FILTER (g = 1) AS mean_b, var_samp(v) FILTER (g = 0) AS va, var_samp(v) FILTER (g = 1) AS vb, sum(r) FILTER (g = 1) AS rb FROM r GROUP BY win),
c AS (SELECT win, n_a, n_b, mean_a, mean_b, (mean_b - mean_a) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS cohens_d, (rb - n_b * (n_b + 1) / 2.0)::DOUBLE / (n_a * n_b) AS auc FROM s WHERE n_a >= 2 AND n_b >= 2)"""


def _groups(spark, d):
    """Windows in which both groups have two subjects or more."""
    f = points(spark, d).groupBy("subject", F.expr("int(i div 20)").alias("win")).agg(F.round(F.avg("value"), 9).alias("v")).withColumn("g", F.col("subject") % 2)
    return S.rank_auc(f, "v", "g", "win")


query("group_comparison", f"{_GROUP} SELECT win, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(cohens_d, 6) AS cohens_d, round(auc, 6) AS auc FROM c")(lambda spark, d: rounded(_groups(spark, d)))
query("rank_metrics", f"{_GROUP} SELECT 'value' AS metric, round(avg(abs(auc - 0.5) + 0.5), 6) AS mean_auc, round(max(abs(auc - 0.5) + 0.5), 6) AS max_auc FROM c")(lambda spark, d: rounded(_groups(spark, d).groupBy(F.lit("value").alias("metric")).agg(F.avg(F.abs(F.col("auc") - 0.5) + 0.5).alias("mean_auc"), F.max(F.abs(F.col("auc") - 0.5) + 0.5).alias("max_auc"))))
simple("comparability", ", n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject) SELECT 'n_samples' AS axis, min(n) AS least, max(n) AS most, (max(n) - min(n))::DOUBLE / max(n) <= 0.05 AS ok FROM n", lambda p: R.unit_sizes(p).groupBy(F.lit("n_samples").alias("axis")).agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumn("ok", (F.col("most") - F.col("least")) / F.col("most") <= 0.05))
simple("corr_sum", f", {_PAIRS}, r AS (SELECT unnest([0.5, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS radius) SELECT subject, radius, CAST(sum((d <= radius)::INT) AS BIGINT) AS n, round(sum((d <= radius)::INT)::DOUBLE / count(*), 6) AS c FROM pairs CROSS JOIN r GROUP BY 1, 2", lambda p: D.correlation_curve(p, ["value"], [0.5, 1.0, 2.0, 4.0, 8.0], counts=True))
simple("nn_stats", f", {_PAIRS}, m AS (SELECT subject, i, min(d) AS d FROM pairs GROUP BY 1, 2) SELECT subject, round(avg(d), 6) AS nn_mean, round(stddev_pop(d) / avg(d), 6) AS nn_cv FROM m GROUP BY subject HAVING avg(d) > 0", lambda p: R.pairs(p, ["value"], 1).groupBy("subject", "i").agg(F.min("d").alias("d")).groupBy("subject").agg(F.avg("d").alias("nn_mean"), F.stddev_pop("d").alias("s")).where("nn_mean > 0").select("subject", "nn_mean", (F.col("s") / F.col("nn_mean")).alias("nn_cv")))
query("corpus_join", "SELECT coalesce(d.doc_id, l.doc_id) AS subject, d.doc_id IS NOT NULL AS has_file, l.doc_id IS NOT NULL AS has_label, l.quality FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")(lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit(True).alias("f")).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", F.lit(True).alias("l")), "doc_id", "full").select(F.col("doc_id").alias("subject"), F.col("f").isNotNull().alias("has_file"), F.col("l").isNotNull().alias("has_label"), "quality"))


# embedding choice, invariants, comparisons
_NEAR = """, e AS (SELECT * FROM (SELECT subject, i, value AS x0, lead(value, 1) OVER w AS x1, lead(value, 2) OVER w AS x2 FROM pts WINDOW w AS (PARTITION BY subject ORDER BY i)) WHERE x2 IS NOT NULL),
z AS (SELECT subject, sqrt(var_pop(x0) + var_pop(x1)) AS size FROM e GROUP BY subject),
q AS (SELECT a.subject, a.i, b.i AS j, round(sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2)), 9) AS d, a.x2 AS u, b.x2 AS v, size FROM e a JOIN e b ON a.subject = b.subject AND a.i <> b.i JOIN z ON z.subject = a.subject),
nn AS (SELECT *, sqrt(d * d + pow(u - v, 2)) AS more FROM (SELECT *, row_number() OVER (PARTITION BY subject, i ORDER BY d, j) AS r FROM q WHERE d > 1e-9 * size) WHERE r = 1)"""
simple("fnn_fraction", f"{_NEAR} SELECT subject, 2 AS m, round(avg((round((more - d) / d, 9) > 10 OR round(more / size, 9) > 2)::INT), 6) AS fnn FROM nn GROUP BY subject", lambda p: D.false_neighbours(p, "value", 2))
simple("estimate_tau", """, x AS (SELECT subject, i, value - avg(value) OVER (PARTITION BY subject) AS v FROM pts), l AS (SELECT unnest(range(1, 9))::INT AS lag),
s AS (SELECT a.subject, l.lag, sum(a.v * b.v) AS s FROM x a CROSS JOIN l JOIN x b ON a.subject = b.subject AND b.i = a.i + l.lag GROUP BY 1, 2), t AS (SELECT subject, sum(v * v) AS ss FROM x GROUP BY 1), c AS (SELECT subject, lag, round(s / ss, 9) AS acf FROM s JOIN t USING (subject))
SELECT subject, coalesce(min(CASE WHEN acf <= exp(-1.0) THEN lag END), arg_min(lag, acf)) AS tau FROM c GROUP BY subject""", lambda p: D.estimate_tau(p, "value", 8))
RADII = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
simple("fixed_region_slope", f", {_PAIRS}, r AS (SELECT unnest({RADII})::DOUBLE AS radius), c AS (SELECT subject, radius, avg((d <= radius)::INT) AS c FROM pairs CROSS JOIN r GROUP BY 1, 2) SELECT subject, round(regr_slope(ln(c), ln(radius)), 6) AS slope, round(regr_intercept(ln(c), ln(radius)), 6) AS intercept, round(regr_r2(ln(c), ln(radius)), 6) AS r2, count(*) AS n FROM c WHERE c > 0 AND radius BETWEEN 1 AND 32 GROUP BY subject", lambda p: D.slope_within(D.correlation_curve(p, ["value"], RADII), 1, 32))
query("correlation_dimension")(lambda spark, d: rounded(D.correlation_dimension(points(spark, d), ["value"], [0.25 * 1.2**k for k in range(24)], max_c=0.5)))
query("k2_entropy", f"{_CORE}, {_DIAG}, h AS (SELECT subject, length, count(*) AS c FROM dg WHERE length >= 2 GROUP BY 1, 2), m AS (SELECT *, sum(c) OVER (PARTITION BY subject ORDER BY length DESC) AS least FROM h) SELECT subject, round(CASE WHEN count(*) >= 3 THEN -regr_slope(ln(least), length) END, 6)::DOUBLE AS k2 FROM m GROUP BY subject")(lambda spark, d: rounded(D.k2(R.kernel_histogram(points(spark, d), ["value"], RR))))
simple("neighbour_agreement", """, a AS (SELECT * FROM (SELECT x.subject, x.i, y.i AS j, row_number() OVER (PARTITION BY x.subject, x.i ORDER BY round(abs(x.value - y.value), 9), y.i) AS r FROM pts x JOIN pts y ON x.subject = y.subject AND x.i <> y.i) WHERE r <= 4),
b AS (SELECT * FROM (SELECT x.subject, x.i, y.i AS j, row_number() OVER (PARTITION BY x.subject, x.i ORDER BY round(abs(x.gap - y.gap), 9), y.i) AS r FROM pts x JOIN pts y ON x.subject = y.subject AND x.i <> y.i) WHERE r <= 4),
n AS (SELECT subject, count(*) AS n FROM pts GROUP BY 1), h AS (SELECT subject, count(*) AS hits FROM a JOIN b USING (subject, i, j) GROUP BY 1)
SELECT subject, round(coalesce(hits, 0) / (n * 4.0::DOUBLE), 6) AS agreement FROM n LEFT JOIN h USING (subject) WHERE n > 4""", lambda p: D.neighbour_agreement(p, ["value"], ["gap"], 4))
simple("comodulogram", " ".join("SELECT subject, 'phase' AS phase_band, '{a}' AS amplitude_band, round(sqrt(pow(avg({a} * cos(phase)), 2) + pow(avg({a} * sin(phase)), 2)) / avg({a}), 6) AS value FROM pts GROUP BY subject {u}".format(a=a, u=u) for a, u in (("value", "UNION ALL"), ("gap", ""))), lambda p: D.comodulogram(p, ["phase"], ["value", "gap"]))
simple("instantaneous_rate", ", t AS (SELECT subject, i, phase - lag(phase) OVER (PARTITION BY subject ORDER BY i) AS turn FROM pts), x AS (SELECT subject, i, coalesce(turn - 2 * pi() * round(turn / (2 * pi())), 0) AS step FROM t), y AS (SELECT *, lead(step) OVER (PARTITION BY subject ORDER BY i) AS a FROM x) SELECT subject, i, round((CASE WHEN i = 0 AND a IS NULL THEN 0 WHEN i = 0 THEN a WHEN a IS NULL THEN step ELSE (step + a) / 2 END) / (2 * pi()), 6)::DOUBLE AS rate FROM y", lambda p: D.instantaneous_rate(p, "phase"))


def _course_values(spark, d):
    return points(spark, d).groupBy("subject", F.expr("int(i div 20)").alias("window")).agg(F.round(F.avg("value"), 9).alias("value")).withColumn("metric", F.lit("mean"))


def _course(spark, d):
    v = _course_values(spark, d)
    units = v.select("subject", (F.col("subject") % 2).cast("int").alias("g")).distinct()
    return I.group_timecourse(v, units, 2000, 5)


simple("cao_growth", f"{_NEAR} SELECT subject, 2 AS m, round(avg(more / d), 6) AS e, round(avg(abs(u - v)), 6) AS s FROM nn GROUP BY subject", lambda p: D.cao_ratios(p, "value", 2))
query("group_timecourse", f"{_GROUP.replace(' WHERE n_a >= 2 AND n_b >= 2', '')} SELECT 'mean' AS metric, win AS \"window\", CASE WHEN n_a >= 5 AND n_b >= 5 THEN round(auc, 6) END AS auc, n_a, n_b FROM c")(lambda spark, d: rounded(_course(spark, d)[0]))
query("group_timecourse_summary")(lambda spark, d: rounded(_course(spark, d)[1]))


@query("event_windows", "SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n, CAST(count(*) - count(value) AS BIGINT) AS n_missing, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def _event_windows(spark, d):
    measures = {k: v for k, v in W.channel_measures("value").items() if k != "std"}
    out = W.windowed(spark.read.parquet(f"{d}/events.parquet").select("event_type", "ts", "value"), "ts", ["event_type"], measures, "1 hour")
    return rounded(out.select("event_type", F.expr("unix_micros(cast(start as timestamp))").alias("start_us"), *measures))


@query("meta_rqa")
def _meta(spark, d):
    w = S.into_windows(points(spark, d).select("subject", "i", "value"), SIZE, STEP)
    table = R.rqa(w, ["value"], RR, keys=("subject", "window")).select("subject", "window", "DET", "LAM", "ENTR")
    return rounded(M.meta_recurrence(table, ["DET", "LAM", "ENTR"], SIZE, STEP, 0.2))


@query("classify_groups")
def _classify(spark, d):
    f = points(spark, d).groupBy("subject").agg(F.avg("value").alias("level"), F.stddev_pop("value").alias("spread"), F.avg("gap").alias("pace"))
    return rounded(I.classify_groups(f.withColumn("label", (F.col("subject") % 2).cast("int")), ["level", "spread", "pace"], n_splits=2))
