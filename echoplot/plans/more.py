"""Queries of preprocessing, state spaces, windows, dynamics, comparisons, generators and figures, with their SQL."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..operators import comparability as K
from ..operators import coupling as C
from ..operators import dynamics as D
from ..operators import inference as I
from ..operators import preprocess as P
from ..operators import recurrence as R
from ..operators import series as S
from ..operators import spaces as SS
from ..operators import structures as ST
from ..operators import windowed as W
from ..records import events
from ..sinks import images
from ..sources import generators as G
from ..sources.memory import quality_report
from . import figures as FIG
from .catalogue import _CORE, _CROSS, _DIAG, _PAIRS, _PTS, _REC, _VERT, RR, SIZE, STEP, parts, points, query, rounded, simple


def record(spark, d):
    """Events as a record: value and gap as amplitudes, two phases, one of which turns seven times as fast."""
    rec = events(spark, d).with_channels(phase2=F.expr("phase * 7"), rate=F.col("gap") / 3600)
    bands = {"phase": (0.01, 0.02), "phase2": (0.07, 0.14), "value": (0.2, 0.5), "gap": (0.1, 0.2), "rate": (0.1, 0.2)}
    return replace(rec, roles={"value": "amplitude", "gap": "amplitude", "phase": "phase", "phase2": "phase", "rate": "inst_freq"}).with_meta(bands=bands)


def raw_record(spark, d):
    return replace(events(spark, d).select("value"), roles={"value": "raw"})


def on_record(name: str, sql: str, build):
    query(name, f"WITH {_PTS} {sql}")(lambda spark, d: rounded(build(record(spark, d))))


# records
on_record("channel_frame", ", l AS (SELECT subject, 'value' AS channel, value AS v FROM pts UNION ALL SELECT subject, 'gap', gap FROM pts) SELECT subject, channel, count(*) AS n_samples, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, 'amplitude' AS role, count(*)::DOUBLE AS duration FROM l GROUP BY 1, 2", lambda r: r.select("value", "gap").channel_frame().drop("digest", "unit", "n_missing"))
on_record("record_times", "SELECT subject, (i - 5)::DOUBLE / 1 + 5 AS t, value FROM pts WHERE i >= 5 AND i < 25", lambda r: r.window(5, 25).to_frame("value"))
on_record("record_array", "SELECT subject, i, round(value + gap, 6) AS total FROM pts", lambda r: r.as_array("value", "gap").select("subject", "i", F.expr("coords[0] + coords[1]").alias("total")))
on_record("quality_issues", ", s AS (SELECT subject, count(*) AS n, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM pts GROUP BY subject), e AS (SELECT p.subject, sum((value = lo)::INT) AS a, sum((value = hi)::INT) AS b FROM pts p JOIN s USING (subject) GROUP BY p.subject) SELECT subject, 'value' AS channel, CASE WHEN sd = 0 THEN 'CONSTANT' ELSE 'SATURATION' END AS code, 'warning' AS severity FROM s JOIN e USING (subject) WHERE sd = 0 OR greatest(a, b) > greatest(3.0, n * 0.05)", lambda r: quality_report(r.select("value")))

# preprocessing
_LO, _HI, _TAPS = 0.2, 0.4, 15
_FIR = f"""n AS (SELECT subject, count(*) AS n, least(3 * {_TAPS}, count(*) - 1) AS pad FROM pts GROUP BY subject),
u AS (SELECT k, CASE WHEN k = 7 THEN 2 * ({_HI} - {_LO}) ELSE (sin(2 * pi() * {_HI} * (k - 7)) - sin(2 * pi() * {_LO} * (k - 7))) / (pi() * (k - 7)) END * (0.54 - 0.46 * cos(2 * pi() * k / ({_TAPS} - 1))) AS h FROM (SELECT unnest(range(0, {_TAPS}))::DOUBLE AS k)),
t AS (SELECT CAST(k AS BIGINT) AS k, h / (SELECT sum(h * cos(2 * pi() * ({_LO} + {_HI}) / 2 * (k - 7))) FROM u) AS h FROM u),
e0 AS (SELECT subject, i, value AS x FROM pts UNION ALL SELECT p.subject, -p.i, 2 * f.value - p.value FROM pts p JOIN n USING (subject) JOIN pts f ON f.subject = p.subject AND f.i = 0 WHERE p.i BETWEEN 1 AND pad UNION ALL SELECT p.subject, 2 * (n - 1) - p.i, 2 * f.value - p.value FROM pts p JOIN n USING (subject) JOIN pts f ON f.subject = p.subject AND f.i = n - 1 WHERE p.i BETWEEN n - 1 - pad AND n - 2),
f0 AS (SELECT e.subject, e.i, sum(t.h * g.x) AS x FROM e0 e JOIN n USING (subject) CROSS JOIN t JOIN e0 g ON g.subject = e.subject AND g.i = greatest(e.i - t.k, -pad) GROUP BY 1, 2),
b0 AS (SELECT e.subject, e.i, sum(t.h * g.x) AS x FROM f0 e JOIN n USING (subject) CROSS JOIN t JOIN f0 g ON g.subject = e.subject AND g.i = least(e.i + t.k, n - 1 + pad) WHERE e.i BETWEEN 0 AND n - 1 GROUP BY 1, 2)"""
query("bandpass", f"WITH {_PTS}, {_FIR} SELECT subject, i, round(x, 6) AS band FROM b0")(lambda spark, d: rounded(P.bandpass(raw_record(spark, d), (_LO, _HI), name="band").df.select("subject", "i", "band")))
# the analytic signal by circular convolution with the discrete Hilbert kernel
_HILBERT = """n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject),
hk AS (SELECT subject, n, unnest(range(1, n)) AS k FROM n), hh AS (SELECT subject, k, CASE WHEN n % 2 = 0 THEN CASE WHEN k % 2 = 1 THEN 2.0 / n / tan(pi() * k / n) ELSE 0 END ELSE (1 / tan(pi() * k / n) - cos(pi() * k) / sin(pi() * k / n)) / n END AS h FROM hk),
ht AS (SELECT a.subject, a.i, sum(b.value * hh.h) AS y FROM pts a JOIN n USING (subject) JOIN hh ON hh.subject = a.subject JOIN pts b ON b.subject = a.subject AND b.i = (a.i - hh.k + n) % n GROUP BY 1, 2),
an AS (SELECT subject, i, value, y, sqrt(value * value + y * y) AS amp, atan2(y, value) AS ph FROM pts JOIN ht USING (subject, i))"""
_RATE = """st AS (SELECT *, ph - lag(ph) OVER (PARTITION BY subject ORDER BY i) AS turn FROM an), su AS (SELECT *, coalesce(turn - 2 * pi() * round(turn / (2 * pi())), 0) AS step FROM st), sv AS (SELECT *, lead(step) OVER (PARTITION BY subject ORDER BY i) AS after FROM su)"""


def _analytic(spark, d, policy="none", edge=0):
    rec = P.analytic(raw_record(spark, d), ["value"], policy, edge)
    return rec.df.select("subject", "i", F.col("amp_value").alias("amp"), (F.col("amp_value") * F.cos("phase_value")).alias("x"), (F.col("amp_value") * F.sin("phase_value")).alias("y"), F.col("ifreq_value").alias("rate"))


query("analytic_signal", f"WITH {_PTS}, {_HILBERT}, {_RATE} SELECT subject, i, round(amp, 5) AS amp, round(value, 5) AS x, round(y, 5) AS y, round((CASE WHEN i = 0 THEN after WHEN after IS NULL THEN step ELSE (step + after) / 2 END) / (2 * pi()), 5)::DOUBLE AS rate FROM sv")(lambda spark, d: rounded(_analytic(spark, d), 5))
query("analytic_trimmed", f"WITH {_PTS}, {_HILBERT} SELECT subject, i - 7 AS i, round(amp, 5) AS amp FROM an JOIN n USING (subject) WHERE i >= 7 AND i < n - 7")(lambda spark, d: rounded(_analytic(spark, d, "trim", 7).select("subject", "i", "amp"), 5))
query("resample_fourier", f"""WITH {_PTS}, n AS (SELECT subject, count(*) AS n, round_even(count(*) * 0.5, 0)::BIGINT AS m FROM pts GROUP BY subject), k AS (SELECT subject, n, m, unnest(range(0, m // 2 + 1)) AS k FROM n),
z AS (SELECT k.subject, k, min(k.m) AS m, sum(value * cos(2 * pi() * k * i / n)) / min(n) AS a, sum(-value * sin(2 * pi() * k * i / n)) / min(n) AS b FROM k JOIN pts USING (subject) GROUP BY 1, 2), o AS (SELECT subject, m, unnest(range(0, m)) AS i FROM n)
SELECT o.subject, o.i, round(sum(CASE WHEN k = 0 THEN a WHEN 2 * k = o.m THEN 2 * a * cos(pi() * o.i) ELSE 2 * (a * cos(2 * pi() * k * o.i / o.m) - b * sin(2 * pi() * k * o.i / o.m)) END), 5) AS value FROM o JOIN z USING (subject) GROUP BY 1, 2""")(lambda spark, d: rounded(P.resample(raw_record(spark, d), 0.5, "fourier").df, 5))
_SIGMA = float(np.sqrt(np.log(2) / 2) / (np.pi * 0.2))
_REACH = int(4 * _SIGMA + 0.5)
query("smooth_gaussian", f"""WITH {_PTS}, n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), w AS (SELECT unnest(range(-{_REACH}, {_REACH} + 1)) AS k), v AS (SELECT k, exp(-0.5 * pow(k / {_SIGMA}::DOUBLE, 2)) AS w FROM w), q AS (SELECT k, w / (SELECT sum(w) FROM v) AS w FROM v),
j AS (SELECT subject, i, w, CASE WHEN (i + k + 2 * n) % (2 * n) < n THEN (i + k + 2 * n) % (2 * n) ELSE 2 * n - 1 - (i + k + 2 * n) % (2 * n) END AS at FROM pts JOIN n USING (subject) CROSS JOIN q) SELECT j.subject, j.i, round(sum(w * p.value), 6) AS value FROM j JOIN pts p ON p.subject = j.subject AND p.i = j.at GROUP BY 1, 2""")(lambda spark, d: rounded(SS.smooth(points(spark, d).select("subject", "i", "value"), ["value"], 0.2, 1.0)))
simple("rms_pairwise", "SELECT subject, round(sqrt(2 * (var_pop(value) + var_pop(gap)) * count(*) / (count(*) - 1)), 6) AS rms FROM pts GROUP BY subject", lambda p: P.rms_pairwise_distance(p, ["value", "gap"]))
simple("shape_stats", f", {_PAIRS}, q AS (SELECT subject, quantile_cont(d, 0.999) AS q, max(d) AS m FROM pairs GROUP BY 1), c AS (SELECT subject, value - avg(value) OVER (PARTITION BY subject) AS x FROM pts), s AS (SELECT subject, sqrt(2 * avg(x * x) * count(*) / (count(*) - 1)) AS rms, avg(x * x * x) / pow(avg(x * x), 1.5) AS sk FROM c GROUP BY 1) SELECT subject, round(q / rms, 5) AS tail_ratio, round(m / rms, 5) AS max_ratio, round(sk, 5) AS skewness FROM q JOIN s USING (subject)", lambda p: rounded(P.shape_stats(p, ["value"]), 5))
_BLOCKS = {"value": ["value"], "gap": ["gap"]}
_MS = ", s AS (SELECT subject, 2 * var_pop(value) AS v, 2 * var_pop(gap) AS g FROM pts GROUP BY subject), r AS (SELECT *, 2 * (1 / v) / (1 / v + 1 / g) AS wv, 2 * (1 / g) / (1 / v + 1 / g) AS wg FROM s)"
simple("scaler_weighted", f"{_MS}, f AS (SELECT subject, 'value' AS block, v AS ms, wv * 2 * 0.7 AS w FROM r UNION ALL SELECT subject, 'gap', g, wg * 2 * 0.3 FROM r) SELECT subject, block, round(sqrt(ms), 6) AS rms, round(w, 6) AS weight, round(w * ms / sum(w * ms) OVER (PARTITION BY subject), 6) AS variance_share FROM f", lambda p: P.fit_weights(p, _BLOCKS, "weighted", 0.3))
simple("scaler_custom", ", s AS (SELECT subject, 'value' AS block, 2 * var_pop(value) AS ms, 1.0::DOUBLE AS w FROM pts GROUP BY subject UNION ALL SELECT subject, 'gap', 2 * var_pop(gap), 0.25::DOUBLE FROM pts GROUP BY subject) SELECT subject, block, round(sqrt(ms), 6) AS rms, round(w, 6) AS weight, round(w * ms / sum(w * ms) OVER (PARTITION BY subject), 6) AS variance_share FROM s", lambda p: P.fit_weights(p, _BLOCKS, "custom", weights={"value": 1.0, "gap": 0.25}))
simple("scale_report", """, b AS (SELECT subject, i, 'value' AS block, value AS x FROM pts UNION ALL SELECT subject, i, 'gap', gap FROM pts), pr AS (SELECT a.subject, a.block, round(abs(a.x - c.x), 9) AS d FROM b a JOIN b c ON a.subject = c.subject AND a.block = c.block AND a.i <> c.i), q AS (SELECT subject, block, quantile_cont(d, 0.999) AS q FROM pr GROUP BY 1, 2), s AS (SELECT subject, block, 2 * var_pop(x) AS ms, sqrt(2 * var_pop(x) * count(*) / (count(*) - 1)) AS rms FROM b GROUP BY 1, 2),
f AS (SELECT subject, block, sqrt(ms) AS r, (1 / ms) * 2 / sum(1 / ms) OVER (PARTITION BY subject) AS w, ms, q / rms AS tail FROM s JOIN q USING (subject, block)) SELECT subject, block, round(r, 6) AS rms, round(w, 6) AS weight, round(w * ms / sum(w * ms) OVER (PARTITION BY subject), 6) AS variance_share, round(tail, 5) AS tail_ratio, w * ms / sum(w * ms) OVER (PARTITION BY subject) > 0.9 AS dominant, max(tail) OVER (PARTITION BY subject) / min(tail) OVER (PARTITION BY subject) > 1.6 AS uneven_tails FROM f""", lambda p: rounded(P.scale_report(p, _BLOCKS).drop("skewness").withColumn("tail_ratio", F.round("tail_ratio", 5))))

# state spaces
_C = lambda c, n: f"round(cos({c}), 6) AS cos_{n}, round(sin({c}), 6) AS sin_{n}"
_P2 = "phase * 7"
_space = lambda s: s.df
on_record("ppc_space", f"SELECT subject, i, {_C('phase', 'phase')}, {_C(_P2, 'phase2')} FROM pts", lambda r: SS.ppc_space(r).df)
on_record("ppa_space", f"SELECT subject, i, {_C('phase', 'phase')}, {_C(_P2, 'phase2')}, value FROM pts", lambda r: SS.ppa_space(r, "phase", "phase2", "value").df)
on_record("nested_space", f"SELECT subject, i, {_C('phase', 'phase')}, {_C(_P2, 'phase2')}, round(gap, 6) AS gap, value FROM pts", lambda r: SS.nested_space(r, ["phase", "phase2", "gap", "value"]).df)
on_record("freq_amp_space", "SELECT subject, i, round(gap / 3600, 6) AS rate, value FROM pts", lambda r: SS.freq_amp_space(r, amplitude="value").df)
on_record("envelope_space", "SELECT * FROM (SELECT subject, i, value AS value_0, lead(value, 1) OVER w AS value_1, round(gap, 6) AS gap_0, round(lead(gap, 1) OVER w, 6) AS gap_1 FROM pts WINDOW w AS (PARTITION BY subject ORDER BY i)) WHERE value_1 IS NOT NULL", lambda r: SS.envelope_space(r, ["value", "gap"], embed=2).df)
on_record("pac_space_auto", f"SELECT subject, i, {_C('phase', 'phase')}, value FROM pts", lambda r: SS.pac_space(r).df)
on_record("pac_space_smooth", f"""{{smooth}} SELECT subject, i, {_C('phase', 'phase')}, z.value FROM pts JOIN z USING (subject, i)""".replace("{smooth}", f""", n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), w AS (SELECT unnest(range(-{_REACH}, {_REACH} + 1)) AS k), v AS (SELECT k, exp(-0.5 * pow(k / {_SIGMA}::DOUBLE, 2)) AS w FROM w), q AS (SELECT k, w / (SELECT sum(w) FROM v) AS w FROM v),
j AS (SELECT subject, i, w, CASE WHEN (i + k + 2 * n) % (2 * n) < n THEN (i + k + 2 * n) % (2 * n) ELSE 2 * n - 1 - (i + k + 2 * n) % (2 * n) END AS at FROM pts JOIN n USING (subject) CROSS JOIN q), z AS (SELECT j.subject, j.i, round(sum(w * p.value), 6) AS value FROM j JOIN pts p ON p.subject = j.subject AND p.i = j.at GROUP BY 1, 2)"""), lambda r: SS.pac_space(r, "phase", "value", smooth=0.2).df)
# a delay block is shorter: the circle's last points stand beside it
on_record("build_hybrid", """, n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), e AS (SELECT * FROM (SELECT subject, i, value AS value_0, lead(value, 2) OVER w AS value_1, lead(value, 4) OVER w AS value_2 FROM pts WINDOW w AS (PARTITION BY subject ORDER BY i)) WHERE value_2 IS NOT NULL)
SELECT e.subject, e.i, round(cos(p.phase), 6) AS cos_phase, round(sin(p.phase), 6) AS sin_phase, value_0, value_1, value_2 FROM e JOIN n USING (subject) JOIN pts p ON p.subject = e.subject AND p.i = e.i + 4""", lambda r: SS.pac_space(r, "phase", "value", embed_amplitude=3, tau=2).df)
on_record("takens_multivariate", "SELECT * FROM (SELECT subject, i, value AS value_0, lead(value, 2) OVER w AS value_1, round(gap, 6) AS gap_0, round(lead(gap, 2) OVER w, 6) AS gap_1 FROM pts WINDOW w AS (PARTITION BY subject ORDER BY i)) WHERE value_1 IS NOT NULL", lambda r: SS.takens_multivariate(r, ["value", "gap"], 2, 2).df)
on_record("weighted_coords", f"{_MS} SELECT subject, i, round(value * sqrt(wv), 6) AS value, round(gap * sqrt(wg), 4) AS gap FROM pts JOIN r USING (subject)", lambda r: SS.channels(r, ["value", "gap"]).weighted_coords().withColumn("gap", F.round("gap", 4)))
on_record("space_reweight", f"{_MS} SELECT subject, i, round(value * sqrt(wv * 2 * 0.8), 6) AS value, round(gap * sqrt(wg * 2 * 0.2), 4) AS gap FROM pts JOIN r USING (subject)", lambda r: SS.channels(r, ["value", "gap"]).reweight(0.2).weighted_coords().withColumn("gap", F.round("gap", 4)))
on_record("space_reduce", f"""{_MS}, c AS (SELECT subject, i, (value - avg(value) OVER w) * sqrt(wv) AS x, (gap - avg(gap) OVER w) * sqrt(wg) AS y FROM pts JOIN r USING (subject) WINDOW w AS (PARTITION BY subject)), a AS (SELECT subject, 0.5 * atan2(2 * avg(x * y), avg(x * x) - avg(y * y)) AS th FROM c GROUP BY 1)
SELECT subject, i, round(abs(x * cos(th) + y * sin(th)), 3) AS pc1, round(abs(-x * sin(th) + y * cos(th)), 3) AS pc2 FROM c JOIN a USING (subject)""", lambda r: SS.channels(r, ["value", "gap"]).reduce(2).df.select("subject", "i", F.round(F.abs("pc1"), 3).alias("pc1"), F.round(F.abs("pc2"), 3).alias("pc2")))
on_record("space_subsample", ", n AS (SELECT subject, ceil(count(*) / 20.0)::BIGINT AS f FROM pts GROUP BY subject) SELECT subject, i // f AS i, value FROM pts JOIN n USING (subject) WHERE i % f = 0", lambda r: SS.channels(r, ["value"], "none").subsample(max_points=20).df)
on_record("space_indices", "SELECT subject, CASE i WHEN 0 THEN 0 WHEN 7 THEN 1 ELSE 2 END::BIGINT AS i, value FROM pts WHERE i IN (0, 7, 30)", lambda r: SS.channels(r, ["value"], "none").subsample(indices=[30, 0, 7]).df)
on_record("space_describe", ", n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject) SELECT subject, n AS n_points, 3 AS dim, 2 AS n_blocks, 'observable' AS route, n::DOUBLE AS duration FROM n", lambda r: SS.pac_space(r, "phase", "value").describe())
on_record("space_split", f"SELECT subject, i, {_C('phase', 'phase')} FROM pts", lambda r: SS.pac_space(r, "phase", "value").split(["phase"]).df)
on_record("space_custom", "SELECT subject, i, round(value * value, 6) AS square, round(value - gap, 6) AS diff FROM pts", lambda r: SS.custom(r, lambda x: np.column_stack([x[:, 0] ** 2, x[:, 0] - x[:, 1]]), ["square", "diff"], ["value", "gap"]).df)
_BANDED = f"{_FIR}, q0 AS (SELECT subject, i, x AS value FROM b0)"
query("from_bands", f"WITH {_PTS}, {_FIR}, {_HILBERT.replace('n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject),', '', 1).replace('pts', 'bp')} SELECT subject, i - 7 AS i, round(amp, 5) AS amp_slow FROM an JOIN n USING (subject) WHERE i >= 7 AND i < n - 7".replace("hk AS", "bp AS (SELECT subject, i, x AS value FROM b0), hk AS"))(lambda spark, d: rounded(SS.from_bands(raw_record(spark, d), {"slow": (_LO, _HI, "amplitude")}, scaling="none").df, 5))
on_record("block_series", ", t AS (SELECT subject, i, value, atan2(sin(phase), cos(phase)) AS ph FROM pts), st AS (SELECT *, ph - lag(ph) OVER (PARTITION BY subject ORDER BY i) AS turn FROM t), su AS (SELECT *, coalesce(turn - 2 * pi() * round(turn / (2 * pi())), 0) AS step FROM st), sv AS (SELECT *, lead(step) OVER (PARTITION BY subject ORDER BY i) AS after FROM su) SELECT subject, i, round(CASE WHEN i = 0 THEN after WHEN after IS NULL THEN step ELSE (step + after) / 2 END, 5)::DOUBLE AS phase, value FROM sv", lambda r: rounded(D.block_series(SS.pac_space(r, "phase", "value")), 5))

# embedding and dynamics
_AMI = """, x AS (SELECT subject, lag, a, b FROM (SELECT p.subject, l.lag, p.value AS a, q.value AS b FROM pts p CROSS JOIN (SELECT unnest(range(1, 7))::INT AS lag) l JOIN pts q ON q.subject = p.subject AND q.i = p.i + l.lag)), y AS (SELECT *, CAST(least(floor((a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) * 6), 5) AS INT) AS p, CAST(least(floor((b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) * 6), 5) AS INT) AS q FROM x WINDOW w AS (PARTITION BY subject, lag)),
c AS (SELECT subject, lag, p, q, count(*) AS n FROM y GROUP BY ALL), e AS (SELECT subject, lag, n, sum(n) OVER (PARTITION BY subject, lag, p) AS np, sum(n) OVER (PARTITION BY subject, lag, q) AS nq, sum(n) OVER (PARTITION BY subject, lag) AS t FROM c), f AS (SELECT subject, lag, CASE WHEN max(t) >= 24 THEN sum(n::DOUBLE / t * ln(n::DOUBLE * t / (np::DOUBLE * nq))) ELSE 0 END AS ami FROM e GROUP BY 1, 2)"""
simple("ami_lags", f"{_AMI} SELECT subject, lag, round(ami, 6) AS ami FROM f", lambda p: D.ami_curve(p, "value", [1, 2, 3, 4, 5, 6], 6))
simple("estimate_tau_ami", f"{_AMI}, r AS (SELECT subject, lag, round(ami, 9) AS ami FROM f), g AS (SELECT *, lag(ami) OVER w AS before, lead(ami) OVER w AS after FROM r WINDOW w AS (PARTITION BY subject ORDER BY lag)) SELECT subject, coalesce(min(CASE WHEN ami < before AND ami <= after THEN lag END), min(CASE WHEN ami = m THEN lag END)) AS tau FROM (SELECT *, min(ami) OVER (PARTITION BY subject) AS m FROM g) GROUP BY subject", lambda p: D.estimate_tau_ami(p, "value", 6, 6))
_ACF = """, x AS (SELECT subject, i, value - avg(value) OVER (PARTITION BY subject) AS v FROM pts), l AS (SELECT unnest(range(1, 9))::INT AS lag), s AS (SELECT a.subject, l.lag, sum(a.v * b.v) AS s FROM x a CROSS JOIN l JOIN x b ON a.subject = b.subject AND b.i = a.i + l.lag GROUP BY 1, 2), t AS (SELECT subject, sum(v * v) AS ss FROM x GROUP BY 1), c AS (SELECT subject, lag, round(s / ss, 9) AS acf FROM s JOIN t USING (subject))"""
simple("estimate_tau_zero", f"{_ACF} SELECT subject, coalesce(min(CASE WHEN acf <= 0 THEN lag END), arg_min(lag, acf)) AS tau FROM c GROUP BY subject", lambda p: D.estimate_tau_zero(p, "value", 8))
simple("estimate_tau_multi", f"{_ACF}, r AS (SELECT subject, coalesce(min(CASE WHEN acf <= exp(-1.0) THEN lag END), arg_min(lag, acf)) AS tau FROM c GROUP BY subject) SELECT ceil(quantile_cont(tau, 0.5))::INT AS tau FROM r", lambda p: D.estimate_embedding_multi(p, "value", max_lag=8, m_max=2).select("tau"))
_RADII = f", {_PAIRS}, q AS (SELECT subject, quantile_cont(d, 0.01) AS lo, quantile_cont(d, 0.5) AS hi FROM pairs WHERE d > 0 GROUP BY 1), k AS (SELECT unnest(range(0, 12))::INT AS k), r AS (SELECT subject, k, round(lo * exp(ln(hi / lo) / 11 * k), 9) AS radius FROM q CROSS JOIN k WHERE hi > lo), c AS (SELECT subject, k, radius, avg((d <= radius)::INT) AS c FROM r JOIN pairs USING (subject) GROUP BY 1, 2, 3)"
simple("correlation_sum", f"{_RADII} SELECT subject, k, round(radius, 5) AS radius, round(c, 6) AS c FROM c", lambda p: D.correlation_sum(p, ["value"], 12, 1, lo=0.01, hi=0.5).withColumn("radius", F.round("radius", 5)))
simple("correlation_sum_slope", f"{_RADII} SELECT subject, round(regr_slope(ln(c), ln(radius)), 5) AS d2 FROM c WHERE c BETWEEN 0.02 AND 0.4 GROUP BY subject", lambda p: D.correlation_sum(p, ["value"], 12, 1, lo=0.01, hi=0.5).where("c between 0.02 and 0.4").groupBy("subject").agg(F.round(F.regr_slope(F.log("c"), F.log("radius")), 5).alias("d2")))
_EMB = "e AS (SELECT * FROM (SELECT subject, i, value AS x0, lead(value, 1) OVER w AS x1, lead(value, 2) OVER w AS x2 FROM pts WINDOW w AS (PARTITION BY subject ORDER BY i)) WHERE x2 IS NOT NULL)"
_DIV = f""", {_EMB}, n AS (SELECT subject, count(*) AS n FROM e GROUP BY 1), p AS (SELECT a.subject, a.i, b.i AS j, round(sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)), 9) AS d FROM e a JOIN e b ON a.subject = b.subject AND abs(a.i - b.i) >= 3 JOIN n ON n.subject = a.subject WHERE greatest(a.i, b.i) + 5 < n),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, i ORDER BY d, j) AS r FROM p WHERE d > 0) WHERE r = 1), s AS (SELECT unnest(range(0, 6))::INT AS step), h AS (SELECT nn.subject, s.step, round(sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)), 9) AS d FROM nn CROSS JOIN s JOIN e a ON a.subject = nn.subject AND a.i = nn.i + step JOIN e b ON b.subject = nn.subject AND b.i = nn.j + step),
c AS (SELECT subject, step, avg(ln(d)) AS y, count(*) AS n FROM h WHERE d > 0 GROUP BY 1, 2)"""
_x3 = ["x0", "x1", "x2"]
simple("divergence_curve", f"{_DIV} SELECT subject, step, round(y, 6) AS log_distance, n FROM c", lambda p: D.divergence_curve(S.embed(p, "value", 3, 1), _x3, 6, 3))
simple("lyapunov_max", f"{_DIV} SELECT subject, round(regr_slope(y, step), 6) AS lambda_1, round(regr_r2(y, step), 5) AS r2, count(*) AS n_steps FROM c GROUP BY subject", lambda p: D.lyapunov_max(S.embed(p, "value", 3, 1), _x3, 6, 3).select("subject", "lambda_1", F.round("r2", 5).alias("r2"), "n_steps"))
simple("divergence_kantz", f""", {_EMB}, n AS (SELECT subject, count(*) AS n FROM e GROUP BY 1), p AS (SELECT a.subject, a.i, b.i AS j, round(sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)), 9) AS d FROM e a JOIN e b ON a.subject = b.subject AND abs(a.i - b.i) >= 3 JOIN n ON n.subject = a.subject WHERE greatest(a.i, b.i) + 5 < n),
nn AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY subject, i) AS m FROM p WHERE d > 0 AND d <= 20) WHERE m >= 3), s AS (SELECT unnest(range(0, 6))::INT AS step), h AS (SELECT nn.subject, nn.i, s.step, round(sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)), 9) AS d FROM nn CROSS JOIN s JOIN e a ON a.subject = nn.subject AND a.i = nn.i + step JOIN e b ON b.subject = nn.subject AND b.i = nn.j + step),
g AS (SELECT subject, i, step, avg(d) AS d FROM h WHERE d > 0 GROUP BY 1, 2, 3) SELECT subject, step, round(avg(ln(d)), 6) AS log_distance, count(*) AS n FROM g GROUP BY 1, 2""", lambda p: D.divergence_curve(S.embed(p, "value", 3, 1), _x3, 6, 3, "kantz", 20.0, 3))
simple("invariants_series", f"""{_DIV}, pa AS (SELECT a.subject, round(sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)), 9) AS d FROM e a JOIN e b ON a.subject = b.subject AND abs(a.i - b.i) >= 3), q AS (SELECT subject, quantile_cont(d, 0.0002) AS lo, quantile_cont(d, 0.5) AS hi FROM pa WHERE d > 0 GROUP BY 1), k AS (SELECT unnest(range(0, 20))::INT AS k), r AS (SELECT subject, k, round(lo * exp(ln(hi / lo) / 19 * k), 9) AS radius FROM q CROSS JOIN k WHERE hi > lo), u AS (SELECT subject, radius, avg((d <= radius)::INT) AS c FROM r JOIN pa USING (subject) GROUP BY 1, 2),
v AS (SELECT subject, regr_slope(ln(c), ln(radius)) AS d2 FROM u WHERE c BETWEEN 0.01 AND 0.2 GROUP BY 1), l AS (SELECT subject, regr_slope(y, step) AS l FROM c GROUP BY 1) SELECT subject, round(d2, 4) AS "D2", round(l, 4) AS lambda_1 FROM v FULL JOIN l USING (subject)""", lambda p: rounded(D.invariants_from_series(p, "value", 3, 1, 3, 1.0, 6), 4))
_HIG = """, k AS (SELECT unnest(range(1, 9))::INT AS k), n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), d AS (SELECT a.subject, k, n, a.i % k AS m, abs(b.value - a.value) AS d FROM pts a CROSS JOIN k JOIN pts b ON a.subject = b.subject AND b.i = a.i + k JOIN n ON n.subject = a.subject), l AS (SELECT subject, k, m, sum(d) * (min(n) - 1) / count(*) / k / k AS len FROM d GROUP BY subject, k, m), h AS (SELECT subject, k, ln(1.0::DOUBLE / k) AS u, ln(avg(len)) AS v FROM l GROUP BY 1, 2),
sl AS (SELECT *, (v - lag(v) OVER w) / (u - lag(u) OVER w) AS s FROM h WINDOW w AS (PARTITION BY subject ORDER BY k)), fi AS (SELECT *, max(CASE WHEN k = 2 THEN s END) OVER (PARTITION BY subject) AS f FROM sl), en AS (SELECT *, min(CASE WHEN round(abs(s - f) - 0.25 * greatest(abs(f), 1e-12), 9) > 0 THEN k END) OVER (PARTITION BY subject) AS e FROM fi)"""
simple("higuchi_dimension", f"{_HIG} SELECT subject, round(CASE WHEN count(*) >= 3 THEN regr_slope(v, u) END, 5) AS higuchi FROM en WHERE e IS NULL OR k < greatest(e, 4) GROUP BY subject", lambda p: rounded(D.higuchi_dimension(p, "value", 8), 5))
_DFA = """, x AS (SELECT subject, i, value - avg(value) OVER (PARTITION BY subject) AS v, count(*) OVER (PARTITION BY subject) AS n FROM pts), y AS (SELECT subject, i, n, sum(v) OVER (PARTITION BY subject ORDER BY i) AS y FROM x), s AS (SELECT *, i // scale AS seg FROM y CROSS JOIN (SELECT unnest([4, 6, 8, 12, 16])::INT AS scale)), e AS (SELECT subject, scale, seg, greatest(var_pop(y) - covar_pop(i, y) * covar_pop(i, y) / var_pop(i), 0) AS r FROM s WHERE (seg + 1) * scale <= n GROUP BY subject, scale, seg), f AS (SELECT subject, scale, sqrt(avg(r)) AS f FROM e GROUP BY 1, 2)"""
simple("dfa_exponent", f"{_DFA} SELECT subject, round(CASE WHEN count(*) >= 3 THEN regr_slope(ln(f), ln(scale)) END, 4) AS alpha, count(*) AS n_scales FROM f WHERE f > 0 GROUP BY subject", lambda p: rounded(D.dfa_exponent(p, "value", [4, 6, 8, 12, 16]), 4))
simple("hurst_exponent", f"{_DFA} SELECT subject, round(regr_slope(ln(f), ln(scale)), 4) AS hurst FROM f WHERE f > 0 GROUP BY subject", lambda p: rounded(D.hurst_exponent(p, "value", [4, 6, 8, 12, 16]), 4))
_TURN = ", d AS (SELECT subject, i, lead(value) OVER (PARTITION BY subject ORDER BY i) - value AS d FROM pts), e AS (SELECT *, lead(d) OVER (PARTITION BY subject ORDER BY i) AS e FROM d), s AS (SELECT subject, count(*) AS n, sum(CASE WHEN d * e < 0 THEN 1 ELSE 0 END) AS c FROM e GROUP BY subject)"
simple("fine_scale_factor", f"{_TURN} SELECT subject, greatest(1, least(floor(CASE WHEN c > 0 THEN n::DOUBLE / c ELSE n END / 1.2), floor(n / 16.0)))::INT AS factor FROM s", lambda p: D.fine_scale_factor(p, "value", 1.2, 16))
on_record("dynamics_measures", """, l AS (SELECT subject, i, 'value' AS channel, value AS v FROM pts UNION ALL SELECT subject, i, 'gap', gap FROM pts), d AS (SELECT *, v - lag(v) OVER w AS d1 FROM l WINDOW w AS (PARTITION BY subject, channel ORDER BY i)), e AS (SELECT *, lead(d1) OVER (PARTITION BY subject, channel ORDER BY i) AS d2 FROM d), s AS (SELECT subject, channel, count(*) AS n, sum(CASE WHEN d1 * d2 < 0 THEN 1 ELSE 0 END) AS c, sqrt(var_pop(d1) / var_pop(v)) AS mob FROM e GROUP BY 1, 2)
SELECT subject, channel, round(mob, 5) AS mobility, round(log10(n) / (log10(n) + log10(n / (n + 0.4::DOUBLE * c))), 5) AS petrosian FROM s""", lambda r: rounded(D.dynamics_measures(r.df, ["value", "gap"], ("mobility", "petrosian")), 5))
_GEO = lambda pairs: f"m AS (SELECT u, i, min(d) AS d FROM {pairs} GROUP BY 1, 2), a AS (SELECT u, avg(d) AS nn_mean, stddev_pop(d) / avg(d) AS nn_cv FROM m GROUP BY 1)"
query("geometry_descriptors", f"WITH {_PTS}, {_PAIRS}, g AS (SELECT subject AS u, i, d FROM pairs), {_GEO('g')}, q AS (SELECT u, unnest([0.01, 0.02, 0.05, 0.1, 0.2])::DOUBLE AS c, unnest([quantile_cont(d, 0.01), quantile_cont(d, 0.02), quantile_cont(d, 0.05), quantile_cont(d, 0.1), quantile_cont(d, 0.2)]) AS r FROM g GROUP BY u), s AS (SELECT u, regr_slope(ln(c), ln(r)) AS s FROM q WHERE r > 0 GROUP BY 1), x AS (SELECT subject AS u, sqrt(var_pop(value)) AS x FROM pts GROUP BY 1) SELECT u AS subject, round(nn_mean, 8) AS nn_mean, round(nn_cv, 5) AS nn_cv, round(s, 5) AS corr_slope, round(x, 5) AS extent FROM a LEFT JOIN s USING (u) JOIN x USING (u)")(lambda spark, d: (lambda g: g.select("subject", F.round("nn_mean", 8).alias("nn_mean"), *[F.round(c, 5).alias(c) for c in ("nn_cv", "corr_slope", "extent")]))(D.geometry_descriptors(points(spark, d), ["value"])))
on_record("lambda_sweep", f"""{_MS}, g AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS l), w AS (SELECT subject, l, i, value * sqrt(wv) * sqrt(2 * (1 - l)) AS x, gap * sqrt(wg) * sqrt(2 * l) AS y FROM pts JOIN r USING (subject) CROSS JOIN g), p AS (SELECT a.subject, a.l, a.i, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9) AS d FROM w a JOIN w b ON a.subject = b.subject AND a.l = b.l AND a.i <> b.i),
m AS (SELECT subject, l, i, min(d) AS d FROM p GROUP BY 1, 2, 3), a AS (SELECT subject, l, avg(d) AS nn_mean, stddev_pop(d) / avg(d) AS cv FROM m GROUP BY 1, 2) SELECT subject, l AS lambda, round(nn_mean, 4) AS nn_mean, round(cv, 4) AS nn_cv, round(arg_min(cv, l) OVER (PARTITION BY subject) + (arg_max(cv, l) OVER (PARTITION BY subject) - arg_min(cv, l) OVER (PARTITION BY subject)) * (l - 0.1) / 0.8 - cv, 4)::DOUBLE AS deficit FROM a""", lambda r: rounded(D.lambda_sweep(SS.channels(r, ["value", "gap"]), (0.1, 0.5, 0.9)).select("subject", "lambda", "nn_mean", "nn_cv", "deficit"), 4))
on_record("compare_routes", f", g AS (SELECT 'a' AS route, a.subject, a.i, round(abs(a.value - b.value), 9) AS d FROM pts a JOIN pts b ON a.subject = b.subject AND a.i <> b.i UNION ALL SELECT 'b', a.subject, a.i, round(sqrt(pow(a.value - b.value, 2) + pow(a.gap / 3600 - b.gap / 3600, 2)), 9) FROM pts a JOIN pts b ON a.subject = b.subject AND a.i <> b.i), m AS (SELECT route, subject, i, min(d) AS d FROM g GROUP BY 1, 2, 3) SELECT route, subject, round(avg(d), 4) AS nn_mean, CASE WHEN route = 'a' THEN 1 ELSE 2 END AS dim FROM m GROUP BY 1, 2", lambda r: rounded(D.compare_routes({"a": SS.channels(r, ["value"], "none"), "b": SS.channels(r, ["value", "rate"], "none")}).select("route", "subject", "nn_mean", "dim"), 4))

# coupling
_BIN6 = "CAST(least(floor((phase + pi()) / (2 * pi()) * 6), 5) AS INT)"
simple("coupling_indices", f""", g AS (SELECT subject, {_BIN6} AS bin, avg(value) AS mean, count(*) AS n FROM pts GROUP BY 1, 2), s AS (SELECT subject, sum(n) AS n, sum(CASE WHEN s > 0 THEN s * ln(s) END) AS h FROM (SELECT *, mean / sum(mean) OVER (PARTITION BY subject) AS s FROM g) GROUP BY 1), c AS (SELECT subject, (max(mean) - min(mean)) / (max(mean) + min(mean)) AS contrast FROM g GROUP BY 1), b AS (SELECT subject, bin FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(mean, 9) DESC, bin) AS r FROM g) WHERE r = 1),
v AS (SELECT subject, sqrt(pow(avg(value * cos(phase)), 2) + pow(avg(value * sin(phase)), 2)) / avg(value) AS mvl FROM pts GROUP BY 1), r AS (SELECT subject, rank() OVER (PARTITION BY subject ORDER BY value) + (count(*) OVER (PARTITION BY subject, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY subject ORDER BY gap) + (count(*) OVER (PARTITION BY subject, gap) - 1) / 2.0 AS b FROM pts), a AS (SELECT subject, corr(a, b) AS aac FROM r GROUP BY 1)
SELECT subject, round(mvl, 6) AS mvl, round(CASE WHEN n >= 24 THEN (ln(6) + h) / ln(6) END, 6) AS mi_tort, round(contrast, 6) AS mod_contrast, round((bin + 0.5) * 2 * pi() / 6 - pi(), 6) AS preferred_phase, round(aac, 6) AS aac FROM v JOIN s USING (subject) JOIN c USING (subject) JOIN b USING (subject) JOIN a USING (subject)""", lambda p: C.coupling_indices(p, "phase", "value", amp2="gap", n_bins=6))
simple("aac_pearson", "SELECT subject, round(corr(value, gap), 6) AS rho FROM pts GROUP BY subject", lambda p: C.aac_index(p, "value", "gap", "pearson"))
simple("negative_envelopes", "SELECT subject, count(value) AS n, CAST(sum((value < 0)::INT) AS BIGINT) AS n_negative, sum((value < 0)::INT) = 0 AS ok FROM pts GROUP BY subject", lambda p: C.negative_envelopes(p, "value"))
_SHARES = C.shift_shares(200)
simple("surrogate_significance", f""", n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), u AS (SELECT 0 AS k, -1.0::DOUBLE AS u UNION ALL SELECT unnest(range(1, 201)), unnest({_SHARES}::DOUBLE[])), m AS (SELECT p.subject, k, (p.i + CASE WHEN k = 0 THEN 0 ELSE n // 10 + floor(u * (n - 2 * (n // 10)))::BIGINT END) % n AS i, p.value AS a FROM pts p JOIN n USING (subject) CROSS JOIN u),
v AS (SELECT m.subject, k, round(sqrt(pow(avg(a * cos(phase)), 2) + pow(avg(a * sin(phase)), 2)) / avg(a), 9) AS v FROM m JOIN pts q ON q.subject = m.subject AND q.i = m.i GROUP BY 1, 2), o AS (SELECT subject, v AS o FROM v WHERE k = 0) SELECT v.subject, round(min(o), 6) AS observed, round(avg(v), 6) AS null_mean, round(stddev_pop(v), 6) AS null_std, round((min(o) - avg(v)) / stddev_pop(v), 4) AS z, round((1 + sum((v >= o)::INT))::DOUBLE / 201, 6) AS p FROM v JOIN o USING (subject) WHERE k > 0 GROUP BY v.subject""", lambda p: C.surrogate_significance(p, "phase", "value").withColumn("z", F.round("z", 4)))

# windows
_GRID = f"n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), g0 AS (SELECT subject, n, unnest(range(0, n - {SIZE} + 1, {STEP})) AS s FROM n WHERE n >= {SIZE}), g AS (SELECT subject, CAST(s // {STEP} AS INT) AS win, s, s + {SIZE} AS e FROM g0)"
_WPTS = "wp AS (SELECT p.subject, g.win, p.i - g.s AS i, p.value, p.gap, p.phase FROM pts p JOIN g ON g.subject = p.subject AND p.i >= g.s AND p.i < g.e)"
simple("window_grid_tail", f", {_GRID}, t AS (SELECT * FROM g UNION ALL SELECT subject, CAST((n - {SIZE}) // {STEP} + 1 AS INT), n - {SIZE}, n FROM n WHERE n >= {SIZE} AND (n - {SIZE}) % {STEP} <> 0) SELECT subject, win AS \"window\", s AS start, e AS stop, 'w' || lpad(win::VARCHAR, 3, '0') AS label, s / 2.0::DOUBLE AS t_start, e / 2.0::DOUBLE AS t_stop, (s + e) / 4.0::DOUBLE AS t_center FROM t", lambda p: W.WindowSpec(size=SIZE, step=STEP, drop_last=False).grid(R.unit_sizes(p), 2.0))
simple("window_describe", f", {_GRID} SELECT subject, win AS \"window\", s AS start, e AS stop, e - s AS n_samples, s - lag(s) OVER w AS step_samples, greatest(lag(e) OVER w - s, 0) AS overlap_samples FROM g WINDOW w AS (PARTITION BY subject ORDER BY win)", lambda p: W.WindowSpec(size=SIZE, overlap=0.5).describe(R.unit_sizes(p)).drop("label", "t_start", "t_stop", "t_center").withColumn("overlap_samples", F.when(F.col("step_samples").isNotNull(), F.col("overlap_samples")).otherwise(F.lit(0))).withColumn("overlap_samples", F.col("overlap_samples").cast("long")))
simple("window_pairs", ", n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), w AS (SELECT 0 AS win, 0 AS s, 30 AS e UNION ALL SELECT 1, 20, 70) SELECT subject, win AS \"window\", s::BIGINT AS start, e::BIGINT AS stop FROM n CROSS JOIN w WHERE e <= n", lambda p: W.resolve_windows([(0, 30), (20, 70)], R.unit_sizes(p)).select("subject", "window", "start", "stop"))


def _wr(spark, d, scope="per_window", coords=("value",)):
    p = points(spark, d).select("subject", "i", "value", "gap", "phase")
    return W.windowed_recurrence(p, list(coords), W.WindowSpec(size=SIZE, step=STEP), RR, 1, scope)


_WREC = f"{_GRID}, {_WPTS}, wpairs AS (SELECT a.subject, a.win, a.i, b.i AS j, round(abs(a.value - b.value), 9) AS d FROM wp a JOIN wp b ON a.subject = b.subject AND a.win = b.win AND a.i <> b.i), we AS (SELECT subject, win, round(quantile_cont(d, {RR}), 9) AS eps FROM wpairs GROUP BY 1, 2), wr AS (SELECT subject, win, min(eps) AS eps, avg((d <= eps)::INT) AS rr FROM wpairs JOIN we USING (subject, win) GROUP BY 1, 2)"
query("windowed_metrics", f"""WITH {_PTS}, {_WREC}, cv AS (SELECT subject, win, sqrt(pow(avg(value * cos(phase)), 2) + pow(avg(value * sin(phase)), 2)) / avg(value) AS mvl FROM wp GROUP BY 1, 2), d1 AS (SELECT *, value - lag(value) OVER (PARTITION BY subject, win ORDER BY i) AS d FROM wp), mo AS (SELECT subject, win, CASE WHEN var_pop(value) > 0 THEN sqrt(var_pop(d) / var_pop(value)) ELSE 0 END AS mobility FROM d1 GROUP BY 1, 2)
SELECT subject, win AS "window", s AS start, e AS stop, round(eps, 6) AS epsilon, round(rr, 6) AS recurrence_rate, round(mvl, 5) AS mvl, round(mobility, 5) AS mobility FROM g JOIN wr USING (subject, win) LEFT JOIN cv USING (subject, win) LEFT JOIN mo USING (subject, win)""")(lambda spark, d: rounded(_wr(spark, d).metrics(classical=("phase", "value"), dynamics=("mobility",)).select("subject", "window", "start", "stop", "epsilon", "recurrence_rate", F.round("mvl", 5).alias("mvl"), F.round("mobility", 5).alias("mobility"))))
query("windowed_describe", f"WITH {_PTS}, {_WREC} SELECT subject, count(*) AS n_windows, round(avg(eps), 5) AS epsilon_mean, round(stddev_pop(eps), 5) AS epsilon_std, min(round(eps, 5)) AS epsilon_min, max(round(eps, 5)) AS epsilon_max, round(stddev_pop(eps) / avg(eps), 5) AS epsilon_cv FROM wr GROUP BY subject HAVING avg(eps) > 0")(lambda spark, d: rounded(_wr(spark, d).describe(("epsilon",)), 5))
query("windowed_series", f"WITH {_PTS}, {_WREC} SELECT subject, win AS \"window\", (s + e) / 2.0::DOUBLE AS t_center, round(rr, 6) AS recurrence_rate FROM wr JOIN g USING (subject, win)")(lambda spark, d: rounded(_wr(spark, d).series()))
query("windowed_matrices", f"WITH {_PTS}, {_WREC} SELECT subject, win AS \"window\", count(*) AS n, CAST(sum(i * 31 + j) AS BIGINT) AS s FROM wpairs JOIN we USING (subject, win) WHERE d <= eps GROUP BY 1, 2")(lambda spark, d: _wr(spark, d).matrices().groupBy("subject", "window").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i") * 31 + F.col("j")).alias("s")))
query("windowed_one_matrix", f"WITH {_PTS}, {_WREC} SELECT subject, i, j FROM wpairs JOIN we USING (subject, win) WHERE d <= eps AND win = 1")(lambda spark, d: _wr(spark, d).matrix(1))
query("windowed_sweep", f"WITH {_PTS}, {_WREC}, rc AS (SELECT subject, win, i, j FROM wpairs JOIN we USING (subject, win) WHERE d <= eps), dg AS (SELECT subject, win, count(*) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY subject, win, j - i ORDER BY i) AS q FROM rc) GROUP BY subject, win, j - i, q), k AS (SELECT subject, win, sum(length)::DOUBLE AS k FROM dg GROUP BY 1, 2) SELECT subject, win AS \"window\", floor, round(sum(CASE WHEN length >= floor THEN length ELSE 0 END) / min(k), 6) AS \"DET\" FROM dg CROSS JOIN (SELECT unnest([2, 3, 4])::INT AS floor) JOIN k USING (subject, win) GROUP BY 1, 2, 3")(lambda spark, d: rounded(_wr(spark, d).line_length_sweep((2, 3, 4)).select("subject", "window", "floor", "DET")))
query("windowed_cross", f"WITH {_PTS}, {_GRID}, {_WPTS}, op AS (SELECT p.subject - 1 AS subject, g.win, p.i - g.s AS i, p.value FROM pts p JOIN g ON g.subject = p.subject - 1 AND p.i >= g.s AND p.i < g.e), c AS (SELECT a.subject, a.win, round(abs(a.value - b.value), 9) AS d FROM wp a JOIN op b ON a.subject = b.subject AND a.win = b.win), e AS (SELECT subject, win, round(quantile_cont(d, {RR}), 9) AS eps FROM c GROUP BY 1, 2) SELECT subject, win AS \"window\", round(min(eps), 6) AS eps, count(*) AS n_pairs, CAST(sum((d <= eps)::INT) AS BIGINT) AS n_recurrent, round(avg((d <= eps)::INT), 6) AS rr FROM c JOIN e USING (subject, win) GROUP BY 1, 2")(
    lambda spark, d: rounded((lambda p: W.windowed_cross_recurrence(p, p.withColumn("subject", F.col("subject") - 1), ["value"], W.WindowSpec(size=SIZE, step=STEP).grid(R.unit_sizes(p)), RR))(points(spark, d)))
)
query("windowed_joint", f"WITH {_PTS}, {_GRID}, {_WPTS}, c AS (SELECT a.subject, a.win, round(abs(a.value - b.value), 9) AS d, round(abs(a.gap - b.gap), 9) AS f FROM wp a JOIN wp b ON a.subject = b.subject AND a.win = b.win AND a.i <> b.i), e AS (SELECT subject, win, round(quantile_cont(d, {RR}), 9) AS x, round(quantile_cont(f, {RR}), 9) AS y FROM c GROUP BY 1, 2), r AS (SELECT subject, win, avg((d <= x AND f <= y)::INT) AS j, avg((d <= x)::INT) AS a, avg((f <= y)::INT) AS b FROM c JOIN e USING (subject, win) GROUP BY 1, 2) SELECT subject, win AS \"window\", round(j, 6) AS rr_joint, round(a, 6) AS rr_value, round(b, 6) AS rr_gap, round(j / (a * b), 5) AS independence_ratio FROM r")(
    lambda spark, d: rounded((lambda p: W.windowed_joint_recurrence(p, _BLOCKS, W.WindowSpec(size=SIZE, step=STEP).grid(R.unit_sizes(p)), RR))(points(spark, d)).withColumn("independence_ratio", F.round("independence_ratio", 5)))
)

# comparability and groups
simple("unit_contract", """, n AS (SELECT subject, count(*)::DOUBLE AS n FROM pts GROUP BY subject), s AS (SELECT min(n) AS lo, max(n) AS hi, count(DISTINCT n) AS k, CAST(sum((abs(n - 66) > 0.1 * greatest(n, 66))::INT) AS BIGINT) AS off FROM n)
SELECT 'n_samples' AS axis, CASE WHEN hi - lo <= 0.1 * hi AND off = 0 THEN 'ok' ELSE 'violated' END AS status, k AS n_values, lo AS least, hi AS most, off AS n_offenders FROM s UNION ALL SELECT 'fs', 'ok', 1, 1.0::DOUBLE, 1.0::DOUBLE, 0 UNION ALL SELECT 'metric', 'ok', 1, NULL, NULL, 0 UNION ALL SELECT 'theiler', 'violated', 1, 1.0::DOUBLE, 1.0::DOUBLE, (SELECT count(*) FROM n) UNION ALL SELECT 'route', 'absent', 0, NULL, NULL, 0""", lambda p: K.check_comparability(_units(p), K.ComparabilityContract({"n_samples": 66, "theiler": 2}, 0.1), ("n_samples", "fs", "metric", "theiler", "route")).drop("expected"))


def _units(p):
    return K.describe_units(R.unit_sizes(p).withColumnRenamed("n", "n_samples"), fs=1.0, metric="euclidean", theiler=1, threshold_mode="target_rr", target_rr=RR, window_size=SIZE)


simple("metric_validity", "SELECT * FROM (VALUES ('coupling', true, ''), ('determinism', true, ''), ('entropy', true, ''), ('invariants', false, 'embedding_m,embedding_tau'), ('line_lengths', true, ''), ('recurrence_rate', false, 'scaling')) t(family, valid, lacking)", lambda p: K.metric_validity(K.check_comparability(_units(p))))
_TAB = ", f AS (SELECT subject, CAST(i // 20 AS INT) AS win, CAST(subject % 2 AS INT) AS g, round(avg(value), 9) AS m, round(stddev_pop(value), 9) AS s FROM pts GROUP BY 1, 2), l AS (SELECT subject, win, g, 'm' AS metric, m AS v FROM f UNION ALL SELECT subject, win, g, 's', s FROM f)"


def window_table(p):
    return p.groupBy("subject", F.expr("int(i div 20)").alias("win")).agg(F.round(F.avg("value"), 9).alias("m"), F.round(F.stddev_pop("value"), 9).alias("s")).withColumn("g", (F.col("subject") % 2).cast("int"))


def _erfc(x):
    t = f"(1 / (1 + 0.5 * ({x})))"
    s = "0.17087277::DOUBLE"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        s = f"({s} * t + {c}::DOUBLE)"
    return t, s


_T, _SERIES = _erfc("zz")
_TESTS = f"""{_TAB}, r AS (SELECT *, rank() OVER (PARTITION BY metric, win ORDER BY v) + (count(*) OVER (PARTITION BY metric, win, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY metric, win, v) AS t FROM l),
a AS (SELECT metric, win, count(v) FILTER (g = 0) AS n_a, count(v) FILTER (g = 1) AS n_b, avg(v) FILTER (g = 0) AS mean_a, avg(v) FILTER (g = 1) AS mean_b, stddev_samp(v) FILTER (g = 0) AS std_a, stddev_samp(v) FILTER (g = 1) AS std_b, sum(r) FILTER (g = 1)::DOUBLE AS rb, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1, 2),
b AS (SELECT *, rb - n_b * (n_b + 1) / 2.0::DOUBLE AS u, sqrt(n_a::DOUBLE * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))) AS sd FROM a WHERE n_a >= 2 AND n_b >= 2), z AS (SELECT *, greatest(abs(u - n_a * n_b / 2.0::DOUBLE) - 0.5, 0) / sd / sqrt(2) AS zz FROM b), y AS (SELECT *, {_T} AS t FROM z), x AS (SELECT *, least(t * exp(-zz * zz + {_SERIES}), 1) AS p FROM y)"""
_tests = lambda p: K.group_tests(window_table(p), ["m", "s"], "g", "win").drop("ties")
query("group_tests", f"WITH {_PTS} {_TESTS} SELECT metric, win, n_a, n_b, round(mean_a, 8) AS mean_a, round(mean_b, 8) AS mean_b, round(std_a, 5) AS std_a, round(std_b, 5) AS std_b, round(mean_b - mean_a, 8) AS diff, round((mean_b - mean_a) / sqrt(((n_a - 1) * std_a * std_a + (n_b - 1) * std_b * std_b) / (n_a + n_b - 2)), 5) AS cohens_d, u, round(u / (n_a * n_b), 6) AS auc, round(p, 6) AS p_normal FROM x")(lambda spark, d: _tests(points(spark, d)).withColumns({c: F.round(c, 8) for c in ("mean_a", "mean_b", "diff")} | {c: F.round(c, 5) for c in ("std_a", "std_b", "cohens_d")} | {c: F.round(c, 6) for c in ("u", "auc", "p_normal")}))
simple("rank_metrics_many", f"{_TESTS}, w AS (SELECT metric, avg(abs(u / (n_a * n_b) - 0.5) + 0.5) AS mean_auc, max(abs(u / (n_a * n_b) - 0.5) + 0.5) AS max_auc, min(p) AS min_p FROM x GROUP BY 1) SELECT metric, round(mean_auc, 6) AS mean_auc, round(max_auc, 6) AS max_auc, round(min_p, 6) AS min_p, CAST(row_number() OVER (ORDER BY mean_auc DESC, metric) AS INT) AS place FROM w", lambda p: K.rank_metrics(K.group_tests(window_table(p), ["m", "s"], "g", "win")))
simple("group_comparison_bonferroni", f"{_TESTS} SELECT metric, win, round(least(p * count(*) OVER (), 1), 5) AS p_bonferroni FROM x QUALIFY least(n_a, n_b) > 8", lambda p: K.group_comparison(window_table(p), ["m", "s"], "g", "win").where("least(n_a, n_b) > 8").select("metric", "win", F.round("p_bonferroni", 5).alias("p_bonferroni")))
query("build_features_all", f"WITH {_PTS} {_TAB}, o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY win) AS ord FROM f) SELECT subject, round(avg(m), 8) AS m_mean, round(stddev_samp(m), 5) AS m_std, round(regr_slope(m, ord), 5) AS m_trend FROM o GROUP BY subject")(lambda spark, d: I.build_features(window_table(points(spark, d)), ["m"], "subject", "all", "win").select("subject", F.round("m_mean", 8).alias("m_mean"), F.round("m_std", 5).alias("m_std"), F.round("m_trend", 5).alias("m_trend")))
simple("align_labels", f"{_TAB} SELECT subject, win, round(m, 6) AS m, CASE WHEN subject % 3 = 0 THEN 'a' ELSE 'b' END AS label FROM f WHERE subject % 5 <> 0", lambda p: I.align_labels(window_table(p).select("subject", "win", "m"), p.select("subject").distinct().withColumn("label", F.when(F.col("subject") % 5 != 0, F.when(F.col("subject") % 3 == 0, "a").otherwise("b")))))
simple("label_importances", ", f AS (SELECT subject, subject % 2 AS label, avg(value) AS a, stddev_pop(value) AS b FROM pts GROUP BY 1, 2) SELECT 'a' AS feature, round(abs(avg(a) FILTER (label = 1) - avg(a) FILTER (label = 0)) / stddev_pop(a), 6) AS weight FROM f UNION ALL SELECT 'b', round(abs(avg(b) FILTER (label = 1) - avg(b) FILTER (label = 0)) / stddev_pop(b), 6) FROM f", lambda p: I.importances(p.groupBy("subject").agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("b")).withColumn("label", F.col("subject") % 2), ["a", "b"]))

# generators
query("generate_henon", "WITH RECURSIVE h AS (SELECT 0::BIGINT AS i, 0.1::DOUBLE AS x, 0.3::DOUBLE AS y UNION ALL SELECT i + 1, 1 - 1.4::DOUBLE * x * x + y, 0.3::DOUBLE * x FROM h WHERE i < 60) SELECT 'henon' AS subject, i - 1 AS i, round(x, 6) AS x, round(y, 6) AS y FROM h WHERE i >= 1 AND i <= 40")(lambda spark, d: rounded(G.generate_system(spark, "henon", 40, transient=0)))
query("generate_mackey_glass", "WITH RECURSIVE m AS (SELECT 0::BIGINT AS i, [1.2::DOUBLE FOR x IN range(0, 18)] AS h UNION ALL SELECT i + 1, list_append(list_slice(h, 2, 18), h[18] + 0.2::DOUBLE * h[1] / (1 + pow(h[1], 10)) - 0.1::DOUBLE * h[18]) FROM m WHERE i < 60) SELECT 'mackey_glass' AS subject, i - 1 AS i, round(h[18], 6) AS x FROM m WHERE i >= 1")(lambda spark, d: rounded(G.generate_system(spark, "mackey_glass", 60, transient=0)))


def _rk4(name: str, rhs: list[str], start: list[float], dt: float, steps: int, keep: int) -> str:
    """Fourth-order Runge-Kutta in SQL, one row a step."""
    dims = len(start)
    v = [f"x{k}" for k in range(dims)]

    def stage(tag: str, source: list[str]) -> str:
        out = []
        for k in range(dims):
            e = rhs[k]
            for j in range(dims):
                e = e.replace(f"${j}", f"({source[j]})")
            out.append(f"{e} AS {tag}{k}")
        return ", ".join(out)

    h = f"{dt!r}::DOUBLE"
    a = f"SELECT *, {stage('a', v)} FROM s0"
    b = f"SELECT *, {stage('b', [f'x{k} + {h} / 2 * a{k}' for k in range(dims)])} FROM ({a})"
    c = f"SELECT *, {stage('c', [f'x{k} + {h} / 2 * b{k}' for k in range(dims)])} FROM ({b})"
    e = f"SELECT *, {stage('e', [f'x{k} + {h} * c{k}' for k in range(dims)])} FROM ({c})"
    step = ", ".join(f"x{k} + {h} / 6 * (a{k} + 2 * b{k} + 2 * c{k} + e{k})" for k in range(dims))
    names = ["x", "y", "z"][:dims]
    return f"WITH RECURSIVE s0 AS (SELECT 0::BIGINT AS n, {', '.join(f'{x!r}::DOUBLE AS x{k}' for k, x in enumerate(start))} UNION ALL SELECT n + 1, {step} FROM ({e}) WHERE n < {steps}) SELECT '{name}' AS subject, n // 4 - 1 AS i, {', '.join(f'round(x{k}, 6) AS {names[k]}' for k in range(dims))} FROM s0 WHERE n % 4 = 0 AND n >= 4 AND n <= {4 * keep}"


for _n, _rhs, _y, _dt in (
    ("lorenz", ["10 * ($1 - $0)", "$0 * (28 - $2) - $1", "$0 * $1 - 8.0::DOUBLE / 3 * $2"], [1.0, 1.0, 1.0], 0.01),
    ("rossler", ["-$1 - $2", "$0 + 0.2::DOUBLE * $1", "0.2::DOUBLE + $2 * ($0 - 5.7::DOUBLE)"], [1.0, 1.0, 1.0], 0.05),
    ("van_der_pol", ["$1", "2 * (1 - $0 * $0) * $1 - $0"], [1.0, 0.0], 0.05),
):
    query(f"generate_{_n}", _rk4(_n, _rhs, _y, _dt / 4, 400, 100))(lambda spark, d, n=_n: rounded(G.generate_system(spark, n, 100, transient=0)))

# figures
_N = "n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject)"


def fig(name: str, sql: str, build):
    def run(spark, d):
        pts, pair, eps, rec = parts(spark, d)
        return rounded(build(pts, pair, eps, rec))

    query(name, f"{_CORE}, {_N} {sql}")(run)


fig("figure_density_bands", ", c AS (SELECT subject, i, ceil((i + 1) * least(8, n) / n::DOUBLE)::INT - 1 AS band, n FROM pts JOIN n USING (subject)), h AS (SELECT subject, i, count(*) AS h FROM rec GROUP BY 1, 2), s AS (SELECT subject, band, min(n) AS n, sum(coalesce(h, 0)) AS h, sum(n - 1) AS cells FROM c LEFT JOIN h USING (subject, i) GROUP BY 1, 2) SELECT subject, band, floor(band * n / least(8, n)::DOUBLE)::BIGINT AS first, floor((band + 1) * n / least(8, n)::DOUBLE)::BIGINT AS stop, round(h::DOUBLE / cells, 6) AS density FROM s", lambda pts, pair, eps, rec: FIG.density_profile(rec, R.unit_sizes(pts), 8))
fig("figure_pooled", ", f AS (SELECT *, ceil(n / 16.0)::BIGINT AS f FROM n), c AS (SELECT subject, n, f, i // f AS r, j // f AS q, count(*) AS h FROM rec JOIN f USING (subject) GROUP BY ALL) SELECT subject, r AS row, q AS col, round(h::DOUBLE / (least(f, n - r * f) * least(f, n - q * f)), 6) AS value FROM c", lambda pts, pair, eps, rec: FIG.pool_matrix(rec, R.unit_sizes(pts), 16, "mean"))
fig("figure_render", ", f AS (SELECT *, ceil(n / 16.0)::BIGINT AS f FROM n) SELECT DISTINCT subject, i // f AS row, j // f AS col, 1.0::DOUBLE AS value FROM rec JOIN f USING (subject)", lambda pts, pair, eps, rec: FIG.render_recurrence(rec, R.unit_sizes(pts), 16, "max"))
fig("figure_image", ", c AS (SELECT subject, n, i * 8 // n AS r, j * 8 // n AS q, count(*) AS h FROM rec JOIN n USING (subject) GROUP BY ALL) SELECT subject, r::INT AS row, q::INT AS col, round(h / ((ceil((r + 1) * n / 8.0) - ceil(r * n / 8.0)) * (ceil((q + 1) * n / 8.0) - ceil(q * n / 8.0)))::DOUBLE, 6) AS value FROM c", lambda pts, pair, eps, rec: images.recurrence_image(rec, R.unit_sizes(pts), 8))
fig("figure_threshold", ", m AS (SELECT subject, min(d) AS lo, max(d) AS hi FROM pairs GROUP BY 1), b AS (SELECT subject, least(floor((d - lo) / (hi - lo) * 16), 15)::INT AS bin, min(lo) AS lo, min((hi - lo) / 16) AS s, count(*) AS n FROM pairs JOIN m USING (subject) GROUP BY 1, 2), r AS (SELECT subject, min(eps) AS eps, avg((d <= eps)::INT) AS rr FROM pairs JOIN eps USING (subject) GROUP BY 1) SELECT subject, bin, round(lo + bin * s + 1e-7, 3) AS lo, round(lo + (bin + 1) * s + 1e-7, 3) AS hi, n, round(eps, 5) AS eps, round(rr, 5) AS achieved_rr FROM b JOIN r USING (subject)", lambda pts, pair, eps, rec: rounded(FIG.threshold_diagnostics(pair, eps, 16).drop("below").withColumns({c: F.round(F.col(c) + 1e-7, 3) for c in ("lo", "hi")}), 5))
fig("figure_lines", f", {_DIAG}, l AS (SELECT subject, 'diagonal' AS kind, length, count(*) AS cnt FROM dg WHERE length >= 2 GROUP BY 1, 3) SELECT subject, kind, length, cnt, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY subject), 6) AS share FROM l", lambda pts, pair, eps, rec: FIG.line_distributions(R.line_histogram(rec, R.unit_sizes(pts)).where("kind = 'diagonal'")))
fig("figure_thresholds", ", f AS (SELECT subject, 'fixed' AS panel, 1.5::DOUBLE AS eps FROM eps UNION ALL SELECT subject, 'rate', eps FROM eps) SELECT f.subject, panel, round(min(f.eps), 6) AS eps, round(avg((d <= f.eps)::INT), 6) AS rr FROM pairs JOIN f USING (subject) GROUP BY 1, 2", lambda pts, pair, eps, rec: FIG.compare_thresholds(pair, {"fixed": R.threshold(pair, "fixed", value=1.5), "rate": eps}))
fig("figure_overlay", f", p2 AS (SELECT a.subject, a.i, b.i AS j, round(abs(a.gap - b.gap), 9) AS d FROM pts a JOIN pts b ON a.subject = b.subject AND a.i <> b.i), e2 AS (SELECT subject, round(quantile_cont(d, {RR}), 9) AS eps FROM p2 GROUP BY 1), r2 AS (SELECT p2.subject, i, j FROM p2 JOIN e2 USING (subject) WHERE d <= eps), u AS (SELECT coalesce(a.subject, b.subject) AS subject, CASE WHEN a.i IS NULL THEN 'b' WHEN b.i IS NULL THEN 'a' ELSE 'both' END AS kind FROM rec a FULL JOIN r2 b ON a.subject = b.subject AND a.i = b.i AND a.j = b.j) SELECT subject, kind, count(*) AS n FROM u GROUP BY 1, 2", lambda pts, pair, eps, rec: (lambda p2: FIG.joint_overlay(rec, R.recurrent(p2, R.threshold(p2, "target_rr", RR))).groupBy("subject", "kind").agg(F.count(F.lit(1)).alias("n")))(R.pairs(pts, ["gap"], 1)))
simple("figure_coverage", f", {_GRID} SELECT subject, win AS \"window\", s AS start, e AS stop, round(s::DOUBLE / n, 6) AS from_share, round(e::DOUBLE / n, 6) AS to_share FROM g JOIN n USING (subject)", lambda p: FIG.window_coverage(W.WindowSpec(size=SIZE, step=STEP).grid(R.unit_sizes(p)), R.unit_sizes(p)))
simple("figure_limits", ", q AS (SELECT subject, quantile_cont(value, 0.002) AS a, quantile_cont(value, 0.998) AS b, avg(value) AS m, quantile_cont(gap, 0.002) AS c, quantile_cont(gap, 0.998) AS d, avg(gap) AS k, sqrt(var_pop(value) + var_pop(gap)) AS s FROM pts GROUP BY 1) SELECT 'value' AS coord, round(min((a - m) / s), 5) AS lo, round(max((b - m) / s), 5) AS hi FROM q UNION ALL SELECT 'gap', round(min((c - k) / s), 5), round(max((d - k) / s), 5) FROM q", lambda p: rounded(FIG.shared_limits(p, ["value", "gap"]), 5))
simple("figure_scale", "SELECT subject, round(sqrt(var_pop(value) + var_pop(gap)), 4) AS scale FROM pts GROUP BY subject", lambda p: rounded(FIG.scale_factor(p, ["value", "gap"]), 4))
simple("figure_attractor_image", ", q AS (SELECT subject, quantile_cont(value, 0.001) AS a, quantile_cont(value, 0.999) AS b, quantile_cont(gap, 0.001) AS c, quantile_cont(gap, 0.999) AS d FROM pts GROUP BY 1) SELECT subject, (7 - greatest(0, least(7, floor((gap - c) / (d - c) * 8))))::INT AS row, greatest(0, least(7, floor((value - a) / (b - a) * 8)))::INT AS col, count(*)::DOUBLE AS value FROM pts JOIN q USING (subject) GROUP BY 1, 2, 3", lambda p: images.attractor_image(p, ("value", "gap"), 8))
simple("figure_envelopes", f", {_N}, f AS (SELECT subject, ceil(n / 20.0)::BIGINT AS f FROM n) SELECT subject, i, value, round(gap, 6) AS gap FROM pts JOIN f USING (subject) WHERE i % f = 0", lambda p: FIG.envelope_pair(p, "value", "gap", 20))
on_record("figure_signal", "SELECT subject, i::DOUBLE AS t, 'value' AS channel, value FROM pts WHERE i >= 3 AND i < 13", lambda r: FIG.signal(r, ["value"], 3.0, 10.0))
on_record("figure_policies", f"{_MS}, f AS (SELECT subject, 'none' AS panel, 'value' AS block, v AS ms, 1.0::DOUBLE AS w FROM r UNION ALL SELECT subject, 'none', 'gap', g, 1 FROM r UNION ALL SELECT subject, 'rms_balanced', 'value', v, wv FROM r UNION ALL SELECT subject, 'rms_balanced', 'gap', g, wg FROM r) SELECT subject, panel, block, round(w * ms / sum(w * ms) OVER (PARTITION BY subject, panel), 5) AS variance_share FROM f", lambda r: rounded(FIG.compare_scale_policies(SS.channels(r, ["value", "gap"], "none")).select("subject", "panel", "block", "variance_share"), 5))

# sequential and spectral measures
query("spectral_entropy", f"""WITH {_PTS}, {_N}, c AS (SELECT subject, i, value - avg(value) OVER (PARTITION BY subject) AS x FROM pts), k AS (SELECT subject, n, unnest(range(1, n // 2 + 1)) AS k FROM n), p AS (SELECT c.subject, k, pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2) AS p FROM c JOIN k USING (subject) GROUP BY 1, 2),
q AS (SELECT subject, p / sum(p) OVER (PARTITION BY subject) AS q FROM p) SELECT subject, round(sum(-q * ln(q)) / ln(count(*)), 6) AS spectral FROM q GROUP BY subject""")(lambda spark, d: rounded(S.kernel_measures(points(spark, d), "value").select("subject", "spectral")))
query("lempel_ziv", f"""WITH RECURSIVE {_PTS}, m AS (SELECT subject, median(value) AS m FROM pts GROUP BY 1), s AS (SELECT subject, string_agg(CASE WHEN value > m THEN '1' ELSE '0' END, '' ORDER BY i) AS s, count(*) AS n FROM pts JOIN m USING (subject) GROUP BY 1),
z AS (SELECT subject, s, n, 0::BIGINT AS pos, 0 AS phrases FROM s UNION ALL SELECT subject, s, n, pos + coalesce(list_min([l FOR l IN range(1, n - pos + 1) IF instr(s[1:pos + l - 1], s[pos + 1:pos + l]) = 0]), n - pos + 1), phrases + 1 FROM z WHERE pos < n) SELECT subject, round(max(phrases) / (min(n) / log2(min(n))), 6) AS lz FROM z GROUP BY subject""")(lambda spark, d: rounded(S.kernel_measures(points(spark, d), "value").select("subject", "lz")))
# singular values are the roots of the Gram matrix's eigenvalues; two of them have a closed form
query("svd_entropy_two", f"""WITH {_PTS}, e AS (SELECT subject, value AS x, lead(value) OVER (PARTITION BY subject ORDER BY i) AS y FROM pts), g AS (SELECT subject, sum(x * x) AS a, sum(y * y) AS b, sum(x * y) AS c FROM e WHERE y IS NOT NULL GROUP BY 1), v AS (SELECT subject, sqrt((a + b + sqrt(pow(a - b, 2) + 4 * c * c)) / 2) AS p, sqrt(greatest((a + b - sqrt(pow(a - b, 2) + 4 * c * c)) / 2, 0)) AS q FROM g)
SELECT subject, round(-(p / (p + q) * ln(p / (p + q)) + q / (p + q) * ln(q / (p + q))) / ln(2), 5) AS svd FROM v""")(lambda spark, d: rounded(S.svd_entropy(points(spark, d), "value", 2), 5))

# whole structures
query("rqa_identity_counted", f"{_CORE}, {_N}, {_DIAG}, k AS (SELECT subject, count(*)::DOUBLE AS k FROM rec GROUP BY 1), p AS (SELECT subject, sum(CASE WHEN length >= 2 THEN length ELSE 0 END) AS p FROM dg GROUP BY 1) SELECT subject, round(p / (k + n), 6) AS \"DET\" FROM k JOIN n USING (subject) JOIN p USING (subject)")(lambda spark, d: rounded(R.rqa(points(spark, d), ["value"], RR, denominator="all").select("subject", "DET")))
fig("threshold_report", ", x AS (SELECT subject, max(value) - min(value) AS extent FROM pts GROUP BY 1) SELECT p.subject, round(min(eps), 6) AS eps, round(avg((d <= eps)::INT), 6) AS achieved_rr, round(min(extent), 6) AS extent, min(eps) <= 1e-9 * min(extent) AS at_rounding FROM pairs p JOIN eps USING (subject) JOIN x USING (subject) GROUP BY 1", lambda pts, pair, eps, rec: ST.threshold_report(pair, eps, pts, ["value"]))
fig("structure_describe", " SELECT p.subject, 'rp' AS kind, min(n) AS n_points, 1 AS dim, 1 AS theiler, round(min(eps), 6) AS eps, round(avg((d <= eps)::INT), 6) AS recurrence_rate FROM pairs p JOIN eps USING (subject) JOIN n USING (subject) GROUP BY 1", lambda pts, pair, eps, rec: ST.describe(pair, eps, R.unit_sizes(pts), 1))
fig("structure_dense", ", c AS (SELECT p.subject, p.i, unnest(range(0, n)) AS j FROM pts p JOIN n USING (subject)) SELECT c.subject, c.i, string_agg(CASE WHEN rec.i IS NULL THEN '0' ELSE '1' END, '' ORDER BY c.j) AS row FROM c LEFT JOIN rec ON rec.subject = c.subject AND rec.i = c.i AND rec.j = c.j GROUP BY 1, 2", lambda pts, pair, eps, rec: ST.dense(rec, R.unit_sizes(pts)).select("subject", "i", F.concat_ws("", F.col("row").cast("array<string>")).alias("row")))
query("joint_cells", f"{_CORE}, p2 AS (SELECT a.subject, a.i, b.i AS j, round(abs(a.gap - b.gap), 9) AS d FROM pts a JOIN pts b ON a.subject = b.subject AND a.i <> b.i), e2 AS (SELECT subject, round(quantile_cont(d, {RR}), 9) AS eps FROM p2 GROUP BY 1) SELECT subject, i, j FROM rec JOIN p2 USING (subject, i, j) JOIN e2 USING (subject) WHERE p2.d <= e2.eps")(lambda spark, d: ST.joint(points(spark, d), _BLOCKS, RR))
query("structure_percentile", f"WITH {_PTS}, {_PAIRS}, e AS (SELECT subject, round(quantile_cont(d, 0.2), 9) AS eps FROM pairs GROUP BY 1) SELECT subject, count(*) AS n, CAST(sum(i * 31 + j) AS BIGINT) AS s FROM pairs JOIN e USING (subject) WHERE d <= eps GROUP BY 1")(lambda spark, d: ST.structure(points(spark, d), ["value"], ST.ThresholdSpec("percentile", percentile=20))[2].groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i") * 31 + F.col("j")).alias("s")))
_ALLPROF = f"""{_CROSS}, {_REC}, n AS (SELECT subject, count(*) AS n FROM pts GROUP BY subject), z AS (SELECT a.subject, a.n, b.n AS m FROM n a JOIN n b ON b.subject = a.subject + 1), o AS (SELECT *, least(n, m - k) - greatest(0, -k) AS cells FROM (SELECT *, unnest(range(-(SELECT max(n) FROM n) + 1, (SELECT max(n) FROM n))) AS k FROM z)),
h AS (SELECT subject, j - i AS k, count(*) AS hits FROM rec GROUP BY 1, 2), pr AS (SELECT o.subject, o.k, round(coalesce(hits, 0)::DOUBLE / cells, 9) AS d FROM o LEFT JOIN h ON h.subject = o.subject AND h.k = o.k WHERE cells > 10), pk AS (SELECT subject, k, d FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY d DESC, k) AS r FROM pr) WHERE r = 1), sd AS (SELECT subject, coalesce(sum(d) FILTER (k > 0), 0) AS p, coalesce(sum(d) FILTER (k < 0), 0) AS q FROM pr GROUP BY 1)"""
query("cross_rqa", f"{_ALLPROF}, {_DIAG}, {_VERT}, t AS (SELECT subject, avg((d <= eps)::INT) AS rr, sum((d <= eps)::INT)::DOUBLE AS k FROM pairs JOIN eps USING (subject) GROUP BY 1), dd AS (SELECT subject, sum(length) FILTER (length >= 2) AS p, max(length) FILTER (length >= 2) AS m FROM dg GROUP BY 1), vv AS (SELECT subject, sum(length) FILTER (length >= 2) AS p FROM vt GROUP BY 1) SELECT t.subject, round(rr, 6) AS \"RR\", round(coalesce(dd.p, 0) / t.k, 6) AS \"DET\", coalesce(dd.m, 0)::DOUBLE AS \"Lmax\", round(coalesce(vv.p, 0) / t.k, 6) AS \"LAM\", CAST(pk.k AS INT) AS peak_offset, pk.k::DOUBLE AS peak_lag_s, round(pk.d, 6) AS peak_density, round(CASE WHEN sd.p + q > 0 THEN (sd.p - q) / (sd.p + q) ELSE 0 END, 6) AS asymmetry FROM t LEFT JOIN dd ON dd.subject = t.subject LEFT JOIN vv ON vv.subject = t.subject LEFT JOIN pk ON pk.subject = t.subject LEFT JOIN sd ON sd.subject = t.subject")(
    lambda spark, d: rounded((lambda p: ST.cross_rqa(p, p.withColumn("subject", F.col("subject") - 1), ["value"], RR))(points(spark, d)).select("subject", "RR", "DET", "Lmax", "LAM", F.col("peak_offset").cast("int").alias("peak_offset"), "peak_lag_s", "peak_density", "asymmetry"))
)
