"""Queries over whole tables, against brute force on small ones."""

import datetime

import numpy as np
import pytest

from echoplot.operators import recurrence
from echoplot.plans import catalogue


def test_distances_of_every_label(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype("float32").tolist(), i % 5) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    far = {
        "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()),
        "chebyshev": lambda a, b: abs(a - b).max(),
        "manhattan": lambda a, b: abs(a - b).sum(),
        "cosine": lambda a, b: 1 - (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()),
    }
    for m, f in far.items():
        got = {(r.i, r.j): r.d for r in catalogue.QUERIES[f"dist_{m}"](spark, str(tmp_path)).collect()}
        want = {(i, j): f(np.array(a), np.array(b)) for i, a, x in rows for j, b, y in rows if i < j and x == y}
        assert len(got) == 30 and got == pytest.approx(want, abs=2e-6)


def test_every_window_of_every_subject(spark, tmp_path):
    rng = np.random.default_rng(1)
    series = {u: np.round(rng.normal(size=n) + u % 2, 2) for u, n in enumerate([230, 95, 70, 81, 45, 61, 100, 90, 85, 62, 99, 83])}
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1000 * u + i, t0 + datetime.timedelta(minutes=i), u, "a", float(v), "{}") for u, x in series.items() for i, v in enumerate(x)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    mean = {(u, i // 20): x[i : i + 20].mean() for u, x in series.items() for i in range(0, len(x), 20)}

    got = run("feature_matrix")
    assert list(got[0].asDict()) == ["subject", *[f"w{w}" for w in range(12)]]
    assert {(r.subject, w): r[f"w{w}"] for r in got for w in range(12) if r[f"w{w}"] is not None} == pytest.approx(mean, abs=1e-6)

    sides = {w: [[m for (u, k), m in mean.items() if k == w and u % 2 == g] for g in (0, 1)] for w in range(12)}
    auc = {w: np.mean([(y > x) + (y == x) / 2 for x in a for y in b]) for w, (a, b) in sides.items() if a and b}
    two = {w for w, (a, b) in sides.items() if min(len(a), len(b)) >= 2}
    got = {r.win: r for r in run("group_comparison")}
    assert set(got) == two and {3, 4} <= two
    assert {w: r.auc for w, r in got.items()} == pytest.approx({w: auc[w] for w in two}, abs=1e-6)
    assert {w: (r.n_a, r.n_b) for w, r in got.items()} == {w: tuple(map(len, sides[w])) for w in two}
    best = run("rank_metrics")[0]
    assert (best.mean_auc, best.max_auc) == pytest.approx((np.mean([abs(auc[w] - 0.5) + 0.5 for w in two]), max(abs(auc[w] - 0.5) + 0.5 for w in two)), abs=1e-6)

    got = {r.window: r for r in run("group_timecourse")}
    assert set(got) == set(range(12)) and got[11].auc is None and got[3].auc == pytest.approx(auc[3], abs=1e-6)
    tested = sum(min(map(len, x)) >= 5 for x in sides.values())
    assert tested > 3 and run("group_timecourse_summary")[0].n_windows_tested == tested


def test_too_few_windows_for_pairs(spark, tmp_path):
    """Subjects of one or two windows keep their row: windows that share samples make no pair, so there is no rate."""
    rng = np.random.default_rng(2)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1000 * u + i, t0 + datetime.timedelta(minutes=i), u, "a", float(v), "{}") for u, n in enumerate([25, 35, 45, 90]) for i, v in enumerate(rng.normal(size=n))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.subject: r for r in catalogue.QUERIES["meta_rqa"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3} and [got[u].RR is None for u in range(4)] == [True, True, False, False]
    assert all((got[u].DET, got[u].LAM, got[u].Lmax) == (0, 0, 0) for u in (0, 1)) and 0 < got[3].RR < 1


def test_cosine_distances_in_blocks(spark, tmp_path):
    """Blocks that meet give every pair once; vectors that have no distance keep their rows; only a row's block travels, no pairs."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist(), int(i % 3 > 0)) for i in range(60)]
    rows += [(7, rng.normal(size=5).tolist(), 1), (60, None, 1), (61, [1.0, None, 0.0, 0.0, 0.0], 1), (62, [1.0, 2.0], 1), (63, [2.0, 4.0], 1), (64, [0.0] * 5, 1), (65, [1.0] * 5, None), (None, [1.0] * 5, 1), (-1, [3.0] * 5, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def far(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        a, b = np.array(a), np.array(b)
        norm = np.sqrt((a * a).sum() * (b * b).sum())
        return round(float(1 - (a * b).sum() / norm), 6) if norm else 1.0

    place = lambda r: (r[0], r[1], r[2] is None, r[2] or 0.0)
    want = sorted([(i, j, far(a, b)) for i, a, x in rows for j, b, y in rows if x is not None and x == y and i is not None and j is not None and i < j], key=place)
    for block, cells in ((1024, 1 << 16), (4, 1 << 16), (9, 5)):
        got = sorted([(r.i, r.j, r.d) for r in recurrence.cosine_pairs(df, "label", "vec_id", "embedding", block=block, cells=cells).collect()], key=place)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert [r[2] is None for r in got] == [r[2] is None for r in want]
        assert [r[2] for r in got if r[2] is not None] == pytest.approx([r[2] for r in want if r[2] is not None], abs=1.01e-6)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = catalogue.QUERIES["dist_cosine"](spark, str(tmp_path))
    assert len(out.collect()) == len(want) and "zip_with" not in out._jdf.queryExecution().executedPlan().toString().lower()
