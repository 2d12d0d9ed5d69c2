import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import timeline as T

START = 1420070400  # 2015-01-01


def series(spark, rows):
    return spark.createDataFrame(rows, "t long, v double")


def test_interpolation_equals_pandas_across_buckets(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    obs = sorted({int(x) for x in rng.integers(0, 40 * 86400, 300)})
    vals = rng.normal(size=len(obs)).tolist()
    frames = list(range(0, 40 * 86400, 3600))
    out = T.align_interpolated(series(spark, list(zip(obs, vals))), spark.createDataFrame([(f,) for f in frames], "t long"), "t", "v", 10**9, None, 86400)
    got = {r.t: r.v for r in out.collect()}
    s = pd.Series(vals, index=pd.to_datetime(obs, unit="s"))
    at = pd.to_datetime(frames, unit="s")
    want = s.reindex(s.index.union(at)).interpolate(method="time", limit_direction="both").reindex(at)
    assert len(got) == len(frames)
    assert all(abs(got[f] - w) < 1e-9 for f, w in zip(frames, want))


def test_interpolation_tolerance_is_inclusive_and_marks_rejected_as_imputed(spark):
    obs = series(spark, [(0, 1.0), (20000, 3.0)])
    frames = spark.createDataFrame([(0,), (7200,), (7201,), (12800,)], "t long")
    got = {r.t: r for r in T.align_interpolated(obs, frames, "t", "v", 7200).collect()}
    assert got[0].v == 1.0 and not got[0].imputed
    assert got[7200].v is not None and got[7201].v is None and got[7201].imputed
    assert got[12800].v is not None


def test_channels_fail_apart(spark):
    obs = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("b", 90000, 2.0)], "c string, t long, v double")
    frames = spark.createDataFrame([("a", 90000), ("b", 90000)], "c string, t long")
    got = {r.c: r.v for r in T.align_interpolated(obs, frames, "t", "v", 7200, ["c"]).collect()}
    assert got == {"a": None, "b": 2.0}


def test_carried_value_lasts_exactly_its_limit(spark):
    obs = series(spark, [(0, 5.0)])
    frames = spark.createDataFrame([(-1,), (0,), (3600,), (10800,), (10801,)], "t long")
    got = {r.t: (r.v, r.imputed) for r in T.align_carried(obs, frames, "t", "v", 10800, None, 3600).collect()}
    assert got == {-1: (None, True), 0: (5.0, False), 3600: (5.0, True), 10800: (5.0, True), 10801: (None, True)}


def test_forward_fill_keeps_leading_gap_and_carries_the_end(spark):
    df = series(spark, [(0, None), (1, 2.0), (2, None), (3, 4.0), (4, None)])
    assert [r.v for r in T.fill_forward_linear(df, "t", "v", 2).orderBy("t").collect()] == [None, 2.0, 3.0, 4.0, 4.0]


@pytest.mark.parametrize(
    "times",
    [
        [k * 3600 for k in range(100)],
        [k * 7200 for k in range(50)],
        [3600 + k * 7200 for k in range(20)],
        [k * 3600 for k in range(20)] + [5 * 86400 + k * 3600 for k in range(20)],
        [k * 7200 for k in range(10)] + [72000 + k * 3600 for k in range(10)],
        [0, 5000, 7199, 7200, 14000, 14400, 21700],
        [],
    ],
)
def test_decimation_equals_a_loop(spark, times):
    want, last = [], None
    for t in times:
        if last is None or t - last >= 7200:
            want.append(t)
            last = t
    df = spark.createDataFrame([(t,) for t in times], "t long")
    assert sorted(r.t for r in T.decimate(df, "t", 7200, 30000).collect()) == want


def test_windows_need_exact_spacing_and_whole_frames(spark):
    c = 7200
    times = [k * c for k in range(30)] + [30 * c + 1 + k * c for k in range(12)]
    rows = [(t, t != 5 * c) for t in times]
    got = T.window_starts(spark.createDataFrame(rows, "t long, ok boolean"), "t", "ok", c, 9, 10 * c).collect()
    want = {}
    for k in range(len(times) - 8):
        part = times[k : k + 9]
        paced = all(b - a == c for a, b in zip(part, part[1:]))
        want[times[k]] = (paced and 5 * c not in part, not paced, paced and 5 * c in part)
    assert {r.t: (r.valid, r.off_cadence, r.missing) for r in got} == want


def test_splits_share_no_frames(spark):
    c, y19, y22 = 7200, 1546300800, 1640995200
    starts = [(t, t + 8 * c) for t in range(y19 - 30 * c, y19 + 30 * c, c)] + [(t, t + 8 * c) for t in range(y22 - 30 * c, y22 + 30 * c, c)]
    df = spark.createDataFrame(starts, "a long, b long").withColumn("s", T.split_name(F.col("a"), F.col("b"), y19, y22, 9 * c))
    frames = {}
    for r in df.collect():
        if r.s:
            for k in range(9):
                frames.setdefault(r.a + k * c, set()).add(r.s)
    assert all(len(v) == 1 for v in frames.values())
    assert {r.s for r in df.collect()} == {"train", "val", "test", None}


def test_first_arrival_stays_and_disagreement_compares_with_the_row_before(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (7200, 1, 10.0), (7200, 2, 10.5), (7200, 3, 9.0)], "t long, seq int, v double")
    assert {r.t: r.v for r in T.dedupe_epochs(df, "t", "seq").collect()} == {0: 1.0, 7200: 10.0}
    d = T.repeat_disagreement(df, "t", "seq", "v").first()
    assert (d.repeats, d.max_diff, d.mean_diff) == (2, 1.5, 1.0)


def test_history_and_hour_filling(spark):
    f = spark.createDataFrame([(k * 7200, k != 3) for k in range(12)], "t long, ok boolean")
    got = {r.t // 7200: r.usable for r in T.history_ok(f, "t", "ok", 6, 7200).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [10, 11]
    two = spark.createDataFrame([(1, h, float(h)) for h in range(0, 24, 2) if h != 4], "d int, h int, v double")
    v = {r.h: r.v for r in T.fill_hours(two, "d", "h", "v").collect()}
    assert v[1] == 1.0 and v[3] is None and v[4] is None and v[23] == 22.0 and len(v) == 24
