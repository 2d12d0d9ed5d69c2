"""Moments by channel, broken drivers, regridding in the row, repeats, and forecasts from windows to packs."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import grids, stats
from tidegrid.plans import compose, generate
from tidegrid.plans.stages import Settings

DAY = 86400


def test_moments_by_channel_equal_numpy(spark):
    rng = np.random.default_rng(0)
    maps, drivers = rng.normal(3, 13, (400, 5)), rng.normal(0, 1, (400, 3)) * [1, 10, 0] + [0, 5, 7]
    rows = [(k, m.tolist(), *map(float, d)) for k, (m, d) in enumerate(zip(maps, drivers, strict=True))]
    df = spark.createDataFrame(rows, "t long, m array<double>, a double, b double, c double").repartition(7)
    m = stats.window_moments(df, "m", ["a", "b", "c"]).first()
    assert (m.n, m.frames) == (2000, 400)
    assert m["mean"] == pytest.approx(maps.mean()) and m["std"] == pytest.approx(maps.std())
    assert np.allclose(m.channel_mean, drivers.mean(axis=0)) and np.allclose(m.channel_std, np.maximum(drivers.std(axis=0), 1e-6))
    got = sorted(map(tuple, stats.vector_moments(df, "m").collect()))
    assert [x[0] for x in got] == list(range(5)) and np.allclose([x[2] for x in got], maps.mean(axis=0)) and np.allclose([x[3] for x in got], maps.std(axis=0))
    with pytest.raises(Exception, match="no training windows"):
        stats.window_moments(df.limit(0), "m", ["a"]).collect()


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_a_broken_driver_makes_its_windows_invalid(spark, bad):
    s = Settings()
    rows = [(7200 * k, [float(k), 1.0], 1.0 * k, bad if k == 12 else 2.0) for k in range(30)]
    series = spark.createDataFrame(rows, "t long, dtec array<double>, a double, b double")
    out, m = compose.windows(series, s, ["a", "b"], 7200 * 100, 7200 * 200)
    starts = sorted(r.t // 7200 for r in out.collect())
    assert starts == [k for k in range(22) if not k <= 12 <= k + 8]
    assert m.first().frames == len({k + j for k in starts for j in range(6)})


def test_regridding_is_one_row_and_no_exchange(spark):
    lats, lons = np.arange(87.5, -88, -2.5), np.arange(-180.0, 181, 5)
    to_lats, _ = grids.gauss_latitudes(23)
    to_lons = np.arange(45) * 8.0
    w = grids.bilinear_weights(lats, lons, to_lats, to_lons)
    rng = np.random.default_rng(1)
    maps = rng.normal(size=(6, 71 * 73))
    rows = [(k, m.tolist()) for k, m in enumerate(maps)] + [(6, None), (7, [*maps[0][:1000].tolist(), None, *maps[0][1001:].tolist()])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    out = df.select("k", grids.regrid_row(F.col("v"), w, 23 * 45).alias("g"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    matrix = np.zeros((23 * 45, 71 * 73))
    for t, s, x in w:
        matrix[t, s] += x
    got = {r.k: r.g for r in out.collect()}
    for k in range(6):
        assert np.allclose(got[k], matrix @ maps[k])
    assert got[6] is None
    lost = {t for t, s, _ in w if s == 1000}
    assert {t for t, x in enumerate(got[7]) if x is None} == lost and lost
    short = df.limit(1).select(grids.regrid_row(F.col("v"), [(0, 3, 1.0)], 2).alias("g")).first().g
    assert short == [pytest.approx(maps[0][3]), None]


def test_three_copies_are_compared_as_neighbours(spark):
    rows = [(1, 0, [1.0, None, 2.0]), (1, 1, [2.0, 5.0, float("nan")]), (1, 2, [2.5, 7.0, 4.0]), (2, 0, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "t long, k int, v array<double>")
    r = grids.repeat_differences(df, "t", "k", "v").first()
    assert (r.dropped, r["max"]) == (2, 2.0)
    assert r["mean"] == pytest.approx((1 + 0.5 + 2) / 3) and r["relative"] == pytest.approx((3.5 / 3) / ((1 + 2 + 2 + 5) / 4))
    assert tuple(grids.repeat_differences(df.where("t = 2"), "t", "k", "v").first()) == (0, 0.0, 0.0, 0.0)


def test_quality_by_channel_and_year(spark):
    rows = [(2015, 1.0, None, [False, True]), (2015, float("nan"), 2.0, [True, False]), (2015, 1.0, 1.0, [True, True]), (2016, 1.0, 1.0, [False, False])]
    df = spark.createDataFrame(rows, "y int, a double, b double, f array<boolean>")
    got = {(r.year, r.channel): tuple(r)[2:] for r in stats.quality_by_year(df, F.col("y"), ["a", "b"], "f").collect()}
    third = pytest.approx(1 / 3)
    assert got[2015, "a"] == (pytest.approx(2 / 3), third, 3, 2) and got[2015, "b"] == (pytest.approx(2 / 3), third, 3, 2)
    assert got[2016, "a"] == got[2016, "b"] == (0.0, 0.0, 1, 0)


def test_repeated_epochs_fail_instead_of_multiplying(spark):
    a = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "t long, v array<double>")
    b = spark.createDataFrame([(1, [1.0])], "t long, b array<double>")
    with pytest.raises(Exception, match="more than once"):
        grids.residuals(a, b, ["t"], "v", "b").collect()


def hourly(spark, days, hole=None):
    lats, lons = np.array([-60.0, -20.0, 20.0, 60.0]), np.array([0.0, 90.0, 180.0, 270.0])
    rows = []
    for k in range(-12, 24 * days):
        t = 1577836800 + 3600 * k  # from 2020-01-01 00:00
        value = [None if hole == k else float(k + c) for c in range(16)]
        rows.append((t, value, [1.0 * k, 2.0], [100.0 + c for c in range(16)]))
    return spark.createDataFrame(rows, "t long, dtec array<double>, drivers array<double>, iri array<double>").repartition(5), lats, lons


def test_from_frames_to_packs_and_nothing_twice(spark, tmp_path):
    frames, lats, lons = hourly(spark, 3, hole=40)
    moments = {"mean": 2.0, "std": 4.0, "channel_mean": [1.0, 2.0], "channel_std": [2.0, 1.0]}
    w = grids.back_weights(lats, lons, np.array([87.5, 60.0, -87.5]), np.array([-180.0, 0.0]))

    def model(maps, drivers):
        assert maps.shape[1:] == (6, 16) and drivers.shape[1:] == (6, 2)
        assert np.allclose(np.diff(maps, axis=1), 0.5) and np.allclose(np.diff(drivers[:, :, 0], axis=1), 1.0)
        return maps[:, -1] + 0.25  # one unit up

    path = str(tmp_path / "packs")
    args = (frames, moments, model, Settings(), w, 6, path)
    days = sorted(r.day for r in generate.generate(spark, *args).collect())
    # The broken frame at hour 40 is in the histories of the second day's last hours.
    assert days == [1577836800 + d * DAY for d in (0, 2)] or days == [1577836800]
    stored = {r.day: r for r in spark.read.parquet(path).collect()}
    day = np.frombuffer(gzip.decompress(stored[1577836800].pack), dtype="<f2").reshape(24, 6)
    # At hour h the frame of two hours before is k = h - 2; back on the grid the cells 14, 12 | 14, 12 | 2, 0.
    even = np.array([[h - 2 + c + 1 + 100 + c for c in (14, 12, 14, 12, 2, 0)] for h in range(0, 24, 2)], dtype=float)
    assert np.allclose(day[0::2], even, atol=0.13)
    assert np.allclose(day[1:22:2], (even[:-1] + even[1:]) / 2, atol=0.13) and np.allclose(day[23], even[-1], atol=0.13)
    read = generate.read_packs(spark, path, "2020-01-01", "2020-01-01")
    assert "PartitionFilters" in read._jdf.queryExecution().executedPlan().toString() and read.count() == 1
    hours = {r.t: r["values"] for r in generate.hour_maps(read, [0, 23], 6).collect()}
    assert sorted(hours) == [1577836800, 1577836800 + 23 * 3600] and np.allclose(hours[1577836800], day[0]) and np.allclose(hours[1577836800 + 23 * 3600], day[23])
    assert generate.read_packs(spark, path, "2019-01-01", "2019-12-31").count() == 0
    before = sorted(p.name for p in tmp_path.rglob("*.parquet"))
    assert generate.generate(spark, *args).count() == 0
    assert sorted(p.name for p in tmp_path.rglob("*.parquet")) == before
    whole, _, _ = hourly(spark, 3)
    more = sorted(r.day for r in generate.generate(spark, whole, *args[1:]).collect())
    assert sorted(days + more) == [1577836800 + d * DAY for d in range(3)]
    assert spark.read.parquet(path).count() == 3
    assert generate.generate(spark, whole, moments, generate.persistence, Settings(), w, 6, str(tmp_path / "other"), years=[2019]).count() == 0
