import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import scalars as S
from tidegrid.operators import clean, climatology, evaluate, grids, harmonics, stats
from tidegrid.plans.stages import Settings, run_stage


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_masks_and_rounding(spark):
    r = one(
        spark,
        clean.mask_from(F.lit(9999.99), 9999.99).alias("a"),
        clean.mask_above(F.lit(300.0), 300).alias("b"),
        clean.mask_above(F.lit(300.1), 300).alias("c"),
        clean.mask_negative(F.lit(-1.0)).alias("d"),
        S.one_decimal(F.lit(0.25)).alias("e"),
        clean.mask_equal_scaled(F.array(F.lit(9999), F.lit(12)), 9999, -1).alias("f"),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == (None, 300.0, None, None, 0.2) and r.f[0] is None and abs(r.f[1] - 1.2) < 1e-12


def test_manifest_rules(spark):
    m = spark.createDataFrame(
        [("x", "1", "failed", "404", 1), ("x", "2", "failed", "timeout", 2), ("x", "2", "downloaded", None, 3), ("x", "3", "failed", "http_503", 4)],
        "source string, key string, status string, reason string, seq int",
    )
    last = clean.last_row_wins(m, ["source", "key"], ["seq"])
    assert {r.key: r.status for r in last.collect()} == {"1": "failed", "2": "downloaded", "3": "failed"}
    wanted = spark.createDataFrame([(str(k),) for k in range(1, 5)], "key string")
    assert sorted(r.key for r in clean.unresolved(wanted, last).collect()) == ["3", "4"]
    r = one(spark, S.credential_failure(F.lit("auth")).alias("a"), S.credential_failure(F.lit("bad_content:too_small")).alias("b"), S.credential_failure(F.lit(None).cast("string")).alias("c"))
    assert (r.a, r.b, r.c) == (True, False, False)


def test_regrid_recovers_a_smooth_field(spark):
    lats, lons = np.arange(87.5, -90, -2.5), np.arange(-180, 181, 5.0)
    to_lats, _ = grids.gauss_latitudes(23)
    to_lons = np.arange(0, 360, 8.0)
    field = lambda a, o: 12.5 + a / 20 + 6 * np.cos(np.radians(2 * o + a))
    flat = field(lats[:, None], lons[None, :]).ravel()
    rows = [(m, k, float(v) if (m, k) != (1, 100) else None) for m in (0, 1) for k, v in enumerate(flat)]
    cells = spark.createDataFrame(rows, "m int, cell int, v double")
    out = grids.regrid(cells, grids.weight_table(spark, grids.bilinear_weights(lats, lons, to_lats, to_lons)), ["m"], "cell", "v").collect()
    want = field(to_lats[:, None], to_lons[None, :]).ravel()
    assert len(out) == 2 * 23 * 45
    assert max(abs(r.v - want[r.target]) for r in out if r.m == 0) < 0.05
    assert 0 < sum(r.v is None for r in out if r.m == 1) <= 4


def test_poles_and_outside_latitudes():
    w = grids.bilinear_weights(np.array([50.0, 0.0, -50.0]), np.array([0.0, 90.0, 180.0, 270.0]), np.array([60.0, 25.0]), np.array([45.0, 315.0]))
    assert {t for t, _, _ in w} == {2, 3} and abs(sum(x for t, _, x in w if t == 3) - 1) < 1e-12


def test_residuals_want_equal_epochs(spark):
    a = spark.createDataFrame([(1, [1.0, None]), (2, [3.0, 4.0])], "t int, v array<double>")
    b = spark.createDataFrame([(1, [0.5, 1.0])], "t int, b array<double>")
    assert grids.residuals(a.where("t = 1"), b, ["t"], "v", "b").first().residual == [0.5, None]
    with pytest.raises(Exception, match="different epochs"):
        grids.residuals(a, b, ["t"], "v", "b").collect()


def test_moments_count_each_frame_once(spark):
    starts = spark.createDataFrame([(0,), (1,)], "t long")
    frames = stats.input_frames(starts, "t", 6, 1)
    assert sorted(r.t for r in frames.collect()) == list(range(7))
    m = stats.population_moments(frames, F.col("t")).first()
    assert m.n == 7 and m.mean == 3.0 and abs(m.std - 2.0) < 1e-12
    flat = stats.population_moments(spark.createDataFrame([(5.0,), (5.0,)], "v double"), F.col("v")).first()
    assert abs(flat.std - 1e-6) < 1e-12


def test_histogram_against_numpy(spark):
    x = np.random.default_rng(1).gamma(2.0, 1.0, 500)
    h = stats.histogram_weights(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", 18).orderBy("bin").collect()
    n, edges = np.histogram(x, 18, density=False)
    density = np.maximum(n / len(x) / np.diff(edges), 1e-8)
    w = 1 / density
    assert [r.n for r in h] == n.tolist() and np.allclose([r.weight for r in h], w / w.mean())


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    p, y, w = rng.normal(size=50), rng.normal(size=50), rng.random(50)
    df = spark.createDataFrame([("m", float(a), float(b), float(c)) for a, b, c in zip(p, y, w)], "model string, p double, y double, w double")
    r = evaluate.metrics(df, ["model"], "p", "y", "w", F.col("y") > 100, F.col("y") < 100).first()
    rmse = math.sqrt((w * (p - y) ** 2).sum() / w.sum())
    assert abs(r.rmse - rmse) < 1e-9 and abs(r.quiet_rmse - rmse) < 1e-9 and r.storm_rmse == 0.0
    assert abs(r["corr"] - np.corrcoef(p, y)[0, 1]) < 1e-9
    assert abs(r.r2 - (1 - (w * (p - y) ** 2).sum() / ((w * y * y).sum() - (w * y).sum() ** 2 / w.sum()))) < 1e-9


def test_equality_gate(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "k int, v double")
    new = spark.createDataFrame([(1, 1.0), (2, 2.0 + 5e-10), (4, None), (5, 1.0)], "k int, v double")
    r = evaluate.equality_gate(old, new, "k", "v").first()
    assert (r["both"], r.only_old, r.only_new, r.exact, r.within) == (3, 1, 1, 2, 2)


def test_baseline_falls_back_one_day_and_then_fails(spark):
    frames = spark.createDataFrame([(0,), (86400,)], "t long")
    flux = spark.sql("SELECT date '1970-01-01' AS day, 110D AS f107 UNION ALL SELECT date '1970-01-02', NULL")
    out = climatology.baseline(frames, flux, "t", [0.0, 45.0], [0.0, 90.0, 180.0]).collect()
    assert sorted(r.t for r in out) == [0, 86400] and all(len(r.iri) == 6 for r in out)
    with pytest.raises(Exception, match="no solar flux"):
        climatology.baseline(spark.createDataFrame([(5 * 86400,)], "t long"), flux, "t", [0.0], [0.0]).collect()


def test_harmonic_power_finds_its_degree():
    n_lat, n_lon, lmax = 16, 32, 8
    x, _ = np.polynomial.legendre.leggauss(n_lat)
    p = harmonics.legendre(lmax, x)
    lon = 2 * np.pi * np.arange(n_lon) / n_lon
    for degree, order in ((0, 0), (3, 0), (5, 2), (8, 8)):
        field = p[degree, order][:, None] * np.cos(order * lon)[None, :]
        s = harmonics.power(field[None], lmax)[0]
        assert s[degree] > 0.1 and abs(s.sum() - s[degree]) < 1e-12


def test_harmonic_power_works_in_blocks_of_a_batch():
    class Frame:
        schema = {"k": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "int"))}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    n_lat, n_lon, lmax, n = 23, 45, 22, 3000
    maps = np.random.default_rng(1).normal(size=(n, n_lat * n_lon))
    rows = pa.array([None, [1.0], [*[0.0] * (n_lat * n_lon - 1), None]], pa.list_(pa.float64()))
    column = pa.concat_arrays([rows, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_lat * n_lon), pa.array(maps.ravel())), rows])
    batch = pa.record_batch([pa.array(range(-3, n + 3), pa.int32()), column], names=["k", "v"])
    run = harmonics.grid_power(Frame(), "k", "v", n_lat, n_lon, lmax)
    tracemalloc.start()
    power, keys = np.zeros(n * (lmax + 1)), []
    for out in run(iter([batch])):
        power[len(keys) : len(keys) + out.num_rows] = out.column(2)
        keys += out.column(0).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys == [k for k in range(n) for _ in range(lmax + 1)]
    assert np.allclose(power.reshape(n, -1), harmonics.power(maps.reshape(n, n_lat, n_lon), lmax))
    assert most < 40e6  # the rows as Python's numbers take over 100 MB


def test_float16_round_trip(spark):
    df = spark.createDataFrame([(1, [1.5, -2.25, 30.0]), (2, None)], "k int, v array<float>")
    out = grids.from_float16(grids.to_float16(df, "v"), "pack").orderBy("k").collect()
    assert out[0]["values"] == [1.5, -2.25, 30.0] and out[1]["values"] is None


def test_stage_runs_once_and_again_when_rows_change(spark, tmp_path):
    df = spark.createDataFrame([(2015, 1), (2016, 2)], "y int, k int")
    args = dict(part="y", build=lambda d: d.withColumn("twice", F.col("k") * 2), target=str(tmp_path / "t"), log=str(tmp_path / "log"))
    assert run_stage(spark, "s", df, **args)["partitions"] == "[2015, 2016]"
    assert run_stage(spark, "s", df, **args)["partitions"] == "[]"
    changed = spark.createDataFrame([(2015, 1), (2016, 3)], "y int, k int")
    assert run_stage(spark, "s", changed, **args)["partitions"] == "[2016]"
    assert run_stage(spark, "s", changed, contract="2", **args)["partitions"] == "[2015, 2016]"
    assert sorted(r.twice for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [2, 6]
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_settings_precedence(tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"cadence_seconds": 3600}')
    s = Settings.load(str(f), {"TIDEGRID_VAL_END": "2023", "TIDEGRID_INPUTS": " "})
    assert (s.cadence_seconds, s.val_end, s.inputs, s.embargo_seconds) == (3600, 2023, 6, 9 * 3600)
    with pytest.raises(FileNotFoundError):
        Settings.load(str(tmp_path / "none.json"), {})
