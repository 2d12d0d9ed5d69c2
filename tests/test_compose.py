"""From raw texts to windows, and the guards on the way."""

import calendar
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_sources import LATS, LONS, driver_line, field, index_line, text
from tidegrid.operators import evaluate, grids
from tidegrid.plans import compose, stages
from tidegrid.plans.stages import Settings

T0 = calendar.timegm((2015, 2, 1, 0, 0, 0))
TO_LATS, TO_LONS = np.array([-30.0, 0.0, 45.0]), np.array([0.0, 90.0, 200.0, 350.0])


def map_texts(spark):
    # Each file ends with the epoch that the next begins with.
    rows = [(f"2015-{32 + d:03d}", text([(2015, 2, 1 + d, h, 0, 0) for h in range(0, 25, 2)])) for d in range(3)]
    return spark.createDataFrame(rows, "key string, text string")


def driver_lines(spark, hole=()):
    rows = []
    for k in range(3 * 288 + 1):
        hour, minute = divmod(k % 288 * 5, 60)
        if k * 300 not in hole:
            f = driver_line(_13=str(k / 10), _17="1.0", _18="-2.0", _21="400.0", _25="5.0").split()
            f[:4] = ["2015", str(32 + k // 288), str(hour), str(minute)]
            rows.append((" ".join(f),))
    return spark.createDataFrame(rows, "value string")


def index_lines(spark):
    rows = []
    for k in range(6):
        f = index_line(1, [k] * 8, 110 + k, 100).split()
        f[:3] = ["2015", *(("1", str(30 + k)) if k < 2 else ("2", str(k - 1)))]
        rows.append((k, " ".join(f)))
    return spark.createDataFrame(rows, "line int, value string")


def test_from_texts_to_windows(spark, tmp_path):
    settings = Settings()
    weights = grids.bilinear_weights(np.array(LATS), np.array(LONS), TO_LATS, TO_LONS)
    maps = compose.interpolated_maps(map_texts(spark), weights, 12).cache()
    assert maps.count() == 37 and maps.select("t").distinct().count() == 37
    one = maps.where(F.col("t") == T0 + 86400).first()
    assert one.src_year == 2015 and len(one.tec) == 12 and abs(one.tec[4] - field(0.0, 0.0)) < 0.06
    flux, kp = compose.index_tables(index_lines(spark), "2015-01-31", "2015-02-04", seasonal=False)
    residual = compose.residual_maps(maps, flux, TO_LATS.tolist(), TO_LONS.tolist())
    drivers = compose.driver_rows(driver_lines(spark), kp, maps.select("t"), settings).withColumn("src_year", F.lit(2015))
    series = compose.aligned_series(residual, drivers).cache()
    assert series.count() == 37 and series.where("kp is null or b_magnitude is null or imputed").where(F.pmod("t", F.lit(10800)) == 0).count() == 0
    names = ["b_magnitude", "by_gsm", "bz_gsm", "flow_speed", "proton_density", "kp"]
    train_end = T0 + 24 * 7200
    out, moments = compose.windows(series, settings, names, train_end, train_end)
    path = str(tmp_path / "windows")
    compose.save_windows(spark, out, path)
    with pytest.raises(FileExistsError):
        compose.save_windows(spark, out, path)
    compose.save_windows(spark, out, path, overwrite=True)
    got = compose.read_windows(spark, path, "train").orderBy("t").collect()
    assert [r.t for r in got] == [T0 + 7200 * k for k in range(16)]
    assert all(len(r.inputs) == 6 and len(r.targets) == 3 and len(r.inputs[0]) == 12 and len(r.drivers[0]) == 6 for r in got)
    assert compose.read_windows(spark, path, "val").count() == 0
    by_t = {r.t: r.dtec for r in series.collect()}
    seen = np.array([by_t[T0 + 7200 * k] for k in range(21)])
    m = moments.first()
    assert (m.n, m["mean"], m["std"]) == (21 * 12, pytest.approx(seen.mean()), pytest.approx(seen.std()))
    driven = {r.t: [r[n] for n in names] for r in series.collect()}
    d = np.array([driven[T0 + 7200 * k] for k in range(21)])
    assert np.allclose(m.channel_mean, d.mean(axis=0)) and np.allclose(m.channel_std, np.maximum(d.std(axis=0), 1e-6)) and m.frames == 21
    assert np.allclose(got[3].drivers, (d[3:9] - d.mean(axis=0)) / np.maximum(d.std(axis=0), 1e-6), atol=1e-5)
    assert got[3].targets[1] == pytest.approx((np.array(by_t[T0 + 7200 * 10]) - m["mean"]) / m["std"], abs=1e-5)
    assert compose.read_windows(spark, path, "train", ["t"]).columns == ["t"]
    summary = stages.output_summary(spark, [path, str(tmp_path / "none")])
    assert summary[0]["exists"] and summary[0]["files"] > 0 and summary[1] == {"path": str(tmp_path / "none"), "exists": False, "files": 0}
    with pytest.raises(Exception, match="no training windows"):
        compose.windows(series, settings, names, T0, T0)[1].collect()
    meta = json.loads(stages.metadata(settings, m.asDict(), {"train": 16}, names, {"2015": "abc"}))
    assert meta["embargo_seconds"] == meta["split_rule"]["embargo_seconds"] == 9 * 7200 and meta["splits"] == {"train": 16} and meta["lineage"] == {"2015": "abc"}
    assert meta["horizon"] == {"history": "12h", "lead_times": "+2/+4/+6h", "steps": ["t+2h", "t+4h", "t+6h"]}
    assert meta["normalization"]["driver_mean"] == m.channel_mean and len(meta["drivers"]) == 6


def test_outage_of_one_channel_stays_its_own(spark):
    hole = {300 * k for k in range(100, 200)}
    frames = spark.createDataFrame([(T0 + 3600 * k,) for k in range(24)] + [(T0,)], "t long")
    kp = spark.createDataFrame([(T0, 3.0), (T0 + 10800, 4.0)], "t long, kp double")
    out = compose.driver_rows(driver_lines(spark, hole), kp, frames, Settings())
    rows = {r.t: r for r in out.collect()}
    assert len(rows) == 24 and rows[T0 + 3600 * 12].flow_speed is None and rows[T0 + 3600 * 9].flow_speed == 400.0
    assert rows[T0 + 3600].kp == 3.0 and rows[T0 + 3600].imputed and not rows[T0].imputed and rows[T0 + 3600 * 20].kp is None
    assert compose.fan_out(frames, out, "t").where(F.col("t") == T0).count() == 2


def test_years_must_agree_and_may_lack_drivers(spark):
    maps = spark.createDataFrame([(2015, 1, [1.0]), (2015, 2, [2.0]), (2016, 2, [9.0]), (2016, 3, [3.0]), (2017, 4, [4.0])], "src_year int, t long, dtec array<double>")
    drivers = spark.createDataFrame([(2015, 1, 1.0), (2015, 2, 1.0), (2016, 2, 1.0), (2016, 3, 1.0)], "src_year int, t long, kp double")
    with pytest.warns(UserWarning, match="2017"):
        got = sorted((r.t, r.src_year, r.dtec[0]) for r in compose.aligned_series(maps, drivers).collect())
    assert got == [(1, 2015, 1.0), (2, 2015, 2.0), (3, 2016, 3.0)]
    with pytest.warns(UserWarning), pytest.raises(Exception, match="different times in 2016"):
        compose.aligned_series(maps, drivers.where("t < 3")).collect()


def test_seasons_and_repeats_are_checked(spark):
    with pytest.raises(ValueError, match="swapped"):
        compose.index_tables(index_lines(spark), "2015-01-01", "2015-12-31")
    weights = grids.bilinear_weights(np.array(LATS), np.array(LONS), TO_LATS, TO_LONS)
    same = map_texts(spark)
    assert not compose.repeats_differ(compose.gridded_maps(same, weights, 12))
    scaled = F.regexp_replace("text", "^    -1", "     0")  # another exponent
    other = same.withColumn("text", F.when(F.col("key") == "2015-033", scaled).otherwise(F.col("text")))
    with pytest.warns(UserWarning, match="repeated epochs differ"):
        assert compose.repeats_differ(compose.gridded_maps(other, weights, 12))


def test_manifests_years_and_stored_tables(spark, tmp_path):
    path = str(tmp_path / "manifest")
    row = "source string, key string, status string, reason string, seq int"
    stages.append_manifest(spark.createDataFrame([("m", "2015-001", "failed", "timeout", 1), ("m", "2016-001", "downloaded", "", 2)], row), path)
    stages.append_manifest(spark.createDataFrame([("m", "2015-001", "downloaded", "", 3), ("m", "2016-002", "failed", "404", 4)], row), path)
    by_year = compose.rows_by_year(spark.read.parquet(path), ["seq"])
    assert sorted((r.year, r.files) for r in by_year.collect()) == [(2015, 1), (2016, 1)]
    assert sorted(r.year for r in compose.years_needed([2016, 2020], by_year).collect()) == [2015, 2016, 2020]
    table = stages.write_index(spark.createDataFrame([(1, 2.0)], "t long, kp double"), str(tmp_path), "kp")
    assert compose.read_index(spark, table, ["t", "kp"]).count() == 1
    with pytest.raises(ValueError, match="f107"):
        compose.read_index(spark, table, ["f107"])
    maps = spark.createDataFrame([(2015, 1), (2016, 2)], "src_year int, t long")
    maps.write.partitionBy("src_year").parquet(str(tmp_path / "maps"))
    assert [r.t for r in compose.read_year(spark, str(tmp_path / "maps"), 2016).collect()] == [2]
    year = spark.range(301).withColumnRenamed("id", "day")
    assert compose.save_year(spark, year, str(tmp_path / "packs"), 2023) and not compose.save_year(spark, year, str(tmp_path / "packs"), 2023)
    assert sorted(r.t for r in compose.in_range(maps, "t", 1, 1).collect()) == [1]
    made = compose.forecast_days(spark.createDataFrame([(0, 1.0)], "t long, value double"), spark.createDataFrame([(7200, 5.0)], "t long, base double"), 7200)
    assert [(r.t, r.value) for r in made.collect()] == [(7200, 6.0)]


def test_poles_and_the_way_back(spark):
    lats, lons = np.array([-60.0, -20.0, 20.0, 60.0]), np.array([0.0, 90.0, 180.0, 270.0])
    to_lats, to_lons = np.array([-80.0, -20.0, 20.0, 80.0]), np.array([0.0, 180.0])
    w = grids.bilinear_weights(lats, lons, to_lats, to_lons)
    cells = spark.createDataFrame([(1, k, float(k)) for k in range(16)], "m int, cell int, v double")
    got = {r.target: r.v for r in grids.with_poles(cells, w, ["m"], "cell", "v", (4, 4), (4, 2)).collect()}
    assert got == {0: 1.5, 1: 1.5, 2: 4.0, 3: 6.0, 4: 8.0, 5: 10.0, 6: 13.5, 7: 13.5}
    back = grids.back_weights(lats, lons, np.array([87.5, 60.0, -87.5]), np.array([-180.0, 0.0]))
    got = {r.target: r.v for r in grids.regrid(cells, grids.weight_table(spark, back), ["m"], "cell", "v").collect()}
    assert got == {0: 14.0, 1: 12.0, 2: 14.0, 3: 12.0, 4: 2.0, 5: 0.0}


def test_small_formulas(spark):
    from tidegrid.operators import spectrum

    df = spark.createDataFrame([(1, 2.0, 0.5), (1, 4.0, 0.25), (2, 1.0, 1.0)], "h int, e double, w double")
    got = {r.h: r.rmse for r in evaluate.horizon_rmse(df, "h", F.col("e"), F.col("w")).collect()}
    assert got == {1: pytest.approx(np.sqrt((0.5 * 4 + 0.25 * 16) / 2)), 2: 1.0}
    one = spark.range(1).select(spectrum.sobolev_weight(F.lit(3)), spectrum.gibbs_window(F.lit(3), 4), evaluate.teacher_forcing(F.lit(3), 4), evaluate.teacher_forcing(F.lit(9), 4)).first()
    assert list(one) == [13, 0.25, 0.25, 0.0]
    back = spark.range(1).select(evaluate.denormalised(evaluate.normalised(F.lit(5.0), F.lit(3.0), F.lit(4.0)), F.lit(3.0), F.lit(4.0))).first()
    assert back[0] == 5.0
    for n in (0, 1, 3, 4, 103):
        df = spark.range(n)
        a = {r.id for r in evaluate.subsample(df, "id", 4, 1).collect()}
        assert len(a) == (max(1, n // 4) if n else 0) and a == {r.id for r in evaluate.subsample(df.repartition(3), "id", 4, 1).collect()}
    old, new = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double"), spark.createDataFrame([(2, 2.0), (3, 3.5), (4, 4.0)], "k int, v double")
    assert sorted((r.k, r.side) for r in evaluate.mismatches(old, new, "k", "v").collect()) == [(1, "only_old"), (3, "differs"), (4, "only_new")]
    with pytest.raises(ValueError):
        evaluate.require_equal(evaluate.equality_gate(old, new, "k", "v"))
    evaluate.require_equal(evaluate.equality_gate(old, old, "k", "v"))


def test_a_changed_value_is_rebuilt_and_a_lost_log_only_warns(spark, tmp_path):
    a = spark.createDataFrame([(2015, 1, 5.0, None), (2016, 2, 6.0, "")], "y int, k int, v double, s string")
    b = spark.createDataFrame([(2015, 1, 5.0, ""), (2016, 2, 6.0, "")], a.schema)
    args = dict(part="y", build=lambda d: d, target=str(tmp_path / "t"), log=str(tmp_path / "log"))
    stages.run_stage(spark, "s", a, **args)
    assert stages.run_stage(spark, "s", b, **args)["partitions"] == "[2015]"

    def fails(d):
        raise KeyError("from the build")

    (tmp_path / "blocked").write_text("a file")
    with pytest.warns(UserWarning, match="isn't in the log"), pytest.raises(KeyError, match="from the build"):
        stages.run_stage(spark, "s", a, part="y", build=fails, target=str(tmp_path / "u"), log=str(tmp_path / "blocked" / "log"))
