"""Settings files, manifests, fallbacks, cut-offs, tables and small functions."""

import pytest
from pyspark.sql import functions as F

from test_sources import field, text  # noqa: F401
from tidegrid.functions import scalars as S
from tidegrid.operators import clean, climatology, evaluate, grids, spectrum
from tidegrid.plans.stages import Settings
from tidegrid.sources import ionex


def test_settings_come_from_yaml_and_candidates(tmp_path):
    pytest.importorskip("yaml")
    one, two = tmp_path / "a.yaml", tmp_path / "b.json"
    two.write_text('{"inputs": 4}')
    assert Settings.load(None, {}, candidates=[str(one), str(two)]).inputs == 4
    one.write_text("cadence_seconds: 3600\nroot: /data\n")
    s = Settings.load(None, {"TIDEGRID_INPUTS": "5"}, candidates=[str(one), str(two)])
    assert (s.cadence_seconds, s.root, s.inputs) == (3600, "/data", 5)
    assert Settings.load(None, {}, candidates=[str(tmp_path / "none.yaml")]) == Settings()
    assert Settings.load(None, {"TIDEGRID_CONFIG_FILE": " "}, candidates=[]) == Settings()
    assert Settings.load(None, {"TIDEGRID_CONFIG_FILE": str(two)}, candidates=[str(one)]).inputs == 4
    with pytest.raises(FileNotFoundError, match="asked for"):
        Settings.load(None, {"TIDEGRID_CONFIG_FILE": str(tmp_path / "lost.yaml")}, candidates=[str(one)])
    one.write_text("no_such: 1\n")
    with pytest.raises(ValueError, match="unknown"):
        Settings.load(str(one), {})
    one.write_text("")
    assert Settings.load(str(one), {}) == Settings()
    one.write_text("- a\n")
    with pytest.raises(ValueError, match="by name"):
        Settings.load(str(one), {})


def test_the_last_manifest_row_of_a_key_wins_as_the_file_has_it(spark, tmp_path):
    head = "source,key,expected_filename,status,reason,n_bytes,checked_at"
    lines = [f"m,2015-{k % 50:03d},f{k},{'downloaded' if k >= 50 else 'failed'},{'' if k >= 50 else '404'},{k},t{k}" for k in range(100)]
    (tmp_path / "m.csv").write_text("\n".join([head, *lines]) + "\n")
    rows = clean.read_manifest(spark, str(tmp_path / "m.csv"))
    last = clean.last_row_wins(rows, ["source", "key"], ["seq"]).collect()
    assert len(last) == 50 and all(r.status == "downloaded" and r.n_bytes >= 50 and r.reason is None for r in last)


def test_a_day_falls_back_one_day_and_no_farther(spark):
    daily = spark.createDataFrame([("2020-01-01", 110.0), ("2020-01-02", float("nan")), ("2020-01-05", 130.0), ("2020-01-06", None)], "d string, f double").withColumn("d", F.to_date("d"))

    def ask(*days):
        return clean.with_fallback(spark.createDataFrame([(d, 1) for d in days], "d string, x int").withColumn("d", F.to_date("d")), daily, "d", "f")

    got = {str(r.d): (r.f, r.from_previous, r.x) for r in ask("2020-01-01", "2020-01-02", "2020-01-05", "2020-01-06").collect()}
    assert got == {"2020-01-01": (110.0, False, 1), "2020-01-02": (110.0, True, 1), "2020-01-05": (130.0, False, 1), "2020-01-06": (130.0, True, 1)}
    for day in ("2020-01-03", "2019-12-31"):
        with pytest.raises(Exception, match="no finite f for"):
            ask(day).collect()
    frames = spark.createDataFrame([(1577923200,)], "t long")  # 2020-01-02
    assert climatology.baseline(frames, daily.toDF("day", "f107"), "t", [0.0], [0.0]).count() == 1


def test_cut_offs_take_the_higher_criterion_for_raw_maps(spark):
    s = spark.createDataFrame([(k, 10.0 ** -(0.2 * k if k < 16 else 0.2 * k + 3)) for k in range(30)], "l int, s double")
    raw, rest = spectrum.cut_off(s, "s", 0.05).first(), spectrum.cut_off(s, "s", 0.05, residual=True).first()
    assert raw.cliff == 15 and raw.by_energy < 15 and raw.l == 15 and rest.l == rest.by_energy == raw.by_energy
    flat = spectrum.cut_off(s.withColumn("s", F.lit(1.0)), "s", 0.05).first()
    assert flat.cliff == 36 and flat.l == 36


def test_models_stand_side_by_side(spark):
    t = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 4.0)], "model string, horizon int, rmse double")
    got = {r.model: (r.rmse_1, r.rmse_2) for r in evaluate.comparison(t, "model", "horizon", "rmse", [1, 2]).collect()}
    assert got == {"a": (2.0, 3.0), "b": (4.0, None)}


def test_times_without_a_zone_are_refused(spark):
    ok = spark.createDataFrame([("2015-03-08T02:30:00Z",), ("2015-03-08 02:30:00+01:00",), ("2015-03-08T02:30:00-0500",), (None,)], "s string")
    assert [r[0] for r in ok.select(S.aware_epoch(F.col("s"))).collect()] == [1425781800, 1425778200, 1425799800, None]
    for naive in ("2015-03-08T02:30:00", "2015-03-08"):
        with pytest.raises(Exception, match="without a zone"):
            spark.createDataFrame([(naive,)], "s string").select(S.aware_epoch(F.col("s"))).collect()


def test_labels_names_and_scales(spark):
    one = spark.range(1).select(
        S.horizon_label(F.lit(6), 7200), S.horizon_label(F.lit(3), 1800), S.lead_labels(F.lit(3), 7200), S.lead_labels(F.lit(3), 1800), S.step_label(F.lit(1), 7200),
        S.driver_file_name(F.lit(2015)), S.date_key(F.lit("2015-02-01").cast("date")), S.two_digits(F.lit(7)), S.two_digits(F.lit(12)),
        S.diverging(F.lit(-45.0)), S.diverging(F.lit(15.0)),
    ).first()
    assert list(one) == ["12h", "1.5h", "+2/+4/+6h", "+0.5/+1/+1.5h", "t+2h", "omni_5min2015.asc", "2015-02-01", "07", "12", -1.0, 0.5]


def test_grids_are_checked():
    lats, lons = grids.checked_grid([-10.0, 10.0], [0.0, 90.0, 180.0], 2, 3)
    assert lats.shape == (2,) and lons.shape == (3,)
    for bad in (([-10.0], [0.0, 90.0, 180.0]), ([10.0, -10.0], [0.0, 90.0, 180.0]), ([-10.0, 100.0], [0.0, 90.0, 180.0]), ([-10.0, float("nan")], [0.0, 90.0, 180.0])):
        with pytest.raises(ValueError):
            grids.checked_grid(*bad, 2, 3)


def test_short_and_lost_bands_are_null():
    head = [f"{'  10.0   0.0 -10.0':<60}LAT1 / LAT2 / DLAT", f"{'   0.0  20.0  10.0':<60}LON1 / LON2 / DLON", f"{'':<60}END OF HEADER"]

    def body(*bands):
        out = [f"{'1':<60}START OF TEC MAP", f"{'  2015  1  1  0  0  0':<60}EPOCH OF CURRENT MAP"]
        for b in bands:
            out += [f"{'':<60}LAT/LON1/LON2/DLON/H", " ".join(map(str, b))]
        return [*out, f"{'1':<60}END OF TEC MAP"]

    def rows(*bands):
        return [m[3] for m in ionex.parse("\n".join([*head, *body(*bands)]))]

    assert rows([10, 20, 30], [40, 9999, 60]) == [[[1.0, 2.0, 3.0], [4.0, None, 6.0]]]
    assert rows([10, 20], [40, 50, 60]) == [[[None] * 3, [4.0, 5.0, 6.0]]]
    assert rows([10, 20, 30]) == [[[1.0, 2.0, 3.0], [None] * 3]]
    assert rows([10, 20, 30, 40], [1, 2, 3], [7, 8, 9]) == [[[1.0, 2.0, 3.0], [pytest.approx(0.1), pytest.approx(0.2), pytest.approx(0.3)]]]
    assert list(ionex.parse("")) == []
    with pytest.raises(ValueError, match="no grid"):
        list(ionex.parse("\n".join(body([1, 2, 3]))))


def test_map_files_are_dealt_by_size_and_opened_by_uri(spark, tmp_path):
    for d in range(5):
        sub = tmp_path / f"y{d % 2}"
        sub.mkdir(exist_ok=True)
        (sub / f"f{d}.txt").write_text(text([(2015, 1, 1 + d, 0, 0, 0)]))
    (tmp_path / "_hidden").write_text("not a map")
    ionex.register(spark)
    size = (tmp_path / "y0" / "f0.txt").stat().st_size
    for uri in (str(tmp_path), f"file://{tmp_path}"):
        df = spark.read.format("ionex").option("split_bytes", str(2 * size)).load(uri)
        assert df.rdd.getNumPartitions() == 3 and df.count() == 5
    assert spark.read.format("ionex").load(str(tmp_path / "y0" / "f0.txt")).count() == 1
    parts = ionex._Reader(str(tmp_path), 1).partitions()
    assert [len(p.paths) for p in parts] == [1] * 5
    with pytest.raises(FileNotFoundError):
        ionex._Reader(str(tmp_path / "none"), 1).partitions()
