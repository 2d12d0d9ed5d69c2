from tidegrid.streaming import frames


def test_decimation_keeps_state_per_key(spark, tmp_path):
    rows = [(k, t) for k in (1, 2) for t in range(0, 36000, 1800 * k)]
    spark.createDataFrame(rows, "k long, t long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, t long").parquet(str(tmp_path / "in"))
    out = frames.run_once(frames.decimated(stream, "k", "t", 7200), "decimated_test", "append").collect()
    assert sorted((r.k, r.t) for r in out) == [(k, t) for k in (1, 2) for t in range(0, 36000, 7200)]


T0 = 7200 * 138889  # watermarks begin at the epoch, so events must come later


def stamped(spark, rows, path):
    spark.createDataFrame([(T0 + t, v) for t, v in rows], "t long, v double").selectExpr("timestamp_seconds(t) AS ts", "v").write.mode("append").parquet(path)
    return spark.readStream.schema("ts timestamp, v double").parquet(path)


def test_sliding_windows_need_all_their_frames(spark, tmp_path):
    frames_at = [7200 * k for k in range(20) if k != 12]
    stream = stamped(spark, [(t, float(t)) for t in frames_at], str(tmp_path / "in"))
    out = frames.run_to_table(frames.sliding_frames(stream, "ts", "v"), at=str(tmp_path / "out")).collect()
    assert sorted(r.t - T0 for r in out) == [7200 * k for k in range(4)]
    assert all(r["values"] == [float(r.t - T0 + 7200 * k) for k in range(9)] for r in out)


def test_streams_go_on_where_they_ended(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "out")
    first = frames.run_to_table(frames.first_of_epoch(stamped(spark, [(0, 1.0), (0, 1.0), (60, 2.0)], path), "ts", ["ts"]), "append", at)
    assert sorted(r.v for r in first.collect()) == [1.0, 2.0]
    second = frames.run_to_table(frames.first_of_epoch(stamped(spark, [(60, 2.0), (120, 3.0)], path), "ts", ["ts"]), "append", at)
    assert second.count() == 3


def test_values_older_than_the_limit_are_not_carried(spark, tmp_path):
    a = stamped(spark, [(3600 * k, 0.0) for k in range(6)] + [(10**6, 0.0)], str(tmp_path / "a"))
    b = stamped(spark, [(0, 1.0), (1800, 2.0), (10800, 3.0), (10**6, 4.0)], str(tmp_path / "b"))
    out = frames.run_to_table(frames.bounded_staleness(a, b, "ts", "v", 3600), "append", str(tmp_path / "out"))
    got = {r.ts - T0: r.v for r in out.collect()}
    assert {t: v for t, v in got.items() if t < 10**6} == {0: 1.0, 3600: 2.0, 10800: 3.0, 14400: 3.0}


def test_definitive_values_replace_preliminary_ones(spark, tmp_path):
    path, row = str(tmp_path / "t"), "k long, definitive int, v double"
    frames.upsert(spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0)], row), path, "k", "definitive")
    frames.upsert(spark.createDataFrame([(1, 1, 5.0), (2, 0, 9.0), (3, 0, 3.0)], row), path, "k", "definitive")
    assert sorted(tuple(r) for r in frames.current(spark, path).collect()) == [(1, 1, 5.0), (2, 1, 2.0), (3, 0, 3.0)]
