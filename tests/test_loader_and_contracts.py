"""Batches for training; contracts that chain; sinks that write a batch once."""

import json

import pytest
from pyspark.sql import functions as F

from tidegrid.plans import contracts, loader, stages
from tidegrid.plans.stages import Settings
from tidegrid.streaming import frames


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(997).withColumn("t", F.pmod(F.col("id") * 7919, F.lit(1009))).repartition(6)
    got = sorted((r.t, r.position) for r in loader.with_positions(df, ["t"]).collect())
    assert [p for _, p in got] == list(range(997))
    assert loader.with_positions(df.limit(0), ["t"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 1000, 4097])
def test_places_are_a_permutation_of_each_epoch(spark, n):
    df = spark.range(n).select(F.col("id"), *[loader.permuted(F.col("id"), n, e).alias(f"e{e}") for e in (0, 1)])
    rows = df.collect()
    for e in ("e0", "e1"):
        assert sorted(r[e] for r in rows) == list(range(n))
    if n >= 100:
        assert [r.e0 for r in rows] != [r.e1 for r in rows]
        assert sum(r.e0 == r.id for r in rows) < n // 10


def test_an_epoch_has_exactly_its_rows_anywhere(spark):
    df = spark.range(1003).withColumnRenamed("id", "position")
    one = {(r.position, r.place, r.batch) for r in loader.epoch_batches(df, 1003, 64, epoch=3, fraction=0.25).collect()}
    two = {(r.position, r.place, r.batch) for r in loader.epoch_batches(df.repartition(7), 1003, 64, epoch=3, fraction=0.25).collect()}
    assert one == two and len(one) == 250 and {p for _, p, _ in one} == set(range(250)) and all(b == p // 64 for _, p, b in one)
    other = {r.position for r in loader.epoch_batches(df, 1003, 64, epoch=4, fraction=0.25).collect()}
    assert len(other) == 250 and other != {x for x, _, _ in one}
    plain = loader.epoch_batches(df, 1003, 64, epoch=0, shuffle=False).collect()
    assert len(plain) == 1003 and all(r.place == r.position for r in plain)
    assert loader.epoch_batches(df.limit(0), 0, 64, 0).count() == 0 and loader.epoch_batches(df.limit(1), 1, 64, 0, 0.01).count() == 1
    plan = loader.epoch_batches(df, 1003, 64, 3)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()


def made(settings=Settings(), lats=(0.0, 1.0), lons=(0.0, 8.0), drivers=("a", "b"), provider="analytic"):
    return {k: c.text() for k, c in contracts.contracts(settings, list(lats), list(lons), list(drivers), provider).items()}


@pytest.mark.parametrize(
    ("changed", "stages_"),
    [
        ({"lats": (0.0, 1.0, 2.0)}, {"interpolate", "climatology"}),
        ({"settings": Settings(gap_minutes=60)}, {"drivers"}),
        ({"settings": Settings(kp_hours=6)}, {"drivers"}),
        ({"drivers": ("a",)}, {"drivers"}),
        ({"drivers": ("b", "a")}, {"drivers"}),
        ({"provider": "other"}, {"climatology"}),
        ({"settings": Settings(cadence_seconds=3600)}, {"windows"}),
    ],
)
def test_a_constant_changes_the_contracts_that_depend_on_it(changed, stages_):
    base, other = made(), made(**changed)
    assert {k for k in base if base[k] != other[k]} == stages_


def test_contracts_hold_versions_and_their_parts_apart():
    text = json.loads(made()["climatology"])
    assert text["version"] == 1 and text["packages"]["numpy"] not in ("absent", "unknown")
    assert contracts.dependency_version("no-such-package") == "absent"
    assert contracts.Contract("s", 1, ("ab", "c")).text() != contracts.Contract("s", 1, ("a", "bc")).text()
    assert contracts.Contract("s", 1, (1, 2)).text() != contracts.Contract("s", 1, (2, 1)).text() != contracts.Contract("s", 2, (1, 2)).text()
    assert len(contracts.source_revision()) == 40 or contracts.source_revision() == "unknown"
    assert contracts.source_revision("/nowhere") == "unknown"


def test_a_change_upstream_reaches_the_last_stage(spark, tmp_path):
    raw = spark.createDataFrame([(2015, 1, 5.0), (2016, 2, 6.0)], "y int, k int, v double")
    c = contracts.contracts(Settings(), [0.0], [0.0], ["a"])
    at = {n: str(tmp_path / n) for n in ("interpolate", "residual", "windows")}

    def run(rows, contract=c):
        built = []
        stages.run_stage(spark, "interpolate", rows, "y", lambda d: d, at["interpolate"], str(tmp_path / "log"), contract["interpolate"].text(), versions={"numpy": "x"})
        source, before = spark.read.parquet(at["interpolate"]), "interpolate"
        for name in ("residual", "windows"):
            prints = contracts.chained(contract[name], [contracts.stored_fingerprints(spark, at[before])])
            row = stages.run_stage(spark, name, source, "y", lambda d: d, at[name], str(tmp_path / "log"), expected=prints)
            built.append(row["partitions"])
            source, before = spark.read.parquet(at[name]), name
        return built

    assert run(raw) == ["[2015, 2016]", "[2015, 2016]"]
    assert run(raw) == ["[]", "[]"]
    first = contracts.lineage(spark, list(at.values()))
    changed = raw.withColumn("v", F.when(F.col("y") == 2016, 7.0).otherwise(F.col("v")))
    assert run(changed) == ["[2016]", "[2016]"]
    second = contracts.lineage(spark, list(at.values()))
    assert first["2015"] == second["2015"] and first["2016"] != second["2016"]
    later = contracts.contracts(Settings(cadence_seconds=3600), [0.0], [0.0], ["a"])
    assert run(changed, later) == ["[]", "[2015, 2016]"]
    log = [json.loads(x) for p in (tmp_path / "log").glob("*.json") for x in p.read_text().splitlines()]
    assert {"numpy": "x"} in [json.loads(x["versions"]) for x in log]
    assert contracts.stored_fingerprints(spark, str(tmp_path / "none")).count() == 0


def files(path):
    return {p.name: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def by_bucket(spark, path):
    rows = frames.current(spark, str(path)).select(F.input_file_name().alias("f")).distinct().collect()
    return {r.f.split("_bucket=")[1].split("/")[0]: r.f for r in rows}


def test_an_upsert_leaves_untouched_buckets_alone(spark, tmp_path):
    path, row = tmp_path / "t", "k long, definitive int, v double"
    frames.upsert(spark.createDataFrame([(k, 0, float(k)) for k in range(200)], row), str(path), "k", "definitive", 0, buckets=8)
    before = by_bucket(spark, path)
    assert len(before) == 8
    frames.upsert(spark.createDataFrame([(3, 1, -3.0)], row), str(path), "k", "definitive", 1, buckets=8)
    after = by_bucket(spark, path)
    moved = {b for b in before if before[b] != after[b]}
    assert len(moved) == 1
    got = {r.k: (r.definitive, r.v) for r in frames.current(spark, str(path)).collect()}
    assert len(got) == 200 and got[3] == (1, -3.0) and got[4] == (0, 4.0)
    # The same batch again, and an older one, change nothing.
    held = files(path)
    frames.upsert(spark.createDataFrame([(3, 2, 9.0)], row), str(path), "k", "definitive", 1, buckets=8)
    frames.upsert(spark.createDataFrame([(5, 2, 9.0)], row), str(path), "k", "definitive", 0, buckets=8)
    assert files(path) == held
    for n in range(2, 7):
        frames.upsert(spark.createDataFrame([(3, 1 + n, float(n))], row), str(path), "k", "definitive", n, buckets=8)
    assert len([p for p in path.rglob("_bucket=*") if p.is_dir()]) <= 8 + 2
    assert len(list((path / "manifests").glob("*.json"))) == 2
    assert {r.k: r.v for r in frames.current(spark, str(path)).collect()}[3] == 6.0
    with pytest.raises(ValueError, match="buckets"):
        frames.upsert(spark.createDataFrame([(3, 1, 0.0)], row), str(path), "k", "definitive", 9, buckets=16)


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(k, float(k))], "t long, v double").write.mode("append").parquet(source)
        stream = spark.readStream.schema("t long, v double").parquet(source)
        got = frames.run_to_table(stream, "append", at)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0.0), (1, 1.0)]
    # The last batch's commit is lost, as when the driver dies behind its write: it runs again.
    last = max((tmp_path / "out/log/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (tmp_path / "out/log/commits").glob(".*.crc"):
        crc.unlink()
    again = frames.run_to_table(spark.readStream.schema("t long, v double").parquet(source), "append", at)
    assert sorted(tuple(r) for r in again.collect()) == [(0, 0.0), (1, 1.0)]
