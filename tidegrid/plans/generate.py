"""Forecast days: from stored frames and a model to hourly day packs on the map files' grid.

A model is any function of batches of normalised histories; it runs in Arrow
batches inside Spark's tasks. Everything around it is joins and functions of
rows. Days whose pack is stored are left out before anything is read for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import hour_slice
from tidegrid.operators import evaluate, grids
from tidegrid.plans.stages import Settings, path_exists
from tidegrid.session import settled

DAY, HOUR = 86_400, 3_600
#: (maps [n, steps, cells], drivers [n, steps, channels]) -> the next map, normalised [n, cells].
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


def persistence(maps: np.ndarray, drivers: np.ndarray) -> np.ndarray:
    """The model that says: as it was last."""
    return maps[:, -1]


def days_to_do(frames: DataFrame, stored: DataFrame | None, t: str = "t", years: list[int] | None = None) -> DataFrame:
    """(day): first seconds of the days that have all 24 hourly frames and no stored pack."""
    hour = F.col(t).cast("long")
    day = (F.floor(hour / DAY) * DAY).alias("day")
    own = frames.where(hour % HOUR == 0).select(day, hour.alias("h")).distinct().groupBy("day").agg(F.count("*").alias("n")).where("n = 24").select("day")
    if years is not None:
        own = own.where(F.year(F.timestamp_seconds("day")).isin([int(y) for y in years]))
    return own if stored is None else own.join(stored.select("day"), "day", "left_anti")


def histories(frames: DataFrame, targets: DataFrame, settings: Settings, maps: str, drivers: str, base: str, t: str = "t") -> DataFrame:
    """(target, maps, drivers, base): for each target time the frames before it, oldest first, and the baseline at it.

    Only targets whose frames are all there and finite, maps and drivers, and
    whose own baseline is finite.
    """
    cadence, steps = settings.cadence_seconds, settings.inputs
    back = targets.select("target", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("back"))
    fine = frames.where(grids.all_finite(F.col(maps)) & grids.all_finite(F.col(drivers))).select(F.col(t).alias("_t"), maps, drivers)
    seen = back.withColumn("_t", F.col("target") - F.col("back") * cadence).join(fine, "_t")
    cell = F.struct((-F.col("back")).alias("k"), F.col(maps).alias("m"), F.col(drivers).alias("d"))
    whole = seen.groupBy("target").agg(F.array_sort(F.collect_list(cell)).alias("_w")).where(F.size("_w") == steps)
    based = frames.where(grids.all_finite(F.col(base))).select(F.col(t).alias("target"), F.col(base).alias("base"))
    return whole.join(based, "target").select("target", F.transform("_w", lambda x: x["m"]).alias("maps"), F.transform("_w", lambda x: x["d"]).alias("drivers"), "base")


def predicted(history: DataFrame, moments: Mapping[str, object], model: Model) -> DataFrame:
    """(target, value): the model's maps, denormalised, plus the baseline of the time they are for."""
    mean, std = float(moments["mean"]), float(moments["std"])
    c_mean, c_std = np.array(moments["channel_mean"], dtype=np.float64), np.array(moments["channel_std"], dtype=np.float64)

    def nested(column: pa.Array, n: int) -> np.ndarray:
        return column.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(column[0]), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = ((nested(batch.column(1), n) - mean) / std).astype(np.float32)
                d = ((nested(batch.column(2), n) - c_mean) / c_std).astype(np.float32)
                out = np.asarray(model(x, d), dtype=np.float64)
                ends = np.arange(n + 1, dtype=np.int32) * out.shape[1]
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel())), batch.column(3)], names=["target", "scaled", "base"])

    kind = history.schema["base"].dataType.simpleString()
    out = history.mapInArrow(run, f"target long, scaled array<double>, base {kind}")
    absolute = F.zip_with("scaled", "base", lambda p, b: evaluate.denormalised(p, F.lit(mean), F.lit(std)) + b)
    return out.select("target", absolute.alias("value"))


def filled_days(maps: DataFrame, t: str, value: str) -> DataFrame:
    """(day, hours): all 24 maps of each day from those at even hours, only of days where all are there.

    An odd hour is the mean of its neighbours, the last one repeats the one
    before. Twelve maps a day at most are gathered.
    """
    hour = F.floor(F.pmod(F.col(t), F.lit(DAY)) / HOUR).cast("int")
    even = maps.where((F.pmod(F.col(t), F.lit(HOUR)) == 0) & (hour % 2 == 0) & grids.all_finite(F.col(value)))
    by_day = even.groupBy((F.floor(F.col(t) / DAY) * DAY).alias("day")).agg(F.array_sort(F.collect_list(F.struct(hour.alias("h"), F.col(value).alias("v")))).alias("_e"))

    def at(k: Column) -> Column:
        return F.get(F.col("_e"), k)["v"]

    def one(k: Column) -> Column:
        half = F.floor(k / 2).cast("int")
        mean = F.zip_with(at(half), at(half + 1), lambda a, b: 0.5 * (a + b))
        return F.when((k % 2 == 0) | (k == 23), at(half)).otherwise(mean)

    whole = by_day.where((F.size("_e") == 12) & (F.size(F.array_distinct(F.transform("_e", lambda x: x["h"]))) == 12))
    return whole.select("day", F.transform(F.sequence(F.lit(0), F.lit(23)), one).alias("hours"))


def packed(days: DataFrame, weights: list[tuple[int, int, float]], targets: int) -> DataFrame:
    """(day, year, pack): every hour on the target grid, all hours of a day as one gzipped block of half floats."""
    on_grid = F.flatten(F.transform("hours", lambda m: grids.regrid_row(m, weights, targets)))
    return grids.packed_last(days.select("day", F.year(F.timestamp_seconds("day")).alias("year"), on_grid.alias("_v")), "pack")


def stored_days(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path).select("day") if path_exists(spark, path) else None


def generate(
    spark: SparkSession,
    frames: DataFrame,
    moments: Mapping[str, object],
    model: Model,
    settings: Settings,
    weights: list[tuple[int, int, float]],
    targets: int,
    path: str,
    years: list[int] | None = None,
    maps: str = "dtec",
    drivers: str = "drivers",
    base: str = "iri",
) -> DataFrame:
    """Forecast and pack all days of ``frames`` (t, maps, drivers, base) that have no pack at ``path``; returns the days written.

    A second run over the same frames writes nothing. A day with an hour
    missing gets no pack, and is tried again by the next run.
    """
    todo = settled(days_to_do(frames, stored_days(spark, path), "t", years))
    hours = F.explode(F.sequence(F.lit(0), F.lit(22), F.lit(2)))
    wanted = todo.select("day", hours.alias("h")).select((F.col("day") + F.col("h") * HOUR).alias("target"))
    maps_ = predicted(histories(frames, wanted, settings, maps, drivers, base), moments, model)
    if todo.isEmpty():
        return todo
    packed(filled_days(maps_, "target", "value"), weights, targets).write.mode("append").partitionBy("year").parquet(path)
    return spark.read.schema("day long, pack binary, year int").parquet(path).select("day").join(todo, "day", "left_semi")


def read_packs(spark: SparkSession, path: str, first: str, last: str, source: str | None = None) -> DataFrame:
    """(day, year, pack) from one day to another, both included; only files of their years (and of one source, where packs are stored by source) are read."""
    df = spark.read.parquet(path)
    if source is not None:
        df = df.where(F.col("source") == source)
    lo, hi = (F.unix_seconds(F.to_timestamp(F.lit(d))) for d in (first, last))
    return df.where(F.col("year").between(int(first[:4]), int(last[:4])) & F.col("day").between(lo, hi))


def hour_maps(packs: DataFrame, hours: list[int], cells: int) -> DataFrame:
    """(t, values): the maps of these hours of each day's pack."""
    flat = grids.from_float16(packs, "pack", "_v")
    each = flat.select("day", "_v", F.explode(F.array(*[F.lit(h) for h in hours])).alias("_h"))
    return each.select((F.col("day") + F.col("_h") * HOUR).alias("t"), hour_slice(F.col("_v"), F.col("_h"), cells).alias("values"))
