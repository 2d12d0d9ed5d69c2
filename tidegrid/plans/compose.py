"""The stages from raw texts to windows, each a function from DataFrames to a DataFrame.

Writing is the stage runner's and ``save_windows``' work; nothing here collects
rows, but for the checks that a stage makes of one aggregated row.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import epoch_date
from tidegrid.operators import clean, climatology, evaluate, grids, stats, timeline
from tidegrid.plans.stages import Settings, path_exists
from tidegrid.session import settled
from tidegrid.sources import ionex, text_tables

#: Fluxes above this are spikes; repeats that differ by more than this share of the signal are worth a warning.
FLUX_LIMIT = 300.0
REPEAT_TOLERANCE = 0.05


def in_range(df: DataFrame, column: str, first: str | int, last: str | int) -> DataFrame:
    """Rows from ``first`` to ``last``, both included; null on either side is not in range."""
    return df.where(F.col(column).between(F.lit(first), F.lit(last)))


def index_tables(lines: DataFrame, first: str, last: str, seasonal: bool = True) -> tuple[DataFrame, DataFrame]:
    """(day, f107) and (t, kp) of daily index lines between two days.

    Spikes are filled along the line between their neighbours. With
    ``seasonal``, the ratio of observed to adjusted flux must show the Earth's
    distance to the Sun, else the columns are not what they claim to be, and
    this fails.
    """
    rows = in_range(text_tables.parse_indices(lines), "date", first, last)
    if seasonal:
        seen = stats.seasonal_ratio(rows, "date", "f107_obs", "f107_adj").first()  # one row
        if not seen["observed"]:
            raise ValueError(f"observed and adjusted flux look swapped: January {seen['january']}, July {seen['july']}")
    masked = rows.select(F.unix_date("date").cast("long").alias("t"), "date", clean.mask_above(F.col("f107_obs"), FLUX_LIMIT).alias("f107"))
    flux = timeline.fill_forward_linear(masked, "t", "f107", 400).select(F.col("date").alias("day"), "f107")
    return flux, text_tables.kp_steps(rows)


def usable_rows(manifest: DataFrame, order: list[str]) -> DataFrame:
    """(key, year, ...): of each key the last manifest row, if it is a finished download."""
    last = clean.last_row_wins(manifest, ["source", "key"], order)
    return last.where(F.col("status").isin("present", "downloaded")).withColumn("year", F.split("key", "-")[0].cast("int"))


def rows_by_year(manifest: DataFrame, order: list[str]) -> DataFrame:
    """(year, files): usable files of each year."""
    return usable_rows(manifest, order).groupBy("year").agg(F.count("*").alias("files"))


def gridded_maps(texts: DataFrame, weights: list[tuple[int, int, float]], targets: int, key: str = "key") -> DataFrame:
    """(t, key, src_year, tec) of map files ``key``, ``text``: every map on the target grid, rows of latitude in one array.

    Regridding is work within the row, done before anything moves. ``src_year``
    is the year in the file's key. Cells without a corner stay null.
    """
    maps = ionex.parse_texts(texts, keep=[key]).select("epoch_s", key, F.flatten("grid").alias("_v"))
    return maps.select(F.col("epoch_s").alias("t"), key, F.split(key, "-")[0].cast("int").alias("src_year"), grids.regrid_row(F.col("_v"), weights, targets).alias("tec"))


def interpolated_maps(texts: DataFrame, weights: list[tuple[int, int, float]], targets: int, key: str = "key") -> DataFrame:
    """(t, src_year, tec): ``gridded_maps``, one map an epoch.

    Files overlap in the epoch between two days: of an epoch the map of the
    first file stays.
    """
    return timeline.dedupe_epochs(gridded_maps(texts, weights, targets, key), "t", key).select("t", "src_year", "tec")


def repeats_differ(maps: DataFrame, t: str = "t", key: str = "key", values: str = "tec", tolerance: float = REPEAT_TOLERANCE) -> bool:
    """Whether repeated epochs of ``gridded_maps`` differ by more than ``tolerance`` of the signal; warns if so."""
    found = grids.repeat_differences(maps, t, key, values).first()  # one row
    if found["relative"] > tolerance:
        warnings.warn(f"repeated epochs differ by {found['relative']:.1%} of the signal", stacklevel=2)
        return True
    return False


def residual_maps(maps: DataFrame, flux: DataFrame, lats: list[float], lons: list[float], provider: climatology.Provider = climatology.analytic) -> DataFrame:
    """(t, src_year, dtec): maps minus the climatology's at the same epochs."""
    base = climatology.baseline(maps.select("t"), flux, "t", lats, lons, provider)
    joined = maps.join(base, "t", "full_outer")
    one_sided = F.col("tec").isNull() | F.col("iri").isNull()
    checked = F.when(one_sided, F.raise_error(F.lit("maps and baselines have different epochs"))).otherwise(grids.minus(F.col("tec"), F.col("iri")))
    return joined.select("t", "src_year", checked.alias("dtec"))


def driver_rows(lines: DataFrame, kp: DataFrame, frames: DataFrame, settings: Settings) -> DataFrame:
    """(t, five drivers, kp, imputed, imputed_channels): all drivers at the frames' epochs, one row for each distinct frame.

    Five-minute drivers lie on the line between their neighbours, no farther
    than the longest gap; kp carries its last value. A value that is too far
    away stays null, by its own channel only. ``imputed_channels`` flags each
    channel, kp last, whose value was not observed at the frame; ``imputed`` any.
    """
    names = list(text_tables.DRIVERS)
    wide = clean.mean_of_repeats(text_tables.parse_drivers(lines), ["t"], names)
    long = wide.select("t", F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).alias("value")) for n in names])).alias("c")).select("t", "c.*")
    times = frames.select(F.col("t").cast("long").alias("t")).distinct()
    wanted = times.select("t", F.explode(F.array(*[F.lit(n) for n in names])).alias("channel"))
    aligned = timeline.align_interpolated(long.where("value is not null"), wanted, "t", "value", settings.gap_minutes * 60, ["channel"])
    values = [F.max(F.when(F.col("channel") == n, F.col("value"))).alias(n) for n in names]
    flags = [F.max(F.when(F.col("channel") == n, F.col("imputed"))).alias(f"_i_{n}") for n in names]
    driven = aligned.groupBy("t").agg(*values, *flags)
    carried = timeline.align_carried(kp, times, "t", "kp", settings.kp_hours * 3600)
    both = driven.join(carried.select("t", "kp", F.col("imputed").alias("_old")), "t")
    each = F.array(*[F.coalesce(f"_i_{n}", F.lit(True)) for n in names], F.coalesce("_old", F.lit(True)))
    return both.select("t", *names, "kp", F.exists(each, lambda x: x).alias("imputed"), each.alias("imputed_channels"))


def fan_out(targets: DataFrame, values: DataFrame, t: str) -> DataFrame:
    """Values of distinct times back to every row of ``targets``, which may repeat times."""
    return targets.join(values, t, "left")


def aligned_series(maps: DataFrame, drivers: DataFrame, year: str = "src_year", t: str = "t") -> DataFrame:
    """Maps and drivers of all years in one series, one row a time.

    In every year that has drivers both sides must hold the same times, else
    this fails. A year without drivers is left out, with a warning. A time in
    two years belongs to the earlier one.
    """
    years = maps.select(year).distinct().join(drivers.select(year).distinct().withColumn("_driven", F.lit(True)), year, "left")
    lost = sorted(r[0] for r in years.where("_driven is null").select(year).limit(200).collect())
    if lost:
        warnings.warn(f"years without drivers are left out: {lost}", stacklevel=2)
    driven = maps.join(F.broadcast(years.where("_driven").select(year)), year, "left_semi")  # one row a year
    both = driven.withColumn("_m", F.lit(True)).join(drivers.withColumn("_d", F.lit(True)), [year, t], "full_outer")
    paired = F.col("_m").isNotNull() & F.col("_d").isNotNull()
    fault = F.raise_error(F.concat(F.lit("maps and drivers have different times in "), F.col(year).cast("string")))
    checked = both.withColumn(t, F.when(paired, F.col(t)).otherwise(fault)).drop("_m", "_d")
    rest = [c for c in checked.columns if c not in (t, year)]
    first = checked.groupBy(t).agg(F.min_by(F.struct(year, *rest), F.col(year)).alias("_r"))
    return first.select(t, *[F.col("_r")[c].alias(c) for c in (year, *rest)])


def windows(series: DataFrame, settings: Settings, drivers: list[str], train_end: int, val_end: int, values: str = "dtec") -> tuple[DataFrame, DataFrame]:
    """(split, t, inputs, targets, drivers) of all valid windows, normalised by the training frames, and the moments (one row).

    The series is thinned to the cadence; a window is valid if its frames are
    evenly spaced and neither a map nor a driver misses a value or holds NaN or
    an infinity. Maps have one mean and deviation, drivers one each. Splits are
    purged and embargoed by one window. Fails where no window is left to train
    on. The thinned series is kept in the checkpoint folder, as moments, starts
    and rows all need it.
    """
    cadence, length = settings.cadence_seconds, settings.inputs + settings.targets
    whole = grids.all_finite(F.col(values)) & grids.all_finite(F.array(*[F.col(d).cast("double") for d in drivers]))
    frames = settled(timeline.decimate(series, "t", cadence).select("t", values, *drivers, whole.alias("_ok")))
    valid = timeline.window_starts(frames.select("t", "_ok"), "t", "_ok", cadence, length).where("valid")
    named = valid.select("t", timeline.split_name(F.col("t"), F.col("last_t"), train_end, val_end, length * cadence).alias("split")).where("split is not null")
    used = stats.input_frames(named.where("split = 'train'").select("t"), "t", settings.inputs, cadence).join(frames, "t")
    moments = stats.window_moments(used, values, drivers)
    steps = named.select("split", F.col("t").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step"))
    rows = steps.withColumn("t", F.col("start") + F.col("step") * cadence).join(frames, "t").join(F.broadcast(moments.select(F.struct("*").alias("_m"))))  # one row
    scaled = F.transform(values, lambda x: evaluate.normalised(x, F.col("_m.mean"), F.col("_m.std")).cast("float"))
    driven = [evaluate.normalised(F.col(d), F.get(F.col("_m.channel_mean"), F.lit(k)), F.get(F.col("_m.channel_std"), F.lit(k))).cast("float") for k, d in enumerate(drivers)]
    cell = F.struct("step", scaled.alias("map"), F.array(*driven).alias("drivers"))
    packed = rows.groupBy("split", "start").agg(F.array_sort(F.collect_list(cell)).alias("_w"))

    def part(first: int, many: int, field: str) -> Column:
        return F.transform(F.slice("_w", first + 1, many), lambda x: x[field])

    out = packed.select(
        "split",
        F.col("start").alias("t"),
        part(0, settings.inputs, "map").alias("inputs"),
        part(settings.inputs, settings.targets, "map").alias("targets"),
        part(0, settings.inputs, "drivers").alias("drivers"),
    )
    return out, moments


def save_windows(spark: SparkSession, out: DataFrame, path: str, overwrite: bool = False) -> None:
    """Windows by split; refuses to replace what is there unless told to."""
    if path_exists(spark, path) and not overwrite:
        raise FileExistsError(f"{path} is there; pass overwrite to replace it")
    out.write.mode("overwrite").partitionBy("split").parquet(path)


def read_windows(spark: SparkSession, path: str, split: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Windows of one split (only its files are read), only the columns asked for."""
    df = spark.read.parquet(path)
    df = df.where(F.col("split") == split) if split else df
    return df.select(*columns) if columns else df


def read_year(spark: SparkSession, path: str, year: int | None = None, part: str = "src_year") -> DataFrame:
    """A table that is stored by year; of one year only its own files are read."""
    df = spark.read.parquet(path)
    return df.where(F.col(part) == year) if year is not None else df


def read_index(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """An index table with all needed columns, or an error that names those it lacks."""
    df = spark.read.parquet(path)
    if lost := [c for c in needed if c not in df.columns]:
        raise ValueError(f"{path} lacks {lost}")
    return df


def years_needed(wanted: list[int], stored: DataFrame, year: str = "year") -> DataFrame:
    """The wanted years, and of each the year before where it is stored."""
    spark = stored.sparkSession
    asked = spark.createDataFrame([(int(y),) for y in wanted], f"{year} int")
    before = asked.select((F.col(year) - 1).alias(year)).join(stored.select(year).distinct(), year, "left_semi")
    return asked.union(before).distinct()


def forecast_days(forecast: DataFrame, baseline: DataFrame, lead: int, t: str = "t", value: str = "value", base: str = "base") -> DataFrame:
    """(t, value): forecasts made at ``t``, plus the baseline of the time they are for, ``lead`` seconds later, at that time."""
    out = evaluate.add_baseline(forecast, baseline, t, value, base, F.lit(lead))
    return out.select((F.col(t) + lead).alias(t), F.col("absolute").alias(value))


def save_year(spark: SparkSession, maps: DataFrame, path: str, year: int, least: int = 300) -> bool:
    """Write a year's day packs; False, without a computation, where the year is stored with more than ``least`` packs."""
    target = f"{path.rstrip('/')}/year={year}"
    if path_exists(spark, target) and spark.read.parquet(target).count() > least:
        return False
    maps.write.mode("overwrite").parquet(target)
    return True
