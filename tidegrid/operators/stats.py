"""Moments, histograms, quality and coverage figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def population_moments(df: DataFrame, value: Column, by: list[str] | None = None, floor: float = 1e-12) -> DataFrame:
    """Mean and population deviation by one pass over sums; the variance has a floor."""
    x = value.cast("double")
    out = df.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    mean = F.col("_s") / F.col("n")
    return out.select(
        *(by or []), "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(floor))).alias("std")
    )


def train_moments(frames: DataFrame, value: Column) -> DataFrame:
    """``population_moments`` of the training frames; without any frame to learn from it fails instead of passing on nothing."""
    m = population_moments(frames, value)
    return m.select(
        F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no training windows to take moments from"))).alias("n"), "mean", "std"
    )


def vector_moments(frames: DataFrame, values: str, floor: float = 1e-12) -> DataFrame:
    """(channel, n, mean, std) of an array column, place by place, in one pass of partial sums; nulls don't count."""
    flat = frames.select(F.posexplode(values).alias("channel", "_x"))
    return population_moments(flat, F.col("_x"), ["channel"], floor)


def window_moments(frames: DataFrame, values: str, channels: list[str], floor: float = 1e-12) -> DataFrame:
    """One row (n, mean, std, frames, channel_mean, channel_std): moments over all cells of all maps, and of each channel over frames.

    One pass: every row adds its map up in place, then sums are added. Frames
    must be finite. Without any frame to learn from it fails.
    """
    x = [F.col(c).cast("double") for c in channels]
    own = frames.select(
        F.size(values).alias("_n"),
        F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v).alias("_s"),
        F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")).alias("_q"),
        *[c.alias(f"_x{k}") for k, c in enumerate(x)],
    )
    sums = own.agg(
        F.sum("_n").alias("n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.count("*").alias("frames"),
        *[F.sum(f"_x{k}").alias(f"_s{k}") for k in range(len(x))],
        *[F.sum(F.col(f"_x{k}") * F.col(f"_x{k}")).alias(f"_q{k}") for k in range(len(x))],
    )

    def spread(s: str, q: str, n: str) -> Column:
        mean = F.col(s) / F.col(n)
        return F.sqrt(F.greatest(F.col(q) / F.col(n) - mean * mean, F.lit(floor)))

    some = F.when(F.col("frames") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no training windows to take moments from")))
    return sums.select(
        some.alias("n"),
        (F.col("_s") / F.col("n")).alias("mean"),
        spread("_s", "_q", "n").alias("std"),
        "frames",
        F.array(*[F.col(f"_s{k}") / F.col("frames") for k in range(len(x))]).alias("channel_mean"),
        F.array(*[spread(f"_s{k}", f"_q{k}", "frames") for k in range(len(x))]).alias("channel_std"),
    )


def input_frames(starts: DataFrame, t: str, steps: int, cadence: int) -> DataFrame:
    """The distinct frames that windows show as input: each counts once however many windows show it."""
    offsets = starts.select(F.col(t), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_k"))
    return offsets.select((F.col(t) + F.col("_k") * cadence).alias(t)).distinct()


def histogram_weights(df: DataFrame, value: str, bins: int, least: float = 1e-8) -> DataFrame:
    """(bin, lo, hi, n, weight) of equal-width bins; the last bin holds its upper edge; weights are 1/density, mean 1.

    Empty bins are there, with their density clipped at ``least``.
    """
    spark = df.sparkSession
    span = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.count(value).alias("total"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).join(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # span: one row
    full = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").join(F.broadcast(span))
    width = (F.col("hi") - F.col("lo")) / bins
    n = F.coalesce("n", F.lit(0))
    dense = full.select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
        n.cast("long").alias("n"),
        (1.0 / F.greatest(n / F.col("total") / width, F.lit(least))).alias("_w"),
    )
    mean = dense.agg(F.avg("_w").alias("_m"))
    return dense.join(F.broadcast(mean)).select("bin", "lo", "hi", "n", (F.col("_w") / F.col("_m")).alias("weight"))


def bucket_of(x: Column, inner_edges: list[float]) -> Column:
    """Index by inner edges, left-open and right-closed: edge i-1 < x <= edge i."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in inner_edges]), lambda e: e < x))


def seasonal_ratio(df: DataFrame, day: str, num: str, den: str) -> DataFrame:
    """Mean ratio in January and in July, and whether they lie on the two sides that tell observed from adjusted values."""
    ratio = F.col(num) / F.col(den)
    means = df.agg(F.avg(F.when(F.month(day) == 1, ratio)).alias("january"), F.avg(F.when(F.month(day) == 7, ratio)).alias("july"))
    return means.withColumn("observed", F.coalesce((F.col("january") > 1.015) & (F.col("july") < 0.985), F.lit(False)))


def driver_quality(aligned: DataFrame, channel: str, value: str, imputed: str = "imputed") -> DataFrame:
    """Per channel: share imputed, share missing, and frames."""
    return aligned.groupBy(channel).agg(
        F.avg(F.col(imputed).cast("int")).alias("imputed_share"), F.avg(F.col(value).isNull().cast("int")).alias("outage_share"), F.count("*").alias("frames")
    )


def quality_by_year(rows: DataFrame, year: Column, channels: list[str], imputed: str) -> DataFrame:
    """(year, channel, imputed_share, outage_share, frames, frames_lost) of wide driver rows, one pass.

    ``imputed`` is an array of flags in the order of ``channels``; an outage is
    a null or NaN. ``frames_lost`` counts the year's frames that miss any channel.
    """

    def lost(c: str) -> Column:
        x = F.col(c).cast("double")
        return x.isNull() | F.isnan(x)

    any_lost = F.lit(False)
    for c in channels:
        any_lost = any_lost | lost(c)
    shares = [F.avg(F.coalesce(F.get(F.col(imputed), F.lit(k)), F.lit(False)).cast("int")).alias(f"_i{k}") for k in range(len(channels))]
    outages = [F.avg(lost(c).cast("int")).alias(f"_o{k}") for k, c in enumerate(channels)]
    wide = rows.groupBy(year.alias("year")).agg(F.count("*").alias("frames"), F.count_if(any_lost).alias("frames_lost"), *shares, *outages)
    parts = [F.struct(F.lit(c).alias("channel"), F.col(f"_i{k}").alias("imputed_share"), F.col(f"_o{k}").alias("outage_share")) for k, c in enumerate(channels)]
    return wide.select("year", F.explode(F.array(*parts)).alias("c"), "frames", "frames_lost").select("year", "c.*", "frames", "frames_lost")


def weighted_anomaly(cells: DataFrame, by: list[str], value: str, weight: str, out: str = "anomaly") -> DataFrame:
    """Each cell minus its map's weighted mean; joined by the map's key after a partial sum."""
    mean = cells.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("_mean"))
    return cells.join(mean, by).withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def ring_mean(cells: DataFrame, by: list[str], row: str, value: str, rows: list[int]) -> DataFrame:
    """Edge rows (the poles) replaced by their own mean."""
    mean = cells.where(F.col(row).isin(rows)).groupBy(*by, row).agg(F.avg(value).alias("_ring"))
    return cells.join(mean, [*by, row], "left").withColumn(value, F.coalesce("_ring", value)).drop("_ring")
