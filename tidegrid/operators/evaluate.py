"""Forecast evaluation in one pass, comparison gates, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(cells: DataFrame, by: list[str], pred: str, target: str, weight: str, storm: Column, quiet: Column) -> DataFrame:
    """Weighted RMSE and R2, unweighted correlation, RMSE of storm and quiet cells; one partial and one final sum."""
    w, p, y = F.col(weight), F.col(pred), F.col(target)
    e = w * (p - y) * (p - y)
    sums = cells.groupBy(*by).agg(
        F.sum(e).alias("_e"),
        F.sum(w).alias("_w"),
        F.sum(w * y).alias("_y"),
        F.sum(w * y * y).alias("_yy"),
        F.corr(p, y).alias("corr"),
        F.sum(F.when(storm, e)).alias("_se"),
        F.sum(F.when(storm, w)).alias("_sw"),
        F.sum(F.when(quiet, e)).alias("_qe"),
        F.sum(F.when(quiet, w)).alias("_qw"),
    )
    def floor(c: str) -> Column:
        return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-8))

    return sums.select(
        *by,
        F.sqrt(F.col("_e") / floor("_w")).alias("rmse"),
        (1 - F.col("_e") / (F.col("_yy") - F.col("_y") * F.col("_y") / floor("_w"))).alias("r2"),
        "corr",
        F.sqrt(F.coalesce("_se", F.lit(0.0)) / floor("_sw")).alias("storm_rmse"),
        F.sqrt(F.coalesce("_qe", F.lit(0.0)) / floor("_qw")).alias("quiet_rmse"),
    )


def skill(table: DataFrame, model: str, horizon: str, rmse: str, reference: str) -> DataFrame:
    """Add the percentage by which each model's RMSE is below the reference model's at that horizon."""
    ref = table.where(F.col(model) == reference).select(horizon, F.col(rmse).alias("_ref"))
    return table.join(F.broadcast(ref), horizon, "left").withColumn("skill", 100 * (1 - F.col(rmse) / F.col("_ref"))).drop("_ref")


def comparison(table: DataFrame, model: str, horizon: str, value: str, horizons: list) -> DataFrame:
    """One row per model with a column ``value_horizon`` for each of the horizons; null where a model has none."""
    cells = [F.max(F.when(F.col(horizon) == h, F.col(value))).alias(f"{value}_{h}") for h in horizons]
    return table.groupBy(model).agg(*cells)


def persistence(frames: DataFrame, t: str, value: str, horizons: int, cadence: int) -> DataFrame:
    """(horizon, t, pred, target): the value at t carried to t + horizon * cadence, where that frame exists."""
    out = frames.select(F.col(t), F.col(value).alias("pred"), F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("horizon"))
    later = frames.select(F.col(t).alias("_t"), F.col(value).alias("target"))
    return out.withColumn("_t", F.col(t) + F.col("horizon") * cadence).join(later, "_t").drop("_t")


def storm_weighted_loss(cells: DataFrame, sample: str, error: Column, weight: str) -> DataFrame:
    """Mean squared error by sample, averaged with the samples' weights."""
    per = cells.groupBy(sample).agg(F.avg(error * error).alias("_mse"), F.max(weight).alias("_w"))
    return per.agg((F.sum(F.col("_w") * F.col("_mse")) / F.sum("_w")).alias("loss"))


def add_baseline(forecast: DataFrame, baseline: DataFrame, t: str, value: str, base: str, shift: Column | int = 0) -> DataFrame:
    """Forecast plus the baseline at t + shift; forecasts without a baseline at that very time fail."""
    keyed = forecast.withColumn("_t", F.col(t) + shift)
    both = keyed.join(baseline.select(F.col(t).alias("_t"), F.col(base).alias("_base")), "_t", "left")
    total = F.when(F.col("_base").isNull(), F.raise_error(F.lit("no baseline at a forecast's time"))).otherwise(F.col(value) + F.col("_base"))
    return both.withColumn("absolute", total).drop("_t", "_base")


def equality_gate(old: DataFrame, new: DataFrame, key: str, value: str, near: float = 1e-9) -> DataFrame:
    """Counts of keys on both sides, on one only, of equal and of nearly equal values."""
    both = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_io")).join(new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_in")), key, "full_outer")
    paired = F.col("_io").isNotNull() & F.col("_in").isNotNull()
    return both.agg(
        F.count_if(paired).alias("both"),
        F.count_if(F.col("_in").isNull()).alias("only_old"),
        F.count_if(F.col("_io").isNull()).alias("only_new"),
        F.count_if(paired & F.col("_o").eqNullSafe(F.col("_n"))).alias("exact"),
        F.count_if(paired & (F.abs(F.col("_o") - F.col("_n")) <= near)).alias("within"),
    )


def partition_fingerprints(df: DataFrame, part: Column, row_key: Column) -> DataFrame:
    """(part, fingerprint) of each partition's rows, whatever their order.

    Row hashes are summed, not listed, so the aggregation is partial before the
    shuffle and no task holds a partition's rows.
    """
    h = F.conv(F.substring(F.sha2(row_key.cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = df.groupBy(part.alias("part")).agg(F.count("*").alias("_n"), F.sum(h).alias("_h"))
    whole = F.concat_ws(":", F.col("_n").cast("string"), F.col("_h").cast("decimal(38,0)").cast("string"))
    return sums.select("part", F.substring(F.sha2(whole, 256), 1, 16).alias("fingerprint"))


def stale_partitions(expected: DataFrame, stored: DataFrame, overwrite: bool = False) -> DataFrame:
    """(part, fingerprint, action): build, rebuild or skip, by whether a stored fingerprint is there and equal."""
    both = expected.join(stored.select("part", F.col("fingerprint").alias("_old")), "part", "left")
    action = (
        F.when(F.lit(overwrite), "rebuild")
        .when(F.col("_old").isNull(), "build")
        .when(F.col("_old") != F.col("fingerprint"), "rebuild")
        .otherwise("skip")
    )
    return both.select("part", "fingerprint", action.alias("action"))


def best_epoch(log: DataFrame, epoch: str, loss: str) -> DataFrame:
    """The epoch of the lowest loss; the earlier of equals."""
    return log.agg(F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.min(loss).alias("best_loss"))


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def windows_long(frames: DataFrame, starts: DataFrame, t: str, value: str, cadence: int, inputs: int, targets: int, moments: DataFrame) -> DataFrame:
    """(start, step, role, value): the frames of each window, normalised, gathered by joins on exact times.

    ``moments`` is one row (n, mean, std); where it has no frames it fails, and so does this.
    """
    steps = starts.select(F.col(t).alias("start"), F.explode(F.sequence(F.lit(0), F.lit(inputs + targets - 1))).alias("step"))
    rows = steps.withColumn(t, F.col("start") + F.col("step") * cadence).join(frames.select(t, value), t)
    one = moments.select(F.when(F.col("n") > 0, F.col("mean")).alias("_mean"), F.col("std").alias("_std"))
    role = F.when(F.col("step") < inputs, "input").otherwise("target").alias("role")
    return rows.join(F.broadcast(one)).select("start", "step", role, normalised(F.col(value), F.col("_mean"), F.col("_std")).alias("value"))  # one row


def normalised(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def denormalised(value: Column, mean: Column, std: Column) -> Column:
    """The inverse of ``normalised``; stored values are single precision, the result is double."""
    return value.cast("double") * std + mean


def map_rmse(cells: DataFrame, by: list[str], sample: str, error: Column) -> DataFrame:
    """Root of the mean over maps of each map's mean squared error."""
    per = cells.groupBy(*by, sample).agg(F.avg(error * error).alias("_mse"))
    return per.groupBy(*by).agg(F.sqrt(F.avg("_mse")).alias("rmse"))


def horizon_rmse(cells: DataFrame, horizon: str, error: Column, weight: Column) -> DataFrame:
    """(horizon, rmse): root of the plain mean of weighted squared errors, with the latitudes' weights; not divided by their sum."""
    return cells.groupBy(horizon).agg(F.sqrt(F.avg(weight * error * error)).alias("rmse"))


def seeded_order(key: str, seed: int) -> Column:
    """Order of a seeded draw: the digest of seed and key, the same on any cluster and in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def subsample(df: DataFrame, key: str, one_in: int, seed: int) -> DataFrame:
    """Exactly max(1, floor(n / one_in)) of the n rows, drawn by ``seeded_order``, ties to the smaller key; keys are distinct.

    The draw is a threshold: counts by the digest's first signs tell the class
    of the last row drawn, and only that class, about n in 4096, is ordered.
    """
    order = df.select(key, seeded_order(key, seed).alias("_o")).withColumn("_c", F.substring("_o", 1, 3))
    classes = order.groupBy("_c").agg(F.count("*").alias("_n"))  # at most 4096 rows
    below = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    total = classes.agg(F.greatest(F.lit(1), F.floor(F.sum("_n") / one_in)).alias("_k"))
    wanted = classes.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0))).join(F.broadcast(total)).select("_c", "_n", (F.col("_k") - F.col("_before")).alias("_left"))
    marked = order.join(F.broadcast(wanted.where("_left > 0")), "_c")
    whole = marked.where("_n <= _left").select(key)
    last = marked.where("_n > _left").withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("_o", key))).where("_r <= _left").select(key)
    return df.join(whole.union(last), key, "left_semi")


def teacher_forcing(epoch: Column, epochs: int) -> Column:
    """Share of steps fed with the truth: falls evenly from 1 to 0, and stays there."""
    return F.greatest(F.lit(0.0), 1 - epoch / epochs)


def mismatches(old: DataFrame, new: DataFrame, key: str, value: str, near: float = 1e-9) -> DataFrame:
    """(key, side, old, new): keys on one side only, and on both with values farther apart than ``near``."""
    both = old.select(key, F.col(value).alias("old"), F.lit(1).alias("_io")).join(new.select(key, F.col(value).alias("new"), F.lit(1).alias("_in")), key, "full_outer")
    apart = ~F.col("old").eqNullSafe(F.col("new")) & ~F.coalesce(F.abs(F.col("old") - F.col("new")) <= near, F.lit(False))
    side = F.when(F.col("_in").isNull(), "only_old").when(F.col("_io").isNull(), "only_new").when(apart, "differs")
    return both.withColumn("side", side).where("side is not null").select(key, "side", "old", "new")


def require_equal(gates: DataFrame) -> None:
    """Fails unless every gate (a row of ``equality_gate``) has equal keys and values on both sides."""
    bad = gates.where("only_old > 0 or only_new > 0 or within < both").count()
    if bad:
        raise ValueError(f"{bad} gates don't hold")


def lineage(parts: DataFrame, *stored: DataFrame) -> DataFrame:
    """(part, fp_0, fp_1, ...): each partition's stored fingerprints, ``unknown`` where there is none."""
    out = parts.select("part").distinct()
    for k, s in enumerate(stored):
        out = out.join(s.select("part", F.col("fingerprint").alias(f"fp_{k}")), "part", "left").withColumn(f"fp_{k}", F.coalesce(f"fp_{k}", F.lit("unknown")))
    return out
