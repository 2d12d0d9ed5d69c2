"""Operators on one ordered time line, without pulling it into one task.

A window over all rows would sort the whole series in a single task. Rows are
dealt to time buckets instead; what a bucket needs from before or after it is
one carried row, found from a table with one row per bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket, a day; and of a bucket of decimation, whose distinct seconds bound what its task holds.
BUCKET = 86400
FOLD_BUCKET = 30 * 86400


def with_neighbours(df: DataFrame, t: str, value: str, by: list[str] | None = None, bucket: int = BUCKET, ahead: bool = True) -> DataFrame:
    """Add prev_t, prev_v, next_t, next_v: the nearest known value at or before and at or after each row.

    Both ways the frames start at an edge and grow row by row (the way ahead in
    descending order), so a bucket costs its rows, not their square. Without
    ``ahead``, next_t and next_v are null.
    """
    by = by or []
    known = F.when(F.col(value).isNotNull(), F.col(t))
    df = df.withColumn("_b", F.floor(F.col(t) / bucket))
    grown = (Window.unboundedPreceding, 0)
    back = Window.partitionBy(*by, "_b").orderBy(t).rowsBetween(*grown)
    front = Window.partitionBy(*by, "_b").orderBy(F.desc(t)).rowsBetween(*grown)
    near = df.withColumn("_pt", F.last(known, True).over(back)).withColumn("_pv", F.last(value, True).over(back))
    nothing_t, nothing_v = (F.lit(None).cast(df.schema[c].dataType) for c in (t, value))
    near = near.withColumn("_nt", F.last(known, True).over(front) if ahead else nothing_t)
    near = near.withColumn("_nv", F.last(value, True).over(front) if ahead else nothing_v)
    edges = df.groupBy(*by, "_b").agg(
        F.max(known).alias("lt"), F.max_by(value, known).alias("lv"), F.min(known).alias("ft"), F.min_by(value, known).alias("fv")
    )
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *by,
        "_b",
        F.last("lt", True).over(before).alias("_ct"),
        F.last("lv", True).over(before).alias("_cv"),
        (F.last("ft", True).over(after) if ahead else nothing_t).alias("_dt"),
        (F.last("fv", True).over(after) if ahead else nothing_v).alias("_dv"),
    )
    return (
        near.join(carried, [*by, "_b"])
        .withColumn("prev_t", F.coalesce("_pt", "_ct"))
        .withColumn("prev_v", F.coalesce("_pv", "_cv"))
        .withColumn("next_t", F.coalesce("_nt", "_dt"))
        .withColumn("next_v", F.coalesce("_nv", "_dv"))
        .drop("_b", "_pt", "_pv", "_nt", "_nv", "_ct", "_cv", "_dt", "_dv")
    )


def _linear(t: str) -> Column:
    span = F.col("next_t") - F.col("prev_t")
    return F.when(span == 0, F.col("prev_v")).otherwise(
        F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * (F.col(t) - F.col("prev_t")) / span
    )


def _on_one_line(obs: DataFrame, frames: DataFrame, t: str, value: str, by: list[str]) -> DataFrame:
    rows = obs.select(*by, t, F.col(value).cast("double").alias(value), F.lit(0).alias("is_frame")).unionByName(
        frames.select(*by, t, F.lit(None).cast("double").alias(value), F.lit(1).alias("is_frame"))
    )
    return rows.groupBy(*by, t).agg(F.avg(value).alias(value), F.max("is_frame").alias("is_frame"))


def align_interpolated(
    obs: DataFrame, frames: DataFrame, t: str, value: str, tolerance: int, by: list[str] | None = None, bucket: int = BUCKET
) -> DataFrame:
    """Each frame's value on the line between its neighbours, flat beyond the ends.

    Null where the nearest observation is farther than ``tolerance`` seconds
    (exactly that far stays). ``imputed`` tells that no observation stands at
    the frame itself. Repeated observations count by their mean; repeated
    frames collapse.
    """
    by = by or []
    near = with_neighbours(_on_one_line(obs, frames, t, value, by), t, value, by, bucket).where("is_frame = 1")
    line = F.when(F.col("prev_t").isNull(), F.col("next_v")).when(F.col("next_t").isNull(), F.col("prev_v")).otherwise(_linear(t))
    gap = F.least(F.col(t) - F.col("prev_t"), F.col("next_t") - F.col(t))
    return near.select(*by, t, F.when(gap <= tolerance, line).alias(value), F.coalesce(gap > 0, F.lit(True)).alias("imputed"), gap.alias("gap_s"))


def align_carried(
    obs: DataFrame, frames: DataFrame, t: str, value: str, limit: int, by: list[str] | None = None, bucket: int = BUCKET
) -> DataFrame:
    """Each frame's last value at or before it, null where that is older than ``limit`` seconds."""
    by = by or []
    near = with_neighbours(_on_one_line(obs, frames, t, value, by), t, value, by, bucket, ahead=False).where("is_frame = 1")
    age = F.col(t) - F.col("prev_t")
    return near.select(*by, t, F.when(age <= limit, F.col("prev_v")).alias(value), F.coalesce(age > 0, F.lit(True)).alias("imputed"))


def fill_forward_linear(df: DataFrame, t: str, value: str, bucket: int = BUCKET) -> DataFrame:
    """Missing values on the line between neighbours; a leading gap stays, a trailing one carries the last value."""
    near = with_neighbours(df, t, value, None, bucket)
    line = F.when(F.col("prev_t").isNull(), F.lit(None)).when(F.col("next_t").isNull(), F.col("prev_v")).otherwise(_linear(t))
    return near.withColumn(value, line).drop("prev_t", "prev_v", "next_t", "next_v")


def _exits(t: np.ndarray, cadence: int) -> np.ndarray:
    """For each time, the last time kept if it is kept itself; pointers to the next kept time double in every step."""
    last, step = np.arange(len(t)), np.searchsorted(t, t + cadence)
    while (inside := step < len(t)).any():
        last = np.where(inside, last[np.minimum(step, len(t) - 1)], last)
        step = np.where(inside, step[np.minimum(step, len(t) - 1)], step)
    return t[last]


def decimate(df: DataFrame, t: str, cadence: int, bucket: int = FOLD_BUCKET) -> DataFrame:
    """Keep a row if it stands at least ``cadence`` after the last row kept; rows of one time stay or go together.

    A recurrence over the whole series, folded by buckets: what a bucket keeps
    depends only on its first kept time, which lies in its first cadence (or
    is the first time behind that). Each bucket, on its own, maps every such
    time to the last time it keeps; these small tables, at most one row for
    each second of a cadence and bucket, are chained to find the true entry of
    each bucket; then all buckets are replayed apart. ``t`` holds whole
    seconds. Null times go; an empty table gives an empty result.
    """
    times = df.where(F.col(t).isNotNull()).select(F.col(t).cast("long").alias("_t")).distinct().withColumn("_b", F.floor(F.col("_t") / bucket))

    def maps(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.sort(rows["_t"].to_numpy())
        b = key[0].as_py()
        some = int(np.searchsorted(x, b * bucket + cadence)) + 1
        first, last = x[:some], _exits(x, cadence)[:some]
        # Neighbours that lead to one exit are one row, known by the latest of them.
        ends = np.r_[last[1:] != last[:-1], True]
        return pa.table({"_b": np.full(int(ends.sum()), b), "_first": first[ends], "_last": last[ends]})

    def chain(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_b", "ascending"), ("_first", "ascending")])
        b, first, last = (rows[c].to_numpy() for c in ("_b", "_first", "_last"))
        starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        kept, entries = None, []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
            entry = int(first[lo]) if kept is None else kept + cadence
            # A first kept time is never before the bucket; the earliest entry takes its first row.
            entries.append(entry if kept is not None else int(b[lo]) * bucket)
            at = lo + int(np.searchsorted(first[lo:hi], entries[-1]))
            if at < hi:
                kept = int(last[at])
        return pa.table({"_b": b[starts], "_entry": np.array(entries, dtype=np.int64)})

    def replay(rows: pa.Table) -> pa.Table:
        x = np.sort(rows["_t"].to_numpy())
        step, at, kept = np.searchsorted(x, x + cadence), int(np.searchsorted(x, rows["_entry"][0].as_py())), []
        while at < len(x):
            kept.append(x[at])
            at = int(step[at])
        return pa.table({"_t": np.array(kept, dtype=np.int64)})

    tables = times.groupBy("_b").applyInArrow(maps, "_b long, _first long, _last long")
    entries = tables.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(chain, "_b long, _entry long")
    kept = times.join(entries, "_b").groupBy("_b").applyInArrow(replay, "_t long")
    return df.join(kept, F.col(t) == F.col("_t"), "left_semi")


def window_starts(df: DataFrame, t: str, finite: str, cadence: int, length: int = 9, bucket: int = BUCKET) -> DataFrame:
    """(t, valid, off_cadence, missing, last_t) of every row that ``length - 1`` rows follow.

    Valid: all gaps between the ``length`` rows equal ``cadence`` and all are
    ``finite``. Wrong spacing comes before missing data in the attribution. A
    valid window ends (length - 1) * cadence later, so a bucket needs only the
    rows of that reach from the next one.
    """
    reach = (length - 1) * cadence
    bucket = max(bucket, 4 * reach)
    rows = df.select(t, F.col(finite).cast("int").alias("_ok")).withColumn("_b", F.floor(F.col(t) / bucket))
    tail = rows.where(F.pmod(F.col(t), F.lit(bucket)) <= reach).withColumn("_b", F.col("_b") - 1)
    both = rows.withColumn("_own", F.lit(True)).unionByName(tail.withColumn("_own", F.lit(False)))
    order = Window.partitionBy("_b").orderBy(t)
    ahead = order.rowsBetween(0, length - 1)
    steps = order.rowsBetween(0, length - 2)
    timed = both.withColumn("_g", F.lead(t).over(order) - F.col(t))
    judged = (
        timed.withColumn("_n", F.count("*").over(ahead))
        .withColumn("_paced", (F.min("_g").over(steps) == cadence) & (F.max("_g").over(steps) == cadence))
        .withColumn("_whole", F.sum("_ok").over(ahead) == length)
        .where("_own")
    )
    ends = df.select(F.col(t).alias("_end")).orderBy(F.desc(t)).limit(length)
    last_start = ends.agg(F.when(F.count("*") == length, F.min("_end")).alias("_last"))
    paced = F.coalesce((F.col("_n") == length) & F.col("_paced"), F.lit(False))
    return (
        judged.join(F.broadcast(last_start))  # one row
        .where(F.col(t) <= F.col("_last"))
        .select(
            t,
            (paced & F.col("_whole")).alias("valid"),
            (~paced).alias("off_cadence"),
            (paced & ~F.col("_whole")).alias("missing"),
            F.when(paced, F.col(t) + reach).alias("last_t"),
        )
    )


def split_name(first: Column, last: Column, train_end: int, val_end: int, gap: int) -> Column:
    """train, val or test by both ends of a window, with purge and embargo; null for windows in between."""
    return (
        F.when(last < train_end, "train")
        .when((first >= train_end + gap) & (last < val_end), "val")
        .when(first >= val_end + gap, "test")
    )


def fill_hours(df: DataFrame, day: str, hour: str, value: str) -> DataFrame:
    """Hourly values from two-hourly ones: odd hours are midpoints of known neighbours, hour 23 repeats hour 22."""
    grid = df.select(day).distinct().withColumn(hour, F.explode(F.sequence(F.lit(0), F.lit(23))))
    full = grid.join(df.select(day, hour, value), [day, hour], "left")
    w = Window.partitionBy(day).orderBy(hour)
    middle = (F.lag(value).over(w) + F.lead(value).over(w)) / 2
    filled = F.when(F.col(hour) == 23, F.lag(value).over(w)).when(F.col(hour) % 2 == 1, middle).otherwise(F.col(value))
    return full.withColumn("filled", filled).select(day, hour, F.col("filled").alias(value))


def history_ok(frames: DataFrame, t: str, ok: str, steps: int, cadence: int) -> DataFrame:
    """(t, usable): all ``steps`` frames at t - k * cadence are there and ok. Joined by time, so gaps need no window."""
    past = frames.where(F.col(ok)).select((F.col(t)).alias("_t"))
    wanted = frames.select(t, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_k")).withColumn("_t", F.col(t) - F.col("_k") * cadence)
    counts = wanted.join(past.distinct(), "_t").groupBy(t).agg(F.count("*").alias("_n"))
    return frames.select(t).distinct().join(counts, t, "left").select(t, F.coalesce(F.col("_n") == steps, F.lit(False)).alias("usable"))


def dedupe_epochs(df: DataFrame, t: str, arrival: str) -> DataFrame:
    """Of rows at one time the first to arrive; ties of arrival fall to the other columns."""
    rest = sorted(c for c in df.columns if c not in (t, arrival))
    order = F.struct(arrival, *rest)
    out = df.groupBy(t).agg(F.min_by(F.struct(arrival, *rest), order).alias("_r"))
    return out.select(t, *[F.col("_r")[c].alias(c) for c in (arrival, *rest)])


def repeat_disagreement(df: DataFrame, t: str, arrival: str, value: str) -> DataFrame:
    """How far repeats stand from the row right before them: count, largest and mean difference, mean relative to the kept."""
    w = Window.partitionBy(t).orderBy(arrival)
    pairs = df.withColumn("_k", F.row_number().over(w)).withColumn("_prev", F.lag(value).over(w)).where("_k > 1")
    d = F.abs(F.col(value) - F.col("_prev"))
    return pairs.agg(
        F.count("*").alias("repeats"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), (F.avg(d) / F.avg(F.abs("_prev"))).alias("relative_diff")
    )
