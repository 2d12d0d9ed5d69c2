"""Sentinels, range filters, repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mask_from(x: Column, fill: float) -> Column:
    """Null from the fill value up."""
    return F.when(x < fill, x)


def mask_negative(x: Column) -> Column:
    return F.when(x >= 0, x)


def mask_above(x: Column, limit: float) -> Column:
    """Null above the limit; the limit itself stays."""
    return F.when(x <= limit, x)


def mask_equal_scaled(values: Column, sentinel: int, exponent: int) -> Column:
    """Array of counts to values: the sentinel becomes null before the scale is applied."""
    return F.transform(values, lambda v: F.when(v != sentinel, v * F.lit(10.0**exponent)))


def mean_of_repeats(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key, each value the mean of its known ones."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def last_row_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that stands last in ``order``; partly reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def unresolved(wanted: DataFrame, manifest: DataFrame, key: str = "key") -> DataFrame:
    """Wanted keys without a finished download or a permanent gap in the manifest."""
    from tidegrid.functions.scalars import permanent_gap

    done = F.col("status").isin("present", "downloaded") | permanent_gap(F.col("status"), F.col("reason"))
    return wanted.join(manifest.where(done).select(key), key, "left_anti")


def coverage(manifest: DataFrame, wanted: DataFrame, source: str = "source") -> DataFrame:
    """Per source: present, 404 gaps, other failures in the whole manifest, and how many were wanted."""
    gap = F.col("reason") == "404"
    failed = F.col("status") == "failed"
    counts = manifest.groupBy(source).agg(
        F.count_if(F.col("status").isin("present", "downloaded")).alias("present"),
        F.count_if(failed & gap).alias("gaps_404"),
        F.count_if(failed & ~F.coalesce(gap, F.lit(False))).alias("other_failures"),
    )
    return wanted.groupBy(source).agg(F.count("*").alias("total")).join(counts, source, "left").na.fill(0)


def calendar(spark, start: str, end: str) -> DataFrame:
    """Every day from start to end, both included."""
    return spark.sql(f"SELECT explode(sequence(date '{start}', date '{end}', interval 1 day)) AS day")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, key, expected_filename, status, reason, n_bytes, checked_at, seq) of manifest CSV files with a header.

    ``seq`` is a row's place: files by name, rows in the order of their file,
    so that the last row of a key wins as the file has it.
    """
    schema = "source string, key string, expected_filename string, status string, reason string, n_bytes long, checked_at string"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    # Offsets grow with a row's place in its file; a file is read in as many parts as Spark likes.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias("seq"))


def with_fallback(wanted: DataFrame, daily: DataFrame, day: str, value: str, days: int = 1, what: str | None = None) -> DataFrame:
    """``wanted`` with the day's finite value, else the one of the nearest day before, ``days`` back at most; fails where there is none.

    ``from_previous`` tells a value of another day, ``what`` names the value in
    the error. ``daily`` has one row a day.
    """
    fine = daily.select(F.col(day).alias("_of"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v) and abs(_v) <> double('inf')")
    serves = fine.select("_v", F.explode(F.sequence(F.lit(0), F.lit(days))).alias("_back"), "_of").select(F.date_add("_of", F.col("_back")).alias(day), "_v", "_back")
    best = serves.groupBy(day).agg(F.min_by(F.struct("_v", "_back"), "_back").alias("_b"))
    both = wanted.join(best, day, "left")
    fault = F.raise_error(F.concat(F.lit(f"no {what or 'finite ' + value} for "), F.col(day).cast("string"), F.lit(" or the day before"))).cast("double")
    return both.withColumn(value, F.when(F.col("_b").isNull(), fault).otherwise(F.col("_b._v"))).withColumn("from_previous", F.col("_b._back") > 0).drop("_b")
