"""Fixed-width-free text tables: five-minute drivers and daily indices, split inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import one_decimal, stamp
from tidegrid.operators.clean import mask_from, mask_negative

# Places of the fields kept, and the fill value from which each is missing.
DRIVER_FIELDS = 49
DRIVERS = {"b_magnitude": (13, 9999.99), "by_gsm": (17, 9999.99), "bz_gsm": (18, 9999.99), "flow_speed": (21, 99999.9), "proton_density": (25, 999.99)}
INDEX_FIELDS = 28
KP_AT, OBSERVED_AT, ADJUSTED_AT, FLAG_AT = 7, 25, 26, 27


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f")).where("f[0] <> ''")


def parse_drivers(lines: DataFrame) -> DataFrame:
    """(t, five drivers) of text lines ``value``; a line without 49 fields fails; blank lines are passed over."""
    f = _fields(lines)
    checked = F.when(F.size("f") == DRIVER_FIELDS, F.col("f")).otherwise(
        F.raise_error(F.concat(F.lit("driver line has another number of fields: "), F.size("f").cast("string")))
    )
    f = f.select(checked.alias("f"))

    def at(k: int) -> Column:
        return F.col("f")[k]

    return f.select(
        stamp(at(0).cast("int"), at(1).cast("int"), at(2).cast("int"), at(3).cast("int")).alias("t"),
        *[mask_from(at(k).cast("double"), fill).alias(name) for name, (k, fill) in DRIVERS.items()],
    )


def parse_indices(lines: DataFrame, check_first: bool = True) -> DataFrame:
    """(date, kp, f107_obs, f107_adj, definitive) of daily lines; comments, blank lines and lines of another width are passed over.

    With ``check_first`` the first data line by position must have 28 fields;
    position is the column ``line`` where there is one.
    """
    f = lines.where(~F.startswith(F.ltrim("value"), F.lit("#")))
    if check_first and "line" in lines.columns:
        first = f.where(F.trim("value") != "").agg(F.min_by("value", "line").alias("value"))
        width = _fields(first).select(F.size("f").alias("n")).first()
        if width and width["n"] != INDEX_FIELDS:
            raise ValueError(f"first index line has {width['n']} fields")
    f = _fields(f).where(F.size("f") == INDEX_FIELDS)

    def at(k: int) -> Column:
        return F.col("f")[k]

    return f.select(
        F.make_date(at(0).cast("int"), at(1).cast("int"), at(2).cast("int")).alias("date"),
        F.transform(F.slice("f", KP_AT + 1, 8), lambda x: mask_negative(x.cast("double"))).alias("kp"),
        mask_negative(at(OBSERVED_AT).cast("double")).alias("f107_obs"),
        mask_negative(at(ADJUSTED_AT).cast("double")).alias("f107_adj"),
        at(FLAG_AT).cast("int").alias("definitive"),
    )


def kp_steps(indices: DataFrame) -> DataFrame:
    """(t, kp): three-hourly values at the start of their window, rounded to one decimal; missing ones dropped."""
    rows = indices.select("date", F.posexplode("kp").alias("pos", "k")).where("k is not null")
    return rows.select((F.unix_date("date").cast("long") * 86400 + F.col("pos") * 10800).alias("t"), one_decimal(F.col("k")).alias("kp"))
