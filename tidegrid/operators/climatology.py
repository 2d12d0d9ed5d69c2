"""Baseline maps from a climatology model, one call per day of frames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import epoch_date, ut_hours
from tidegrid.operators.clean import with_fallback

#: (day of year, hours, latitudes, longitudes, f107) -> hours x latitudes x longitudes
Provider = Callable[[int, np.ndarray, np.ndarray, np.ndarray, float], np.ndarray]


def analytic(doy: int, hours: np.ndarray, lats: np.ndarray, lons: np.ndarray, f107: float) -> np.ndarray:
    """A smooth stand-in for an ionosphere model: it follows the sub-solar point and grows with solar flux."""
    decl = np.radians(-23.44) * np.cos(2 * np.pi * (doy + 10) / 365.25)
    lat, lon = np.radians(lats)[None, :, None], np.radians(lons)[None, None, :]
    hour_angle = np.radians(15.0 * (hours[:, None, None] - 14.0)) + lon
    cos_zenith = np.sin(lat) * np.sin(decl) + np.cos(lat) * np.cos(decl) * np.cos(hour_angle)
    return (4.0 + 0.25 * max(f107, 0.0) * np.clip(cos_zenith, 0.0, None)).astype(np.float32)


def baseline(frames: DataFrame, f107: DataFrame, t: str, lats: list[float], lons: list[float], provider: Provider = analytic) -> DataFrame:
    """(t, iri): a flat map, rows of latitude, for each frame.

    The day's flux, or the day before's where it is missing or not finite; a
    day without either fails. Frames are distinct before the costly call, and one call
    serves all frames of a day.
    """
    flux = f107.select(F.col("day").alias("_day"), "f107")
    keyed = frames.select(F.col(t).cast("long").alias("t")).distinct().withColumn("_day", epoch_date(F.col("t"))).withColumn("ut", ut_hours(F.col("t")))
    ready = with_fallback(keyed, flux, "_day", "f107", what="solar flux").select("_day", "t", "ut", F.dayofyear("_day").alias("doy"), "f107")

    def run(day: pa.Table) -> pa.Table:
        maps = provider(day["doy"][0].as_py(), day["ut"].to_numpy(), np.array(lats), np.array(lons), float(day["f107"][0].as_py()))
        return pa.table({"t": day["t"].combine_chunks(), "iri": pa.array([m.ravel() for m in np.asarray(maps, dtype=np.float32)], pa.list_(pa.float32()))})

    return ready.groupBy("_day").applyInArrow(run, "t long, iri array<float>")
