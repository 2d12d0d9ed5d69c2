"""Maps on grids: regridding by fixed sparse weights, differences, orientation, packing for transport."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def wrap_longitudes(lons: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes from 0 to 360, ascending, each once (the first in source order), and the source index of each."""
    return np.unique(np.mod(lons, 360.0), return_index=True)


def gauss_latitudes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre latitudes, ascending, and their weights, which sum to 1."""
    x, w = np.polynomial.legendre.leggauss(n)
    return np.degrees(np.arcsin(x)), w / w.sum()


def bilinear_weights(src_lats: np.ndarray, src_lons: np.ndarray, tgt_lats: np.ndarray, tgt_lons: np.ndarray) -> list[tuple[int, int, float]]:
    """(target cell, source cell, weight), four corners each, zero weights included; targets outside the latitudes have none.

    Cells count along rows. The source may run either way in latitude and wraps
    in longitude.
    """
    lats = np.argsort(src_lats)
    lons, first = wrap_longitudes(src_lons)
    out = []
    for i, lat in enumerate(tgt_lats):
        if not src_lats.min() <= lat <= src_lats.max():
            continue
        a = int(np.clip(np.searchsorted(src_lats[lats], lat, side="right") - 1, 0, len(lats) - 2))
        v = (lat - src_lats[lats[a]]) / (src_lats[lats[a + 1]] - src_lats[lats[a]])
        for j, lon in enumerate(np.mod(tgt_lons, 360.0)):
            b = int(np.searchsorted(lons, lon, side="right")) - 1
            left, right = (b, b + 1) if 0 <= b < len(lons) - 1 else (len(lons) - 1, 0)
            span = (lons[right] - lons[left]) % 360.0
            u = ((lon - lons[left]) % 360.0) / span
            for row, wr in ((lats[a], 1 - v), (lats[a + 1], v)):
                for col, wc in ((first[left], 1 - u), (first[right], u)):
                    out.append((i * len(tgt_lons) + j, int(row) * len(src_lons) + int(col), float(wr * wc)))
    return out


def regrid(cells: DataFrame, weights: DataFrame, by: list[str], cell: str, value: str) -> DataFrame:
    """Every map on the target grid: joined with the grid's fixed weights and summed; null where a corner is missing.

    ``weights`` (target, source, weight) has the size of a grid, whatever the
    number of maps, and is broadcast.
    """
    w = F.broadcast(weights.toDF("_target", cell, "_w"))
    return cells.join(w, cell).groupBy(*by, F.col("_target").alias("target")).agg(
        F.when(F.count(value) == F.count("*"), F.sum(F.col(value) * F.col("_w"))).alias(value)
    )


def regrid_row(values: Column, weights: list[tuple[int, int, float]], targets: int) -> Column:
    """A flat map on the target grid, by weights that the plan holds as a constant: no join, no exchange, nothing but the row.

    ``weights`` are (target, source, weight). A target without weights, or with
    a missing corner, is null; so is the whole of a null map.
    """
    corners: list[list] = [[] for _ in range(targets)]
    for target, source, weight in weights:
        corners[target].append({"s": source, "w": weight})
    plan = F.from_json(F.lit(json.dumps(corners)), "array<array<struct<s:int,w:double>>>")  # folded into a constant

    def one(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0.0), lambda acc, c: acc + F.get(values, c["s"]).cast("double") * c["w"])
        return F.when(F.size(parts) > 0, total)

    return F.when(values.isNotNull(), F.transform(plan, one))


def pole_weights(weights: list[tuple[int, int, float]], src: tuple[int, int], tgt: tuple[int, int], south_first: bool = True) -> list[tuple[int, int, float]]:
    """``weights``, and for target rows beyond the source's latitudes the mean of the source's edge row on their side.

    ``src`` and ``tgt`` are (latitudes, longitudes); ``south_first`` tells which
    way the source runs; the target's rows run north.
    """
    covered = {t // tgt[1] for t, _, _ in weights}
    first = min(covered, default=0)
    extra = []
    for row in sorted(set(range(tgt[0])) - covered):
        southern = row < first if covered else 2 * row < tgt[0]
        source_row = 0 if southern == south_first else src[0] - 1
        extra += [(row * tgt[1] + j, source_row * src[1] + k, 1.0 / src[1]) for j in range(tgt[1]) for k in range(src[1])]
    return weights + extra


def repeat_differences(maps: DataFrame, t: str, order: str, values: str) -> DataFrame:
    """(dropped, max, mean, relative): how far maps of one time lie from their predecessors in ``order``, cell by cell; one row.

    Only times that repeat move. ``relative`` is the mean difference over the
    mean size of the predecessors. Missing cells of either map don't count.
    Without repeats: 0 and three zeros.
    """
    again = maps.groupBy(t).agg(F.count("*").alias("_n")).where("_n > 1").select(t)
    rows = maps.join(again, t, "left_semi").withColumn("_before", F.lag(values).over(Window.partitionBy(t).orderBy(order)))

    def known(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x)

    both = F.filter(F.arrays_zip(F.col(values).alias("b"), F.col("_before").alias("a")), lambda c: known(c["a"]) & known(c["b"]))
    apart = rows.where(F.col("_before").isNotNull()).select(
        F.transform(both, lambda c: F.abs(c["b"].cast("double") - c["a"].cast("double"))).alias("_d"),
        F.transform(F.filter("_before", known), lambda a: F.abs(a.cast("double"))).alias("_s"),
    )

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)

    sums = apart.select(F.array_max("_d").alias("top"), total("_d").alias("d"), F.size("_d").alias("nd"), total("_s").alias("s"), F.size("_s").alias("ns"))
    mean, scale = F.try_divide(F.sum("d"), F.sum("nd")), F.try_divide(F.sum("s"), F.sum("ns"))
    zero = F.lit(0.0)
    return sums.agg(
        F.count("*").alias("dropped"),
        F.coalesce(F.max("top"), zero).alias("max"),
        F.coalesce(mean, zero).alias("mean"),
        F.coalesce(F.when(scale > 0, mean / scale), zero).alias("relative"),
    )


def with_poles(cells: DataFrame, weights: list[tuple[int, int, float]], by: list[str], cell: str, value: str, src: tuple[int, int], tgt: tuple[int, int], south_first: bool = True) -> DataFrame:
    """``regrid``, where target rows beyond the source's latitudes get the mean of the source's edge row on their side.

    ``src`` and ``tgt`` are (latitudes, longitudes); ``south_first`` tells which
    way the source runs; the target's rows run north.
    """
    return regrid(cells, weight_table(cells.sparkSession, pole_weights(weights, src, tgt, south_first)), by, cell, value)


def back_weights(lats: np.ndarray, lons: np.ndarray, native_lats: np.ndarray, native_lons: np.ndarray) -> list[tuple[int, int, float]]:
    """Bilinear weights from the Gauss-Legendre grid back to a map file's grid; latitudes outside take the nearest row's."""
    inside = np.clip(native_lats, lats.min(), lats.max())
    return bilinear_weights(lats, lons, inside, native_lons)


def checked_grid(lats: list[float], lons: list[float], n_lat: int, n_lon: int) -> tuple[np.ndarray, np.ndarray]:
    """A grid's axes, which must have the sizes that are expected, ascend, and lie on the sphere."""
    a, b = np.asarray(lats, dtype=np.float64), np.asarray(lons, dtype=np.float64)
    if a.shape != (n_lat,) or b.shape != (n_lon,):
        raise ValueError(f"the grid is {a.shape} by {b.shape}, not {n_lat} by {n_lon}")
    if not (np.isfinite(a).all() and np.isfinite(b).all() and (np.diff(a) > 0).all() and (np.diff(b) > 0).all() and np.abs(a).max() <= 90):
        raise ValueError("the grid's axes must ascend, latitudes within 90 degrees")
    return a, b


def weight_table(spark: SparkSession, rows: list[tuple[int, int, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "target int, source int, weight double")


def minus(a: Column, b: Column) -> Column:
    """Cell by cell difference of two maps; null where either is."""
    return F.zip_with(a, b, lambda x, y: x - y)


def oriented(rows: Column, flip: Column) -> Column:
    """Latitude rows turned over where ``flip``."""
    return F.when(flip, F.reverse(rows)).otherwise(rows)


def all_finite(values: Column) -> Column:
    """No nulls, NaN or infinities; null arrays are not finite."""
    return F.coalesce(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def any_missing(values: Column) -> Column:
    return ~all_finite(values)


def residuals(left: DataFrame, right: DataFrame, keys: list[str], value: str, baseline: str) -> DataFrame:
    """Map minus baseline on equal keys; fails when a key stands on one side only, or more often on one side than once."""
    one = [df.groupBy(*keys).agg(F.any_value(c).alias(c), F.count("*").alias(n)) for df, c, n in ((left, value, "_l"), (right, baseline, "_r"))]
    both = one[0].join(one[1], keys, "full_outer")
    one_sided = F.col(value).isNull() | F.col(baseline).isNull()
    repeated = (F.col("_l") > 1) | (F.col("_r") > 1)
    checked = (
        F.when(one_sided, F.raise_error(F.lit("maps and baselines have different epochs")))
        .when(repeated, F.raise_error(F.lit("an epoch stands more than once")))
        .otherwise(minus(F.col(value), F.col(baseline)))
    )
    return both.select(*keys, checked.alias("residual"))


def _half_floats(column: pa.Array, level: int) -> pa.Array:
    import gzip

    def one(x) -> bytes | None:
        return None if x is None or not x.is_valid else gzip.compress(np.asarray(x.values.to_numpy(zero_copy_only=False), dtype="<f2").tobytes(), level, mtime=0)

    return pa.array([one(x) for x in column], pa.binary())


def packed_last(df: DataFrame, out: str = "pack", level: int = 6) -> DataFrame:
    """``df`` with its last column, of arrays, as gzipped half floats named ``out``."""
    names = [*df.columns[:-1], out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:-1], _half_floats(batch.column(batch.num_columns - 1), level)], names=names)

    return df.mapInArrow(run, f"{schema}, `{out}` binary")


def to_float16(df: DataFrame, values: str, out: str = "pack", level: int = 6) -> DataFrame:
    """Add the values as gzipped little-endian half floats, for transport."""

    @F.arrow_udf("binary")
    def pack(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield _half_floats(column, level)

    return df.withColumn(out, pack(F.col(values)))


def from_float16(df: DataFrame, pack: str, out: str = "values") -> DataFrame:
    @F.arrow_udf("array<float>")
    def unpack(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import gzip

        for column in columns:
            yield pa.array(
                [None if x.as_py() is None else np.frombuffer(gzip.decompress(x.as_py()), dtype="<f2").astype("f4") for x in column], pa.list_(pa.float32())
            )

    return df.withColumn(out, unpack(F.col(pack)))


def day_packs(maps: DataFrame, day: str, hour: str, values: str, hours: int = 24) -> DataFrame:
    """(day, pack): gzipped half floats of a day's maps in hour order, only for days whose every hour is there and finite.

    A day is at most ``hours`` maps, whatever the number of days.
    """
    fine = maps.where(all_finite(F.col(values)))
    days = fine.groupBy(day).agg(F.array_sort(F.collect_list(F.struct(hour, values))).alias("_h")).where(F.size("_h") == hours)
    flat = days.select(day, F.flatten(F.transform("_h", lambda h: h[values])).alias("_v"))
    return to_float16(flat, "_v", "pack").select(day, "pack")
