"""Spherical-harmonic power of maps on a Gauss-Legendre grid: FFT along longitudes, quadrature along latitudes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def legendre(lmax: int, x: np.ndarray) -> np.ndarray:
    """Orthonormal associated Legendre functions P[l, m, x], by the standard three-term recurrence."""
    p = np.zeros((lmax + 1, lmax + 1, len(x)))
    s = np.sqrt(1 - x * x)
    p[0, 0] = math.sqrt(1 / (4 * math.pi))
    for m in range(1, lmax + 1):
        p[m, m] = -math.sqrt((2 * m + 1) / (2 * m)) * s * p[m - 1, m - 1]
    for m in range(lmax):
        p[m + 1, m] = math.sqrt(2 * m + 3) * x * p[m, m]
        for n in range(m + 2, lmax + 1):
            a = math.sqrt((4 * n * n - 1) / (n * n - m * m))
            b = math.sqrt(((n - 1) ** 2 - m * m) / (4 * (n - 1) ** 2 - 1))
            p[n, m] = a * (x * p[n - 1, m] - b * p[n - 2, m])
    return p


def power(maps: np.ndarray, lmax: int) -> np.ndarray:
    """Power by degree of maps (n, latitudes ascending, longitudes): sums of squared coefficients over all orders."""
    x, w = np.polynomial.legendre.leggauss(maps.shape[1])
    f = np.fft.rfft(maps, axis=2) * (2 * math.pi / maps.shape[2])
    p = legendre(lmax, x)
    out = np.zeros((len(maps), lmax + 1))
    for m in range(min(lmax, f.shape[2] - 1) + 1):
        a = np.einsum("nk,lk,k->nl", f[:, :, m], p[:, m], w)
        out += (1 if m == 0 else 2) * np.abs(a) ** 2
    return out


#: Maps that a worker analyses at a time, whatever the size of the batches that it is handed.
BLOCK = 256


def _whole(part: pa.RecordBatch, cells: int) -> tuple[pa.Array, np.ndarray]:
    """Keys and maps (n, cells) of the rows whose map has that size and no missing cell."""
    sized = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part.column(1)), cells), False))
    flat = sized.column(1).flatten()
    full = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, cells).any(axis=1)
    maps = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, cells)
    return sized.column(0).filter(pa.array(full)), maps[full]


def grid_power(df: DataFrame, key: str, values: str, n_lat: int, n_lon: int, lmax: int) -> DataFrame:
    """(key, l, s_l) of flat maps, in Arrow batches; maps with a missing cell or another size have no power."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                keys, maps = _whole(batch.slice(lo, BLOCK), n_lat * n_lon)
                if len(keys):
                    s = power(maps.reshape(-1, n_lat, n_lon), lmax)
                    rows = pa.array(np.repeat(np.arange(len(keys)), lmax + 1))
                    degrees = pa.array(np.tile(np.arange(lmax + 1, dtype=np.int32), len(keys)))
                    yield pa.record_batch([keys.take(rows), degrees, pa.array(s.ravel())], names=[key, "l", "s_l"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, values).mapInArrow(run, f"{key} {kind}, l int, s_l double")
