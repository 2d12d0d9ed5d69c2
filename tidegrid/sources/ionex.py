"""Map files in the IONEX 1.0 layout, as a Python data source and as a transformation of texts."""

from __future__ import annotations

import calendar
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidegrid.sources.lzw import to_text

MISSING = 9999
SCHEMA = "epoch_s long, lats array<double>, lons array<double>, grid array<array<double>>"


def _axis(line: str) -> list[float]:
    first, last, step = (float(x) for x in line[:60].split()[:3])
    n = int(round((last - first) / step)) + 1
    return [first + k * step for k in range(n)]


def parse(text: str) -> Iterator[tuple[int, list[float], list[float], list[list[float | None]]]]:
    """(epoch, latitudes, longitudes, rows) of each map; error maps end the reading.

    Labels stand in columns 61 to 80, values use all 80. The missing mark is
    told before the scale, ten to the EXPONENT (-1 where the header has none).
    A band with too few values, and one that isn't there, is null as a whole;
    values and bands beyond the header's grid are passed over. A text without a
    grid in its header is an error, an empty one has no maps.
    """
    exponent, lats, lons = -1, [], []
    epoch, rows, row, band, in_map = None, [], None, -1, False
    if not text.strip():
        return
    for line in text.splitlines():
        label = line[60:80].strip()
        if label == "EXPONENT" and line[:60].strip():
            exponent = int(line[:60].split()[0])
        elif label == "LAT1 / LAT2 / DLAT":
            lats = _axis(line)
        elif label == "LON1 / LON2 / DLON":
            lons = _axis(line)
        elif label == "START OF RMS MAP":
            return
        elif label == "START OF TEC MAP":
            if not lats or not lons:
                raise ValueError("the header has no grid")
            rows, row, band, in_map = [[None] * len(lons) for _ in lats], None, -1, True
        elif not in_map:
            continue
        elif label == "EPOCH OF CURRENT MAP":
            y, mo, d, h, mi, s = (int(x) for x in line[:60].split()[:6])
            epoch = calendar.timegm((y, mo, d, 0, 0, 0)) + h * 3600 + mi * 60 + s
        elif label == "LAT/LON1/LON2/DLON/H":
            row, band = [], band + 1
        elif label == "END OF TEC MAP":
            if epoch is None:
                raise ValueError("a map has no epoch")
            yield epoch, lats, lons, rows
            in_map = False
        elif row is not None and band < len(lats):
            row.extend(int(x) for x in line[:80].split())
            if len(row) >= len(lons):
                scale = 10.0**exponent
                rows[band] = [None if x == MISSING else x * scale for x in row[: len(lons)]]
                row = None


def parse_texts(texts: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per map of a DataFrame of file texts, with the file's columns ``keep``."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))]
        for batch in batches:
            for k, t in enumerate(batch.column(len(keep)).to_pylist()):
                maps = list(parse(t or ""))
                columns = list(zip(*maps, strict=True)) if maps else [[], [], [], []]
                kept = [batch.column(c).take(pa.array([k] * len(maps), pa.int64())) for c in range(len(keep))]
                yield pa.record_batch([*kept, *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]], names=[*keep, "epoch_s", "lats", "lons", "grid"])

    given = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep]
    return texts.select(*keep, text).mapInArrow(run, ", ".join([*given, SCHEMA]))


class _Files(InputPartition):
    def __init__(self, uri: str, paths: list[str]):
        self.uri, self.paths = uri, paths


def _store(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Reader(DataSourceReader):
    def __init__(self, uri: str, split_bytes: int):
        self.uri, self.split_bytes = uri, split_bytes

    def partitions(self) -> list[InputPartition]:
        """The files below the path by name, neighbours together up to so many bytes."""
        from pyarrow import fs

        store, path = _store(self.uri)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        listed = [found] if found.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size or 0) for f in listed if f.is_file and not f.base_name.startswith(("_", ".")))
        out, size = [], 0
        for name, n in files:
            if not out or size + n > self.split_bytes:
                out, size = [*out, _Files(self.uri, [])], 0
            out[-1].paths.append(name)
            size += n
        return out

    def read(self, partition: InputPartition):
        store, _ = _store(partition.uri)
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as f:
                yield from parse(to_text(path, f.read()))


class IonexSource(DataSource):
    """``spark.read.format("ionex").load(folder or file)`` in any store that Arrow's file systems open.

    Files are listed with their sizes and dealt to tasks by ``split_bytes``
    (32 MB). Stores that only Spark reads are ``read_maps``' work.
    """

    @classmethod
    def name(cls) -> str:
        return "ionex"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split_bytes", 32_000_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IonexSource)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """Maps of all files under a path of any store that Spark reads."""
    from tidegrid.sources.lzw import read_texts

    return parse_texts(read_texts(spark, path))
