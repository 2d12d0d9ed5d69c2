"""The batch operators' nearest relatives over streams. Event times become TIMESTAMP first: watermarks refuse naive ones."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.session import settled, shared_folder


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling_means(stream: DataFrame, ts: str, value: str, width: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(t, n, mean): fixed cadence buckets."""
    out = timed(stream, ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.unix_seconds("window.start").alias("t"), "n", "mean")


def gap_runs(stream: DataFrame, ts: str, gap: str = "2 hours", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """(by, start, n): runs of rows without a gap that long."""
    keys = by or []
    out = timed(stream, ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return out.select(*keys, F.unix_seconds("session_window.start").alias("start"), "n")


def first_of_epoch(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Repeats of a key within the watermark dropped."""
    return timed(stream, ts, late).dropDuplicatesWithinWatermark(keys)


def decimated(stream: DataFrame, key: str, t: str, cadence: int) -> DataFrame:
    """Greedy decimation per key, with the last kept time as state; rows of a batch are taken in time order."""

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for x in sorted(v for b in batches for v in b[t].tolist()):
            if last is None or x - last >= cadence:
                kept.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), t: kept})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, {t} long", "last long", "append", GroupStateTimeout.NoTimeout)


def sliding_frames(stream: DataFrame, ts: str, value: str, frames: int = 9, cadence: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(t, n, values): for each frame the ``frames`` cadences that begin with it, as long as all of them have a row.

    ``cadence`` is a number of hours or minutes. Rows of a window in time order.
    """
    count, unit = cadence.split()
    out = timed(stream, ts, late).groupBy(F.window(ts, f"{int(count) * frames} {unit}", cadence)).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.unix_seconds(ts).alias("t"), F.col(value).alias("value")))).alias("_r")
    )
    return out.where(F.col("n") == frames).select(F.unix_seconds("window.start").alias("t"), "n", F.transform("_r", lambda x: x["value"]).alias("values"))


def bounded_staleness(frames: DataFrame, drivers: DataFrame, t: str, value: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """(t, value): of two streams the drivers' latest value at or before each frame, no older than ``limit`` seconds.

    A join of streams by a range of event time, so the state that it keeps is
    bounded by the limit and the lateness; frames without such a value don't
    appear. Both sides meet in buckets of the limit's length: a value serves its
    own bucket and the next.
    """
    a = timed(frames, t, late).select(F.col(t).alias("_t"), F.floor(F.unix_seconds(t) / limit).alias("_b"))
    own = F.floor(F.unix_seconds(t) / limit)
    b = timed(drivers, t, late).select(F.col(t).alias("_d"), F.col(value), F.explode(F.array(own, own + 1)).alias("_b"))
    near = a.join(b, (a["_b"] == b["_b"]) & (F.col("_d") <= F.col("_t")) & (F.col("_d") >= F.col("_t") - F.expr(f"INTERVAL {int(limit)} SECONDS")))
    latest = near.groupBy(F.window("_t", "1 second")).agg(F.max_by(value, F.col("_d")).alias(value))  # frames stand at whole seconds
    return latest.select(F.unix_seconds("window.start").alias(t), value)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of a table's last whole manifest; (0, {}) where there is none."""
    fs, at = _folder(spark, f"{path}/manifests")
    if not fs.exists(at):
        return 0, {}
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    last = max((int(n.removesuffix(".json")) for n in names if re.fullmatch(r"[0-9]+\.json", n)), default=0)
    if not last:
        return 0, {}
    return last, json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifests/{last:09d}.json").collect()))


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """A new manifest, whole or not at all: written beside its place and renamed."""
    fs, part = _folder(spark, f"{path}/manifests/{number:09d}.part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if not fs.rename(part, _folder(spark, f"{path}/manifests/{number:09d}.json")[1]):
        raise FileExistsError(f"another writer published version {number} of {path}")


def upsert(batch: DataFrame, path: str, key: str, rank: str, batch_id: int | None = None, buckets: int = 64, keep: int = 2) -> None:
    """Rows of a micro-batch into the table at ``path``: of each key the row of the highest rank (definitive over preliminary).

    Keys are dealt to a fixed number of buckets. Only buckets that the batch
    touches are read and written anew; a manifest says which version of each
    bucket counts, so a lost executor leaves the table as it was. A batch whose
    number isn't above the last one's is there already and changes nothing.
    Files that none of the last ``keep`` manifests names are removed.
    """
    spark = batch.sparkSession
    number, now = _manifest(spark, path)
    if now and now["buckets"] != buckets:
        raise ValueError(f"{path} has {now['buckets']} buckets, not {buckets}")
    if batch_id is not None and now.get("batch_id") is not None and batch_id <= now["batch_id"]:
        return
    fresh = settled(batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
    versions = dict(now.get("versions", {}))
    if touched:
        old = [f"{path}/data/{versions[str(b)]}/_bucket={b}" for b in touched if str(b) in versions]
        rows = fresh
        if old:
            rows = rows.unionByName(spark.read.option("basePath", f"{path}/data").schema(batch.schema).parquet(*old).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).select(*fresh.columns))
        rest = [c for c in batch.columns if c not in (key, rank)]
        best = rows.groupBy("_bucket", key).agg(F.max_by(F.struct(rank, *rest), F.struct(F.coalesce(rank, F.lit(-1)), *rest)).alias("_r"))
        fields = {key: F.col(key), rank: F.col("_r")[rank]} | {c: F.col("_r")[c] for c in rest}
        version = f"v{number + 1:09d}_{uuid.uuid4().hex[:8]}"
        best.select("_bucket", *[fields[c].alias(c) for c in batch.columns]).write.partitionBy("_bucket").parquet(f"{path}/data/{version}")
        versions |= {str(b): version for b in touched}
    told = now.get("batch_id") if batch_id is None else batch_id
    _publish(spark, path, number + 1, {"buckets": buckets, "versions": versions, "batch_id": told})
    _clean(spark, path, number + 1, keep)


def _clean(spark: SparkSession, path: str, number: int, keep: int) -> None:
    """Remove manifests before the last ``keep``, and bucket versions that none of the kept ones names."""
    fs, at = _folder(spark, f"{path}/manifests")
    used: set[tuple[str, str]] = set()
    for n in range(max(1, number - keep + 1), number + 1):
        if fs.exists(_folder(spark, f"{path}/manifests/{n:09d}.json")[1]):
            used |= {(v, b) for b, v in json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifests/{n:09d}.json").collect()))["versions"].items()}
    for f in fs.listStatus(at):
        if (m := re.fullmatch(r"([0-9]+)\.json", f.getPath().getName())) and int(m[1]) <= number - keep:
            fs.delete(f.getPath(), False)
    data = _folder(spark, f"{path}/data")[1]
    for version in fs.listStatus(data) if fs.exists(data) else []:
        left = 0
        for f in fs.listStatus(version.getPath()):
            if m := re.fullmatch(r"_bucket=([0-9]+)", f.getPath().getName()):
                if (version.getPath().getName(), m[1]) in used:
                    left += 1
                else:
                    fs.delete(f.getPath(), True)
        if not left:
            fs.delete(version.getPath(), True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` as its last manifest has it."""
    _, now = _manifest(spark, path)
    if not now.get("versions"):
        raise FileNotFoundError(f"nothing was upserted at {path}")
    parts = [f"{path}/data/{v}/_bucket={b}" for b, v in sorted(now["versions"].items(), key=lambda x: int(x[0]))]
    return spark.read.parquet(*parts)


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over all that is there and return what it wrote."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, mode: str = "complete", at: str | None = None) -> DataFrame:
    """Drive a stream over all that is there into Parquet; rows never pass the driver.

    A later call with the same folder ``at`` goes on where the last one ended;
    by default each call has a new one in the shared folder. A batch that is
    run again leaves one copy of its rows.
    """
    spark = stream.sparkSession
    path, schema = at or f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}", stream.schema
    whole = mode == "complete"

    def write(df: DataFrame, batch_id: int) -> None:
        # A batch has a folder of its own, which its repetition replaces; a complete result is one batch.
        df.write.mode("overwrite").parquet(f"{path}/out/batch__={0 if whole else batch_id}")

    q = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/log")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    fs, out = _folder(spark, f"{path}/out")
    if not fs.exists(out):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/out").drop("batch__")
