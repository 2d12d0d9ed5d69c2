"""Stage runner: settings, fingerprints decide what is rebuilt, one manifest row per run."""

from __future__ import annotations

import json
import os
import platform
import time
import warnings
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.evaluate import partition_fingerprints, stale_partitions


@dataclass(frozen=True)
class Settings:
    """Run parameters: defaults, then a JSON or YAML file, then the environment; blank values count as unset."""

    root: str = "data"
    cadence_seconds: int = 7200
    inputs: int = 6
    targets: int = 3
    gap_minutes: int = 120
    kp_hours: int = 3
    train_end: int = 2019
    val_end: int = 2022

    @property
    def embargo_seconds(self) -> int:
        return (self.inputs + self.targets) * self.cadence_seconds

    def path(self, layer: str, table: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{table}"

    @classmethod
    def load(cls, file: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "TIDEGRID_", candidates: list[str] | None = None) -> Settings:
        """A file that is named, by argument or by ``<prefix>CONFIG_FILE``, must be there; else the first candidate that is.

        Candidates are ``config.yaml`` and ``config.json`` in the working
        folder. A key that isn't a setting is an error.
        """
        out, env = cls(), os.environ if env is None else env
        named = (file or "").strip() or env.get(f"{prefix}CONFIG_FILE", "").strip()
        if named and not os.path.exists(named):
            raise FileNotFoundError(f"settings were asked for in {named}, which isn't there")
        at = named or next((c for c in (["config.yaml", "config.json"] if candidates is None else candidates) if os.path.exists(c)), None)
        if at:
            given = read_settings(at)
            unknown = set(given) - {x.name for x in fields(cls)}
            if unknown:
                raise ValueError(f"unknown settings: {sorted(unknown)}")
            out = replace(out, **{k: type(getattr(out, k))(v) for k, v in given.items()})
        for x in fields(cls):
            value = env.get(prefix + x.name.upper(), "").strip()
            if value:
                out = replace(out, **{x.name: type(getattr(out, x.name))(value)})
        return out


def read_settings(path: str) -> dict:
    """The mapping in a JSON or YAML file; an empty file is an empty one."""
    with open(path) as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ImportError(f"{path} needs a YAML library; write it as JSON instead") from e
        given = yaml.safe_load(text)
    else:
        given = json.loads(text) if text.strip() else None
    if given is not None and not isinstance(given, dict):
        raise ValueError(f"{path} holds no settings by name")
    return given or {}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def output_summary(spark: SparkSession, paths: list[str]) -> list[dict]:
    """Of each path whether it is there, and how many data files it holds, folders below it included."""
    out = []
    for path in paths:
        there, files = path_exists(spark, path), 0
        if there:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
            while found.hasNext():
                files += not found.next().getPath().getName().startswith(("_", "."))
        out.append({"path": path, "exists": there, "files": files})
    return out


def append_manifest(rows: DataFrame, path: str) -> None:
    """Rows added to a manifest; a manifest is never rewritten."""
    rows.write.mode("append").parquet(path)


def write_index(df: DataFrame, root: str, table: str) -> str:
    """An index table below ``root``, which may be a staging folder; returns its path."""
    path = f"{root.rstrip('/')}/{table}"
    df.write.mode("overwrite").parquet(path)
    return path


def row_content(df: DataFrame) -> Column:
    """All columns of a row as one text, by name: nulls told apart from empty texts, so that any changed value shows."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def run_stage(
    spark: SparkSession,
    name: str,
    source: DataFrame,
    part: str,
    build: Callable[[DataFrame], DataFrame],
    target: str,
    log: str,
    contract: str = "1",
    overwrite: bool = False,
    expected: DataFrame | None = None,
    versions: Mapping[str, str] | None = None,
) -> dict:
    """Build the partitions of ``source`` whose fingerprint isn't the one stored with ``target``; append a manifest row.

    The fingerprint covers all columns of the rows and the contract, unless
    ``expected`` (part, fingerprint) gives it, as contracts.chained does from
    the stages before. ``versions`` go into the manifest row. Failures
    are logged and raised again; a log that can't be written is only warned of.
    Partitions are overwritten one by one (dynamic overwrite).
    """
    started, status, stale = time.time(), "failed", None
    try:
        prints = partition_fingerprints(source, F.col(part), F.concat(F.lit(f"{contract}|"), row_content(source))) if expected is None else expected
        prints = prints.withColumn("part", F.col("part").cast(source.schema[part].dataType))
        stored = spark.read.parquet(f"{target}_fingerprints") if path_exists(spark, f"{target}_fingerprints") else prints.limit(0)
        latest = stored.groupBy("part").agg(F.max_by("fingerprint", "written_at").alias("fingerprint")) if "written_at" in stored.columns else stored
        todo = stale_partitions(prints, latest, overwrite).where("action <> 'skip'")
        stale = sorted(r["part"] for r in todo.select("part").collect())  # one row per partition
        if stale:
            fresh = source.where(F.col(part).isin(stale))
            build(fresh).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(target)
            todo.select("part", "fingerprint").withColumn("written_at", F.lit(started)).write.mode("append").parquet(f"{target}_fingerprints")
        status = "ok"
    finally:
        row = {
            "stage": name,
            "status": status,
            "started": started,
            "seconds": time.time() - started,
            "partitions": json.dumps(stale),
            "spark": spark.version,
            "python": platform.python_version(),
            "timezone": spark.conf.get("spark.sql.session.timeZone"),
            "versions": json.dumps(dict(versions or {}), sort_keys=True),
            "outputs": json.dumps(output_summary(spark, [target])),
        }
        try:
            spark.createDataFrame([row]).coalesce(1).write.mode("append").json(log)
        except Exception as e:
            warnings.warn(f"the run of {name} isn't in the log: {e}", stacklevel=2)
    return row


def metadata(settings: Settings, moments: Mapping[str, object], counts: Mapping[str, int], drivers: list[str] | None = None, lineage: Mapping[str, str] | None = None) -> str:
    """What a reader of the windows needs to know, as JSON with sorted keys.

    ``moments`` is the row that goes with the windows, or the part of it that
    is known; ``lineage`` has the digest of each year's inputs.
    """
    m = dict(moments)
    scale = {
        "map_mean": m.get("mean"),
        "map_std": m.get("std"),
        "driver_mean": list(m.get("channel_mean") or []),
        "driver_std": list(m.get("channel_std") or []),
        "computed_from": "distinct input frames of training windows, each counted once",
        "applied_to": ["inputs", "targets", "drivers"],
    }
    step = settings.cadence_seconds / 3600
    leads = "/".join(f"+{(k + 1) * step:g}" for k in range(settings.targets))
    return json.dumps(
        {
            "settings": asdict(settings),
            "cadence_seconds": settings.cadence_seconds,
            "horizon": {"history": f"{settings.inputs * step:g}h", "lead_times": f"{leads}h", "steps": [f"t+{(k + 1) * step:g}h" for k in range(settings.targets)]},
            "drivers": list(drivers or []),
            "normalization": scale,
            "split_rule": {
                "train_end": settings.train_end,
                "val_end": settings.val_end,
                "assignment": "a window belongs to a split only if all of it does",
                "embargo_steps": settings.inputs + settings.targets,
                "embargo_seconds": settings.embargo_seconds,
            },
            "window_rule": "frames stand exactly one cadence apart; maps and drivers are finite in all of them",
            "splits": dict(counts),
            "embargo_seconds": settings.embargo_seconds,
            "lineage": dict(lineage or {}),
        },
        sort_keys=True,
    )
