"""What a stage's output depends on besides its rows: constants, versions, and the stages before it."""

from __future__ import annotations

import json
import platform
from dataclasses import asdict, dataclass
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.plans.stages import Settings, path_exists


def dependency_version(name: str) -> str:
    """Installed version of a package; ``absent`` where there is none."""
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return "absent"


def source_revision(folder: str | None = None) -> str:
    """The commit that ``folder`` (by default this package's repository) stands at, or ``unknown``."""
    git = Path(folder or Path(__file__).resolve().parents[2]) / ".git"
    try:
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return head
        loose = git / head[5:]
        if loose.exists():
            return loose.read_text().strip()
        packed = [line.split() for line in (git / "packed-refs").read_text().splitlines()]
        return next((x[0] for x in packed if x[1:] == [head[5:]]), "unknown")
    except OSError:
        return "unknown"


@dataclass(frozen=True)
class Contract:
    """A stage's version, raised by hand when its meaning changes, its constants, and the packages whose output is the data."""

    stage: str
    version: int
    constants: tuple = ()
    packages: tuple[str, ...] = ()

    def text(self) -> str:
        """The same text for the same contract, another for any other: constants keep their order and their kinds."""
        return json.dumps({**asdict(self), "packages": {p: dependency_version(p) for p in self.packages}}, sort_keys=True)


def contracts(settings: Settings, lats: list[float], lons: list[float], drivers: list[str], provider: str = "analytic") -> dict[str, Contract]:
    """Contracts of the stages from maps to windows."""
    grid = (tuple(float(x) for x in lats), tuple(float(x) for x in lons))
    return {
        "interpolate": Contract("interpolate", 1, grid),
        "climatology": Contract("climatology", 1, (provider, *grid), ("numpy",)),
        "residual": Contract("residual", 1),
        "drivers": Contract("drivers", 1, (tuple(drivers), settings.gap_minutes, settings.kp_hours)),
        "windows": Contract("windows", 1, (settings.cadence_seconds, settings.inputs, settings.targets, settings.train_end, settings.val_end)),
    }


def stored_fingerprints(spark: SparkSession, target: str) -> DataFrame:
    """(part, fingerprint): the latest fingerprint of each part of a stage's output; empty where none was stored."""
    path = f"{target}_fingerprints"
    if not path_exists(spark, path):
        return spark.createDataFrame([], "part string, fingerprint string")
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("part").cast("string").alias("part")).agg(F.max_by("fingerprint", "written_at").alias("fingerprint"))


def chained(contract: Contract, upstream: list[DataFrame]) -> DataFrame:
    """(part, fingerprint) of a stage from its contract and the fingerprints of the stages it reads: a change before it shows without reading its rows again.

    Parts are those that any upstream stage has; one that lacks it counts as unknown.
    """
    both = None
    for k, prints in enumerate(upstream):
        one = prints.select(F.col("part").cast("string").alias("part"), F.col("fingerprint").alias(f"_{k}"))
        both = one if both is None else both.join(one, "part", "full_outer")
    if both is None:
        raise ValueError("a chained stage reads at least one other")
    parts = [F.coalesce(F.col(f"_{k}"), F.lit("unknown")) for k in range(len(upstream))]
    whole = F.to_json(F.struct(F.lit(contract.text()).alias("c"), F.array(*parts).alias("u")))
    return both.select("part", F.substring(F.sha2(whole, 256), 1, 16).alias("fingerprint"))


def lineage(spark: SparkSession, targets: list[str]) -> dict[str, str]:
    """Per part one short digest of the named stages' fingerprints, to be stored with what was made of them."""
    prints = chained(Contract("lineage", 1), [stored_fingerprints(spark, t) for t in targets])
    return {r["part"]: r["fingerprint"] for r in prints.orderBy("part").collect()}  # one row a year
