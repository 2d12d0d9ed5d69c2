"""Sharding by fixed virtual slots and a versioned slot-to-shard map (operator 2).

Records hash into a fixed number of slots. Bytes are aggregated per slot, and
only the slot-to-shard map, whose size is that fixed number, is edited when
shards are rebalanced or added. Law: ``bytes``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import shared_dir, written

#: Virtual slots; fixed for the life of a dataset. The map has this many rows.
SLOTS = 4096
#: Bytes counted for each record besides its text.
RECORD_BYTES = 16
#: Rows from which a slot can be too full for one shard.
LEAST_HOT = 1000


def with_slots(docs: DataFrame, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot) per row.

    ``size`` is the text's UTF-8 bytes plus 16; null text counts as empty. A
    null id hashes by its text's checksum, so many null ids don't meet in one
    slot unless their texts are equal. Rows that repeat share a slot.
    """
    body: Column = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(F.encode(body, "UTF-8"))
    return docs.select(
        F.col(id_col),
        (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(crc)).otherwise(F.xxhash64(id_col)), F.lit(slots)).alias("vslot"),
    )


def slot_loads(placed: DataFrame) -> DataFrame:
    """(vslot, rows, bytes): at most one row per slot, partly summed before the shuffle."""
    return placed.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt to shards in equal ranges, whatever they hold."""
    return [slot * shards // slots for slot in range(slots)]


def rebalance(slot_map: list[int], load: list[int], shards: int) -> list[int]:
    """Edit the map until no move or swap of slots between the fullest and the emptiest shard helps.

    A step moves the slot that comes nearest to half of the gap, or else swaps
    the two slots whose difference does. Works on the fixed number of slots
    only, never on records. Shards without slots (new ones) fill up first.
    """
    out = list(slot_map)
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(out):
        held[shard].add(slot)
    total = [sum(load[s] for s in x) for x in held]
    for _ in range(20 * len(out)):
        order = sorted(range(shards), key=lambda x: (total[x], x))
        lo, hi = order[0], order[-1]
        gap = total[hi] - total[lo]
        best = min(((abs(load[s] - gap / 2), s) for s in held[hi] if 0 < load[s] < gap), default=None)
        if best is not None and (best[0] <= gap / 4 or shards > len(out)):
            moved, back = best[1], None
        else:
            low = sorted((load[s], s) for s in held[lo])
            found = None
            for x in held[hi]:
                for y_load, y in _near(low, load[x] - gap / 2):
                    d = load[x] - y_load
                    if 0 < d < gap and (found is None or (abs(d - gap / 2), x, y) < found):
                        found = (abs(d - gap / 2), x, y)
            if found is not None and (best is None or found[0] < best[0]):
                _, moved, back = found
            elif best is not None:
                moved, back = best[1], None
            else:
                break
        held[hi].discard(moved)
        held[lo].add(moved)
        delta = load[moved]
        out[moved] = lo
        if back is not None:
            held[lo].discard(back)
            held[hi].add(back)
            delta -= load[back]
            out[back] = hi
        total[hi] -= delta
        total[lo] += delta
    return out


def _near(low: list[tuple[int, int]], want: float) -> list[tuple[int, int]]:
    """The two slots of the sorted list whose loads lie next to ``want``."""
    import bisect

    at = bisect.bisect_left(low, (want, -1))
    return low[max(0, at - 1) : at + 1]


def save_map(spark: SparkSession, path: str, version: int, slot_map: list[int]) -> None:
    """Add a version of the map, one row a slot; a stored version is never changed."""
    rows = [(slot, shard) for slot, shard in enumerate(slot_map)]
    spark.createDataFrame(rows, "vslot long, shard int").coalesce(1).write.parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """(version, map) of that or of the last version; (-1, []) where none is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return -1, []
    stored = spark.read.schema("vslot long, shard int, version int").parquet(path)
    last = stored.agg(F.max("version")).first()[0] if version is None else version
    rows = stored.where(F.col("version") == last).orderBy("vslot").collect()  # one row a slot
    if not rows:
        raise ValueError(f"{path} has no version {version}")
    return last, [r["shard"] for r in rows]


def _spread_hot(placed: DataFrame, hot: list[int], id_col: str, slots: int) -> DataFrame:
    """Rows of slots that hold more than a shard's part, dealt to slots by their places; written, as places differ in another run."""
    anew = F.pmod(F.xxhash64(id_col, "text_crc32", F.monotonically_increasing_id()), F.lit(slots))
    return written(placed.withColumn("vslot", F.when(F.col("vslot").isin(hot), anew).otherwise(F.col("vslot"))), "sharding_rows")


def shard(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None
) -> DataFrame:
    """Place every row: (id, size, text_crc32, law, shard, slot, grown_shard, vslot).

    The map starts from the last version stored at ``map_path`` (by default a
    new folder) or from equal ranges; where rebalancing moves a slot, the
    edited map is stored as the next version. A slot that alone holds more than
    a shard's part of bytes or rows (one id or text repeated without end) is
    dealt anew over all slots.

    ``slot`` is the row's place in its shard, gapless from 0: the rows of the
    shard's earlier virtual slots plus the place within its own. No task ever
    holds more than one virtual slot's narrow rows. An empty table gives an
    empty result. Other columns of ``docs`` don't take part.
    """
    spark = docs.sparkSession
    placed = with_slots(docs, id_col, text, slots)

    def loads() -> tuple[list[int], list[int]]:
        rows, load = [0] * slots, [0] * slots
        for r in slot_loads(placed).collect():  # at most `slots` rows
            rows[r["vslot"]], load[r["vslot"]] = r["rows"], r["bytes"]
        return rows, load

    rows, load = loads()
    hot = [k for k in range(slots) if rows[k] > LEAST_HOT and (rows[k] * shards > sum(rows) or load[k] * shards > sum(load))]
    if hot:
        placed = _spread_hot(placed, hot, id_col, slots)
        rows, load = loads()
    path = map_path or f"{shared_dir(spark)}/slot_map_{uuid.uuid4().hex}"
    version, start = load_map(spark, path)
    if version < 0:
        version, start = 0, first_map(shards, slots)
        save_map(spark, path, 0, start)
    if len(start) != slots:
        raise ValueError(f"the stored map has {len(start)} slots, not {slots}")
    edited = rebalance(start, load, shards)
    if edited != start:
        version += 1
        save_map(spark, path, version, edited)
    slot_map = spark.read.schema("vslot long, shard int, version int").parquet(path).where(F.col("version") == version).drop("version")
    before, base = [0] * shards, []
    for slot in range(slots):
        base.append((slot, before[edited[slot]]))
        before[edited[slot]] += rows[slot]
    known = slot_map.join(spark.createDataFrame(base, "vslot long, base long"), "vslot")
    within = F.row_number().over(Window.partitionBy("vslot").orderBy(id_col, "text_crc32"))
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(known), "vslot")  # one row per virtual slot
        .select(
            id_col,
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("within") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "vslot",
        )
    )
