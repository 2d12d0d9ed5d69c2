"""Stored windows as training batches: a keyed permutation says where each row goes, so nothing is sorted as a whole.

Rows carry a dense position, given once when they are stored. For each epoch a
small network of keyed hashes maps positions one to one onto places; the rows
with the first k places are the epoch's sample, and places divide into batches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import settled

ROUNDS = 6


def with_positions(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """Rows numbered from 0 without a gap, in the order of the columns: ranges are counted, each numbers its own rows.

    The ranges are kept in the checkpoint folder, as their bounds are sampled.
    """
    place = F.spark_partition_id().alias("_range")
    ranged = settled(df.repartitionByRange(*order).select("*", place))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def permuted(position: Column, n: int, epoch: int, seed: int = 0) -> Column:
    """A place from 0 to n - 1 for every position, each once, another order for each epoch and seed.

    A position is a pair of coordinates in a rectangle just above n; rounds
    shift one coordinate by a hash of the other, which can be undone, so no two
    positions meet. What falls outside of n goes through the rounds again.
    """
    if n < 1:
        return F.lit(None).cast("long")
    a = max(1, math.isqrt(n - 1) + 1)
    b = -(-n // a)

    def shifted(x: Column) -> Column:
        left, right = F.pmod(x, F.lit(a)), F.floor(x / a).cast("long")
        for r in range(ROUNDS):
            salt = [F.lit(seed), F.lit(epoch), F.lit(r)]
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, *salt), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, *salt), F.lit(a)), F.lit(a))
        return right * a + left

    # Fewer than ``a`` of the a * b places lie outside; a walk visits each at most once. In large tables one in a is outside.
    again = min(a + 1, 16)
    out = F.aggregate(F.sequence(F.lit(1), F.lit(again)), shifted(position.cast("long")), lambda x, _: F.when(x < n, x).otherwise(shifted(x)))
    return F.when(position.isNull(), None).when(out < n, out).otherwise(F.raise_error(F.lit("a place lies outside")).cast("long"))


def epoch_batches(df: DataFrame, n: int, batch: int, epoch: int, fraction: float = 1.0, seed: int = 0, position: str = "position", shuffle: bool = True) -> DataFrame:
    """The rows of an epoch with ``batch`` and ``place``: max(1, floor(n * fraction)) of them, exactly, in batches of ``batch`` rows.

    ``n`` is the number of rows, whose ``position`` runs from 0. The same rows
    come in the same batches on any cluster. Only the chosen rows move, each
    batch to one task, in the order of places there. No rows: none.
    """
    k = min(n, max(1, math.floor(n * fraction))) if n else 0
    place = permuted(F.col(position), n, epoch, seed) if shuffle else F.col(position).cast("long")
    chosen = df.withColumn("place", place).where(F.col("place") < k)
    return chosen.withColumn("batch", F.floor(F.col("place") / batch).cast("long")).repartition("batch").sortWithinPartitions("batch", "place")
