"""Filter interaction audit (operator 12).

Five text filters are judged in every order. Each document's failures are a
mask of five bits; how many documents of a part show which mask is all that
any order needs, so the masks are counted once and all orders are read off the
counters.

Equal texts are found by sorting: rows are dealt by ranges of (fingerprints,
id), sorted by (fingerprints, text, id), and each compared with its
predecessor, whole text with whole text. A group of equal
texts may run over any number of ranges; what a range's first run continues is
learnt from the ends of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import few_or_shuffled, strings, text_blocks, written

LETTERS = "ABCDE"
BIT = {letter: 1 << k for k, letter in enumerate(LETTERS)}


@dataclass(frozen=True)
class Limits:
    """When a text fails: A too few words, B too few distinct ones, C too many capitals, D any of the marks. E: an equal text has a smaller id."""

    least_words: int = 100
    least_distinct_percent: int = 80
    most_capitals_percent: int = 10
    marks: str = "#$%&*|"


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The octets of all texts, and where each text begins and the last one ends."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    octets = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return octets, offsets - offsets[0]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of words and of distinct words between ASCII white space."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    which, distinct = coded.indices.to_numpy().astype(np.int64), strings(coded.dictionary)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    if "" in distinct:  # before, after or between white space
        some = which != distinct.index("")
        which, row = which[some], row[some]
    seen = np.unique(row * max(1, len(distinct)) + which) // max(1, len(distinct))
    return np.bincount(row, minlength=len(texts)), np.bincount(seen, minlength=len(texts))


def failing(texts: pa.Array, limits: Limits = Limits()) -> np.ndarray:
    """Per text the bits of the filters A to D that it fails; ``texts`` holds no nulls."""
    if not len(texts):
        return np.zeros(0, np.int32)
    octets, offsets = _bytes_of(texts)

    def count(table: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(table[octets], dtype=np.int64)][offsets])

    codes = np.arange(256)
    capitals, points = count((codes >= 65) & (codes <= 90)), count((codes & 0xC0) != 0x80)
    marks = count(np.isin(codes, list(limits.marks.encode("ascii"))))
    words, distinct = _words(texts)
    return (
        BIT["A"] * (words < limits.least_words)
        + BIT["B"] * (100 * distinct < limits.least_distinct_percent * words)
        + BIT["C"] * (100 * capitals > limits.most_capitals_percent * points)
        + BIT["D"] * (marks > 0)
    ).astype(np.int32)


_RANGED = "range int, head boolean, id long, part string, mask int, first string, last string, last_id long, single boolean"


class RunsOfEquals:
    """Follows sorted rows batch by batch: which row has an equal text with a smaller id, and whether it is in the range's first run."""

    def __init__(self):
        self.first = self.last = self.least = None
        self.single = True

    def step(self, texts: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        starts = np.ones(n, dtype=bool)
        starts[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if self.first is None:
            self.first = texts[0]
        else:
            starts[0] = not texts[0].equals(self.last)
            self.single &= not starts[0]
        known, value = pc.is_valid(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
        # Ids ascend in a run, nulls last: the first one is the least.
        begin = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
        carried = begin < 0
        least, has = value[np.maximum(begin, 0)], known[np.maximum(begin, 0)]
        if carried.any():
            least = np.where(carried, 0 if self.least is None else self.least, least)
            has = np.where(carried, self.least is not None, has)
        if self.last is None:
            starts[0] = False  # the first run's start is no change
        head = self.single & ~np.maximum.accumulate(starts)
        self.single = bool(head[-1])
        self.last = texts[n - 1]
        self.least = int(least[-1]) if has[-1] else None
        return known & has & (value > least), head


def _ranged(docs: DataFrame, limits: Limits) -> DataFrame:
    """One row per document with its mask as far as its range shows, and one per range with its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, runs = TaskContext.get().partitionId(), RunsOfEquals()
        names = [x.split()[0] for x in _RANGED.split(", ")]
        for part in text_blocks(batches, 1):
            later, head = runs.step(part.column(1), part.column(0))
            n = part.num_rows
            mask = failing(part.column(1), limits) + BIT["E"] * later.astype(np.int32)
            rest = [pa.nulls(n, t) for t in (pa.string(), pa.string(), pa.int64(), pa.bool_())]
            yield pa.record_batch([pa.array(np.full(n, place, np.int32)), pa.array(head), part.column(0), part.column(2), pa.array(mask), *rest], names=names)
        if runs.first is not None:
            none = [pa.nulls(1, t) for t in (pa.bool_(), pa.int64(), pa.string(), pa.int32())]
            ends = [pa.array([str(runs.first)], pa.string()), pa.array([str(runs.last)], pa.string()), pa.array([runs.least], pa.int64()), pa.array([runs.single])]
            yield pa.record_batch([pa.array([place], pa.int32()), *none, *ends], names=names)

    # Bounds of ranges are sampled keys: two fingerprints stand for the text there, so no text goes to the driver.
    prints = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    by_id = F.col("id").asc_nulls_last()
    ranged = docs.select("id", "text", "part").repartitionByRange(*prints, by_id)
    return ranged.sortWithinPartitions(*prints, "text", by_id).mapInArrow(run, _RANGED)


def _carried(ends: DataFrame) -> DataFrame:
    """(range, carried): for each range whose first run began in an earlier one, the least id of that run.

    Texts meet only with their neighbour's; the chain over ranges has one row
    of numbers per range.
    """
    by_place = Window.orderBy("range")
    places = ends.select("range", F.lag("range").over(by_place).alias("before"))
    before = ends.select(F.col("range").alias("before"), F.col("last").alias("last_before"))
    goes_on = (
        places.join(ends.select("range", "first"), "range")
        .join(before, "before")
        .where(F.col("first") == F.col("last_before"))
        .select("range", F.lit(True).alias("goes_on"))
    )
    chain = ends.select("range", "last_id", "single").join(goes_on, "range", "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    # A range that begins a run, and isn't all one continued run, knows the run's least id.
    knows = F.when(~(F.col("single") & F.col("goes_on")), F.struct("last_id"))
    found = F.last(knows, ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    return chain.withColumn("_k", found).where("goes_on").select("range", F.col("_k.last_id").alias("carried"))


def failure_masks(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask) per document, written; bit k of the mask is the k-th filter of ABCDE.

    Null texts are empty, null parts the empty string. A null id fails no E
    and makes no other row fail it; of rows that repeat text and id none
    fails by the others. Other columns don't take part.
    """
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    )
    rows = written(_ranged(plain, limits), "audit_ranged")
    carried = _carried(rows.where("first is not null").select("range", "first", "last", "last_id", "single"))
    masked = rows.where("first is null").join(few_or_shuffled(carried), "range", "left")
    late = F.coalesce(F.col("head") & (F.col("carried") < F.col("id")), F.lit(False))
    return masked.select("id", "part", F.when(late, F.col("mask").bitwiseOR(BIT["E"])).otherwise(F.col("mask")).alias("mask"))


def mask_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counters of documents, of good and of toxic ones.

    ``labels``: doc_id, quality, toxic; a document is good or toxic if any of
    its label rows says so. Counters of disjoint tables add up.
    """
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic")
    )
    every = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    told = masks.join(flags.where("good + toxic > 0"), "id").groupBy("part", "mask")
    told = told.agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return every.union(told).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(counters: DataFrame) -> DataFrame:
    """One row per part, filter order and step, read off the counters; see ``filter_audit``."""
    plan, slot = [], 0
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            plan.append((slot, "".join(order), step, letter, BIT[letter], before))
            before, slot = before | BIT[letter], slot + 1
    steps = counters.sparkSession.createDataFrame(plan, "slot int, filter_order string, step int, letter string, bit int, before int")
    spread = counters.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slot - 1)))).join(F.broadcast(steps), "slot")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(when, what: str = "n"):
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")

    out = spread.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    return out.drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row per part, order of the five filters and step, zeros included; an
    empty table has no parts and gives no rows. Nulls, ties and repeated rows:
    see ``failure_masks``; an id that labels repeat counts once per document.
    """
    return audit(mask_counters(failure_masks(docs, limits, id_col, text, part), labels))
