"""N-gram Jaccard join by vertical partitioning (operator 10).

Every document is a set of word n-grams, held as 64-bit hashes in one global
order: grams that many documents show late, all others before them. The order
is cut into fragments. The first fragment of a document is its prefix, so long
that two documents over the threshold must share a gram of it. Candidates come
from the prefixes only; overlaps are counted fragment by fragment and summed
per pair, and a pair leaves as soon as one fragment shows more differing grams
than the threshold leaves room for. Where a list of one prefix gram still holds
documents that are not known to be connected, its pairs are compared inside the
task by the parities of many fine fragments, a lower bound of their differing
grams; only pairs that this bound can't refute become rows. Where a
group leaves many of them for each of its documents, its documents become rows
instead: tasks compare their whole sets and hand on a forest of links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import common_from, discard, few_or_shuffled, only_ids, shuffles_freed, strings, text_blocks, tidied, written
from tidegrid.llm.components import connected_components

#: Documents that show a gram in their prefix before it counts as common, and the most grams put last as common.
#: Both move only the order of grams, never the result.
COMMON_FROM = 24
COMMON_MOST = 500_000
#: Bytes of text that a task hashes at a time, and grams that it holds while it counts which of them several documents show.
BLOCK_BYTES = 1_000_000
HELD_GRAMS = 1_000_000
#: Parts of the table of all prefix grams, times the session's shuffle partitions.
PARTS = 3
#: Hubs of each list in a round. Another round follows while one leaves less than this share of the open rows.
HUBS = 4
ROUND_LEAVES = 0.67
MOST_ROUNDS = 8
#: Of the pairs that parities can't refute, all are verified at once when there are fewer than this share of the nodes.
AT_ONCE = 0.25
#: Fragments of the grams after the prefix.
FRAGMENTS = 4
#: Documents of one list block, and their grams; larger groups are compared block against block.
BLOCK_NODES = 512
BLOCK_GRAMS = 4_000_000
#: Pairs that parities can't refute, for each document of a group, beyond which the group's whole sets are compared inside a task.
DENSE = 2
#: Cells of the pair tables, pairs, and 8-byte words of parities that a task holds at a time.
CELLS, PAIRS, WORDS = 2_000_000, 250_000, 500_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class GramHasher:
    """Distinct n-gram hashes of texts: A-Z lowered, words between ASCII white space."""

    def __init__(self, n: int):
        self.n = n

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and each text's number of words."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = split.flatten().dictionary_encode()
        distinct = strings(coded.dictionary)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
        which = coded.indices.to_numpy()
        counts = pc.list_value_length(split).to_numpy()
        if "" in distinct:  # before, after or between white space
            some = which != distinct.index("")
            before = np.r_[0, np.cumsum(some)]
            ends = np.cumsum(counts)
            counts = before[ends] - before[ends - counts]
            which = which[some]
        return hashes[which], counts.astype(np.int64)

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat sorted distinct hashes (int64) of each text, and the offsets between texts.

        Fewer than n words: one gram of all of them. No words: none.
        """
        h, counts = self._words(texts)
        ends = np.cumsum(counts)
        width = np.minimum(counts, self.n)
        sizes = np.where(counts > 0, counts - width + 1, 0)
        offsets = np.r_[0, np.cumsum(sizes)]
        out = np.empty(int(offsets[-1]), dtype=np.uint64)
        for w in np.unique(width[width > 0]).tolist():
            mine = np.flatnonzero(width == w)
            if w == self.n:
                acc = np.full(max(0, len(h) - w + 1), w, dtype=np.uint64)
                for k in range(w):
                    acc = _mix(acc * _M1 + h[k : len(h) - w + 1 + k])
                at = np.repeat((ends - counts)[mine], sizes[mine]) + _steps(sizes[mine])
                out[np.repeat(offsets[:-1][mine], sizes[mine]) + _steps(sizes[mine])] = acc[at]
            else:
                acc = np.full(len(mine), w, dtype=np.uint64)
                for k in range(w):
                    acc = _mix(acc * _M1 + h[(ends - counts)[mine] + k])
                out[offsets[:-1][mine]] = acc
        flat = out.view(np.int64)
        cuts = offsets.tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            flat[a:b].sort()
        fresh = np.ones(len(flat), dtype=bool)
        fresh[1:] = flat[1:] != flat[:-1]
        fresh[offsets[:-1][sizes > 0]] = True
        return flat[fresh], np.r_[0, np.cumsum(fresh)][offsets]

    def grams(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of one text."""
        return self.sets(pa.array([text], pa.string()))[0]


def prefix_size(n, num: int, den: int):
    """Grams of an n-gram set that may be left out before it could no longer reach num/den, plus one."""
    return np.where(np.asarray(n) > 0, n - -(-num * np.asarray(n) // den) + 1, 0)


class GramOrder:
    """The global order: rare grams by hash, then common ones by hash."""

    def __init__(self, common: np.ndarray):
        self.common = common
        self.may = np.zeros(1 << 22, dtype=bool)
        self.may[self._slot(common)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams.view(np.uint64) >> np.uint64(42)).astype(np.int64)

    def arrange(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets in this order, and how many grams of each are rare."""
        sizes = np.diff(offsets)
        late = np.zeros(len(flat), dtype=bool)
        if len(self.common):
            at = np.flatnonzero(self.may[self._slot(flat)])
            found = np.minimum(np.searchsorted(self.common, flat[at]), len(self.common) - 1)
            late[at] = self.common[found] == flat[at]
        rare = np.r_[0, np.cumsum(~late)]
        n_rare = np.diff(rare[offsets])
        begin = np.repeat(offsets[:-1], sizes)
        rank = rare[:-1] - np.repeat(rare[offsets[:-1]], sizes)  # rare grams of the set before this one
        place = begin + np.where(late, np.repeat(n_rare, sizes) + (np.arange(len(flat)) - begin - rank), rank)
        out = np.empty_like(flat)
        out[place] = flat
        return out, n_rare


def parity_words(size: np.ndarray) -> np.ndarray:
    """Words of 64 fine fragments for sets of these sizes: 16 fragments a gram up to 4096, at least 2 a gram beyond."""
    n = np.maximum(np.maximum(2 * size, np.minimum(16 * size, 4096)), 128)
    return (1 << np.ceil(np.log2(n)).astype(np.int64)) >> 6


def parities(grams: np.ndarray, words: int) -> np.ndarray:
    """One bit for each fine fragment of the order of hashes: whether an odd number of the set's grams falls into it.

    Two sets differ in at least as many grams as in bits. XOR of neighbouring
    words gives the parities of half as many fragments.
    """
    u = grams.view(np.uint64) ^ np.uint64(1 << 63)
    word = (u >> np.uint64(65 - int(words).bit_length())).astype(np.int64)
    out = np.zeros(words, dtype="<u8")
    if len(u):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.bitwise_xor.reduceat(np.uint64(1) << (u & np.uint64(63)), first)
    return out


def _digests(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two hashes of each whole set."""
    raw, cuts = memoryview(flat).cast("B"), (8 * offsets).tolist()
    made = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    return np.frombuffer(made, dtype="<i8").reshape(-1, 2)


def _first_of(flat: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """The first grams of each set."""
    at = np.repeat(offsets[:-1], counts) + _steps(counts)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat[at]))


def gram_sets(docs: DataFrame, n: int, num: int, den: int, id_col: str, text: str) -> DataFrame:
    """(id, size, h1, h2, prefix, counts): one row per document; h1 and h2 are hashes of the whole set.

    ``prefix`` holds the first grams by hash. Rows of size -1 come between:
    grams that several documents of one task show, and their ``counts``.
    """
    names = ["id", "size", "h1", "h2", "prefix", "counts"]

    def shown(held: list[np.ndarray]) -> pa.RecordBatch:
        g, c = np.unique(np.concatenate(held), return_counts=True)
        g, c = g[c > 1], c[c > 1].astype(np.int32)
        ends = pa.array([0, len(g)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(g)), pa.ListArray.from_arrays(ends, pa.array(c))]
        return pa.record_batch([pa.array([None], pa.int64()), *[pa.array([x], pa.int64()) for x in (-1, 0, 0)], *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, many = GramHasher(n), [], 0
        for part in text_blocks(batches, 1, BLOCK_BYTES):
            flat, offsets = hasher.sets(part.column(1))
            size, digest = np.diff(offsets), _digests(flat, offsets)
            out = [part.column(0).cast(pa.int64()), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
            out += [_first_of(flat, offsets, prefix_size(size, num, den)), pa.nulls(len(size), pa.list_(pa.int32()))]
            yield pa.record_batch(out, names=names)
            held.append(flat)
            many += len(flat)
            if many > HELD_GRAMS:
                yield shown(held)
                held, many = [], 0
        if held:
            yield shown(held)

    schema = "id long, size long, h1 long, h2 long, prefix array<long>, counts array<int>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(tidied(run), schema)


def ordered_sets(docs: DataFrame, n: int, num: int, den: int, id_col: str, text: str, common: np.ndarray) -> DataFrame:
    """(id, size, h1, h2, prefix, rare, bits): prefixes in the global order, of which ``rare`` grams are not common, and parities."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, order = GramHasher(n), GramOrder(shared.value)
        for part in text_blocks(batches, 1, BLOCK_BYTES):
            flat, offsets = hasher.sets(part.column(1))
            size, digest = np.diff(offsets), _digests(flat, offsets)
            cuts, words = offsets.tolist(), parity_words(size)
            bits = [parities(flat[a:b], w).tobytes() for a, b, w in zip(cuts, cuts[1:], words.tolist(), strict=False)]
            k = prefix_size(size, num, den)
            placed, rare = order.arrange(flat, offsets)
            yield pa.record_batch(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array(size),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    _first_of(placed, offsets, k),
                    pa.array(np.minimum(k, rare).astype(np.int32)),
                    pa.array(bits, pa.binary()),
                ],
                names=["id", "size", "h1", "h2", "prefix", "rare", "bits"],
            )

    schema = "id long, size long, h1 long, h2 long, prefix array<long>, rare int, bits binary"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(tidied(run), schema)


def fragments(docs: DataFrame, n: int, text: str, common: np.ndarray) -> DataFrame:
    """(h1, h2, fragment, grams): each set cut by the global order; fragment -1 holds common grams, the rest hash ranges."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, order = GramHasher(n), GramOrder(shared.value)
        edges = np.linspace(-(2.0**63), 2.0**63, FRAGMENTS + 1)[1:-1].astype(np.int64)
        for part in text_blocks(batches, 0, BLOCK_BYTES):
            flat, offsets = hasher.sets(part.column(0))
            digest = np.repeat(_digests(flat, offsets), FRAGMENTS + 1, axis=0)
            placed, rare = order.arrange(flat, offsets)
            cuts = [np.r_[a, a + np.searchsorted(placed[a : a + r], edges), a + r] for a, r in zip(offsets[:-1].tolist(), rare.tolist(), strict=True)]
            ends = np.r_[np.concatenate(cuts) if cuts else np.zeros(0, np.int64), len(placed)].astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array(np.ascontiguousarray(digest[:, 0])),
                    pa.array(np.ascontiguousarray(digest[:, 1])),
                    pa.array(np.tile(np.r_[np.arange(FRAGMENTS), -1].astype(np.int32), len(rare))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(placed)),
                ],
                names=["h1", "h2", "fragment", "grams"],
            )

    return docs.select(F.col(text).alias("text")).mapInArrow(tidied(run), "h1 long, h2 long, fragment int, grams array<long>")


def whole_sets(docs: DataFrame, n: int, text: str) -> DataFrame:
    """(h1, h2, grams): each set's grams in the order of hashes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = GramHasher(n)
        for part in text_blocks(batches, 0, BLOCK_BYTES):
            flat, offsets = hasher.sets(part.column(0))
            digest, raw, cuts = _digests(flat, offsets), memoryview(flat).cast("B"), (8 * offsets).tolist()
            grams = pa.array([bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
            yield pa.record_batch([*(pa.array(np.ascontiguousarray(digest[:, k])) for k in (0, 1)), grams], names=["h1", "h2", "grams"])

    return docs.select(F.col(text).alias("text")).mapInArrow(tidied(run), "h1 long, h2 long, grams binary")


def _least_overlap(size_a: Column, size_b: Column, num: int, den: int) -> Column:
    """Grams that two sets of these sizes share at least when they reach num/den."""
    return F.floor(((size_a + size_b) * num + (num + den - 1)) / F.lit(num + den)).cast("long")


def _room(size_a: Column, size_b: Column, num: int, den: int) -> Column:
    """Differing grams that two sets of these sizes may have at most: (a+b) - 2 * least overlap."""
    return size_a + size_b - 2 * _least_overlap(size_a, size_b, num, den)


def _may_link(size_a: Column, at_a: Column, size_b: Column, at_b: Column, num: int, den: int) -> Column:
    """Whether a gram at these places (from 0) of two ordered sets can be the first one that linked sets share.

    Linked sets share one so early that, on both sides, no more grams stand
    before it than may differ.
    """
    least = _least_overlap(size_a, size_b, num, den)
    return (at_a <= size_a - least) & (at_b <= size_b - least)


def _linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int, common: np.ndarray, id_col: str, text: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold, by partial overlaps.

    First fragment: the prefixes. Where both run up to the lower of their last
    grams, every gram that only one shows is a difference; too many of them end
    the pair. The remaining fragments are counted for the survivors.
    """
    # Only the sets that stand in a pair move.
    ends = few_or_shuffled(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    sides = reps.select("node", "size", "prefix", "rare").join(ends, "node", "left_semi")
    first = (
        pairs.join(sides.toDF("a", "size_a", "pre_a", "rare_a"), "a")
        .join(sides.toDF("b", "size_b", "pre_b", "rare_b"), "b")
        .where(F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num)
    )

    # Rare grams of a prefix are in hash order, so both prefixes are whole up to the lower of the last rare ones.
    def last(p: str, k: str) -> Column:
        # A prefix that runs into the common grams shows all of its rare ones.
        return F.when(F.col(k) < F.size(p), F.lit(2**63 - 1)).otherwise(F.element_at(p, F.col(k)))

    first = first.withColumn("upto", F.least(last("pre_a", "rare_a"), last("pre_b", "rare_b")))
    for p, k in (("pre_a", "rare_a"), ("pre_b", "rare_b")):
        first = first.withColumn(p, F.filter(F.slice(F.col(p), F.lit(1), F.col(k)), lambda g: g <= F.col("upto")))
    differing = F.size("pre_a") + F.size("pre_b") - 2 * F.size(F.array_intersect("pre_a", "pre_b"))
    left = written(
        first.where(differing <= _room(F.col("size_a"), F.col("size_b"), num, den)).select("a", "b", "size_a", "size_b"), "jaccard_pairs"
    )
    sides = left.select(F.col("a").alias("node"), "*").union(left.select(F.col("b").alias("node"), "*"))
    need = written(reps.select("node", "id", "h1", "h2").join(sides.select("node").distinct(), "node", "left_semi"), "jaccard_need")
    ids = need.select(F.col("id").alias(id_col)).distinct()
    # A repeated row repeats its fragments; its pairs count each fragment once.
    parts = fragments(only_ids(docs, ids, id_col), n, text, common).join(need, ["h1", "h2"]).select("node", "fragment", "grams")
    overlap = (
        few_or_shuffled(sides)
        .join(parts, "node")
        .groupBy("a", "b", "size_a", "size_b", "fragment")
        .agg(F.max_by("grams", F.col("node") == F.col("a")).alias("of_a"), F.max_by("grams", F.col("node") == F.col("b")).alias("of_b"))
        .groupBy("a", "b", "size_a", "size_b")
        .agg(F.sum(F.size(F.array_intersect("of_a", "of_b"))).alias("overlap"))
    )
    return overlap.where(F.col("overlap") * den >= (F.col("size_a") + F.col("size_b") - F.col("overlap")) * num).select("a", "b")


def _open_lists(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of the lists that still hold several components, with each row's component and each list's anchor, one of its nodes."""
    known = lists.select("gram", "at", "node", "size").join(comps.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    seen = known.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("node", F.xxhash64("node")).alias("anchor"))
    return known.join(seen.where("lo < hi").select("gram", "anchor"), "gram").select("gram", "at", "node", "size", "comp", "anchor")


def _hub_pairs(lists: DataFrame, hubs: int, seed: int, num: int, den: int) -> DataFrame:
    """In each list, every document outside of a hub's component with that hub; hubs are the least by hash."""
    picks = [F.min_by(F.struct("node", "size", "comp", "at"), F.xxhash64("node", F.lit(seed + k))).alias(f"h{k}") for k in range(hubs)]
    chosen = lists.groupBy("gram").agg(*picks).select("gram", F.array_distinct(F.array(*[f"h{k}" for k in range(hubs)])).alias("hubs"))
    out = lists.join(chosen, "gram").select("node", "size", "comp", "at", F.explode("hubs").alias("h"))
    fits = _may_link(F.col("size"), F.col("at"), F.col("h.size"), F.col("h.at"), num, den)
    return (
        out.where(fits & (F.col("h.comp") != F.col("comp")))
        .select(F.least("h.node", "node").alias("a"), F.greatest("h.node", "node").alias("b"))
        .distinct()
    )


class BlockPairs:
    """Pairs across components that lists of whole blocks may still link; each list is compared in one task, no pair becomes a row before."""

    def __init__(self, block: pa.Table, num: int, den: int):
        self.num, self.den = num, den
        get = {c: block[c].combine_chunks() for c in ("lists", "bits")}
        self.node, self.size, self.comp, self.part, lo, hi, anchor = (
            block[c].to_numpy() for c in ("node", "size", "comp", "part", "lo", "hi", "anchor")
        )
        self.across, self.block = lo != hi, block
        # The groups follow each other; their pairs are cells of one flat table.
        first = _starts(block)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, block.num_rows]))
        members = np.bincount(group)
        self.members, self.inside = members[group], np.arange(len(group)) - first[group]
        self.base = np.r_[0, np.cumsum(members * members)]
        self.group = group
        entries = get["lists"].flatten()
        row = np.repeat(np.arange(len(group)), pc.list_value_length(get["lists"]).to_numpy())
        gram, at = entries.field("gram").to_numpy(), entries.field("at").to_numpy()
        order = np.lexsort((gram, group[row]))
        self.row, self.at = row[order], at[order].astype(np.int64)
        fresh = np.r_[True, (gram[order][1:] != gram[order][:-1]) | (group[self.row][1:] != group[self.row][:-1])]
        ends = np.r_[np.flatnonzero(fresh)[1:], len(fresh)]
        self.later = ends[np.cumsum(fresh) - 1] - np.arange(len(fresh)) - 1  # entries of the same list behind each
        self.bits = get["bits"]

    def _least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((self.size[a] + self.size[b]) * self.num + self.num + self.den - 1) // (self.num + self.den)

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of pairs that a list's places allow, each pair of a group once."""
        cells = np.zeros(int(self.base[-1]), dtype=bool)
        laid, lo = np.r_[0, np.cumsum(self.later)], 0
        while lo < len(self.row):
            hi = max(lo + 1, int(np.searchsorted(laid, laid[lo] + PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(lo, hi), self.later[lo:hi])
            j = i + _steps(self.later[lo:hi]) + 1
            a, b = self.row[i], self.row[j]
            least = self._least(a, b)
            fits = (self.comp[a] != self.comp[b]) & (self.at[i] <= self.size[a] - least) & (self.at[j] <= self.size[b] - least)
            fits &= ~self.across[a] | (self.part[a] != self.part[b])
            a, b = np.minimum(a, b)[fits], np.maximum(a, b)[fits]
            cells[self.base[self.group[a]] + self.inside[a] * self.members[a] + self.inside[b]] = True
            lo = hi
        at = np.flatnonzero(cells)
        group = np.searchsorted(self.base, at, side="right") - 1
        members = np.bincount(self.group)
        begin = np.cumsum(members) - members
        a, b = np.divmod(at - self.base[group], members[group])
        return begin[group] + a, begin[group] + b

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the pairs that parities can't refute, and in how many parities they differ."""
        a, b = self.candidates()
        words = parity_words(self.size)
        common, differ = np.minimum(words[a], words[b]), np.zeros(len(a), dtype=np.int64)
        flat = np.frombuffer(self.bits.buffers()[2], dtype="<u8") if len(a) else np.zeros(0, "<u8")
        begin = np.frombuffer(self.bits.buffers()[1], dtype=np.int32)[self.bits.offset :] // 8
        for w in np.unique(common).tolist():
            table, place = [], np.full(len(self.size), -1, dtype=np.int64)
            mine = np.flatnonzero(common == w)
            used = np.unique(np.r_[a[mine], b[mine]])
            for own in np.unique(words[used]).tolist():
                rows = used[words[used] == own]
                bits = flat[begin[rows][:, None] + np.arange(own)]
                while bits.shape[1] > w:
                    bits = bits[:, 0::2] ^ bits[:, 1::2]
                place[rows] = sum(map(len, table)) + np.arange(len(rows))
                table.append(bits)
            bits = np.concatenate(table)
            for k in range(0, len(mine), max(1, WORDS // w)):
                at = mine[k : k + max(1, WORDS // w)]
                differ[at] = np.bitwise_count(bits[place[a[at]]] ^ bits[place[b[at]]]).sum(axis=1, dtype=np.int64)
        keep = differ <= self.size[a] + self.size[b] - 2 * self._least(a, b)
        return a[keep], b[keep], differ[keep]

    def found(self) -> pa.Table:
        """These pairs as rows, or the documents in them, of groups that leave more than ``DENSE`` pairs for each of theirs."""
        a, b, differ = self.pairs()
        group = self.group[a]
        dense = (np.bincount(group, minlength=len(self.base) - 1) > DENSE * np.bincount(self.group))[group]
        ends = np.sort(self.node[np.stack([a, b])[:, ~dense]], axis=0)
        pairs = pa.table({"a": ends[0], "b": ends[1], "differ": differ[~dense]})
        held = self.block.select(GROUPED).take(pa.array(np.unique(np.r_[a[dense], b[dense]])))
        return pa.concat_tables([pairs, held], promote_options="default")


#: What a document's row says of its group.
GROUPED = ["anchor", "lo", "hi", "part", "node", "size", "comp"]


def _starts(rows: pa.Table) -> np.ndarray:
    """Where the groups of rows with one (anchor, lo, hi) begin."""
    keys = [rows[c].to_numpy() for c in ("anchor", "lo", "hi")]
    fresh = np.ones(rows.num_rows, dtype=bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def _by_groups(rows: DataFrame, each: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``each`` on the rows dealt by (anchor, lo, hi): on whole groups, with few cells of pairs at a time."""

    def out(t: pa.Table, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells, lo = np.r_[0, np.cumsum(np.diff(np.r_[begin, t.num_rows]) ** 2)], 0
        while lo < len(begin):
            hi = max(lo + 1, int(np.searchsorted(cells, cells[lo] + CELLS, side="right")) - 1)
            end = begin[hi] if hi < len(begin) else t.num_rows
            yield from each(t.slice(begin[lo], end - begin[lo]).combine_chunks()).to_batches()
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
                begin = _starts(held)
                if len(begin) > 1:  # the last group may go on in the next batch
                    yield from out(held.slice(0, begin[-1]), begin[:-1])
                    held = held.slice(begin[-1])
        if held is not None and held.num_rows:
            yield from out(held, _starts(held))

    return rows.repartition("anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi").mapInArrow(tidied(run), schema)


def _block_pairs(lists: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, differ): pairs across components that the open lists may still link, by at least how many grams they differ.

    Between them stand the documents of dense groups, as rows of ``GROUPED``
    without a pair. Lists with one anchor go to one task, where each of their documents comes
    once. Larger groups are dealt in blocks, by classes of sizes first: sets
    that link are of one class or of neighbouring ones, so only blocks of such
    classes meet, each pair of blocks in a task of its own.
    """
    rows = lists.groupBy("anchor", "node", "size", "comp").agg(F.collect_list(F.struct("gram", "at")).alias("lists"))
    # A class is a little wider than the ratio of sizes that a link allows.
    klass = F.floor(F.log("size") / (math.log(den / num) * (1 + 1e-6))).cast("int") if num < den else F.col("size").cast("int")
    rows = rows.withColumn("klass", klass)
    rows = written(rows.join(reps.select("node", "bits"), "node"), "jaccard_anchored")
    counts = rows.groupBy("anchor", "klass").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    groups = counts.groupBy("anchor").agg(F.sum("n").alias("all"), F.sum("grams").alias("of_all"))
    counts = counts.join(groups.where((F.col("all") > BLOCK_NODES) | (F.col("of_all") > BLOCK_GRAMS)).select("anchor"), "anchor")
    many = F.ceil(F.greatest(F.col("n") / BLOCK_NODES, F.col("grams") / BLOCK_GRAMS)).cast("int")
    blocks = written(counts.select("anchor", "klass", many.alias("blocks")), "jaccard_blocks")
    # A block's name is its class and its number in it; a row goes to every pair of blocks that holds its own.
    near = blocks.select("anchor", F.col("klass").alias("beside"), F.col("blocks").alias("many"))
    pairs = blocks.join(near, "anchor").where(F.abs(F.col("klass") - F.col("beside")) <= 1).select("anchor", "klass", "blocks", "beside", "many")
    own = F.struct("klass", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int").alias("k"))
    split = rows.join(few_or_shuffled(pairs), ["anchor", "klass"], "left").withColumn("own", own)
    every = F.sequence(F.lit(0), F.coalesce("many", F.lit(1)) - 1)
    other = F.transform(every, lambda k: F.struct(F.col("beside").alias("klass"), k.alias("k")))
    # A group in one piece is one block, whatever its classes.
    whole = F.struct(F.lit(0).alias("klass"), F.lit(0).alias("k"))
    split = split.withColumn("own", F.when(F.col("beside").isNull(), whole).otherwise(F.col("own")))
    split = split.withColumn("other", F.explode(F.when(F.col("beside").isNull(), F.array(whole)).otherwise(other)))

    def named(c: Column) -> Column:
        return c["klass"].cast("long") * 2**31 + c["k"]

    own, other = named(F.col("own")), named(F.col("other"))
    dealt = split.select("anchor", F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), own.alias("part"), "node", "size", "comp", "lists", "bits")
    schema = "a long, b long, differ long, " + ", ".join(f"{c} long" for c in GROUPED)
    return _by_groups(dealt, lambda t: BlockPairs(t, num, den).found(), schema)


def _forest(group: pa.Table, num: int, den: int) -> pa.Table:
    """(a, b): links across components in one group, by whole sets; none that the ones before it make superfluous."""
    lo, hi, part, node, size, comp = (group[c].to_numpy() for c in ("lo", "hi", "part", "node", "size", "comp"))
    sets = [np.frombuffer(x.as_buffer(), dtype="<i8") for x in group["grams"].combine_chunks()]
    # More parities than a set needs only sharpen the bound.
    words = int(parity_words(size).max())
    bits, pairs = np.stack([parities(x, words) for x in sets]), []
    for i in range(len(node) - 1):
        least = ((size[i] + size[i + 1 :]) * num + num + den - 1) // (num + den)
        fits = (comp[i + 1 :] != comp[i]) & (least <= np.minimum(size[i], size[i + 1 :]))
        if lo[0] != hi[0]:
            fits &= part[i + 1 :] != part[i]
        j, least = np.flatnonzero(fits) + i + 1, least[fits]
        for k in range(0, len(j), max(1, WORDS // words)):
            at = slice(k, k + max(1, WORDS // words))
            differ = np.bitwise_count(bits[i] ^ bits[j[at]]).sum(axis=1, dtype=np.int64)
            keep = differ <= size[i] + size[j[at]] - 2 * least[at]
            pairs.append(np.stack([np.full(keep.sum(), i), j[at][keep], differ[keep], least[at][keep]]).astype(np.int32))
    left = np.concatenate([np.zeros((4, 0), np.int32), *pairs], axis=1)
    # The nearest come first, so that their links spare most of the others.
    left, root, links, step = left[:, np.argsort(left[2], kind="stable")], np.unique(comp, return_inverse=True)[1], [], max(1, int(AT_ONCE * len(node)))
    while left.shape[1]:
        left = left[:, root[left[0]] != root[left[1]]]
        for i, j, _, least in left[:, :step].T.tolist():
            if root[i] != root[j]:
                x, y = sorted((sets[i], sets[j]), key=len)
                if np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x) >= least:
                    root[root == root[j]] = root[i]
                    links.append((i, j))
        left = left[:, step:]
    ends = np.sort(node[np.array(links, dtype=np.int64).reshape(-1, 2)], axis=1)
    return pa.table({"a": np.ascontiguousarray(ends[:, 0]), "b": np.ascontiguousarray(ends[:, 1])})


def _dense_links(dense: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int, id_col: str, text: str) -> DataFrame:
    """(a, b): links that join the documents of dense groups as far as their sets reach the threshold, fewer than the documents of each group."""
    need = written(only_ids(reps.select("node", "id", "h1", "h2"), dense.select("node").distinct(), "node"), "jaccard_need")
    ids = need.select(F.col("id").alias(id_col)).distinct()
    sets = whole_sets(only_ids(docs, ids, id_col), n, text).join(need, ["h1", "h2"]).select("node", "grams").dropDuplicates(["node"])

    def each(t: pa.Table) -> pa.Table:
        begin = _starts(t)
        ends = np.r_[begin[1:], t.num_rows]
        return pa.concat_tables([_forest(t.slice(a, b - a), num, den) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)])

    return _by_groups(dense.join(sets, "node").select(*GROUPED, "grams"), each, "a long, b long")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs the nearest of each node."""
    sides = pairs.select(F.col("a").alias("node"), "*").union(pairs.select(F.col("b").alias("node"), "*"))
    least = sides.groupBy("node").agg(F.min_by(F.struct("a", "b"), F.struct("differ", "a", "b")).alias("p"))
    return least.select("p.a", "p.b").distinct()


def _still_apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    cols = pairs.columns
    for c in ("a", "b"):
        pairs = pairs.join(comps.toDF(c, f"comp_{c}"), c, "left")
    return pairs.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select(*cols)


def _joined(docs: DataFrame, n: int, num: int, den: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, size, h1, h2) of all rows, (h1, h2, id, node) of all sets, and the component of each linked node."""
    seen = written(gram_sets(docs, n, num, den, id_col, text), "jaccard_sets")
    found = written(seen.where("size >= 0").select("id", "size", "h1", "h2"), "jaccard_found")
    live = seen.where("id is not null and size > 0")
    # Nodes are numbered once, in a written table: equal sets are known by two hashes.
    classes = written(live.groupBy("h1", "h2").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()), "jaccard_classes")
    # Common grams: what prefixes of all documents show, or what documents of one task share, summed over tasks.
    in_prefix = live.select(F.explode("prefix").alias("gram"), F.lit(1).alias("p"), F.lit(0).alias("c"))
    in_task = seen.where("size = -1").select(F.explode(F.arrays_zip("prefix", "counts")).alias("x")).select("x.prefix", F.lit(0), "x.counts")
    counted = in_prefix.union(in_task).groupBy("gram").agg(F.greatest(F.sum("p"), F.sum("c")).alias("n")).where(F.col("n") >= COMMON_FROM)
    counted = written(counted, "jaccard_common")
    discard(seen)
    frequent = counted.where(F.col("n") >= common_from(counted, COMMON_MOST)).select("gram")
    common = np.sort(frequent.toArrow()["gram"].to_numpy().astype(np.int64))
    ordered = ordered_sets(docs, n, num, den, id_col, text, common).where("id is not null and size > 0")
    reps = written(ordered.join(few_or_shuffled(classes), ["id", "h1", "h2"]), "jaccard_reps")
    if reps.count() > classes.count():  # rows that repeat id and text
        every, reps = reps, written(reps.dropDuplicates(["node"]), "jaccard_reps")
        discard(every)
    # Nearly all grams stand in one list only; many small parts keep the table of them small in each task.
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = reps.select(F.posexplode("prefix").alias("at", "gram"), "node", "size").repartition(parts, "gram")
    # Every column is asked for, so both sides of the join read the same shuffle.
    whole = [F.min("at").alias("at"), F.min("size").alias("size")]
    several = lists.groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), *whole).where("lo < hi and at >= 0 and size > 0").select("gram")
    lists = written(lists.join(several, "gram"), "jaccard_lists")
    verify = partial(_linked, reps=reps, docs=docs, n=n, num=num, den=den, common=common, id_col=id_col, text=text)
    # No node is linked yet. A range, as an empty list would start Python workers of another kind, which Spark keeps beside the others.
    comps = docs.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    many = None
    for k in range(MOST_ROUNDS):
        closed, lists = lists, written(_open_lists(lists, comps), "jaccard_open")
        discard(closed)
        before, many = many, lists.count()
        if not many or before is not None and many > ROUND_LEAVES * before:
            break
        links = verify(written(_hub_pairs(lists, HUBS, HUBS * k, num, den), "jaccard_hub_pairs"))
        comps = connected_components(comps.toDF("a", "b").union(links), "a", "b")
    nodes, open_pairs = reps.count(), written(_block_pairs(lists, reps, num, den), "jaccard_blocked")
    left, dense = open_pairs.where("a is not null").select("a", "b", "differ").distinct(), open_pairs.where("a is null").select(*GROUPED)
    if not dense.isEmpty():
        links = written(_dense_links(dense, reps, docs, n, num, den, id_col, text), "jaccard_dense")
        comps = connected_components(comps.toDF("a", "b").union(links), "a", "b")
    for k in range(MOST_ROUNDS):
        left = written(_still_apart(left, comps), "jaccard_left")
        many = left.count()
        if not many:
            break
        whole = many <= AT_ONCE * nodes or k == MOST_ROUNDS - 1
        chosen = left.select("a", "b") if whole else written(_nearest(left), "jaccard_nearest")
        comps = connected_components(comps.toDF("a", "b").union(verify(chosen)), "a", "b")
        if whole:
            break
        left = left.join(chosen, ["a", "b"], "left_anti")
    discard(open_pairs)
    discard(lists)
    discard(reps)
    return found, classes, comps


def ngram_jaccard(
    docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) per row: documents linked at Jaccard >= num/den, and the least id they reach.

    Exact: no candidate is dropped. Equal sets are one node before any pair is
    formed. In each list of nodes that share a prefix gram, all pair with a few
    hubs first; the links found contract the lists, and rounds with other hubs
    follow while they close many lists. What is left is compared across
    components only, inside the tasks, and only pairs that may link leave them,
    or, where a group holds many, the least links that join it, by whole sets;
    where such pairs are many, each node's nearest is verified first, in rounds, then
    all that the links leave apart. So copies are not expanded into all pairs.

    Null or empty text: no n-grams, linked with nothing, its own component.
    Fewer than n words: the whole sequence is the one n-gram. A null id has a
    null component and links with nothing. Rows that repeat an id keep rows of
    their own, each linked by its own text. Other columns of ``docs`` don't
    take part. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col), F.col(text))
    with shuffles_freed(docs.sparkSession):
        found, classes, comps = _joined(docs, n, num, den, id_col, text)
    by_set = classes.join(comps.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = by_set.groupBy("root").agg(F.min("id").alias("component"))
    by_set = by_set.join(least, "root").select("h1", "h2", "component")
    out = found.select("id", "size", "h1", "h2").join(by_set, ["h1", "h2"], "left")
    linked = F.col("id").isNotNull() & (F.col("size") > 0)
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(linked, F.col("component")).otherwise(F.col("id")).alias("component_id")
    )
