"""Conversation structure repair (operator 11).

A conversation should read system?, then user and assistant in turn, or be
empty. Each message is kept (0), given the other role that is due (2) or
deleted (3); empty messages are inserted (2); an undeleted message that breaks
off adds 1. Messages and gaps between them make a graph whose nodes are (gap,
state of the pattern). The least cost from the beginning and the least cost to
the end tell which arcs lie on a cheapest path; from the set of nodes reached
so far the walk goes on by the least edit letter among these tight arcs.

Conversations are dealt by ranges of (id, turn, role, text) and cut into
chunks, so one of any length is many chunks on many tasks. Costs add up as
min-plus matrices: a chunk is one 4 x 4 matrix, the chain of a conversation's
matrices gives each chunk the costs before and behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import few_or_shuffled, text_blocks, written

#: Messages, and bytes of text, from which a chunk ends.
CHUNK_ROWS = 16_384
CHUNK_BYTES = 262_144
#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
#: States: nothing yet, after the system message, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a due message leads to, by state, and what a kept one with this initial (s, u, a, other) leads to; -1: not allowed.
DUE = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
ENDS = np.array([True, False, False, True])
#: A message's code: its initial, plus 4 if it breaks off; MUST_GO: blank or repeated.
MUST_GO = 8
FAR = 1 << 40


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of vectors (the last axis of ``a``) and matrices (the last two of ``b``)."""
    return np.minimum((a[..., :, None] + b).min(axis=-2), FAR)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of insertions at one gap, of the arcs of a message by its code, and of reaching an end."""
    gap = np.where(np.eye(4, dtype=bool), 0, FAR)
    for q in range(4):
        gap[q, DUE[q]] = min(gap[q, DUE[q]], INSERT)
        gap[q, DUE[DUE[q]]] = min(gap[q, DUE[DUE[q]]], 2 * INSERT)
    arcs = np.full((9, 4, 4), FAR)
    for code in range(9):
        for q in range(4):
            arcs[code, q, q] = DELETE
            if code != MUST_GO:
                more = BROKEN * (code >= 4)
                arcs[code, q, DUE[q]] = min(arcs[code, q, DUE[q]], REROLE + more)
                if (to := KEPT[code % 4, q]) >= 0:
                    arcs[code, q, to] = min(arcs[code, q, to], KEEP + more)
    return gap, arcs, (gap + np.where(ENDS, 0, FAR)).min(axis=1)


GAP, ARCS, TO_END = _tables()
#: The insertions before a message and the message, as one matrix by code.
STEPS = _times(GAP[None], ARCS[:, None])


def _by_length(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from the longest to the shortest, and how many of them have a place t, for each t."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")


def transfer(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per sequence of codes the least cost from each state before it to each state behind it (4 x 4)."""
    out = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(offsets) - 1, 4, 4)).copy()
    order, active = _by_length(offsets)
    for t, n in enumerate(active.tolist()):
        who = order[:n]
        out[who] = _times(out[who], STEPS[codes[offsets[who] + t]][:, None])
    return out


def potentials(codes: np.ndarray, offsets: np.ndarray, before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs from the beginning and to the end, for every gap (one more than codes, per sequence) and state.

    ``before`` are the costs on entry, ``behind`` those from the last gap on.
    """
    many = len(offsets) - 1
    at = offsets[:-1] + np.arange(many)  # where the gaps of a sequence begin
    ahead, back = np.full((int(offsets[-1]) + many, 4), FAR), np.full((int(offsets[-1]) + many, 4), FAR)
    ahead[at], back[offsets[1:] + np.arange(many)] = _times(before, GAP), behind
    order, active = _by_length(offsets)
    for t, n in enumerate(active.tolist()):
        who = order[:n]
        ahead[at[who] + t + 1] = _times(_times(ahead[at[who] + t], ARCS[codes[offsets[who] + t]]), GAP)
    for t in range(len(active) - 1, -1, -1):
        who = order[: active[t]]
        onwards = (ARCS[codes[offsets[who] + t]] + back[at[who] + t + 1][:, None, :]).min(axis=2)
        back[at[who] + t] = np.minimum((GAP + onwards[:, None, :]).min(axis=2), FAR)
    return ahead, back


class Walk:
    """Cheapest edits of many sequences at once, the least letter first.

    A sequence that ``ends`` also walks the insertions at its last gap; else
    these belong to the sequence that goes on there.
    """

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, before: np.ndarray, behind: np.ndarray, total: np.ndarray, entry: np.ndarray, ends: np.ndarray):
        many = len(offsets) - 1
        ahead, back = potentials(codes, offsets, before, behind)
        base, sizes = offsets[:-1] + np.arange(many), np.diff(offsets)
        front = np.zeros((many, 4), dtype=bool)
        front[np.arange(many), entry] = True
        gap = np.zeros(many, dtype=np.int64)
        who, steps = np.arange(many), []
        while True:
            at_end = gap[who] == sizes[who]
            done = at_end & (~ends[who] | ((back[base[who] + gap[who]] == 0) & front[who] & ENDS).any(axis=1))
            who, at_end = who[~done], at_end[~done]
            if not len(who):
                break
            here = base[who] + gap[who]
            there = np.where(at_end, here, here + 1)
            code = np.where(at_end, MUST_GO, codes[np.minimum(offsets[who] + gap[who], max(0, len(codes) - 1))] if len(codes) else MUST_GO)
            more = BROKEN * ((code >= 4) & (code < MUST_GO))
            kept = KEPT[np.where(code == MUST_GO, 3, code % 4)]
            moves = []  # in the order of their letters
            for letter, to, cost, onto, allowed in (
                ("D", np.broadcast_to(np.arange(4), kept.shape), np.full(len(who), DELETE), there, ~at_end),
                ("I", np.broadcast_to(DUE, kept.shape), np.full(len(who), INSERT), here, np.ones(len(who), dtype=bool)),
                ("K", kept, KEEP + more, there, code != MUST_GO),
                ("R", np.broadcast_to(DUE, kept.shape), REROLE + more, there, code != MUST_GO),
            ):
                open_ = front[who] & (to >= 0) & allowed[:, None]
                tight = open_ & (ahead[here] + cost[:, None] + np.take_along_axis(back[onto], np.maximum(to, 0), axis=1) == total[who][:, None])
                moves.append((letter, to, tight))
            choice = np.argmax(np.stack([m[2].any(axis=1) for m in moves]), axis=0)
            fresh = np.zeros((len(who), 4), dtype=bool)
            for k, (_, to, tight) in enumerate(moves):
                rows, q = np.nonzero(tight & (choice == k)[:, None])
                fresh[rows, to[rows, q]] = True
            front[who] = fresh
            steps.append((who, np.array([ord(m[0]) for m in moves], np.uint8)[choice], gap[who], fresh.argmax(axis=1)))
            gap[who] += choice != 1
        self.exit = front.argmax(axis=1)
        flat = [np.concatenate([s[k] for s in steps]) if steps else np.zeros(0, np.int64) for k in range(4)]
        order = np.argsort(flat[0], kind="stable")
        #: Per edit: its letter, the place of its message in the sequence, and the state behind it.
        self.letters, self.places, self.states = (f[order] for f in flat[1:])
        self.bounds = np.r_[0, np.cumsum(np.bincount(flat[0], minlength=many))]


def damaged(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults planted by the checksum of ``conv:turn`` modulo 20, nulls being one space.

    0 drops the row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4
    makes it a user's.
    """
    fault = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))) % 20
    rows = messages.select(conv, turn, F.coalesce(role, F.lit(" ")).alias(role), F.coalesce(text, F.lit(" ")).alias(text), fault.alias("_fault")).where("_fault <> 0")
    kept, body = F.col("_fault"), F.col(text)
    rows = rows.select(
        conv,
        turn,
        F.when(kept == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(kept == 1, "").when(kept == 2, F.translate(body, ".!?", "")).otherwise(body).alias(text),
        F.when(kept == 3, 2).otherwise(1).alias("_times"),
    )
    return rows.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


_CHUNKS = (
    "conv long, range int, chunk int, codes binary, entries array<int>, roles array<string>, texts array<string>, first int, last int, costs array<long>, "
    "blank long, duplicate long, truncated long, illegal long, turns long, least_turn long, most_turn long"
)
_LEGAL = np.zeros((4, 4), dtype=bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def _chunked(rows: DataFrame) -> DataFrame:
    """Sorted entries (conv, turn, role, text, copies, fresh, blank, broken, initial) as chunks of one conversation each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made = TaskContext.get().partitionId(), 0
        for part in text_blocks(batches, 3):
            copies = _column(part, "copies").to_numpy()
            pieces = -(-copies // CHUNK_ROWS)
            entry = np.repeat(np.arange(part.num_rows), pieces)  # an entry of many copies is cut as well
            nth = np.arange(len(entry)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            times = np.minimum(CHUNK_ROWS, copies[entry] - nth * CHUNK_ROWS)
            conv = part.column(0)
            known, value = pc.is_valid(conv).to_numpy(zero_copy_only=False)[entry], pc.fill_null(conv, 0).to_numpy()[entry]
            size = pc.binary_length(part.column(3)).to_numpy()[entry].astype(np.int64)
            fresh = np.r_[True, (known[1:] != known[:-1]) | (value[1:] != value[:-1])]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(entry)), 0))
            for amount, most in ((times, CHUNK_ROWS), (size, CHUNK_BYTES)):
                total = np.cumsum(amount)
                share = (total - (total - amount)[begin]) // most
                fresh |= np.r_[True, share[1:] != share[:-1]]
            starts = np.flatnonzero(fresh)
            bounds, n = np.r_[starts, len(entry)], len(starts)
            chunk_of = np.cumsum(fresh) - 1
            initial, broken = _column(part, "initial").to_numpy()[entry], _column(part, "broken").to_numpy(zero_copy_only=False)[entry]
            blank = _column(part, "blank").to_numpy(zero_copy_only=False)[entry]
            counts = (nth == 0) & _column(part, "fresh").to_numpy(zero_copy_only=False)[entry] & ~blank  # its first copy is judged by itself
            codes = np.full(int(times.sum()), MUST_GO, np.uint8)
            row_begin = np.cumsum(times) - times
            codes[row_begin[counts]] = (initial + 4 * broken)[counts]
            offsets = np.r_[row_begin, len(codes)][bounds]

            def summed(what: np.ndarray) -> pa.Array:
                return pa.array(np.bincount(chunk_of, weights=what, minlength=n).astype(np.int64))

            of_rows = np.repeat(initial, times)
            odd = ~_LEGAL[of_rows[:-1], of_rows[1:]]
            inside = np.ones(len(odd), dtype=bool)
            inside[offsets[1:-1] - 1] = False
            illegal = np.bincount(np.repeat(np.arange(n), np.diff(offsets))[1:][odd & inside], minlength=n)
            turn = part.column(1)
            dated, when = pc.is_valid(turn).to_numpy(zero_copy_only=False)[entry], pc.fill_null(turn, 0).to_numpy()[entry]
            new_turn = dated & np.r_[True, ~dated[:-1] | (when[1:] != when[:-1])]
            new_turn |= dated & fresh
            last, some = bounds[1:] - 1, np.bincount(chunk_of, weights=dated, minlength=n) > 0
            firsts = np.full(n, len(entry))
            np.minimum.at(firsts, chunk_of[dated], np.flatnonzero(dated))
            yield pa.record_batch(
                [
                    pa.array(value[starts], mask=~known[starts]),
                    pa.array(np.full(n, place, np.int32)),
                    pa.array(np.arange(made, made + n, dtype=np.int32)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(codes)]),
                    _lists(pa.array(times.astype(np.int32)), bounds),
                    _lists(part.column(2).take(pa.array(entry)), bounds),
                    _lists(part.column(3).take(pa.array(entry)), bounds),
                    pa.array(initial[starts].astype(np.int32)),
                    pa.array(initial[last].astype(np.int32)),
                    _lists(pa.array(transfer(codes, offsets).reshape(-1)), 16 * np.arange(n + 1)),
                    summed(np.where(blank, times, 0)),
                    summed(np.where(blank, 0, times - counts)),
                    summed(counts & broken),
                    pa.array(illegal),
                    summed(new_turn),
                    pa.array(when[np.minimum(firsts, len(entry) - 1)], mask=~some),
                    pa.array(when[last], mask=~some),
                ],
                names=[x.split()[0] for x in _CHUNKS.split(", ")],
            )
            made += n

    return rows.mapInArrow(run, _CHUNKS)


def _chains(chunks: DataFrame) -> DataFrame:
    """(conv, range, chunk, before, behind, total, more_illegal, shared_turns, leads, ends) for conversations of several chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                costs = [np.array(p["costs"]).reshape(4, 4) for p in parts]
                before, behind = [np.array([0, FAR, FAR, FAR])], [TO_END]
                for m in costs[:-1]:
                    before.append(_times(before[-1], m))
                for m in costs[:0:-1]:
                    behind.append(np.minimum((m + behind[-1]).min(axis=1), FAR))
                total = int((_times(before[-1], costs[-1]) + TO_END).min())
                odd = shared = 0
                latest = None
                for k, p in enumerate(parts):
                    odd += k > 0 and not _LEGAL[parts[k - 1]["last"], p["first"]]
                    shared += latest is not None and p["least_turn"] == latest
                    latest = p["most_turn"] if p["most_turn"] is not None else latest
                n = len(parts)
                yield pa.record_batch(
                    [
                        pa.array([conv] * n, pa.int64()),
                        pa.array([p["range"] for p in parts], pa.int32()),
                        pa.array([p["chunk"] for p in parts], pa.int32()),
                        pa.array([x.tolist() for x in before], pa.list_(pa.int64())),
                        pa.array([x.tolist() for x in behind[::-1]], pa.list_(pa.int64())),
                        pa.array([total] * n, pa.int64()),
                        pa.array([int(odd)] + [0] * (n - 1), pa.int64()),
                        pa.array([int(shared)] + [0] * (n - 1), pa.int64()),
                        pa.array([k == 0 for k in range(n)]),
                        pa.array([k == n - 1 for k in range(n)]),
                    ],
                    names=["conv", "range", "chunk", "before", "behind", "total", "more_illegal", "shared_turns", "leads", "ends"],
                )

    ends = F.struct("range", "chunk", "first", "last", "costs", "least_turn", "most_turn")
    several = chunks.groupBy("conv").agg(F.array_sort(F.collect_list(ends)).alias("parts")).where(F.size("parts") > 1)
    schema = "conv long, range int, chunk int, before array<long>, behind array<long>, total long, more_illegal long, shared_turns long, leads boolean, ends boolean"
    return several.mapInArrow(run, schema)


def _fixed(column: pa.Array, default: np.ndarray) -> np.ndarray:
    """A column of lists of four numbers as a table; nulls are ``default``."""
    out = np.broadcast_to(default, (len(column), 4)).astype(np.int64)
    some = pc.is_valid(column).to_numpy(zero_copy_only=False)
    out[some] = column.drop_null().flatten().to_numpy().reshape(-1, 4)
    return out


def _walked(batch: pa.RecordBatch, entry: np.ndarray) -> tuple[Walk, np.ndarray]:
    """The walk over a batch of chunks with their chain's columns (null: the chunk is a whole conversation), and the costs."""
    raw = _column(batch, "codes").to_pylist()
    codes, offsets = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    before, behind = _fixed(_column(batch, "before"), np.array([0, FAR, FAR, FAR])), _fixed(_column(batch, "behind"), TO_END)
    alone = ~pc.is_valid(_column(batch, "total")).to_numpy(zero_copy_only=False)
    total = pc.fill_null(_column(batch, "total"), 0).to_numpy().copy()
    if alone.any():
        total[alone] = (potentials(codes, offsets, before, behind)[1][offsets[:-1] + np.arange(len(raw))] + before).min(axis=1)[alone]
    ends = pc.fill_null(_column(batch, "ends"), True).to_numpy(zero_copy_only=False)
    return Walk(codes, offsets, before, behind, total, entry, ends), total


def _entries(chunks: DataFrame, chains: DataFrame) -> DataFrame:
    """(range, chunk, entry): the state in which the walk of a long conversation enters each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # From a state that no cheapest path enters there is no tight arc; such walks are not begun.
                before, behind, total = _fixed(_column(batch, "before"), TO_END), _column(batch, "behind"), _column(batch, "total").to_numpy()
                raw = _column(batch, "codes").to_pylist()
                codes, offsets = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
                first = offsets[:-1] + np.arange(len(raw))
                ahead, back = potentials(codes, offsets, before, _fixed(behind, TO_END))
                out = np.full((len(raw), 4), -1)
                for q in range(4):
                    on = np.flatnonzero(ahead[first, q] + back[first, q] == total)
                    if len(on):
                        out[on, q] = _walked(batch.take(pa.array(on)), np.full(len(on), q))[0].exit
                yield pa.record_batch([*[_column(batch, c) for c in ("conv", "range", "chunk")], _lists(pa.array(out.reshape(-1)), 4 * np.arange(len(raw) + 1))], names=["conv", "range", "chunk", "exits"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                state, entry = START, []
                for p in parts:
                    entry.append(state)
                    state = p["exits"][state]
                cols = [pa.array([p[c] for p in parts], pa.int32()) for c in ("range", "chunk")]
                yield pa.record_batch([*cols, pa.array(entry, pa.int32())], names=["range", "chunk", "entry"])

    own = chunks.select("range", "chunk", "codes").join(few_or_shuffled(chains), ["range", "chunk"])
    exits = own.select("conv", "range", "chunk", "codes", "before", "behind", "total", "ends").mapInArrow(run, "conv long, range int, chunk int, exits array<long>")
    by_conv = exits.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("range", "chunk", "exits"))).alias("parts"))
    return by_conv.select("parts").mapInArrow(chained, "range int, chunk int, entry int")


_PIECES = (
    "conv long, range int, chunk int, whole boolean, edits string, roles array<string>, texts array<string>, cost long, "
    "blank long, duplicate long, truncated long, illegal long, turns long, least_turn long, most_turn long"
)


def _edited(chunks: DataFrame) -> DataFrame:
    """Chunks with their chain's columns as pieces: the edits, and the repaired messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = pa.array(["", "", "user", "assistant"])
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n = part.num_rows
                walk, total = _walked(part, pc.fill_null(_column(part, "entry"), START).to_numpy())
                whole = ~pc.is_valid(_column(part, "total")).to_numpy(zero_copy_only=False)
                times, roles, texts = (_column(part, c) for c in ("entries", "roles", "texts"))
                # The entry of each message, counted over the whole part.
                rows = np.repeat(np.arange(len(times.flatten())), times.flatten().to_numpy())
                sizes = np.array([len(x) for x in _column(part, "codes").to_pylist()])
                who = np.repeat(np.arange(n), np.diff(walk.bounds))
                stays = walk.letters != ord("D")
                made, renamed = walk.letters == ord("I"), np.isin(walk.letters, [ord("I"), ord("R")])
                at = (np.cumsum(sizes) - sizes)[who] + walk.places
                source = rows[np.minimum(at, max(0, len(rows) - 1))] if len(rows) else np.zeros(len(at), np.int64)
                role = pc.if_else(pa.array(renamed[stays]), due.take(pa.array(walk.states[stays])), roles.flatten().take(pa.array(source[stays])))
                text = pc.if_else(pa.array(made[stays]), "", texts.flatten().take(pa.array(source[stays])))
                ends = np.r_[0, np.cumsum(np.bincount(who[stays], minlength=n))]
                letters = walk.letters.astype(np.uint8).tobytes().decode("ascii")
                cuts = walk.bounds.tolist()
                leads = pc.fill_null(_column(part, "leads"), True).to_numpy(zero_copy_only=False)
                extra = [pc.add(_column(part, "illegal"), pc.fill_null(_column(part, "more_illegal"), 0)), pc.subtract(_column(part, "turns"), pc.fill_null(_column(part, "shared_turns"), 0))]
                yield pa.record_batch(
                    [
                        *[_column(part, c) for c in ("conv", "range", "chunk")],
                        pa.array(whole),
                        pa.array([letters[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.string()),
                        _lists(role, ends),
                        _lists(text, ends),
                        pa.array(np.where(leads, total, 0)),
                        *[_column(part, c) for c in ("blank", "duplicate", "truncated")],
                        *extra,
                        _column(part, "least_turn"),
                        _column(part, "most_turn"),
                    ],
                    names=[x.split()[0] for x in _PIECES.split(", ")],
                )

    return chunks.mapInArrow(run, _PIECES)


def repair(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Pieces of repaired conversations: edits, roles and texts in order, with the faults counted.

    A conversation is one piece (``whole``) or several, ordered by (range,
    chunk); its cost stands in the first. Null roles and texts count as one
    space. Messages are ordered by turn, nulls first, then role, then text;
    equal messages are adjacent. Rows with a null id make one conversation of
    their own. Other columns don't take part; an empty table has no pieces.
    """
    body, who = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    rows = messages.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"), body.alias("text"))
    # Equal messages become one entry before any of them moves.
    entries = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    entries = written(
        entries.withColumns({"blank": bare == "", "broken": (bare != "") & ~F.substring(bare, -1, 1).isin(".", "!", "?"), "key": F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)}),
        "repair_entries",
    )
    # Of what a conversation says at several turns, the first turn's entry is no repetition.
    when = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    said = entries.where("not blank").groupBy("conv", "key").agg(F.count("*").alias("n"), F.min(when).alias("earliest")).where("n > 1")
    said = few_or_shuffled(written(said.select(F.col("conv").alias("of"), F.col("key").alias("said"), "earliest"), "repair_said"))
    entries = entries.join(said, F.col("conv").eqNullSafe(F.col("of")) & (F.col("key") == F.col("said")), "left")
    entries = entries.withColumn("fresh", F.coalesce(F.col("earliest") == when, F.lit(True)))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    entries = entries.select("conv", "turn", "role", "text", "copies", "fresh", "blank", "broken", initial.alias("initial"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    chunks = written(_chunked(entries.repartitionByRange(*order).sortWithinPartitions(*order)), "repair_chunks")
    chains = written(_chains(chunks), "repair_chains")
    places = chains.drop("conv").join(written(_entries(chunks, chains), "repair_places"), ["range", "chunk"])
    return _edited(chunks.drop("costs").join(few_or_shuffled(places), ["range", "chunk"], "left"))


def repaired_messages(pieces: DataFrame) -> DataFrame:
    """(conv, range, chunk, place, role, text): the repaired messages; the middle three order a conversation."""
    both = pieces.select("conv", "range", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "m"))
    return both.select("conv", "range", "chunk", "place", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


_REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, all edits in order, and the checksum of the repaired text.

    Pieces of one conversation are hashed one after the other, as the
    checksum has it, but never held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _REPORT.split(", ")]
        now, held = None, None

        def row() -> pa.RecordBatch:
            turns = held["most_turn"] - held["least_turn"] + 1 - held["turns"] if held["most_turn"] is not None else 0
            values = [now[0], turns, *[held[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]]
            text = ["".join(held["edits"]), held["sum"].hexdigest()]
            return pa.record_batch([*[pa.array([v], pa.int64()) for v in values], *[pa.array([v], pa.string()) for v in text]], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}
                key = (r["conv"].as_py(),)
                if key != now:
                    if now:
                        yield row()
                    now = key
                    held = {"sum": hashlib.sha256(), "edits": [], "any": False, "least_turn": None, "most_turn": None}
                    held |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
                for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    held[c] += r[c].as_py()
                least, most = r["least_turn"].as_py(), r["most_turn"].as_py()
                if most is not None:
                    held["least_turn"] = least if held["least_turn"] is None else held["least_turn"]
                    held["most_turn"] = most
                held["edits"].append(r["edits"].as_py())
                for role, text in zip(r["roles"].values, r["texts"].values, strict=True):
                    held["sum"].update(f"{chr(10) if held['any'] else ''}{role}:{text}".encode())
                    held["any"] = True
        if now:
            yield row()

    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0))
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda m: F.concat(m["roles"], F.lit(":"), m["texts"])), "\n")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    pieces = written(pieces, "repair_pieces")
    whole = pieces.where("whole").select("conv", gaps.alias("gaps"), *counts, F.col("edits").alias("audit"), F.sha2(lines, 256).alias("repaired_sha256"))
    rest = pieces.where("not whole").drop("whole").repartition("conv").sortWithinPartitions("conv", "range", "chunk")
    return whole.union(rest.mapInArrow(run, _REPORT))


def audit(messages: DataFrame, asked: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``report`` of the messages for every id of ``asked``, once each; without messages: zeros and nothing to repair."""
    ids = asked.select(F.col(conv).cast("long").alias(conv)).distinct()
    told = report(repair(messages, conv, turn, role, text)).withColumnRenamed("conv", "_conv")
    out = ids.join(told, F.col(conv).eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = hashlib.sha256(b"").hexdigest()
    return out.select(conv, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
