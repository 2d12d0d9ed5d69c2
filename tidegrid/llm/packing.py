"""Mixture-controlled packing by deficit round-robin over source queues (operator 5).

Each source is a queue of its documents' tokens. In every round a queue is
credited its quantum, its share of one window, in fixed-point fractions; it
gives the whole tokens it has credit for and carries the rest, its deficit, to
the next round. The rounds of all queues, end to end, are one stream, and
windows are cut from that stream. What a queue has given after any number of
rounds has a closed form, so every document finds its pieces by itself from
the tokens that stand before it in its queue: deficits carry across windows
and across Spark partitions without a pass over them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import give_back, strings, text_blocks, tidied, written
from tidegrid.llm.merge_rounds import MergeTable

#: Binary digits of a quantum's fraction.
FRACTION = 16
#: Where there are more sources than this, those without a given weight share so many queues by hash.
MAX_QUEUES = 512
#: Parts of documents that are laid out at once; a longer document alone may have one a token.
MAX_PARTS = 200_000
#: Parts of words whose ids a worker remembers, their longest in steps of 8 bytes, and the bytes it tokenises at a time.
MAX_PARTS_KEPT = 400_000
KEY_WORDS = 3
BLOCK_BYTES = 1_000_000
#: Places of so many blocks and queues may be broadcast; more are joined in a shuffle.
MAX_PLACES = 500_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The steps of the vocabulary file that the plain path below takes by itself. Files with others are refused.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: What plain chunks consist of (no apostrophe, nothing that NFC changes, no sign of a special string): ASCII and two-byte letters.
_SIGNS = b"!\"#$%&()*+,./:;=>?@[]\\^_`{|}~-"
_OTHER, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = _LETTER
_KIND[np.frombuffer(b"0123456789", np.uint8)] = _DIGIT
_KIND[np.frombuffer(_SIGNS, np.uint8)] = _SIGN
#: Second bytes of the letters À-ÖØ-öø-ÿ behind their first byte, and lower case of first and second bytes.
_LATIN_LEAD = 0xC3
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_LATIN_LOWER = np.array([b + 32 if 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256)], dtype=np.uint8)


def _octets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a text or binary column without nulls, and the cuts between them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    cuts = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    octets = np.frombuffer(data, dtype=np.uint8)[cuts[0] : cuts[-1]] if data else np.zeros(0, np.uint8)
    return octets, cuts - cuts[0]


def _binary(octets: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(octets))])


def plain_parts(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which chunks are plain, the count of each one's parts (none of the others), and these in lower case, in order.

    A part is a run of letters, a run of signs, or a digit.
    """
    octets, cuts = _octets(chunks)
    kind, low = _KIND[octets], _LOWER[octets]
    lead = np.flatnonzero(octets[:-1] == _LATIN_LEAD)
    lead = lead[_LATIN[octets[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] = _LATIN_LOWER[octets[lead + 1]]
    odd = np.r_[0, np.cumsum(kind == _OTHER)]
    plain = odd[cuts[1:]] == odd[cuts[:-1]]
    begins = kind == _DIGIT
    begins[1:] |= kind[1:] != kind[:-1]
    begins[cuts[:-1][np.diff(cuts) > 0]] = True
    if not plain.all():
        stays = np.repeat(plain, np.diff(cuts))
        begins, low = begins[stays], low[stays]
        cuts = np.r_[0, np.cumsum(np.where(plain, np.diff(cuts), 0))]
    at = np.flatnonzero(begins)
    return plain, np.diff(np.searchsorted(at, cuts)), _binary(low, np.r_[at, len(low)])


class WordMerges:
    """The vocabulary's merges over bytes, where the last byte of a word is marked."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if model["type"] != "BPE" or file["normalizer"] != NORMALIZER or split.get("pattern") != {"Regex": SPLIT} or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: packing knows byte-pair vocabularies of lower-case words only")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[sign[b] + end] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.top = max([*vocab.values(), *(t["id"] for t in file.get("added_tokens") or [])])
        self.table = MergeTable(max(vocab.values()) + 1, [(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(pairs)])

    def part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of plain parts, none of them empty, and each one's count."""
        if not len(parts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        octets, cuts = _octets(parts)
        ends = cuts[1:] - 1
        sym = self.inner[octets]
        sym[ends] = self.last[octets[ends]]
        flat, counts = self.table.merge(sym, np.diff(cuts))
        return flat.astype(np.int32), counts.astype(np.int64)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each count, one after the other."""
    begin = np.cumsum(count) - count
    return np.repeat(start - begin, count) + np.arange(int(count.sum()))


class KnownParts:
    """Ids of at most ``most`` parts by their bytes, in plain arrays: open addressing with linear probing.

    Keys are the bytes themselves, filled up with zeros, which no plain part holds.
    """

    def __init__(self, most: int):
        self.most, self.bits = most, (2 * most - 1).bit_length()
        self.key = np.empty((most, KEY_WORDS), np.uint64)
        self.start, self.count, self.used = (np.empty(most, np.int32) for _ in range(3))
        self.clear()

    def clear(self) -> None:
        self.n, self.held = 0, 0
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.flat = np.empty(self.most, np.int32)

    def keys(self, octets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        room = np.r_[octets, np.zeros(8, np.uint8)]
        eights = np.ndarray(len(room) - 7, "<u8", room, strides=(1,))
        size, mask = np.diff(cuts), np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        out = np.empty((len(size), KEY_WORDS), np.uint64)
        for k in range(KEY_WORDS):
            out[:, k] = eights[np.minimum(cuts[:-1] + 8 * k, len(octets))] & mask[np.clip(size - 8 * k, 0, 8)]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = np.zeros(len(keys), np.uint64)
        for k in range(KEY_WORDS):
            mixed = (mixed ^ keys[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        return (mixed & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the parts, -1 for unknown ones."""
        slot = self.slots(keys)
        found = self.at[slot].astype(np.int64)
        left = np.flatnonzero(found >= 0)
        while len(left := left[(self.key[found[left]] != keys[left]).any(axis=1)]):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found[left] = self.at[slot[left]]
            left = left[found[left] >= 0]
        return found

    def add(self, keys: np.ndarray, counts: np.ndarray, flat: np.ndarray, used: np.ndarray) -> None:
        """Remember distinct unknown parts, as many as there is room for."""
        keys, counts, used = (x[: self.most - self.n] for x in (keys, counts, used))
        ids, rows = int(counts.sum()), slice(self.n, self.n + len(keys))
        if self.held + ids > len(self.flat):
            self.flat = np.r_[self.flat[: self.held], np.empty(max(ids, self.held // 2), np.int32)]
        self.flat[self.held : self.held + ids] = flat[:ids]
        self.key[rows], self.count[rows], self.used[rows] = keys, counts, used
        self.start[rows] = self.held + np.cumsum(counts) - counts
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.at[slot[left]] < 0]
            self.at[slot[free]] = self.n + free  # of those that meet here, one stays
            left = left[self.at[slot[left]] != self.n + left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.n, self.held = self.n + len(keys), self.held + ids

    def forget_rare(self) -> None:
        """Keep the parts that came up often since the last time, if they leave room."""
        kept = np.flatnonzero(self.used[: self.n] >= 3)
        keys, counts = self.key[kept], self.count[kept]
        flat = self.flat[_spread(self.start[kept], counts)]
        self.clear()
        if 2 * len(kept) < self.most:
            self.add(keys, counts, flat, np.zeros(len(kept), np.int32))


class ChunkIds:
    """Ids of texts by chunks between plain white space, which this vocabulary drops and never crosses.

    Plain chunks fall into parts; each distinct part is merged once, and the
    frequent ones stay in memory. All other chunks go to the library.
    """

    def __init__(self, path: str):
        self.path, self.merges, self.known = path, WordMerges(path), KnownParts(MAX_PARTS_KEPT)

    def part_ids(self, parts: pa.Array, often: np.ndarray) -> pa.Array:
        """Ids, as bytes, of distinct plain parts, which come up so often; new ones are merged."""
        octets, cuts = _octets(parts)
        short, keys = np.diff(cuts) <= 8 * KEY_WORDS, self.known.keys(octets, cuts)
        at = np.where(short, self.known.find(keys), -1)
        hits, miss = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        flat, new = self.merges.part_ids(parts.take(pa.array(miss)))
        self.known.used[at[hits]] += often[hits]
        old = self.known.count[at[hits]].astype(np.int64)
        made = [self.as_bytes(self.known.flat[_spread(self.known.start[at[hits]], old)], old), self.as_bytes(flat, new)]
        place = np.empty(len(parts), np.int64)
        place[hits], place[miss] = np.arange(len(hits)), len(hits) + np.arange(len(miss))
        if self.known.n + len(miss) > self.known.most:
            self.known.forget_rare()
        keep = short[miss]
        self.known.add(keys[miss[keep]], new[keep], flat[np.repeat(keep, new)], often[miss[keep]])
        return pa.concat_arrays(made).take(pa.array(place))

    def as_bytes(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        return _binary(ids.astype(self.width).view(np.uint8), np.r_[0, np.cumsum(counts)] * self.width.itemsize)

    def chunk_ids(self, chunks: pa.Array) -> pa.Array:
        """Ids, as bytes, of each distinct chunk."""
        plain, many, parts = plain_parts(chunks)
        coded = parts.dictionary_encode()
        which = coded.indices.to_numpy()
        ids = self.part_ids(coded.dictionary, np.bincount(which, minlength=len(coded.dictionary)))
        octets, cuts = _octets(ids.take(coded.indices))
        made = _binary(octets, cuts[np.r_[0, np.cumsum(many)]])
        if plain.all():
            return made
        # The library is loaded by the first chunk that needs it; it takes more memory than all else that is kept here.
        rest = strings(chunks.take(pa.array(np.flatnonzero(~plain))))
        other = [e.ids for e in _tokenizer(self.path).encode_batch_fast(rest, add_special_tokens=False)]
        other = self.as_bytes(np.fromiter(chain.from_iterable(other), dtype=np.int64), np.fromiter(map(len, other), dtype=np.int64, count=len(other)))
        place = np.arange(len(chunks))
        place[~plain] = len(chunks) + np.arange(len(rest))
        return pa.concat_arrays([made, other]).take(pa.array(place))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, each with the end id, and the offsets between them.

        Arrow splits the texts and finds the distinct chunks; only those are
        looked up. Ids take two bytes where the vocabulary and the end id fit,
        else four.
        """
        self.width = np.dtype("<u2" if self.merges.top < 1 << 16 and 0 <= end_id < 1 << 16 else "<u4")
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = split.flatten().dictionary_encode()
        ids = pa.concat_arrays([self.chunk_ids(coded.dictionary), self.as_bytes(np.array([end_id]), np.ones(1, np.int64))])
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        octets, cuts = _octets(ids.take(pa.array(np.insert(coded.indices.to_numpy(), ends, len(ids) - 1))))
        return octets.view(self.width), cuts[np.r_[0, ends + np.arange(1, len(ends) + 1)]] // self.width.itemsize


@lru_cache(maxsize=2)
def _chunks(path: str) -> ChunkIds:
    made = ChunkIds(path)
    give_back()  # reading the vocabulary takes many times what is kept of it
    return made


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text: str, source: str) -> DataFrame:
    """(id, queue, block, before, tokens, ids): ``before`` counts the queue's tokens in the same block before the row, ``ids`` holds them as bytes.

    A block is one task's rows. The table must be written before use: blocks
    are not the same in another run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, block, held = _chunks(tokenizer), TaskContext.get().partitionId(), {}
        for part in text_blocks(batches, 1, BLOCK_BYTES):
            flat, ends = coder.encode(part.column(1), end_id)
            sizes, before, queues = np.diff(ends), [], strings(part.column(2))
            for q, n in zip(queues, sizes.tolist(), strict=True):
                before.append(held.get(q, 0))
                held[q] = before[-1] + n
            yield pa.record_batch(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(np.full(len(sizes), block, dtype=np.int64)),
                    pa.array(before, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    coder.as_bytes(flat, sizes),
                ],
                names=[id_col, "queue", "block", "before", "tokens", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text, source).mapInArrow(
        tidied(run), f"{id_col} {kind}, queue string, block long, before long, tokens long, ids binary"
    )


def queue_plan(totals: dict[str, int], window: int, weights: dict[str, float] | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Queues, their tokens, and their quanta per round in fixed point. Default target: each queue's share of all tokens."""
    names = sorted(totals)
    held = [totals[n] for n in names]
    want = [max(0.0, float(weights.get(n, 0.0))) for n in names] if weights else held
    whole = sum(want) or 1
    quanta = [max(1, int(w * (window << FRACTION) // whole)) for w in want]
    return names, np.array(held, dtype=np.int64), np.array(quanta, dtype=np.int64)


def _given(rounds: np.ndarray, quanta: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Tokens that each queue (columns) has given after these rounds (rows)."""
    most = ((held + 1) << FRACTION) // quanta + 1
    return np.minimum((np.minimum(rounds[:, None], most) * quanta) >> FRACTION, held)


def _round_of(token: np.ndarray, quanta: np.ndarray) -> np.ndarray:
    """The round in which a queue gives its token of this number, from 0."""
    return -((-((token + 1) << FRACTION)) // quanta)


def _parts(begin: np.ndarray, size: np.ndarray, quanta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each document: its rounds, or its tokens where a round gives less than one."""
    first = _round_of(begin, quanta)
    slow = quanta < 1 << FRACTION
    return np.where(slow, begin, first), np.where(slow, size, _round_of(begin + size - 1, quanta) - first + 1)


def pieces_of(begin: np.ndarray, size: np.ndarray, queue: np.ndarray, held: np.ndarray, quanta: np.ndarray, window: int):
    """Pieces of documents: (document, start, length, sequence, offset) arrays.

    ``begin`` is the document's place in its queue. A document is cut where its
    queue's round ends and where the window does; parts that meet in the stream
    are one piece.
    """
    first, n = _parts(begin, size, quanta[queue])
    doc = np.repeat(np.arange(len(begin)), n)
    at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
    dq = queue[doc]
    rounds = np.where(quanta[dq] < 1 << FRACTION, _round_of(at, quanta[dq]), at)
    lo = np.maximum(begin[doc], ((rounds - 1) * quanta[dq]) >> FRACTION)
    hi = np.minimum(begin[doc] + size[doc], (rounds * quanta[dq]) >> FRACTION)
    some = hi > lo
    doc, rounds, dq, lo, hi = doc[some], rounds[some], dq[some], lo[some], hi[some]
    place = np.empty(len(doc), dtype=np.int64)
    step = max(1, 500_000 // len(quanta))
    for k in range(0, len(doc), step):
        part = slice(k, k + step)
        old, new = _given(rounds[part] - 1, quanta, held), _given(rounds[part], quanta, held)
        at = np.arange(len(old))
        earlier = np.cumsum(new - old, axis=1) - (new - old)
        place[part] = old.sum(axis=1) + earlier[at, dq[part]] + lo[part] - old[at, dq[part]]
    # Parts that follow each other in the document and in the stream join again.
    joined = np.zeros(len(doc), dtype=bool)
    if len(doc):
        joined[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + (hi - lo)[:-1])
    head = np.flatnonzero(~joined)
    length = np.add.reduceat(hi - lo, head) if len(head) else np.zeros(0, dtype=np.int64)
    doc, start, place = doc[head], lo[head] - begin[doc[head]], place[head]
    # Cut at windows.
    cuts = (place + length - 1) // window - place // window + 1
    i = np.repeat(np.arange(len(doc)), cuts)
    k = np.arange(int(cuts.sum())) - np.repeat(np.r_[0, np.cumsum(cuts)[:-1]], cuts)
    seq = place[i] // window + k
    lo = np.maximum(place[i], seq * window)
    hi = np.minimum((place + length)[i], (seq + 1) * window)
    return doc[i], start[i] + lo - place[i], hi - lo, seq, lo - seq * window


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 1,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_queue[, ids]).

    A document is its ids and the end id; null or empty text is the end id
    alone. ``weights`` gives target shares by source (default: the shares that
    the corpus has, so all queues run dry together; sources without a weight
    follow at one fraction a round). All sequences but the last are full. A null source is
    a queue of its own. Beyond MAX_QUEUES sources, those without a weight share
    queues, whose tokens come in the order of the blocks. Repeated rows and null ids are packed as they stand. An
    empty table gives an empty result. Other columns don't take part.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(source).cast("string"), F.lit("\0null"))
    few = docs.select(key.alias("q")).distinct().limit(MAX_QUEUES + 1).count() <= MAX_QUEUES
    if not few:
        shared = F.concat(F.lit("\0hash "), F.pmod(F.xxhash64(key), F.lit(MAX_QUEUES)))
        key = F.when(key.isin(list(weights)), key).otherwise(shared) if weights else shared
    coded = written(tokenised(docs.select(id_col, text, key.alias(source)), tokenizer, end_id, id_col, text, source), "packing_ids")
    blocks = coded.groupBy("queue", "block").agg(F.sum("tokens").alias("tokens"))
    base = blocks.select(
        "queue",
        "block",
        (F.sum("tokens").over(Window.partitionBy("queue").orderBy("block")) - F.col("tokens")).alias("base"),
    )
    totals = {r[0]: r[1] for r in blocks.groupBy("queue").agg(F.sum("tokens")).collect()}  # at most MAX_QUEUES rows and the given weights
    names, held, quanta = queue_plan(totals, window, weights)
    index = {n: k for k, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = quanta[[index[x] for x in strings(batch.column("queue"))]]
            _, n = _parts(batch.column("begin").to_numpy(), batch.column("tokens").to_numpy(), q)
            laid, lo, hi = np.r_[0, np.cumsum(n)], 0, 0
            while hi < batch.num_rows:
                lo, hi = hi, min(hi + 1000, max(hi + 1, int(np.searchsorted(laid, laid[hi] + MAX_PARTS, side="right")) - 1))
                part = batch.slice(lo, hi - lo)
                begin = part.column("begin").to_numpy()
                size = part.column("tokens").to_numpy()
                queue = np.array([index[q] for q in strings(part.column("queue"))], dtype=np.int64)
                doc, start, length, seq, offset = pieces_of(begin, size, queue, held, quanta, window)
                octets, cuts = _octets(part.column("ids"))
                flat = octets.view("<u2" if cuts[-1] == 2 * size.sum() else "<u4")
                first = (np.cumsum(size) - size)[doc] + start
                raw = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B")
                crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                out = [
                    part.column(0).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array(size[doc]),
                    pa.array(seq),
                    pa.array(offset),
                    part.column("queue").take(pa.array(doc)),
                ]
                fields = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_queue"]
                if with_ids:
                    at = np.r_[0, np.cumsum(length)]
                    values = flat[np.repeat(first - at[:-1], length) + np.arange(at[-1])]
                    out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32))))
                    fields.append("ids")
                yield pa.record_batch(out, names=fields)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source_queue string"
    base = written(base, "packing_places")
    few = base.limit(MAX_PLACES + 1).count() <= MAX_PLACES
    placed = coded.join(F.broadcast(base) if few else base, ["queue", "block"]).select(id_col, "queue", (F.col("base") + F.col("before")).alias("begin"), "tokens", "ids")
    return placed.mapInArrow(tidied(run), schema + (", ids array<int>" if with_ids else ""))
