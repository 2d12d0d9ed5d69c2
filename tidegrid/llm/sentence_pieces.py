"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 1)."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import strings
from tidegrid.llm.merge_rounds import MergeTable

#: The space marker of SentencePiece (a fixed value of its format).
SPACE = "▁"
#: A worker forgets its words after so many distinct ones, and takes so many characters at a time.
MAX_WORDS = 150_000
BLOCK_CHARS = 500_000


class PieceModel:
    """Tables of a BPE model with byte fallback, in numpy arrays.

    Every pair of pieces whose join is a piece is a merge; its rank is the
    joined piece's place by score (best first, equal scores share a rank).
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.eos = sp.eos_id()
        self.bytes_at = {}
        for i in range(size):
            if sp.is_byte(i):
                self.bytes_at[int(pieces[i][3:5], 16)] = i
        self.byte_base = self.bytes_at[0]
        if any(self.bytes_at[b] != self.byte_base + b for b in range(256)):
            raise ValueError("byte pieces must be consecutive")
        self.id_of = {p: i for i, p in enumerate(pieces) if not special[i]}
        scores = np.array([sp.get_score(i) for i in range(size)])
        rank = np.unique(-scores, return_inverse=True)[1].tolist()
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        merges = []
        for p, i in self.id_of.items():
            if SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)):
                raise ValueError("a piece crosses a word boundary; words can't be encoded apart")
            if any(self.char_id[ord(c)] < 0 for c in p):
                raise ValueError("a piece has a character that is no piece")
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    merges.append((a, b, rank[i], i))
        self.merges = MergeTable(size, merges)
        # What each id stands for in the decoded text, as one array of bytes; the unknown id has a surface of its own.
        octets = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else sp.decode([i]).encode() if sp.is_unknown(i) else b"" if special[i] else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.led = np.array([not special[i] and p.startswith(SPACE) for i, p in enumerate(pieces)])
        self.octets = np.frombuffer(b"".join(octets), dtype=np.uint8)
        self.octet_count = np.array([len(o) for o in octets], dtype=np.int64)
        self.octet_start = np.cumsum(self.octet_count) - self.octet_count

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of all words after merging, and each word's symbol count.

        Symbols are piece ids, or ``-1 - codepoint`` for characters without a piece.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        points[points == 0x20] = ord(SPACE)
        sym = self.char_id[points].astype(np.int64)
        return self.merges.merge(np.where(sym < 0, -1 - points, sym), lengths)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat final ids of the words and each word's count; unknown characters become bytes."""
        sym, counts = self.merge_words(words)
        lost = np.flatnonzero(sym < 0)
        if not len(lost):
            return sym.astype(np.int32), counts
        word = np.repeat(np.arange(len(words)), counts)
        coded = [chr(int(-1 - s)).encode("utf-8", "surrogatepass") for s in sym[lost]]
        times = np.ones(len(sym), dtype=np.int64)
        times[lost] = [len(c) for c in coded]
        out = np.repeat(sym, times)
        out[np.repeat(sym < 0, times)] = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.int64) + self.byte_base
        return out.astype(np.int32), np.bincount(np.repeat(word, times), minlength=len(words))

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of flat ids cut at ``ends``: the bytes of all pieces gathered at once.

        The space that the first piece leads with is dropped. A run of byte
        pieces ends at any other id, also one that leaves nothing behind.
        """
        count = self.octet_count[flat]
        before = np.r_[0, np.cumsum(count)]
        raw = self.octets[np.repeat(self.octet_start[flat] - before[:-1], count) + np.arange(int(before[-1]))].tobytes()
        cuts = before[ends]
        # The first id of each text that leaves something.
        shown = np.flatnonzero(count > 0)
        first = np.searchsorted(shown, ends[:-1])
        led = np.zeros(len(cuts) - 1, dtype=bool)
        some = np.flatnonzero(first < len(shown))
        some = some[shown[first[some]] < ends[1:][some]]
        led[some] = self.led[flat[shown[first[some]]]]
        starts = (cuts[:-1] + led).tolist()
        out = [raw[a:b].decode("utf-8", "each_byte") for a, b in zip(starts, cuts[1:].tolist(), strict=True)]
        broken = np.flatnonzero((count[1:] == 0) & self.is_byte[flat[:-1]]) + 1
        for k in np.unique(np.searchsorted(ends, broken, side="right") - 1).tolist():
            inner = before[broken[(broken > ends[k]) & (broken < ends[k + 1])]].tolist()
            bounds = [starts[k], *inner, int(cuts[k + 1])]
            out[k] = "".join(raw[a:b].decode("utf-8", "each_byte") for a, b in zip(bounds, bounds[1:], strict=False))
        return out


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "\ufffd", e.start + 1


#: In decoding, every byte that is no part of a character becomes one U+FFFD.
codecs.register_error("each_byte", _each_byte)


@lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


_WORD = re.compile(" *[^ ]+| +")


class _Words:
    """Ids of the words seen so far, as one flat array that grows."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.index) > MAX_WORDS:
            self.clear()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        miss = np.flatnonzero(at < 0).tolist()
        if miss:
            new = list(dict.fromkeys([words[i] for i in miss]))
            flat, counts = self.model.word_ids(new)
            begin = len(self.flat) + np.r_[0, np.cumsum(counts)[:-1]]
            base = len(self.start)
            self.start = np.r_[self.start, begin]
            self.count = np.r_[self.count, counts]
            self.flat = np.r_[self.flat, flat]
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
            at[miss] = [self.index[words[i]] for i in miss]
        return at


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(load_model(path))


def encode_texts(path: str, texts: list[str | None], add_eos: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the texts and the offsets between them."""
    seen = _words(path)
    split = [_WORD.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
    per_text = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    at = seen.lookup([w for words in split for w in words])
    counts, starts = seen.count[at], seen.start[at]
    total = np.r_[0, np.cumsum(counts)]
    ids = seen.flat[np.repeat(starts - total[:-1], counts) + np.arange(total[-1])]
    ends = total[np.cumsum(per_text)]
    if add_eos:
        ids = np.insert(ids, ends, seen.model.eos)
        ends = ends + np.arange(1, len(ends) + 1)
    return ids.astype(np.int32), np.r_[0, ends].astype(np.int64)


def _blocks(column: pa.Array) -> Iterator[list[str | None]]:
    block, size = [], 0
    for t in strings(column):
        block.append(t)
        size += len(t or "")
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _rows(model: str, texts: pa.Array, eos: bool, decoded: bool) -> Iterator[list[pa.Array]]:
    """For each block of texts: the ids, and the text decoded from them."""
    m = load_model(model)
    for block in _blocks(texts):
        flat, ends = encode_texts(model, block, eos)
        out: list[pa.Array] = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))]
        if decoded:
            out.append(pa.array(m.decode(flat, ends), pa.string()))
        yield out


def encode(df: DataFrame, model: str, text: str = "text", out: str = "token_ids", eos: bool = True) -> DataFrame:
    """Add ``out`` array<int>: the ids of ``text`` with the model file ``model``.

    Whole texts, no sampling; null or empty text gives the end id alone (or an
    empty array with ``eos=False``). Equal to the library's ids for BPE models
    with byte fallback and no normalisation. An existing column named ``out``
    is replaced, all others pass.
    """

    @F.arrow_udf("array<int>")
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.concat_arrays([x[0] for x in _rows(model, column, eos, False)])

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, model: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` string: the text that the ids stand for.

    Null ids give null, an empty array the empty text. Control ids vanish, the
    unknown id leaves the model's surface for it.
    """

    @F.arrow_udf("string")
    def texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = load_model(model)
        for column in columns:
            counts = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
            found = m.decode(column.flatten().to_numpy(), np.r_[0, np.cumsum(counts)])
            yield pa.array(found, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))

    return df.withColumn(out, texts(F.col(ids)))


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", eos: bool = True) -> DataFrame:
    """(id, token_ids, decoded): both directions in one pass over the texts, one worker per task.

    Nulls, empty texts and repeated rows as in ``encode``; every row keeps a row
    of its own, in blocks of a bounded number of characters. Other columns of
    ``df`` don't take part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for columns in _rows(model, batch.column(1), eos, True):
                n = len(columns[0])
                yield pa.record_batch([batch.column(0).slice(at, n), *columns], names=[id_col, "token_ids", "decoded"])
                at += n

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, token_ids array<int>, decoded string")
