"""Language identification by hyperdimensional profiles (operator 13).

Every letter has a random vector of +1 and -1. A letter and its two neighbours
bind into one vector: the product of the first letter's vector, permuted twice,
the second's, permuted once, and the third's. The sum of these over a text is
the text's profile, the sum over all learnt texts of a language its prototype,
and a text has the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import strings, text_blocks

#: Components of a vector, and the seed of the letters' vectors.
DIM = 1024
SEED = 13
#: Bytes of text that a task takes at a time, and the longest piece of one text in characters.
BLOCK_BYTES = 2_000_000
PIECE = 1_000_000
#: Cells of the count table, and n-gram vectors, that a task holds at a time.
CELLS, HELD = 4_000_000, 8_192
#: Languages whose prototypes are sent to every task (at 8 KB each).
MOST_LANGUAGES = 5_000
UNKNOWN = "und"

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def letter_vectors(letters: np.ndarray, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """A row of +1 and -1 per letter, by hashing its code point; 0 stands for whatever isn't a letter."""
    words = np.arange(1, dim // 64 + 1, dtype=np.uint64) * _C
    hashed = _mix(_mix(letters.astype(np.uint64)[:, None] * _A + np.uint64(seed)) + words)
    return (np.unpackbits(hashed.astype("<u8").view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def _pieces(texts: list[str]) -> Iterator[tuple[int, str, int, int]]:
    """(text, characters, own first, own end): long texts are cut; a piece also shows the character on either side of its own."""
    for k, t in enumerate(texts):
        for a in range(0, max(1, len(t)), PIECE):
            lo, hi = max(0, a - 1), min(len(t), a + PIECE + 1)
            yield k, t if hi - lo == len(t) else t[lo:hi], a - lo, min(len(t), a + PIECE) - lo


class Grams:
    """Letters of some texts with their neighbours: which n-gram each one makes, and in which text."""

    def __init__(self, texts: list[str]):
        cut = list(_pieces(texts))
        code = np.frombuffer(("\n".join(x[1] for x in cut) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.array([len(x[1]) + 1 for x in cut])
        seen = np.flatnonzero(np.bincount(code))
        lower = np.zeros(int(seen[-1]) + 1, dtype=np.int64)
        for c in seen.tolist():
            if chr(c).isalpha():
                low = chr(c).lower()
                lower[c] = ord(low) if len(low) == 1 else c
        self.letters = np.unique(np.r_[0, lower[seen]])  # 0: no letter
        at = np.searchsorted(self.letters, lower)[code]
        own = at > 0
        begin = np.cumsum(sizes) - sizes
        if len(cut) > len(texts):
            for lo, (_, t, first, end) in zip(begin.tolist(), cut, strict=True):
                own[lo : lo + first] = own[lo + end : lo + len(t)] = False
        self.text = np.repeat(np.array([x[0] for x in cut]), sizes)[own]
        n = len(self.letters)
        key = ((np.r_[0, at[:-1]] * n + at) * n + np.r_[at[1:], 0])[own]
        if n**3 <= 1 << 22:
            kinds = np.flatnonzero(np.bincount(key, minlength=1))
            place = np.zeros(int(kinds[-1]) + 1 if len(kinds) else 1, dtype=np.int64)
            place[kinds] = np.arange(len(kinds))
            self.gram = place[key]
        else:
            kinds, self.gram = np.unique(key, return_inverse=True)
        self.kinds = len(kinds) if len(key) else 0
        self.parts = (kinds // (n * n), kinds // n % n, kinds % n)

    def vectors(self, lo: int, hi: int, dim: int, seed: int) -> np.ndarray:
        """The bound vectors of the n-grams from ``lo`` to ``hi``."""
        base = letter_vectors(self.letters, dim, seed)
        a, b, c = (p[lo:hi] for p in self.parts)
        return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def profiles(texts: list[str], groups: np.ndarray, many: int, dim: int = DIM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Per group of texts the sum of its n-gram vectors, and its number of letters."""
    out = np.zeros((many, dim))
    if not texts:
        return out, np.zeros(many, dtype=np.int64)
    grams = Grams(texts)
    group = np.asarray(groups)[grams.text]
    if not grams.kinds:
        return out, np.zeros(many, dtype=np.int64)
    order = np.argsort(group, kind="stable")
    group, gram = group[order], grams.gram[order]
    step = max(1, CELLS // grams.kinds)
    for v in range(0, grams.kinds, HELD):
        w = min(v + HELD, grams.kinds)
        bound = grams.vectors(v, w, dim, seed).astype(np.float32)
        for g in range(0, many, step):
            h = min(g + step, many)
            a, b = np.searchsorted(group, [g, h])
            table = np.bincount((group[a:b] - g) * grams.kinds + gram[a:b], minlength=(h - g) * grams.kinds)
            out[g:h] += table.reshape(h - g, -1)[:, v:w].astype(np.float32) @ bound
    return out, np.bincount(group, minlength=many)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and a prototype row for each."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    dim: int = DIM
    seed: int = SEED


def train(docs: DataFrame, dim: int = DIM, seed: int = SEED, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Prototypes from all rows whose text and language are not null.

    Each task sums its texts by language; Spark adds these sums component by
    component, so what a language takes doesn't grow with its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in text_blocks(batches, 0, BLOCK_BYTES):
            coded = part.column(1).dictionary_encode()
            names = coded.dictionary.to_pylist()
            got, letters = profiles(strings(part.column(0)), coded.indices.to_numpy(), len(names), dim, seed)
            for name, row, n in zip(names, got, letters.tolist(), strict=True):
                if n:
                    sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            values = pa.ListArray.from_arrays(pa.array([0, dim], pa.int32()), pa.array(row.astype(np.int64)))
            yield pa.record_batch([pa.array([name], pa.string()), values], names=["lang", "sums"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    summed = rows.mapInArrow(run, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("at", "value"))
    summed = summed.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    whole = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("row"))
    found = whole.select("lang", "row.value").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: prototypes are sent to every task")
    found.sort(key=lambda r: r.lang)
    rows = np.array([r.value for r in found], dtype=np.float64).reshape(len(found), dim)
    return LanguageModel(tuple(r.lang for r in found), rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12), dim, seed)


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the nearest language and its cosine, 0 at least.

    Null texts, texts without a letter, and all texts if no language was
    learnt, are ``und`` with score 0. Of equally near languages the first by
    name is taken. Columns of the two output names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (out, score)]
    source = docs.select(*kept, F.coalesce(docs[text], F.lit("")).alias("_language_text"))
    names = [*kept, out, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in text_blocks(batches, len(kept), BLOCK_BYTES):
            n = part.num_rows
            if not m.languages:
                best, near, known = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, dtype=bool)
            else:
                got, letters = profiles(strings(part.column(len(kept))), np.arange(n), n, m.dim, m.seed)
                cosine = (got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)) @ m.prototypes.T
                best, known = cosine.argmax(axis=1), letters > 0
                near = np.where(known, np.clip(cosine[np.arange(n), best], 0, 1), 0.0)
            found = pa.array([m.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)], pa.string())
            yield pa.record_batch([*part.columns[: len(kept)], found, pa.array(near)], names=names)

    schema = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}`{out}` string, `{score}` double")


def language_id(docs: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) per row; learns from the rows outside the held-out fold.

    The fold is crc32 of the id as text, modulo ``folds``. A null id is in no
    fold: it is neither learnt from nor held out. Rows that repeat an id are
    rows of their own; other columns don't take part. An empty table gives an
    empty result.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    model = train(docs.where(fold != held).select(text, lang), text=text, lang=lang)
    rows = docs.select(F.col(id_col), F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.col(text).alias("_text"))
    return with_language(rows, model, text="_text").drop("_text")
