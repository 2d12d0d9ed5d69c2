"""Token counts by distinct pre-token (operator 6).

Pieces are counted once per distinct pre-token of the corpus; documents carry
only pre-token frequencies, and a join sums them. No ids are materialised.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import common_from, strings, text_blocks, written

#: Pre-tokens whose counts are broadcast: the commonest of the corpus, at most so many.
HEAD = 300_000
#: Bytes of text that a task splits at a time.
BLOCK_BYTES = 6_000_000

#: Byte-level pre-tokens: contractions, letters, digits, other signs (each with one space before), white space.
#: A fixed value of the tokenizer format.
PRE_TOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A word and signs behind it, no apostrophe among them; and a space before white space or the end: only there a pre-token may go on behind a space that isn't its first sign.
_ENDED = r"^(?P<letters>\p{L}+)(?P<signs>[!-&(-/:-@\[-`{-~]+)$"
_RUN = r" (?:[\s\v\x1c-\x1f\x{85}\p{Z}]|\z)"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Splitter:
    """Pre-tokens of texts, found once for each distinct chunk between spaces."""

    def __init__(self, tokenizer: str):
        self.specials = sorted((t.content for t in _tokenizer(tokenizer).get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None

    def _whole(self, text: str) -> list[str]:
        """Pre-tokens of a text with runs of white space or special strings, which stay whole."""
        if not any(s in text for s in self.specials):
            return PRE_TOKEN.findall(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else PRE_TOKEN.findall(part)
        return out

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(pre-tokens, the chunk that each is of, the row of every chunk in the texts, which chunk it is)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _RUN)
        for s in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy() > 0))
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        counts = pc.list_value_length(parts).to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # The first word of a text has no space before it; chunk 2k + 1 is word k with one.
        code = 2 * code + 1
        code[np.cumsum(counts) - counts] -= 1
        shown = np.zeros(2 * len(words), dtype=bool)
        shown[code] = True
        used, which = np.flatnonzero(shown), (np.cumsum(shown) - 1)[code]
        word, spaced = words.take(pa.array(used // 2)), pa.array(used % 2 == 1)

        def glued(part: pa.Array, at: np.ndarray) -> pa.Array:
            return pc.if_else(spaced.take(pa.array(at)), pc.binary_join_element_wise(" ", part, ""), part)

        # Most chunks are letters alone, or letters and then signs; only the rest needs the whole pattern.
        ended = pc.extract_regex(word, _ENDED)
        plainly = pc.and_(pc.utf8_is_alpha(word), pc.greater(pc.binary_length(word), 0)).to_numpy(zero_copy_only=False)
        signed = ended.is_valid().to_numpy(zero_copy_only=False)
        letters, marked, mixed = np.flatnonzero(plainly), np.flatnonzero(signed), np.flatnonzero(~plainly & ~signed)
        ended = ended.take(pa.array(marked))
        found = [PRE_TOKEN.findall(c) for c in strings(glued(word.take(pa.array(mixed)), mixed))]
        tokens = [glued(word.take(pa.array(letters)), letters), glued(ended.field("letters"), marked), ended.field("signs")]
        tokens.append(pa.array([t for f in found for t in f], pa.string()))
        owner = [letters, marked, marked, np.repeat(mixed, np.array([len(f) for f in found], dtype=np.int64))]
        rows, chunks = [np.repeat(plain, counts)], [which]
        seen: dict[str, int] = {}
        for i in np.flatnonzero(odd).tolist():
            got = [seen.setdefault(t, len(seen)) for t in self._whole(texts[i].as_py())]
            rows.append(np.full(len(got), i))
            chunks.append(np.array(got, dtype=np.int64) + len(used))
        tokens.append(pa.array(list(seen), pa.string()))
        owner.append(len(used) + np.arange(len(seen)))
        return pa.concat_arrays(tokens), np.concatenate(owner), np.concatenate(rows), np.concatenate(chunks)


def pre_tokens(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(pre_token, n): every distinct pre-token of the corpus and how often it stands there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(tokenizer)
        for part in text_blocks(batches, 0, BLOCK_BYTES):
            tokens, owner, _, chunks = splitter.split(part.column(0))
            times = np.bincount(chunks, minlength=int(owner.max(initial=-1)) + 1)
            yield pa.record_batch([tokens, pa.array(times[owner].astype(np.int64))], names=["pre_token", "n"])

    found = docs.select(text).mapInArrow(count, "pre_token string, n long")
    return found.groupBy("pre_token").agg(F.sum("n").alias("n"))


def count_pieces(distinct: DataFrame, tokenizer: str, pre_token: str = "pre_token", out: str = "pieces") -> DataFrame:
    """Add the number of pieces of each distinct pre-token."""

    @F.arrow_udf("int")
    def pieces(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizer(tokenizer)
        for column in columns:
            made, words = [], strings(column)
            for k in range(0, len(words), 5000):
                made += [len(e) for e in t.encode_batch_fast(words[k : k + 5000], add_special_tokens=False)]
            yield pa.array(made, pa.int32())

    return distinct.withColumn(out, pieces(F.col(pre_token)))


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", limit: int = 512, head: int = HEAD
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, counted over whole texts.

    Null text counts as empty: no bytes, no tokens. Repeated rows and null ids
    each keep a row of their own. The commonest pre-tokens, at most ``head``, a
    fixed bound, go to the tasks as a broadcast; all other frequencies join the
    table of distinct pre-tokens in a shuffle, so no count is lost. An empty
    table gives an empty result. Other columns of ``docs`` don't take part.
    """
    spark = docs.sparkSession
    counted = written(count_pieces(pre_tokens(docs, tokenizer, text), tokenizer), "pre_tokens")
    common = counted.where(F.col("n") >= common_from(counted, head)).select("pre_token", "pieces").toArrow()
    shared = spark.sparkContext.broadcast((common["pre_token"].combine_chunks(), common["pieces"].to_numpy().astype(np.int64)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, (known, known_pieces) = Splitter(tokenizer), shared.value
        at = TaskContext.get().partitionId() << 40
        names = ["row_key", id_col, "n_bytes", "tokens", "pre_token", "times"]
        for part in text_blocks(batches, 1, BLOCK_BYTES):
            n = part.num_rows
            tokens, owner, row, chunks = splitter.split(part.column(1))
            found = pc.fill_null(pc.index_in(tokens, value_set=known), -1).to_numpy()
            of_chunk = np.zeros(int(owner.max(initial=-1)) + 1, dtype=np.int64)
            np.add.at(of_chunk, owner[found >= 0], known_pieces[found[found >= 0]])
            total = np.bincount(row, weights=of_chunk[chunks], minlength=n).astype(np.int64)
            sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
            empty = [pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int64))]
            yield pa.record_batch([pa.array(at + np.arange(n)), part.column(0), sizes, pa.array(total), *empty], names=names)
            # What the broadcast doesn't know: each chunk's tokens of that kind, with the number of times a row shows the chunk.
            rest = np.flatnonzero(found < 0)
            rest = rest[np.argsort(owner[rest], kind="stable")]
            many = np.bincount(owner[rest], minlength=len(of_chunk))
            first = np.cumsum(many) - many
            open_at = np.flatnonzero(many[chunks])
            key, times = np.unique(row[open_at] * len(of_chunk) + chunks[open_at], return_counts=True)
            row_of, chunk = np.divmod(key, max(1, len(of_chunk)))
            k = many[chunk]
            which = np.repeat(first[chunk] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(int(k.sum()))
            m = len(which)
            yield pa.record_batch(
                [
                    pa.array(at + np.repeat(row_of, k)),
                    pa.nulls(m, part.column(0).type),
                    pa.nulls(m, pa.int64()),
                    pa.array(np.zeros(m, np.int64)),
                    tokens.take(pa.array(rest[which])),
                    pa.array(np.repeat(times, k).astype(np.int64)),
                ],
                names=names,
            )
            at += n

    id_type = docs.schema[id_col].dataType.simpleString()
    parts = docs.select(id_col, text).mapInArrow(
        rows, f"row_key long, {id_col} {id_type}, n_bytes long, tokens long, pre_token string, times long"
    )
    # Rows that need no join get a key of their own: null keys would all meet in one task.
    keyed = parts.withColumn("join_key", F.coalesce("pre_token", F.concat(F.lit("\0\0row"), F.col("row_key"))))
    joined = keyed.join(counted.select(F.col("pre_token").alias("join_key"), "pieces"), "join_key", "left")
    lost = F.raise_error(F.lit("a pre-token has no count")).cast("int")
    pieces = F.when(F.col("pre_token").isNull(), 0).when(F.col("pieces").isNull(), lost).otherwise(F.col("pieces"))
    summed = joined.groupBy("row_key").agg(
        F.max(id_col).alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("tokens") + F.col("times") * pieces).alias("n_tokens")
    )
    return summed.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
