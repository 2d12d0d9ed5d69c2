"""Toxicity by compression distance (operator 9).

Two zstandard dictionaries are trained apart: one on windows of ordinary text,
one on the narrow windows of toxic text that hold what toxic documents show far
more often than others. Each window of a text is compressed with the ordinary
dictionary and with both; where the toxic one saves bytes, the window is
evidence. The evidence of all windows, weighed by how often labelled text shows
each saving, gives a calibrated score. Words too rare to be told from chance
are no evidence; the README gives figures.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import give_back
from tidegrid.llm.ngram_jaccard import GramHasher

#: Labelled documents to learn from, at most so many of each class, and the longest text among them in bytes.
SAMPLE_DOCS = 3000
SAMPLE_BYTES = 20_000
#: Bytes of a window (it ends at the next space), of the dictionary of ordinary text, and the compression level.
WINDOW = 64
ORDINARY_BYTES = 32_768
#: The same of the narrow windows that the toxic dictionary is trained on.
TOXIC_WINDOW = 8
TOXIC_BYTES = 2_048
LEVEL = 9
#: Savings outside these count as the nearest of them.
LEAST, MOST = -3, 12
#: Windows with a word stem of at least this standard score of its document counts train the toxic dictionary.
STEM_Z = 7.0
#: Least shingle hashes of a text that are compared to find near-equal texts, and groups that make a shingle common.
SKETCH = 64
COMMON_GROUPS = 8

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """Both dictionaries, the weight of each saving, and the logistic calibration."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    slope: float
    bias: float


def normalised(text: str | None) -> bytes:
    return (" " + " ".join((text or "").lower().split())).encode("utf-8", "replace")


def windows(raw: bytes, size: int = WINDOW) -> list[bytes]:
    """The text in consecutive windows that end before a space, at most twice ``size`` long; all bytes are in one."""
    out, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + size)
        if end < n:
            space = raw.find(b" ", end, min(n, at + 2 * size))
            end = min(n, at + 2 * size) if space < 0 else space
        out.append(raw[at:end])
        at = end
    return out or [b""]


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    import zstandard as zs

    made = []
    # The toxic side sees the ordinary dictionary as well, so only toxic text sets the two apart. Both are plain
    # content here: a trained dictionary's tables of symbols would set the two sides apart by more than their texts.
    for content in (ordinary, ordinary + toxic):
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        p = zs.ZstdCompressionParameters.from_level(LEVEL, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)
        d.precompute_compress(compression_params=p)
        made.append(zs.ZstdCompressor(dict_data=d, compression_params=p).compress)
    return tuple(made)


def savings(ordinary: bytes, toxic: bytes, text: str | None) -> np.ndarray:
    """Per window: bytes that the toxic dictionary saves, from LEAST to MOST, as indexes from 0."""
    plain, tox = _compressors(ordinary, toxic)
    got = [len(plain(w)) - len(tox(w)) for w in windows(normalised(text))]
    return np.clip(np.array(got, dtype=np.int64), LEAST, MOST) - LEAST


def _stems(text: str) -> set[str]:
    return {w[:k] for w in set(_LETTERS.findall(text.lower())) for k in range(4, min(len(w), 12) + 1)}


def text_groups(texts: list[str]) -> list[int]:
    """Per text the place of the first text of its group; equal and near-equal texts are one group.

    Near-equal: at least half of the least hashes of its three-word shingles
    are a group's, shingles that COMMON_GROUPS groups show left aside.
    """
    hasher, keys = GramHasher(3), [normalised(t) for t in texts]
    held = {}
    for key, t in zip(keys, texts, strict=True):
        if key not in held:
            held[key] = np.array(hasher.grams(t)[:SKETCH], dtype=np.int64)
    # A shingle that one text alone shows leads to no other text, so only the others' owners are kept.
    _, which, shown = np.unique(np.concatenate([np.zeros(0, np.int64), *held.values()]), return_inverse=True, return_counts=True)
    cuts = np.cumsum([len(h) for h in held.values()])[:-1]
    several = dict(zip(held, np.split(shown[which] > 1, cuts) if held else [], strict=True))
    first, owners, out = {}, {}, []
    for k, key in enumerate(keys):
        if key not in first:
            sketch = [h for h in held[key][several[key]].tolist() if len(owners.get(h, ())) < COMMON_GROUPS]
            size = int((~several[key]).sum()) + len(sketch)
            shared = Counter(g for h in sketch for g in owners.get(h, ()))
            best = max(shared.items(), key=lambda x: (x[1], -x[0]), default=(k, 0))
            first[key] = best[0] if 0 < size <= 2 * best[1] else k
            for h in sketch:
                owners.setdefault(h, set()).add(first[key])
        out.append(first[key])
    return out


def _votes(texts: list[tuple[str, int]], only: set[str] | None = None) -> tuple[Counter, int]:
    """Stems (of ``only``, if given) with the number of groups that show them, and the number of groups; ``texts`` are (text, group).

    One group's stems are held at a time.
    """
    members: dict[int, list[str]] = {}
    for t, g in texts:
        members.setdefault(g, []).append(t)
    counts: Counter = Counter()
    for group in members.values():
        stems = {w for t in group for w in _stems(t)}
        counts.update(stems if only is None else stems & only)
    return counts, max(1, len(members))


def telling_stems(toxic: list[tuple[str, int]], ordinary: list[tuple[str, int]]) -> list[str]:
    """Word stems that toxic texts show far more often, best first; of one word's stems the most telling, then the longest.

    Both lists hold (text, group); copies of one text, being one group, have one vote.
    """
    in_toxic, n = _votes(toxic)
    often = {w: c for w, c in in_toxic.items() if c >= 5}
    in_ordinary, m = _votes(ordinary, set(often))
    telling = []
    for w, c in often.items():
        p = (c + in_ordinary[w]) / (n + m)
        z = (c / n - in_ordinary[w] / m) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n + 1 / m))
        if z >= STEM_Z:
            telling.append((-round(z, 1), -len(w), w))
    kept: list[str] = []
    for _, _, w in sorted(telling):
        if not any(w.startswith(v) or v.startswith(w) for v in kept):
            kept.append(w)
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a one-dimensional logistic fit, lightly drawn to slope 1; ``share`` is each row's weight."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = share * (p * (1 - p) + 1e-9)
        e = share * (p - y)
        g = np.array([(e * x).sum() + 0.1 * (a - 1), e.sum() + 0.001 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.001]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of at most ``size`` bytes, trained by zstandard on all samples; too few to train on are taken as they are."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def learn(texts: list[tuple[str, int]], toxic_share: float, seed: int = 0) -> ToxicityModel | None:
    """A model from labelled texts: half of the groups train the dictionaries, a quarter weighs savings, the rest calibrate.

    None where a class is missing. ``toxic_share`` is the share of label 1 among
    all labelled rows, which the sample doesn't keep.
    """
    order = sorted(texts)
    random.Random(seed).shuffle(order)
    groups = text_groups([t for t, _ in order])
    number = {g: k for k, g in enumerate(dict.fromkeys(groups))}
    copies = Counter((g, bool(y)) for g, (_, y) in zip(groups, order, strict=True))
    # (text, label, group, vote): the copies of a text share one vote in each class, and learn or calibrate together.
    voting = [(t, bool(y), g, 1 / copies[g, bool(y)]) for g, (t, y) in zip(groups, order, strict=True)]
    base_part = [x for x in voting if number[x[2]] % 4 in (1, 2)]
    fit = [x for x in voting if number[x[2]] % 4 == 3]
    rest = [x for x in voting if number[x[2]] % 4 == 0]
    toxic, ordinary = [(t, g) for t, y, g, _ in base_part if y], [(t, g) for t, y, g, _ in base_part if not y]
    if not toxic or not ordinary or not 0 < toxic_share < 1:
        return None
    once = {g: t for t, g in reversed(ordinary)}  # the first text of each group
    pool = [w for t in once.values() for w in windows(normalised(t))]
    random.Random(seed).shuffle(pool)
    base = _trained(ORDINARY_BYTES, pool)
    kept = b""
    if stems := telling_stems(toxic, ordinary):
        telling = re.compile(b"|".join(re.escape((" " + w).encode()) for w in stems))
        first = {g: t for t, g in reversed(toxic)}
        narrow = [w for t in first.values() for w in windows(normalised(t), TOXIC_WINDOW) if telling.search(w)]
        random.Random(seed).shuffle(narrow)
        kept = _trained(TOXIC_BYTES, narrow)
    bins = MOST - LEAST + 1
    seen = [np.ones(bins), np.ones(bins)]
    for t, y, _, vote in fit:
        seen[int(y)] += vote * np.bincount(savings(base, kept, t), minlength=bins)
    weights = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    weights = np.where(np.arange(bins) + LEAST <= 0, np.minimum(weights, 0.0), weights)
    x = np.array([min(30.0, max(-30.0, float(weights[savings(base, kept, t)].sum()))) for t, _, _, _ in rest])
    y = np.array([float(v) for _, v, _, _ in rest])
    if y.min(initial=1) == y.max(initial=0):
        slope, bias = 1.0, 0.0
    else:
        slope, bias = _logistic(x, y, np.array([vote for _, _, _, vote in rest]))
    share = sum(vote for _, v, _, vote in voting if v) / sum(vote for _, _, _, vote in voting)
    bias += math.log(toxic_share / (1 - toxic_share)) - math.log(share / (1 - share))
    return ToxicityModel(base, kept, tuple(float(w) for w in weights), slope, bias)


def score_text(model: ToxicityModel, text: str | None) -> float:
    x = float(np.array(model.weights)[savings(model.ordinary, model.toxic, text)].sum())
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, model.slope * min(30.0, max(-30.0, x)) + model.bias))))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that nothing is learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel | None:
    """Learn from a bounded sample: the first SAMPLE_DOCS labelled ids of each class by hash, held-out rows left out.

    Rows with a null id or label teach nothing; an id labelled twice counts by
    its highest label; texts over SAMPLE_BYTES bytes are scored but not learned
    from.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
        .groupBy(id_col)
        .agg(F.max(label).cast("int").alias("_y"))
    )
    total = known.agg(F.count("*"), F.sum("_y")).first()
    if not total[0] or not total[1]:
        return None
    ids = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCS)
        ids = part if ids is None else ids.union(part)
    rows = (
        docs.where(F.octet_length(text) <= SAMPLE_BYTES)
        .select(id_col, text)
        .join(F.broadcast(ids), id_col)  # two classes of at most SAMPLE_DOCS ids
        .orderBy(F.xxhash64(id_col), text)
        .limit(2 * SAMPLE_DOCS)
        .select(text, "_y")
        .collect()
    )
    try:
        return learn([(r[0], r[1]) for r in rows], total[1] / total[0])
    finally:
        del rows
        _compressors.cache_clear()
        give_back()  # the driver goes on for long without what the training took


def with_scores(docs: DataFrame, model: ToxicityModel | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the probability of label 1, from the whole text alone. Null counts as empty; no model gives 0."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([score_text(model, t.as_py()) for t in column], pa.float64())

    return docs.withColumn(out, scores(F.col(text)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row; repeated rows and null ids keep rows of their own."""
    scored = with_scores(docs.select(id_col, text), train(docs, labels, id_col, text), text, "score")
    return scored.select(
        id_col,
        F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
