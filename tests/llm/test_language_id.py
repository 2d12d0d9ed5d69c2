"""Language identification against a letter-by-letter version, and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import language_id, queries

SF = "/root/testdata/sf0.001"


def plain_profile(text):
    """The profile of one text, n-gram by n-gram."""
    low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else None for c in text]
    of = lambda c: language_id.letter_vectors(np.array([ord(c) if c else 0]))[0].astype(int)
    out = np.zeros(language_id.DIM)
    for k, c in enumerate(low):
        if c:
            before, after = (low[k - 1] if k else None), (low[k + 1] if k + 1 < len(low) else None)
            out += np.roll(of(before), 2) * np.roll(of(c), 1) * of(after)
    return out


TEXTS = ["", "Hello, wörld! 123", "a", "Ⅷ ǅ İx ß", "日本語のテキスト", "naïve\n\nNAÏVE", "😀", "x" * 50 + "é" * 50 + " y", "ab cd\x00ef"]


def test_profiles_equal_plain_sums(monkeypatch):
    got, letters = language_id.profiles(TEXTS, np.arange(len(TEXTS)), len(TEXTS))
    want = np.array([plain_profile(t) for t in TEXTS])
    assert (got == want).all()
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in TEXTS]
    for piece, held, cells in ((1, 3, 5), (2, 8, 1), (7, 10**6, 40)):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "HELD", held)
        monkeypatch.setattr(language_id, "CELLS", cells)
        assert (language_id.profiles(TEXTS, np.arange(len(TEXTS)), len(TEXTS))[0] == want).all()
    both = language_id.profiles(TEXTS, np.array([0, 1] * 4 + [0]), 2)[0]
    assert (both == [want[::2].sum(axis=0), want[1::2].sum(axis=0)]).all()


def test_large_alphabets_are_coded_alike():
    text = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 300)) * 2
    got, _ = language_id.profiles([text], np.zeros(1, int), 1)
    assert (got[0] == plain_profile(text)).all()


def test_letter_vectors_are_balanced_and_apart():
    v = language_id.letter_vectors(np.arange(200)).astype(int)
    assert np.abs(v.mean(axis=1)).max() < 0.15
    near = v @ v.T / language_id.DIM - np.eye(200)
    assert np.abs(near).max() < 0.2


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 for r in docs}
    made = {r.doc_id: language_id.profiles([r.text], np.zeros(1, int), 1)[0][0] for r in docs}
    names = sorted({r.lang for r in docs})
    sums = np.array([sum(made[r.doc_id] for r in docs if r.lang == n and fold[r.doc_id] != 2) for n in names])
    sums /= np.linalg.norm(sums, axis=1, keepdims=True)
    got = queries.op13_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        cosine = sums @ made[r.doc_id] / max(1e-12, np.linalg.norm(made[r.doc_id]))
        assert r.held_out == (fold[r.doc_id] == 2)
        assert r.lang_pred == names[int(cosine.argmax())]
        assert r.score == pytest.approx(max(0, cosine.max()))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op13_language_id(spark, sf).collect() if r.held_out]
    right = sum(truth[r.doc_id] == r.lang_pred for r in held)
    assert len(held) > 2000 and right >= 0.995 * len(held)


def test_edge_cases(spark):
    words = {"en": "the house is over there and it was good", "fr": "la maison est là et elle était bonne", None: "zzz"}
    rows = [(k, t, l) for k, (l, t) in enumerate(list(words.items()) * 20)]
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !", "en"), (1003, "the house " * 300_000, "en"), (1003, "the house", "en"), (None, "la maison", "fr"), (None, "x", None)]
    docs = spark.createDataFrame([(*r, "a", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language_id.language_id(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred) for r in got if (r.doc_id or 0) >= 1000 or r.doc_id is None}
    assert {(1000, "und"), (1001, "und"), (1002, "und"), (1003, "en"), (None, "fr")} <= by
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert language_id.language_id(docs.limit(0)).count() == 0
    unknown = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "the house", "en", "keep")], "doc_id long, text string, lang string, `a b` string")
    model = language_id.train(docs)
    got = language_id.with_language(docs, model).first()
    assert got["a b"] == "keep" and got.lang == "en" and got.lang_pred == "en" and got.score > 0.99
