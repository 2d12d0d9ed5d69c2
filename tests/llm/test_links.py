"""Similarity joins and searches against brute force."""

import os
import random

import numpy as np
import pytest

from tidegrid.llm import mtree, ngram_jaccard, pivot_index
from tidegrid.llm.components import connected_components


def groups(links, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_equal_union_find(spark):
    rng = random.Random(0)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1080)] + [(2000, k) for k in range(2001, 2050)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = groups(links, {x for p in links for x in p})
    assert all(got.get(i, i) == c for i, c in want.items())
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def jaccard_brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if sets[a] and sets[b] and (o := len(sets[a] & sets[b])) * den >= num * (len(sets[a]) + len(sets[b]) - o)
    ]
    return {i: (len(sets[i]), c) for i, c in groups(links, ids).items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 3)))
    line = " ".join(word() for _ in range(15))
    rows, k = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One  two"), (5, "one two three"), (6, "x" * 3000)], 10
    for size in (2, 5, 40, 90):
        base = [word() for _ in range(60)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            rows.append((k, " ".join(words)))
            k += 1
    for _ in range(80):
        rows.append((k, " ".join(word() for _ in range(rng.randint(1, 40))) + " " + line))
        k += 1
    return rows + [(k + j, rows[20][1].upper()) for j in range(30)]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_jaccard_equals_brute_force(spark, corpus, monkeypatch, n, num, den):
    monkeypatch.setattr(ngram_jaccard, "COMMON_FROM", 6)
    df = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS node", "'x' AS gram").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard(df, n, num, den).collect()}
    assert got == jaccard_brute(corpus, n, num, den)


def test_jaccard_just_under_the_threshold(spark, monkeypatch):
    """A large group of near copies: one half links, the other is just too far from all; blocks of a few documents."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_NODES", 37)
    monkeypatch.setattr(ngram_jaccard, "CELLS", 3000)
    monkeypatch.setattr(ngram_jaccard, "PAIRS", 1000)
    monkeypatch.setattr(ngram_jaccard, "WORDS", 500)
    monkeypatch.setattr(ngram_jaccard, "AT_ONCE", 0.01)
    monkeypatch.setattr(ngram_jaccard, "HUBS", 1)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(500):
        words = list(base)
        # Each changed word changes four shingles: 2 or 3 leave 0.85 of two such documents or don't.
        for at in rng.sample(range(6, 112, 6), 2 if k % 2 else 3):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    long = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(3000)) for _ in range(3)]
    rows += [(1000 + k, long[k % 3] + f" tail{k}" * (k // 3)) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard(df).collect()}
    assert got == jaccard_brute(rows, 4, 85, 100)


def test_jaccard_pairs_of_a_large_group_never_become_rows(spark, monkeypatch):
    """No hub finds a link, so a whole group is left to its tasks: they hand on links that join it, not its pairs."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_NODES", 64)
    monkeypatch.setattr(ngram_jaccard, "_hub_pairs", lambda *a, f=ngram_jaccard._hub_pairs: f(*a).limit(0))
    seen = []
    monkeypatch.setattr(ngram_jaccard, "_still_apart", lambda p, c, f=ngram_jaccard._still_apart: (seen.append(p.count()), f(p, c))[1])
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(6, 112, 6), 1 if k % 2 else 2):
            words[at] = f"x{rng.randrange(10**6)}"
        rows += [(k, " ".join(words))] * (1 + (k < 3))
    rows += [(1000 + k, " ".join(f"y{k // 2}z{j}" for j in range(30 + k % 2))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard(df).collect()}
    assert got == jaccard_brute(rows, 4, 85, 100)
    assert seen and max(seen) <= 2 * len(rows)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(0)
    for size in (1, 5, 100, 900, 5000):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, size=size))
        y = np.unique(np.r_[x[: -(-size * 9 // 10)], rng.integers(-(2**63), 2**63 - 1, size=size // 8)])
        for words in (2, 16, 128):
            a, b = ngram_jaccard.parities(x, words), ngram_jaccard.parities(y, words)
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
            wide = ngram_jaccard.parities(x, 2 * words)
            assert (wide[0::2] ^ wide[1::2] == a).all()


def test_jaccard_rows_without_id_and_repeated_rows(spark):
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(7, t), (7, t), (9, t), (None, t), (11, "z y x w v")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard(df).collect())
    assert got == [("11", 2, 11), ("7", 7, 7), ("7", 7, 7), ("9", 7, 7), ("None", 7, None)]
    assert ngram_jaccard.ngram_jaccard(df.limit(0)).count() == 0


def vectors(seed=0, n=600, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    rows = []
    for k, v in enumerate(base):
        if k % 3 == 0 and k > 30:
            v = base[k % 7] + rng.normal(size=dim) * 0.1
        rows.append((k, [float(np.float32(x)) for x in v], k % 2))
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, None, 0), (n + 3, [0.0] * dim, 0), (n + 4, rows[3][1], None)]
    return rows + [(n + 5, [float("nan")] * dim, 0), (n + 6, [None] * dim, 0), (n + 7, [], 0), (n + 50, [1.0, 2.0], 0)]


def ok(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "LEAF", 16)
    monkeypatch.setattr(mtree, "PER_ROUTE", 100)
    monkeypatch.setattr(mtree, "QUERIES", 20)
    monkeypatch.setattr(mtree, "ROOTS", 3)
    monkeypatch.setattr(mtree, "CELLS", 50)
    monkeypatch.setattr(mtree, "SEGMENT", 60)
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS route", "2 AS page").repartition(3)
    got = sorted(tuple(r) for r in mtree.top_k(df, 5, 10).select("query_id", "rank", "vec_id", "score").collect())
    have = {i: np.floor(np.array(v) * 256) for i, v, _ in rows if ok(v)}
    want = []
    for q in have:
        if q % 10 == 0:
            s = sorted((-int(have[q] @ v), i) for i, v in have.items() if i != q and len(v) == len(have[q]))[:5]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert mtree.top_k(df.limit(0)).count() == 0


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 32)
    rows = vectors(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS named").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivot_index.near_duplicates(df).collect()}
    fine = [(i, np.array(v), y) for i, v, y in rows if ok(v) and any(v) and y is not None]
    unit = {i: (v / np.linalg.norm(v), y) for i, v, y in fine}
    links = [
        (a, b)
        for a in unit
        for b in unit
        if a < b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.93
    ]
    comp = groups(links, [r[0] for r in rows])
    assert got == {i: (sum(i in p for p in links), c, c == i) for i, c in comp.items()}
    assert pivot_index.near_duplicates(df.limit(0)).count() == 0


def test_recall_near_the_threshold(spark):
    """Pairs at cosines from 0.93 to 0.96 among random vectors: at least nine in ten are found."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(1500):
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        u = rng.normal(size=64)
        u -= (u @ v) * v
        u /= np.linalg.norm(u)
        c = rng.uniform(0.931, 0.96)
        rows += [(2 * k, v.tolist(), 0), (2 * k + 1, (c * v + np.sqrt(1 - c * c) * u).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    found = pivot_index.near_duplicates(df).where("n_links > 0").count()
    assert found >= 0.9 * len(rows)


def test_ngram_jaccard_leaves_no_intermediate_rows_and_no_list_made_in_python(spark, monkeypatch):
    def files():
        return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")

    shared = ngram_jaccard.written(spark.range(1), "probe").inputFiles()[0].rpartition("/")[0].rpartition("/")[0].removeprefix("file://").removeprefix("file:")
    held, seen = set(os.listdir(shared)), []
    monkeypatch.setattr(ngram_jaccard, "connected_components", lambda *a, f=ngram_jaccard.connected_components: (seen.append(files()), f(*a))[1])
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("an empty list starts Python workers of another kind"))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, first = spark.conf.get(key), files()
    out = ngram_jaccard.ngram_jaccard(spark.range(400).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(0, 40), x -> string(x + id div 4 * 50 + if(x = 40, id, 0)))) text"))
    assert out.where("component_id = doc_id").count() == 100
    assert seen and max(seen) <= first
    assert spark.conf.get(key) == before
    left = {x.rpartition("_")[0] for x in set(os.listdir(shared)) - held}
    assert "jaccard_found" in left and not left & {"jaccard_sets", "jaccard_lists", "jaccard_open", "jaccard_reps"}
