"""The filter interaction audit against plain Python."""

import itertools
import random
import re

import pytest

from tidegrid.llm import filter_audit


def plain_masks(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = (len(words) < 100) * 1 + (100 * len(set(words)) < 80 * len(words)) * 2
        mask += (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) * 4 + bool(re.search(r"[#$%&*|]", t)) * 8
        mask += (i is not None and i > least[t]) * 16
        out.append((i, part or "", mask))
    return out


def plain_audit(masks, labels):
    out = {}
    for part in {p for _, p, _ in masks}:
        mine = [(i, m) for i, p, m in masks if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            before = 0
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                gone = [i for i, m in mine if m & bit and not m & before]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    sum(not m & (bit | before) for _, m in mine),
                    len(gone),
                    sum(bool(m & bit and m & before) for _, m in mine),
                    sum(m == bit for _, m in mine),
                    sum(any(q == 1 for q, _ in labels.get(i, [])) for i in gone),
                    sum(any(t == 1 for _, t in labels.get(i, [])) for i in gone),
                ]
                before |= bit
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def sample(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé😀XYZ") for _ in range(rng.randint(1, 5)))
    texts = ["", " \t\n\x0b ", "A" * 30, "one two three", "x" * 200_000, " ".join(word() for _ in range(150)), "#" + " ".join(word() for _ in range(110))]
    texts += [" ".join(str(k) for k in range(120)), " ".join(str(k) for k in range(120)) + "\x00", "w " * 120 + "&"]
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, *texts, texts[5], texts[5], texts[5]]), rng.choice(["en", "de", None, ""])) for _ in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_audit_equals_brute_force(spark, parts):
    rows = sample(parts, 300)
    labels = {k: [(k % 2, k % 3 == 0)] for k in range(0, 300, 2)}
    labels[4] += [(1, 1), (None, 0)]
    flat = [(i, q, int(t)) for i, x in labels.items() for q, t in x] + [(None, 1, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, lang string, mask string, head int")
        got = filter_audit.filter_audit(docs, spark.createDataFrame(flat, "doc_id long, quality int, toxic int")).collect()
        masks = filter_audit.failure_masks(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain_masks(rows)
    assert sorted(map(tuple, masks), key=repr) == sorted(want, key=repr)
    assert {(r.part, r.filter_order, r.step): [r[c] for c in NAMES] for r in got} == plain_audit(want, labels)
    assert len(got) == 600 * 3


def test_runs_go_on_over_batches():
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((rng.choice("aab"), rng.choice([3, 4, 9, 10**6])) for _ in range(60))  # 10**6 stands for a null id
    least = {t: min(i for u, i in rows if u == t) for t, _ in rows}
    for size in (1, 2, 7, 60):
        runs, got, heads = filter_audit.RunsOfEquals(), [], []
        for k in range(0, 60, size):
            part = rows[k : k + size]
            later, head = runs.step(pa.array([t for t, _ in part]), pa.array([None if i == 10**6 else i for _, i in part], pa.int64()))
            got, heads = got + later.tolist(), heads + head.tolist()
        assert got == [i != 10**6 and i > least[t] for t, i in rows]
        assert heads == [t == rows[0][0] for t, _ in rows]
        assert (str(runs.first), str(runs.last), runs.single) == ("a", "b", False)


def test_a_range_that_one_run_fills_hands_its_beginning_on(spark):
    ends = [(0, "a", "b", 7, False), (2, "b", "b", 8, True), (3, "b", "b", None, True), (5, "b", "c", 2, False), (6, "d", "d", 1, True), (7, "d", "d", 1, True)]
    got = filter_audit._carried(spark.createDataFrame(ends, "range int, first string, last string, last_id long, single boolean")).collect()
    assert sorted(map(tuple, got)) == [(2, 7), (3, 7), (5, 7), (7, 1)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    got = filter_audit.filter_audit(one, labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""}
    assert {r.removed for r in got if r.step == 1} == {0, 1}
