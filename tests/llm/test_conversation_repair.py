"""Conversation repair against a plain shortest-path search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidegrid.llm import conversation_repair as cr

GOES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_repair(rows):
    """Counts, cost, edits and repaired text of one conversation's (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    # Least (cost, letters, messages) by state, gap by gap.
    best = {0: (0, "", ())}
    for k in range(len(rows) + 1):
        for _ in range(4):
            for q, (cost, letters, made) in list(best.items()):
                for x, to in GOES[q].items():
                    if x != "s":
                        new = (cost + 2, letters + "I", (*made, ({"u": "user", "a": "assistant"}[x] + ":")))
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        if k == len(rows):
            break
        (_, role, text), kind, after = rows[k], kinds[k], {}
        for q, (cost, letters, made) in best.items():
            steps = [(3, "D", made, q)]
            if kind not in ("blank", "duplicate"):
                more = kind == "truncated"
                if role[:1] in GOES[q]:
                    steps.append((more, "K", (*made, f"{role}:{text}"), GOES[q][role[:1]]))
                steps += [(2 + more, "R", (*made, f"{n}:{text}"), GOES[q][n[0]]) for n in ("user", "assistant") if n[0] in GOES[q]]
            for c, x, m, to in steps:
                new = (cost + c, letters + x, m)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    cost, letters, made = min(best[q] for q in (0, 3) if q in best)
    counts = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal]
    return (*counts, cost, letters, hashlib.sha256("\n".join(made).encode()).hexdigest())


COLS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def compare(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, costs int")
    got = {r.conv_id: tuple(r[c] for c in COLS) for r in cr.audit(df, df).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = plain_repair([(t, " " if role is None else role, " " if text is None else text) for i, t, role, text in rows if i == c])
    assert got == want


def sample(seed, n, convs, turns=8):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Ärger", "ua"]
    texts = ["Hi there.", "ok", "", " \n", None, "é?", "yes! \t", "no", "😀", "a.b", "what\x00"]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(turns)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_short_conversations(spark):
    compare(spark, sample(1, 900, 150))


@pytest.mark.parametrize("rows,bytes_", [(1, 10**6), (3, 10**6), (10**6, 4)])
def test_long_conversations_over_chunks_and_ranges(spark, monkeypatch, rows, bytes_):
    monkeypatch.setattr(cr, "CHUNK_ROWS", rows)
    monkeypatch.setattr(cr, "CHUNK_BYTES", bytes_)
    made = sample(2, 500, 4, 60) + [(7, 3, "user", "Again.")] * 40
    compare(spark, made)
    pieces = cr.repair(spark.createDataFrame(made, "conv_id long, turn long, role string, text string"))
    assert pieces.where("not whole").count() >= 40


def test_walks_equal_plain_search_on_random_codes():
    rng = np.random.default_rng(3)
    texts = {0: "Yes.", 4: "yes"}
    for _ in range(300):
        codes = rng.integers(0, 9, rng.integers(0, 12))
        rows = [(k, ["s", "u", "a", "x"][c % 4] if c < 8 else "u", f"{k} {texts[c // 4 * 4]}" if c < 8 else "") for k, c in enumerate(codes.tolist())]
        offsets = np.array([0, len(codes)])
        before, behind = np.array([[0, cr.FAR, cr.FAR, cr.FAR]]), cr.TO_END[None]
        total = (cr._times(cr._times(before, cr.transfer(codes, offsets)), cr.GAP) + np.where(cr.ENDS, 0, cr.FAR)).min(axis=1)
        walk = cr.Walk(codes, offsets, before, behind, total, np.zeros(1, int), np.ones(1, bool))
        want = plain_repair(rows)
        assert (int(total[0]), walk.letters.astype(np.uint8).tobytes().decode()) == want[5:7]


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(12) for t in range(8)] + [(None, 1, None, None), (3, None, "system", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [row] * (1 + (kind == 3))
    assert sorted(map(tuple, cr.damaged(df).collect()), key=repr) == sorted(want, key=repr)


def test_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.audit(empty, empty).count() == 0
    ids = spark.createDataFrame([(5,), (5,), (None,)], "conv_id long")
    got = sorted(cr.audit(empty, ids).collect(), key=repr)
    assert len(got) == 2 and {r.cost for r in got} == {0} and {r.audit for r in got} == {""}
    assert {r.repaired_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    compare(spark, [(1, 1, "user", "word " * 400_000), (1, 2, "assistant", "Fine."), (2, None, None, None)])


def test_messages_come_back_in_order(spark):
    rows = [(1, 2, "user", "Hi."), (1, 3, "user", "More."), (1, 5, "assistant", "Good.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = cr.repaired_messages(cr.repair(df)).orderBy("conv", "range", "chunk", "place").collect()
    assert [(r.role, r.text) for r in got] == [("user", "Hi."), ("assistant", ""), ("user", "More."), ("assistant", "Good.")]
