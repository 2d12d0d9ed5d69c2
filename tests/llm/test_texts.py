"""Tokenising, counting, packing, sharding: against the libraries and exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import packing, sentence_pieces, sharding, token_counts
from tidegrid.llm.common import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
WORDS = tokenizer_path("word_bpe_49k.json")
BYTES = tokenizer_path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(0)
    signs = "ab 日本▁\n\t  e̊é😀zq\x00ﬁthe \x1c 'sİΣ,.!9"
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    out += [" " * k for k in range(40)] + ["ab" * k + " " * k for k in range(20)] + ["a" * 3000, "the" * 1000, "x<|endoftext|>y<|startoftext|> z"]
    return out + ["".join(rng.choice("abcdefghinorst") for _ in range(2000)) for _ in range(3)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}", 0) for k, t in enumerate(odd_texts())]
    rows += [(900, None, None, 0), (901, "", "s1", 0), (902, "twice", "s1", 0), (902, "twice", "s1", 0), (None, "no id", "s2", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens long").repartition(3).cache()


def all_rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_pieces_equal_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentence_pieces.encode_decode(docs, PIECES).collect()
    want = sorted((str(i), sp.encode(t, add_eos=True), sp.decode(sp.encode(t, add_eos=True))) for i, t in all_rows(docs))
    assert sorted((str(r.doc_id), r.token_ids, r.decoded) for r in got) == want
    two_steps = sentence_pieces.decode(sentence_pieces.encode(docs, PIECES, out="tokens"), PIECES, "tokens")
    assert sorted((str(r.doc_id), r.tokens, r.decoded) for r in two_steps.collect()) == want


def test_pieces_when_the_memory_of_words_is_short(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(sentence_pieces, "MAX_WORDS", 10)
    texts = odd_texts()
    for _ in range(2):
        flat, ends = sentence_pieces.encode_texts(PIECES, texts)
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == sp.encode(texts, add_eos=True)


def test_bytes_that_are_no_text_decode_as_the_library_does():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m = sentence_pieces.load_model(PIECES)
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(259, 31999), 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        assert m.decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)])) == [sp.decode(ids)], ids
    space = sp.piece_to_id("▁")
    many = [[215, 1, 188], [5000, 0, 5000], [0], [], [1, 2], [35, 5000], [2, 5000], [space, space, 5000], [space], [1, 215, 188], [215], [188, 2, 215, 1, 188]]
    many += [[rng.choice([rng.randint(190, 230), rng.randint(130, 195), 1, space]) for _ in range(rng.randint(0, 9))] for _ in range(2000)]
    flat = np.array([i for ids in many for i in ids], dtype=np.int64)
    assert m.decode(flat, np.r_[0, np.cumsum([len(ids) for ids in many])]) == [sp.decode(ids) for ids in many]


def test_a_very_long_word_is_merged_in_time():
    import sentencepiece

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghinorst") for _ in range(60_000)), "ab" * 50_000, "é" * 9_000]
    flat, ends = sentence_pieces.encode_texts(PIECES, words, True)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [sp.encode(w, add_eos=True) for w in words]


@pytest.mark.parametrize("head", [0, 5, 100_000])
def test_token_counts_equal_the_library(docs, head):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    got = token_counts.token_counts(docs, BYTES, head=head, limit=20).collect()
    want = sorted(
        (str(i), len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 20) for i, x in all_rows(docs)
    )
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def check_pieces(rows, ids_of, window):
    """Every id in exactly one piece; windows gapless, full but for the last. ``ids_of``: id -> list of copies."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert any(zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for ids in ids_of[r.doc_id])
    for i, copies in ids_of.items():
        covered = sorted((r.start, r.length) for r in by_doc[i])
        assert sum(n for _, n in covered) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for start, n in covered:
                assert start == at
                at += n
    assert sorted(by_seq) == list(range(len(by_seq)))
    for seq, parts in by_seq.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or seq == len(by_seq) - 1


@pytest.mark.parametrize("weights", [None, {"s0": 5.0, "s1": 1.0}])
def test_packing_covers_every_id_once(docs, weights):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    ids_of = {}
    for i, x in all_rows(docs):
        ids_of.setdefault(i, []).append(t.encode(x, add_special_tokens=False).ids + [1])
    check_pieces(packing.pack(docs, WORDS, window=64, weights=weights).collect(), ids_of, 64)


def test_windows_hold_the_target_mixture(spark):
    rows = [(k, "word " * 30, ("a", "a", "a", "b")[k % 4]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    share = {}
    for r in packing.pack(df, WORDS, window=128).collect():
        share.setdefault(r.sequence_id, {}).setdefault(r.source_queue, 0)
        share[r.sequence_id][r.source_queue] += r.length
    full = [share[k] for k in sorted(share)[:-1]]
    assert all(abs(x["a"] - 96) <= 2 and abs(x["b"] - 32) <= 2 for x in full)


def test_many_sources_share_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    df = spark.createDataFrame([(k, "a b c", f"s{k}") for k in range(40)], "doc_id long, text string, source string")
    out = packing.pack(df, WORDS, window=16).collect()
    assert len({r.source_queue for r in out}) <= 4 and sum(r.length for r in out) == 160


def test_weights_hold_among_many_sources(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    rows = [(k, "word " * 30, ("a", "a", "a", "b")[k % 4]) for k in range(400)] + [(k, "word", f"s{k}") for k in range(400, 440)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = packing.pack(df, WORDS, window=128, weights={"a": 1.0, "b": 1.0, "absent": 9.0}).collect()
    assert {"a", "b"} < {r.source_queue for r in out} and len({r.source_queue for r in out}) <= 6
    share = {}
    for r in out:
        share.setdefault(r.sequence_id, {"a": 0, "b": 0}).setdefault(r.source_queue, 0)
        share[r.sequence_id][r.source_queue] += r.length
    assert all(abs(share[k]["a"] - 64) <= 2 and abs(share[k]["b"] - 64) <= 2 for k in range(40))
    assert sum(r.length for r in out) == sum(30 + 1 for _ in range(400)) + 40 * 2


@pytest.mark.parametrize("quanta", [[1, 60_000, 8 << 16], [3 << 16, 90_000, 65_535]])
def test_slow_queues_are_laid_out_by_token(quanta):
    import tracemalloc

    held, quanta = np.array([70, 50, 300]), np.array(quanta)
    # One round after another, as the method is told.
    place, at, credit, given = {}, 0, [0, 0, 0], [0, 0, 0]
    while at < held.sum():
        for k in range(3):
            credit[k] += int(quanta[k])
            while credit[k] >= 1 << 16 and given[k] < held[k]:
                place[k, given[k]] = at
                credit[k], given[k], at = credit[k] - (1 << 16), given[k] + 1, at + 1
        if [g >= h for g, h in zip(given, held)] == [False, True, True]:
            for t in range(given[0], held[0]):
                place[0, t], at = at, at + 1
            given[0] = held[0]
    queue, begin, size = np.array([0, 0, 1, 2, 2]), np.array([0, 40, 0, 0, 123]), np.array([40, 30, 50, 123, 177])
    tracemalloc.start()
    doc, start, length, seq, offset = packing.pieces_of(begin, size, queue, held, quanta, 16)
    assert tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()
    got = {(queue[d], begin[d] + s + k): q * 16 + o + k for d, s, n, q, o in zip(doc, start, length, seq, offset) for k in range(n)}
    assert got == place


def test_shards_are_even_and_gapless(docs):
    rows = sharding.shard(docs, 4).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == [0, 1, 2, 3] and len(rows) == docs.count()
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    total = [sum(r["size"] for r in v) for v in by.values()]
    assert max(total) - min(total) <= max(r["size"] for r in rows)
    texts = {(i, zlib.crc32(t.encode()), len(t.encode()) + 16) for i, t in all_rows(docs)}
    assert {(r.doc_id, r.text_crc32, r["size"]) for r in rows} == texts


def test_rebalancing_moves_few_slots():
    rng = random.Random(1)
    load = [rng.randint(50, 150) for _ in range(512)]
    start = sharding.first_map(8, 512)
    edited = sharding.rebalance(start, load, 8)
    total = [sum(x for x, s in zip(load, edited) if s == k) for k in range(8)]
    assert max(total) - min(total) <= 2 and sum(a != b for a, b in zip(start, edited)) < 100
    grown = sharding.rebalance(edited, load, 9)
    assert set(grown) == set(range(9))


def test_maps_are_kept_by_version(spark, docs, tmp_path):
    path = str(tmp_path / "maps")
    assert sharding.load_map(spark, path) == (-1, [])
    first = sharding.shard(docs, 4, slots=64, map_path=path).select("doc_id", "text_crc32", "vslot", "shard").distinct().collect()
    version, edited = sharding.load_map(spark, path)
    assert version == 1 and sharding.load_map(spark, path, 0) == (0, sharding.first_map(4, 64))
    # Another run starts from the last version, and rows stay where they are.
    again = sharding.shard(docs, 4, slots=64, map_path=path).select("doc_id", "text_crc32", "vslot", "shard").distinct().collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and sharding.load_map(spark, path) == (1, edited)
    grown = sharding.shard(docs, 5, slots=64, map_path=path).select("shard").distinct().count()
    moved = [a != b for a, b in zip(edited, sharding.load_map(spark, path)[1], strict=True)]
    assert grown == 5 and sharding.load_map(spark, path)[0] == 2 and 0 < sum(moved) < 40
    with pytest.raises(ValueError):
        sharding.load_map(spark, path, 9)


def test_one_row_repeated_without_end_is_spread(spark):
    df = spark.range(6000).selectExpr("CASE WHEN id < 4000 THEN 7 ELSE id END AS doc_id", "CASE WHEN id < 4000 THEN 'same' ELSE repeat('x', 4) END AS text")
    out = sharding.shard(df, 10).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r.size for r in x) for x in by.values()]
    assert len(out) == 6000 and len(by) == 10 and max(sizes) <= 1.05 * min(sizes)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sentence_pieces.encode_decode(empty, PIECES).count() == 0
    assert token_counts.token_counts(empty, BYTES).count() == 0
    assert packing.pack(empty, WORDS).count() == 0
    assert sharding.shard(empty, 4).count() == 0


def test_merge_rounds_look_up_only_pairs_that_they_make():
    from tidegrid.llm.merge_rounds import MergeTable

    asked = []

    class Counting(MergeTable):
        def joined(self, left, right):
            asked.append(len(left))
            return super().joined(left, right)

    # Pairs 0 0, 1 1, ... make ever longer runs; 20 and 21 never merge.
    table = Counting(64, [(k, k, k, k + 1) for k in range(10)] + [(20, 0, 30, 22), (3, 2, 31, 23)])
    rng = np.random.default_rng(3)
    words = [rng.choice([0, 0, 0, 0, 0, 0, 0, 20, 21], size=n) for n in rng.integers(1, 300, size=200)]
    lengths = np.array([len(w) for w in words])
    flat, counts = table.merge(np.concatenate(words), lengths)
    assert sum(asked) < 3 * lengths.sum()  # all pairs in each round are over five times as many
    asked.clear()
    ends = np.cumsum(counts)
    for w, a, b in zip(words, ends - counts, ends, strict=True):
        assert flat[a:b].tolist() == table.merge_one(w)


def test_packing_of_plain_text_leaves_the_library_unloaded():
    packing._tokenizer.cache_clear()
    coder = packing.ChunkIds(WORDS)
    flat, ends = coder.encode(pa.array(["Plain words, 12 of them.", None]), 1)
    assert packing._tokenizer.cache_info().currsize == 0
    assert flat[: ends[1]].tolist() == [*packing._tokenizer(WORDS).encode("Plain words, 12 of them.", add_special_tokens=False).ids, 1]


def test_packing_merges_no_known_part_again():
    coder, merged = packing.ChunkIds(WORDS), []
    merge = coder.merges.part_ids
    coder.merges.part_ids = lambda parts: merged.append(len(parts)) or merge(parts)
    letters = np.array(list("abcdefghijklmnop"))
    words = ["".join(letters[[k >> 16, k >> 12 & 15, k >> 8 & 15, k >> 4 & 15, k & 15]]) for k in range(150_000)]
    blocks = [pa.array([" ".join(words[k : k + 10_000])]) for k in range(0, 150_000, 10_000)]
    first = [coder.encode(b, 1) for b in blocks]
    assert sum(merged) == 150_000
    again = [coder.encode(b, 1) for b in blocks]
    assert sum(merged) == 150_000
    assert all(np.array_equal(x, y) for a, b in zip(first, again, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("most,end_id", [(40, 1), (1000, 70_000)])
def test_packing_ids_are_the_library_s_however_few_parts_are_kept(monkeypatch, most, end_id):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MAX_PARTS_KEPT", most)
    rng, coder, library = random.Random(7), packing.ChunkIds(WORDS), Tokenizer.from_file(WORDS)
    pieces = ["the", "Ing", "ÀÖØÞ", "ßÿ", "é", "×", "÷", "ı", "漢", "\x1c", " ", "'s", "<unk>", "7", "42", "...", "-_", " ", " ", "\n", "ab" * 12, "x" * 25, "y" * 4100]
    for _ in range(12):
        texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(40)] + [None, ""]
        flat, ends = coder.encode(pa.array(texts), end_id)
        for k, x in enumerate(texts):
            assert flat[ends[k] : ends[k + 1]].tolist() == [*library.encode(x or "", add_special_tokens=False).ids, end_id]
    assert coder.encode(pa.array([None], pa.string()), end_id)[0].tolist() == [end_id]


@pytest.mark.parametrize("end_id,wide", [(1, 2), (70_000, 4)])
def test_packing_hands_ids_on_as_bytes(spark, end_id, wide):
    df = spark.createDataFrame([(k, "Some plain words, " * k, "s") for k in range(50)], "doc_id long, text string, source string")
    rows = packing.tokenised(df, WORDS, end_id, "doc_id", "text", "source").collect()
    assert all(len(r.ids) == wide * r.tokens for r in rows)
    ids_of = {r.doc_id: [np.frombuffer(r.ids, f"<u{wide}").tolist()] for r in rows}
    out = packing.pack(df, WORDS, window=64, end_id=end_id, with_ids=True).collect()
    check_pieces(out, ids_of, 64)
    assert all(r.ids == ids_of[r.doc_id][0][r.start : r.start + r.length] for r in out)
