"""The registered queries on whole given tables against libraries and plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidegrid.llm import queries
from tidegrid.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op1_equals_the_library(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = {}
    for i, t in texts.items():
        ids = sp.encode(t, add_eos=True)
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_sentencepiece(spark, SF).collect()} == want


def test_op2_keeps_its_law(spark, texts):
    rows = queries.op2_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 40
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / 40
    largest = max(r.size for r in rows)
    assert max(load.values()) <= max(1.1 * mean, largest + mean)


def test_op5_packs_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    seen, places = defaultdict(int), defaultdict(list)
    for r in sorted(queries.op5_packing(spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes())
        seen[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    total, padded = sum(map(len, ids.values())), 0
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 2048
    assert padded <= 1.05 * total + 2048


def test_op6_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {i: (len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op6_token_counts(spark, SF).collect()} == want


def test_op9_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op9_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    toxic = [r.predicted for r in held if label[r.doc_id] == 1]
    clean = [r.predicted for r in held if label[r.doc_id] == 0]
    assert len(toxic) > 80 and sum(toxic) >= 56 * len(toxic) / 97
    assert sum(clean) <= 0.01 * len(clean)


@pytest.mark.parametrize("name", ["op4_mtree", "op8_pivot_index", "op10_ngram_jaccard", "op11_conversation_repair", "op12_filter_audit"])
def test_queries_with_sql_equal_it_on_a_larger_table(spark, compare, name):
    ours, theirs = compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.01")
    assert ours == theirs
