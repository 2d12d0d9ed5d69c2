"""Queries op1 to op13: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import chat_tools, conversation_repair, filter_audit, language_id, mtree, ngram_jaccard, packing, pii, pivot_index, sentence_pieces, sharding, token_counts, toxicity
from tidegrid.llm.common import table, tokenizer_path
from tidegrid.llm.repair_sql import repair_sql
from tidegrid.session import bounded_batches


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    coded = sentence_pieces.encode_decode(table(spark, sf_dir, "documents"), model)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


#: The tool that plain conversations call: see chat_tools.turn_calls.
REPLY_SCHEMA = {"reply": {"prompt": "string", "turn": "integer"}}


def op3_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    calls = chat_tools.turn_calls(messages).union(chat_tools.explicit_calls(messages))
    results = chat_tools.turn_results(messages).union(chat_tools.explicit_results(messages))
    return chat_tools.format_chat(messages, calls, results, REPLY_SCHEMA)


def op4_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), window=2048, end_id=1)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op8_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return conversation_repair.audit(conversation_repair.damaged(messages), asked=messages)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_sharding": op2_sharding,
    "op3_chat_tools": op3_chat_tools,
    "op4_mtree": op4_mtree,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_pii": op7_pii,
    "op8_pivot_index": op8_pivot_index,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_language_id": op13_language_id,
}
QUERIES = {name: _bounded(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_tools": """
        WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        c AS (
            SELECT conv_id, 'turn-' || turn AS call_id, turn AS call_turn, count(*) AS copies
            FROM m WHERE role = 'user' GROUP BY conv_id, turn
        ),
        r AS (SELECT DISTINCT conv_id, turn, 'turn-' || (turn - 1) AS call_id FROM m WHERE role = 'assistant'),
        l AS (
            SELECT r.conv_id, r.turn, r.call_id,
                   CASE WHEN c.call_turn IS NULL THEN 'orphan' ELSE 'linked' END AS link_status
            FROM r LEFT JOIN c USING (conv_id, call_id)
        )
        SELECT m.conv_id, m.turn, m.role,
               CASE WHEN c.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS calls,
               CASE WHEN c.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS valid_calls,
               l.link_status, m.turn AS order_turn, 0::INTEGER AS order_step,
               '{' || CASE WHEN l.link_status = 'linked' THEN '"answers":' || to_json(l.call_id)::VARCHAR || ',' ELSE '' END
                   || CASE WHEN c.call_id IS NULL THEN '' ELSE '"calls":[{"arguments":{"prompt":' || to_json(m.text)::VARCHAR || ',"turn":' || m.turn
                   || '},"id":' || to_json(c.call_id)::VARCHAR || ',"name":"reply"}],' END
                   || '"content":' || to_json(m.text)::VARCHAR || ',"conv_id":' || m.conv_id
                   || ',"role":' || to_json(m.role)::VARCHAR || ',"turn":' || m.turn || '}' AS message_json
        FROM m
        LEFT JOIN c ON c.conv_id = m.conv_id AND c.call_turn = m.turn
        LEFT JOIN l ON l.conv_id = m.conv_id AND l.turn = m.turn
    """,
    "op4_mtree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ),
        g AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))) END AS grams
            FROM w
        ),
        e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
        o AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id
            WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ),
        l AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
        reach AS (SELECT doc_id AS node, doc_id AS root FROM g UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.node)
        SELECT g.doc_id, len(g.grams)::BIGINT AS n_shingles, min(reach.root) AS component_id
        FROM g JOIN reach ON reach.node = g.doc_id GROUP BY g.doc_id, g.grams
    """,
    "op8_pivot_index": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        o AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ),
        reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT o.b, reach.root FROM reach JOIN o ON o.a = reach.node),
        c AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
        n AS (SELECT a, count(*) AS n FROM o GROUP BY a)
        SELECT c.node AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.root AS component_id, c.node = c.root AS kept
        FROM c LEFT JOIN n ON n.a = c.node
    """,
    "op11_conversation_repair": repair_sql(),
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ),
        m AS (
            SELECT doc_id, part,
                   (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
                   + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
                   + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END)
                   + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
                   + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
            FROM d
        ),
        l AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
            FROM labels GROUP BY doc_id
        ),
        c AS (
            SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
            FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
        ),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
            AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
        ),
        s AS (
            SELECT filter_order, k::INTEGER AS step, bits[k] AS bit, list_sum(bits[1:k]) - bits[k] AS earlier
            FROM o, range(1, 6) t(k)
        ),
        r AS (
            SELECT part, filter_order, step, bit,
                   sum(CASE WHEN mask & (bit + earlier)::INTEGER = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN mask & bit <> 0 AND mask & earlier::INTEGER = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM c, s GROUP BY part, filter_order, step, bit
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM r
    """,
}
