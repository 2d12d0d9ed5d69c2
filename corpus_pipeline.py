"""Corpus pipeline: toxicity, n-gram Jaccard join, PII, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last
return the columns of ``documents``; each works on all rows its predecessor
kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import ngram_jaccard, packing, pii, toxicity
from tidegrid.llm.common import table, tokenizer_path, written
from tidegrid.session import bounded_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least one half go."""
    bounded_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model, "text", "_score").where(F.col("_score") < 0.5).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a Jaccard similarity of 0.8 on five-word shingles, the one with the least id stays.

    Rows without an id stay. Rows that repeat an id are judged each by its own
    text; of equal rows, and of linked rows with one id, one stays.
    """
    bounded_batches(spark)
    # A row is known by hashes of all its columns, as its id may repeat: by one where it can only stay too long, by two where it would go.
    content = [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]
    named = docs.where(F.col("doc_id").isNotNull()).withColumns({"_row": F.xxhash64(*content), "_second": F.xxhash64(F.lit(1), *content)})
    groups = ngram_jaccard.ngram_jaccard(named, n=5, num=80, den=100, id_col="_row")
    first = groups.select("_row", "component_id").distinct().join(named.select("_row", "doc_id"), "_row")
    kept = written(first.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("k")).select("k._row"), "pipeline_kept")
    one = ngram_jaccard.only_ids(named, kept, "_row").dropDuplicates(["_row", "_second"])
    return one.select(*COLUMNS).union(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows."""
    bounded_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens with the corpus's own mixture of sources."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("pii", redact_private),
    ("packing", pack_windows),
]

#: SQL can't express the toxicity and packing stages. Tests hold the kept rows of the second stage and the pieces of the
#: last against brute force, and the redacted texts against the base patterns.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
