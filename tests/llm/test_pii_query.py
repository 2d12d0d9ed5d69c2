"""The personal data query on given tables, planted secrets, and long texts."""

import hashlib
import re
import time

from pyspark.sql import functions as F

from tidegrid.llm import pii, queries
from tests.llm.test_content import base

KINDS = ("email", "ip", "card", "phone")


def test_query_equals_the_patterns_on_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op7_pii(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = base(d.text), got[d.doc_id]
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
        assert r.n_spans == len([x for x in r.spans.split(",") if x]) == len(want) + r.n_added


def test_planted_secrets_are_found_and_little_else(spark):
    """Planted: 40 hexadecimal digits of either case that are no base span."""
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    planted, found = set(), set()
    for i, t in docs.items():
        taken = base(t)
        for m in re.finditer(r"\b[0-9a-fA-F]{40}\b", t):
            if not any(m.start() < e and s < m.end() for s, _, e in taken):
                planted.add((i, m.start(), m.end()))
    for r in queries.op7_pii(spark, sf).where("n_added > 0").collect():
        found |= {(r.doc_id, int(a), int(b)) for kind, a, b in (x.split(":") for x in r.spans.split(",")) if kind == "secret"}
    assert len(planted) > 150
    assert len(planted & found) >= 0.98 * len(planted)
    assert len(planted & found) >= 0.95 * len(found)


def test_time_grows_with_the_matches(spark):
    def took(n):
        text = " ".join(f"a{k}@b{k % 7}.org" for k in range(n)) + " " + " ".join(f'token = "{k:040x}"' for k in range(n // 4))
        began = time.time()
        row = pii.pii_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_email", "n_added").first()
        assert row.n_email == n and row.n_added == n // 4
        return time.time() - began

    took(100)
    assert took(64_000) < 8 * took(16_000) + 3


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "to a@b.co", "x", "y", 3)], "doc_id long, text string, _pii_base string, _PII_extra string, `a b` int")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert tuple(got.first()) == (1, "to [EMAIL]", "x", "y", 3)
    assert pii.redact(df.where(F.lit(False))).count() == 0
