"""Personal data by weak supervision (operator 7), in DataFrame functions only.

Base patterns find mail addresses, IP addresses, cards and phone numbers.
Wider candidates get votes from regex, gazetteer and context labelers;
expectation-maximisation estimates how reliable each labeler is from the
counts of vote patterns, and the posteriors train a final span classifier,
which is applied as a plain column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import written

# The base patterns, written so that no start is tried twice and no group recurses.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider candidates: long tokens of letters and digits, grouped numbers, bracketed area codes.
CANDIDATE = r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]{14,}+|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9]))"
KINDS = ("email", "ip", "card", "phone", "secret")
#: Words that stand before private values (the gazetteer labeler).
GAZETTEER = r"(?i)(password|passwd|pwd|token|secret|api[_ -]?key|key|ssn|phone|tel|iban|passport|account|auth|bearer)[\"'\x20:=]*$"
#: Characters before a candidate that the labelers see.
BEFORE = 24
EM_ROUNDS = 60
#: Matches whose starts are summed up in one array.
BLOCK = 32

_FOUND = "array<struct<start:int,end:int,value:string,before:string>>"


def _with(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body or a lambda in it uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before_each(values: Column, zero: int, merge) -> Column:
    """For each of the numbers what ``merge`` makes of all before it, beginning with ``zero``: over blocks, then within each block."""

    def blocks_of(of: Column, body) -> Column:
        # A sequence would run backwards where there is no value.
        last = F.floor((F.size(of) - 1) / BLOCK).cast("int")
        ids = F.when(F.size(of) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(ids, lambda k: body(F.slice(of, k * BLOCK + 1, F.lit(BLOCK)), k))

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(zero).cast("long"), merge)

    def before(of: Column) -> Column:
        return F.transform(of, lambda _, k: total(F.slice(of, F.lit(1), k)))

    def laid(of: Column, starts) -> Column:
        """The same for values whose blocks begin at ``starts``."""
        return F.flatten(
            blocks_of(of, lambda block, k: _with(block, lambda b: _with(F.element_at(starts, k + 1), lambda at: F.transform(before(b), lambda x: merge(at, x)))))
        )

    # Blocks of blocks: nothing goes over more than a block, but for the few of the topmost ones.
    def starts_of(sums: Column) -> Column:
        return _with(blocks_of(sums, lambda b, _: total(b)), lambda tops: _with(before(tops), lambda at: laid(sums, at)))

    return _with(values, lambda v: _with(blocks_of(v, lambda b, _: total(b)), lambda sums: _with(starts_of(sums), lambda at: laid(v, at))))


def located(text: Column, pattern: str, worth: Column) -> Column:
    """All matches as (start, end, value, before), in code points, leftmost and without overlap; none where not ``worth``.

    The text is split and searched once; starts are running sums of lengths.
    ``before`` is what stands between the last match and this one, its last
    BEFORE characters at most.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    measured = F.transform(
        F.filter(parts, lambda x: x["hit"].isNotNull()),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("long"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(BEFORE)).alias("tail")),
    )

    def placed(hits: Column) -> Column:
        starts = _before_each(F.transform(hits, lambda x: (x["gap"] + x["long"]).cast("long")), 0, lambda a, b: a + b)
        return F.zip_with(
            hits,
            starts,
            lambda x, at: F.struct(
                (at + x["gap"]).cast("int").alias("start"), (at + x["gap"] + x["long"]).cast("int").alias("end"), x["hit"].alias("value"), x["tail"].alias("before")
            ),
        )

    empty = F.array().cast(_FOUND)
    return F.when(worth, _with(measured, lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(empty))).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _ip_ok(value: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def base_spans(text: Column) -> Column:
    """Sorted (start, rank, end, kind) of the base patterns; matches that fail their check are dropped."""
    body = F.coalesce(text, F.lit(""))
    has_digit = body.rlike("[0-9]")

    def kind(rank: int, pattern: str, worth: Column, ok) -> Column:
        hits = located(body, pattern, worth)
        if ok is not None:
            hits = F.filter(hits, ok)
        return F.transform(
            hits, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"))
        )

    mails = kind(0, EMAIL, F.contains(body, F.lit("@")), None)
    numbers = F.concat(
        kind(1, IP, body.rlike(r"[0-9]\.[0-9]"), lambda x: _ip_ok(x["value"])),
        kind(2, CARD, F.lit(True), lambda x: F.length(_digits(x["value"])).between(14, 19) & _luhn(_digits(x["value"]))),
        kind(3, PHONE, F.contains(body, F.lit("+")), lambda x: F.length(_digits(x["value"])).between(10, 15)),
    )
    return F.when(has_digit, F.array_sort(F.concat(mails, numbers))).otherwise(mails)


#: Votes of the labelers on a candidate: 1 private, 0 not, null no opinion. They see the value and what stands before it.
LABELERS: dict[str, object] = {
    "regex": lambda v, b: F.when(v.rlike(r"^(AKIA[0-9A-Z]{16}|[0-9a-f]{18,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\([0-9]{3}\).*)$") & v.rlike("[0-9]"), 1).otherwise(0),
    "gazetteer": lambda v, b: F.when(b.rlike(GAZETTEER), 1),
    "context": lambda v, b: F.when(b.rlike("[=:\"'][\"']?$"), 1).when(b.rlike("[.!?\\n]\\x20?$"), 0),
    "mixture": lambda v, b: F.when(v.rlike("[0-9].*[0-9].*[0-9]") & v.rlike("[A-Za-z]"), 1).when(~v.rlike("[0-9]"), 0),
}
#: What the final classifier sees.
FEATURES: dict[str, object] = {
    "digits": lambda v, b: v.rlike("[0-9]"),
    "letters": lambda v, b: v.rlike("[A-Za-z]"),
    "many_digits": lambda v, b: F.length(_digits(v)) * 4 >= F.length(v),
    "one_case": lambda v, b: ~(v.rlike("[a-z]") & v.rlike("[A-Z]")),
    "long": lambda v, b: F.length(v) >= 18,
    "named": lambda v, b: b.rlike(GAZETTEER),
    "assigned": lambda v, b: b.rlike("[=:\"'][\"']?$"),
}


def candidates(text: Column, base: Column) -> Column:
    """(start, end, votes, features) of candidates that touch no base span; both codes are digit strings, x for no opinion."""
    body = F.coalesce(text, F.lit(""))
    hits = located(body, CANDIDATE, body.rlike("[0-9]|[A-Za-z]{14}"))  # no candidate is without one of them

    def apart(found: Column, taken: Column) -> Column:
        """The hits that no base span touches: of the spans that begin before a hit ends, none ends behind its start.

        Spans by their start and hits by their end are laid in one order, at
        one place the hit first, so each hit sees the farthest end so far.
        """
        none = F.lit(-1).cast("long")
        spans = F.transform(taken, lambda y: F.struct(y["start"].cast("long").alias("key"), F.lit(1).alias("span"), y["end"].cast("long").alias("far"), F.lit(-1).alias("hit")))
        ours = F.transform(found, lambda x, k: F.struct(x["end"].cast("long").alias("key"), F.lit(0).alias("span"), none.alias("far"), k.alias("hit")))
        order = F.array_sort(F.concat(spans, ours))

        def free(laid: Column) -> Column:
            seen = F.zip_with(laid, _before_each(F.transform(laid, lambda m: m["far"]), -1, lambda a, b: F.greatest(a, b)), lambda m, far: F.struct(m["hit"].alias("hit"), far.alias("far")))
            return F.transform(F.filter(seen, lambda m: (m["hit"] >= 0) & (m["far"] <= F.get(found, m["hit"])["start"])), lambda m: F.get(found, m["hit"]))

        return F.when((F.size(taken) == 0) | (F.size(found) == 0), found).otherwise(_with(order, free))

    hits = _with(hits, lambda found: _with(base, lambda taken: apart(found, taken)))

    def described(x: Column) -> Column:
        votes = [F.coalesce(f(x["value"], x["before"]).cast("string"), F.lit("x")) for f in LABELERS.values()]
        features = [F.when(f(x["value"], x["before"]), "1").otherwise("0") for f in FEATURES.values()]
        return F.struct(x["start"], x["end"], F.concat(*votes).alias("votes"), F.concat(*features).alias("features"))

    return F.transform(hits, described)


@dataclass(frozen=True)
class SpanModel:
    """Labelers' reliabilities, and the weights of the final classifier."""

    reliability: dict[str, tuple[float, float]]
    bias: float
    weights: tuple[tuple[float, float], ...]

    def accepts(self, features: Column) -> Column:
        score = reduce(
            lambda acc, k: acc + F.when(F.substring(features, k + 1, 1) == "1", self.weights[k][1]).otherwise(self.weights[k][0]),
            range(len(self.weights)),
            F.lit(self.bias),
        )
        return score >= 0


def fit(patterns: list[tuple[str, str, int]]) -> SpanModel:
    """Expectation-maximisation over counted (votes, features) patterns, then a naive Bayes classifier on the posteriors.

    The number of patterns is fixed by the labelers and features, however many
    spans there are. Without candidates nothing is accepted.
    """
    names = list(LABELERS)
    prior, sens, spec = 0.5, [0.8] * len(names), [0.8] * len(names)
    post: dict[str, float] = {}
    votes: dict[str, float] = {}
    for v, _, n in patterns:
        votes[v] = votes.get(v, 0) + n
    for _ in range(EM_ROUNDS):
        for v in votes:
            a, b = math.log(prior), math.log(1 - prior)
            for k, c in enumerate(v):
                if c != "x":
                    a += math.log(sens[k] if c == "1" else 1 - sens[k])
                    b += math.log(1 - spec[k] if c == "1" else spec[k])
            post[v] = 1 / (1 + math.exp(min(700.0, b - a)))
        total = sum(votes.values())
        prior = min(0.99, max(0.01, (sum(n * post[v] for v, n in votes.items()) + 1) / (total + 2)))
        for k in range(len(names)):
            yes = sum(n * post[v] for v, n in votes.items() if v[k] == "1")
            yes_all = sum(n * post[v] for v, n in votes.items() if v[k] != "x")
            no = sum(n * (1 - post[v]) for v, n in votes.items() if v[k] == "0")
            no_all = sum(n * (1 - post[v]) for v, n in votes.items() if v[k] != "x")
            # Labelers are taken to be better than chance; the added counts hold them there on little data.
            sens[k] = min(0.999, max(0.5, (yes + 8) / (yes_all + 10)))
            spec[k] = min(0.999, max(0.5, (no + 8) / (no_all + 10)))
    pos = sum(n * post[v] for v, _, n in patterns)
    neg = sum(n * (1 - post[v]) for v, _, n in patterns)
    weights = []
    for k in range(len(FEATURES)):
        p1 = (sum(n * post[v] for v, f, n in patterns if f[k] == "1") + 1) / (pos + 2)
        q1 = (sum(n * (1 - post[v]) for v, f, n in patterns if f[k] == "1") + 1) / (neg + 2)
        weights.append((math.log((1 - p1) / (1 - q1)), math.log(p1 / q1)))
    bias = math.log((pos + 1) / (neg + 1)) if patterns else -1e9
    return SpanModel({n: (sens[k], spec[k]) for k, n in enumerate(names)}, bias, tuple(weights))


def with_candidates(docs: DataFrame, text: str = "text", base: str = "pii_base", extra: str = "pii_candidates") -> DataFrame:
    out = docs.withColumn(base, base_spans(F.col(text)))
    return out.withColumn(extra, candidates(F.col(text), F.col(base)))


def train(found: DataFrame, extra: str = "pii_candidates") -> SpanModel:
    """Fit from the candidates of all documents; only counted patterns reach the driver."""
    rows = found.select(F.explode(extra).alias("c")).groupBy("c.votes", "c.features").count().collect()
    return fit(sorted((r[0], r[1], r[2]) for r in rows))


def all_spans(model: SpanModel, base: Column, extra: Column) -> Column:
    """Base spans and accepted candidates, by start and then kind."""
    more = F.transform(
        F.filter(extra, lambda x: model.accepts(x["features"])),
        lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) - 1).alias("rank"), x["end"].alias("end"), F.lit(KINDS[-1]).alias("kind")),
    )
    return F.array_sort(F.concat(base, more))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced once, by the first."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fresh = x["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"),
        )

    end = F.aggregate(spans, zero, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text))))


def _of_rank(k: int):
    return lambda x: x["rank"] == k


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans) per row.

    ``n_added`` counts the spans that the method adds, ``n_spans`` all.

    Null text counts as empty and has no spans. Repeated rows and null ids keep
    rows of their own; an empty table gives an empty result. Other columns
    don't take part.
    """
    found = written(with_candidates(docs.select(id_col, text), text).drop(text), "pii_found")
    model = train(found)
    count = [F.size(F.filter("pii_base", _of_rank(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    spans = all_spans(model, F.col("pii_base"), F.col("pii_candidates"))
    return found.withColumn("_spans", spans).select(
        id_col,
        *count,
        F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
        (F.size("_spans") - F.size("pii_base")).cast("long").alias("n_added"),
        F.size("_spans").cast("long").alias("n_spans"),
    )


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``docs`` has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced; null stays null, an empty table stays empty.

    The spans are found once and written, as the model needs those of all rows
    before the first text can be changed.
    """
    base, extra = free_names(docs, "_pii_base", "_pii_extra")
    found = written(with_candidates(docs, text, base, extra), "pii_found")
    model = train(found, extra)
    spans = all_spans(model, F.col(base), F.col(extra))
    return found.withColumn(text, redacted(F.col(text), spans)).drop(base, extra)
