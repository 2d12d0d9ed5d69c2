"""Embedding near-duplicates by a pivot-permutation index (operator 8).

A vector is described by its nearest reference points (pivots), in order.
Inverted lists hold the vectors of one label that name a pivot; two vectors
that share enough pivots are candidates, and their cosine is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import written
from tidegrid.llm.components import connected_components

#: Vectors for each pivot, bounds on the number of pivots, vectors sampled to choose them from.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS, PIVOT_SAMPLE = 48, 64, 2048, 6000
#: No two pivots are closer than this cosine, so copies can't take up the pivots.
PIVOT_APART = 0.7
#: Pivots that describe a vector, and how many of them two candidates share.
NAMED, SHARED = 8, 2
#: Vectors of one list compared in one task; longer lists are dealt as a grid of such blocks.
BLOCK = 512


def usable(embedding: str) -> F.Column:
    """Vectors that can link: no nulls, finite, not zero."""
    return (
        F.col(embedding).isNotNull()
        & (F.size(embedding) > 0)
        & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(embedding, lambda x: x != 0)
    )


def choose_pivots(vectors: DataFrame, embedding: str, rows: int) -> dict[int, np.ndarray]:
    """Unit pivots by dimension, from a bounded sample by hash; sampled points near an earlier one are passed over."""
    want = max(LEAST_PIVOTS, min(MOST_PIVOTS, rows // PER_PIVOT))
    sample = vectors.orderBy(F.xxhash64(embedding)).limit(min(PIVOT_SAMPLE, 4 * want)).select(embedding).toArrow()[embedding]
    out: dict[int, list[np.ndarray]] = {}
    for v in sample:
        v = np.array(v.as_py(), dtype=np.float64)
        u = v / np.abs(v).max()
        u /= np.linalg.norm(u)
        kept = out.setdefault(len(u), [])
        if len(kept) < want and (not kept or (np.array(kept) @ u).max() < PIVOT_APART):
            kept.append(u)
    return {d: np.array(x) for d, x in out.items()}


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray], embedding: str, out: str = "named") -> DataFrame:
    """Add the NAMED nearest pivots of each vector, nearest first. A dimension without pivots has the one pivot -1."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("array<int>")
    def named(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            sizes = np.array(pa.compute.list_value_length(column).to_pylist())
            made: list = [[-1]] * len(column)
            for dim in np.unique(sizes).tolist():
                p = shared.value.get(dim)
                at = np.flatnonzero(sizes == dim)
                for lo in range(0, len(at) if p is not None else 0, 2000):
                    part = at[lo : lo + 2000]
                    cos = unit_rows(column.take(pa.array(part)), dim) @ p.T
                    near = np.argsort(-cos, axis=1, kind="stable")[:, :NAMED]
                    for i, x in zip(part.tolist(), near.tolist(), strict=True):
                        made[i] = x
            yield pa.array(made, pa.list_(pa.int32()))

    return vectors.withColumn(out, named(F.col(embedding)))


def _incidence(named: list[list[int]], pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrices, vectors by pivots: all pivots, and those before ``pivot``."""
    used = sorted({p for x in named for p in x})
    at = {p: k for k, p in enumerate(used)}
    full = np.zeros((len(named), len(used)), dtype=np.float32)
    for i, x in enumerate(named):
        full[i, [at[p] for p in x]] = 1
    return full, full * (np.array(used) < pivot)


def _roots(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row reaches in a symmetric 0/1 matrix."""
    root = ids.copy()
    while True:
        least = np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(root, least)
        if (new == root).all():
            return root
        root = new


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """(id, n_links, component_id, kept) per row.

    Two rows link when their labels are equal and not null and their cosine in
    double precision reaches ``threshold``. Null, empty or zero vectors and
    those with null or non-finite parts link with nothing and are kept; so are
    rows with a null id, whose component is null. Equal vectors of a label are
    one class, joined before any comparison; every copy counts as a link of the
    others. A pair is compared in the list of its first shared pivot only.
    Candidates that share fewer than SHARED pivots are not found (measured
    recall is in the README); no pair below the threshold is ever linked.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).alias("v"), F.col(label).alias("label"))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    classes = written(
        good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "pivot_classes"
    )
    pivots = choose_pivots(classes, "v", classes.count())
    named = written(describe(classes, pivots, "v"), "pivot_named")
    lists = named.select("label", "dim", F.explode("named").alias("pivot"), "rep", "copies", "named", "v")
    sizes = lists.groupBy("label", "dim", "pivot").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (
        lists.join(sizes, ["label", "dim", "pivot"])
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .drop("blocks", "n", "other")
    )

    def compare(t: pa.Table) -> pa.Table:
        pivot, dim = t["pivot"][0].as_py(), t["dim"][0].as_py()
        ids, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
        block = t["block"].to_numpy()
        full, before = _incidence(t["named"].to_pylist(), pivot)
        u = unit_rows(t["v"].combine_chunks(), dim)
        a, b = np.flatnonzero(block == t["lo"][0].as_py()), np.flatnonzero(block == t["hi"][0].as_py())
        need = min(SHARED, full.shape[1])
        link = (full[a] @ full[b].T >= need) & (before[a] @ before[b].T == 0)
        if link.any():
            link &= u[a] @ u[b].T >= threshold
        whole = np.zeros((len(ids), len(ids)), dtype=bool)
        whole[np.ix_(a, b)] = link
        whole |= whole.T
        np.fill_diagonal(whole, False)
        n = whole @ copies.astype(np.float64)
        some = np.flatnonzero(n)
        return pa.table({"rep": ids[some], "n": n[some].astype(np.int64), "root": _roots(whole, ids)[some]})

    found = written(dealt.groupBy("label", "dim", "pivot", "lo", "hi").applyInArrow(compare, "rep long, n long, root long"), "pivot_links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = connected_components(found, "rep", "root").toDF("rep", "component")
    classes = classes.join(counts, "rep", "left").join(comps, "rep", "left")
    by_vector = classes.select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    linked = good.join(by_vector, ["label", "v"]).select("id", "n_links", "component")
    alone = rows.where(~F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"), F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")
    )
    return linked.union(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )
