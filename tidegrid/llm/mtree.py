"""Exact top-k inner-product search by M-trees (operator 4).

Vectors are dealt to segments of bounded size around sampled routing objects.
Each segment becomes one M-tree of pages: a page keeps a routing object, its
covering radius and its distance to the parent's routing object. A search is
best-first over pages; stored parent distances and the triangle inequality
rule out pages and entries before their own distance is computed.

The largest inner product is the least Euclidean distance once every stored
vector gets one more component, sqrt(M - |x|^2), and every query a zero there,
with M the largest squared norm: |q - x|^2 = |q|^2 + M - 2 q.x.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import few_or_shuffled, written

#: Vectors of a segment, entries of a leaf page, pages under an inner page, queries that a segment's task takes at a time.
SEGMENT, LEAF, FANOUT, QUERIES = 4096, 256, 16, 8192
#: Root pages that are sent to every task at a time; more go in several rounds. Distances that a task holds at a time.
ROOTS, CELLS = 16_384, 2_000_000
#: Vectors for each routing object and the most of them; they come from a bounded sample by hash.
PER_ROUTE, MOST_ROUTES = 2048, 1024
#: Added to every bound: distances are doubles, scores are exact integers.
SLACK = 1e-6


def scaled(vectors: DataFrame, id_col: str, embedding: str, scale: int) -> DataFrame:
    """(id, v, dim): components floor(scale * x), x as double. Null vectors, null or non-finite parts: left out."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"),
        F.size(embedding).alias("dim"),
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))]


def build(points: np.ndarray) -> list[dict]:
    """Pages of one M-tree over lifted points; page 0 is the root. Entries are indexes of points."""
    pages: list[dict] = []

    def page(at: np.ndarray, parent: int, route: np.ndarray, to_parent: float) -> None:
        d = np.sqrt(((points[at] - route) ** 2).sum(axis=1))
        me = len(pages)
        pages.append({"parent": parent, "route": route, "radius": float(d.max(initial=0.0)), "to_parent": to_parent, "entries": None, "dist": None})
        if len(at) <= LEAF:
            pages[me]["entries"], pages[me]["dist"] = at, d
            return
        k = min(FANOUT, -(-len(at) // LEAF) + 1)
        # Routing objects far apart: each next one is the point farthest from those before.
        chosen, far = [int(np.argmax(d))], np.full(len(at), np.inf)
        while len(chosen) < k:
            far = np.minimum(far, ((points[at] - points[at[chosen[-1]]]) ** 2).sum(axis=1))
            if far.max() <= 0:
                break
            chosen.append(int(np.argmax(far)))
        routes = points[at[chosen]]
        near = ((points[at][:, None, :] - routes[None]) ** 2).sum(axis=2).argmin(axis=1) if len(at) * k < 100_000 else _nearest(points[at], routes)
        for r in range(len(chosen)):
            part = at[near == r]
            if len(part) == len(at):  # equal points: no routing object splits them
                for lo in range(0, len(part), LEAF):
                    page(part[lo : lo + LEAF], me, routes[r], float(np.sqrt(((routes[r] - route) ** 2).sum())))
            elif len(part):
                page(part, me, routes[r], float(np.sqrt(((routes[r] - route) ** 2).sum())))

    if len(points):
        page(np.arange(len(points)), -1, points.mean(axis=0), 0.0)
    return pages


def _nearest(x: np.ndarray, routes: np.ndarray) -> np.ndarray:
    return ((routes * routes).sum(axis=1)[None, :] - 2 * x @ routes.T).argmin(axis=1)


class Tree:
    """Pages of one segment, ready for searches."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, points: np.ndarray, pages: list[dict]):
        self.ids, self.raw, self.points, self.pages = ids, raw, points, pages
        self.under: list = [None] * len(pages)
        for me in range(len(pages)):
            kids = [k for k, p in enumerate(pages) if p["parent"] == me]
            if kids:
                self.under[me] = (
                    np.array(kids),
                    np.array([pages[k]["route"] for k in kids]),
                    np.array([pages[k]["radius"] for k in kids]),
                    np.array([pages[k]["to_parent"] for k in kids]),
                )

    def search(self, query_id: int, query: np.ndarray, k: int, bound: float, most: float) -> list[tuple[float, int]]:
        """The k best (score, id), best first, ties to smaller ids; ``bound`` is a score that k others are known to reach."""
        if not self.pages:
            return []
        lifted, own = np.r_[query, 0.0], float(query @ query)
        best: list[tuple[float, int]] = []  # heap of (score, -id): worst first

        def reach() -> float:
            s = max(bound, best[0][0] if len(best) == k else -np.inf)
            return np.sqrt(max(own + most - 2 * s, 0.0)) + SLACK if s > -np.inf else np.inf

        root = float(np.sqrt(((self.pages[0]["route"] - lifted) ** 2).sum()))
        todo = [(max(0.0, root - self.pages[0]["radius"]), 0, root)]
        while todo:
            low, me, d = heapq.heappop(todo)
            limit = reach()
            if low > limit:
                break
            page = self.pages[me]
            if self.under[me] is not None:
                kids, routes, radii, to_parent = self.under[me]
                some = np.abs(d - to_parent) - radii <= limit
                dist = np.sqrt(((routes[some] - lifted) ** 2).sum(axis=1))
                least = np.maximum(dist - radii[some], 0.0)
                for kid, low_kid, dist_kid in zip(kids[some].tolist(), least.tolist(), dist.tolist(), strict=True):
                    if low_kid <= limit:
                        heapq.heappush(todo, (low_kid, kid, dist_kid))
                continue
            at = page["entries"][np.abs(d - page["dist"]) <= limit]
            if not len(at):
                continue
            score, ids = self.raw[at] @ query, self.ids[at]
            floor = max(bound, best[0][0] if len(best) == k else -np.inf)
            keep = np.flatnonzero((score >= floor) & (ids != query_id))
            if len(keep) > k:
                keep = keep[np.lexsort((ids[keep], -score[keep]))[:k]]
            for s, i in zip(score[keep].tolist(), ids[keep].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _sent(asked: DataFrame, pages: DataFrame, most: float) -> DataFrame:
    """(dim, route, sub, id, v, bound): each query with every segment that its bound doesn't rule out.

    A segment is ruled out by its root page alone: the query is farther from
    the root's object than the covering radius and the distance of the k-th
    best known score together. Roots are read in rounds of a bounded number.
    """
    spark = asked.sparkSession
    roots = pages.where("page = 0").select("dim", "route", "sub", "radius", "object")
    rounds = max(1, -(-roots.count() // ROOTS))
    out = None
    for n in range(rounds):
        held = roots.where(F.pmod(F.xxhash64("dim", "route", "sub"), F.lit(rounds)) == n).toArrow()
        by_dim = {}
        for dim in set(held["dim"].to_pylist()):
            part = held.filter(pa.compute.equal(held["dim"], dim))
            by_dim[dim] = (part["route"].to_numpy(), part["sub"].to_numpy(), part["radius"].to_numpy(), _matrix(part["object"], dim + 1))
        shared = spark.sparkContext.broadcast(by_dim)

        def reach(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column(2).to_numpy()
                for dim in np.unique(sizes).tolist():
                    if dim not in shared.value:
                        continue
                    route, sub, radius, objects = shared.value[dim]
                    mine, norms = np.flatnonzero(sizes == dim), (objects * objects).sum(axis=1)
                    step = max(1, CELLS // len(route))
                    for lo in range(0, len(mine), step):
                        part = batch.take(pa.array(mine[lo : lo + step]))
                        v, bound = _matrix(part.column(1), dim), part.column(3).to_numpy()
                        own = (v * v).sum(axis=1)
                        square = own[:, None] + norms[None, :] - 2 * (v @ objects[:, :dim].T)
                        # What rounding may have added is taken off, so no segment is lost by it.
                        low = np.sqrt(np.maximum(square - 1e-9 * (own[:, None] + norms[None, :] + 1), 0.0)) - radius[None, :]
                        limit = np.sqrt(np.maximum(own + most - 2 * np.maximum(bound, -1e300), 0.0)) + SLACK
                        limit[bound == -np.inf] = np.inf
                        q, s = np.nonzero(low <= limit[:, None])
                        at = pa.array(q)
                        columns = [pa.array(np.full(len(q), dim, np.int32)), pa.array(route[s], pa.int32()), pa.array(sub[s], pa.int32())]
                        yield pa.record_batch([*columns, part.column(0).take(at), part.column(1).take(at), part.column(3).take(at)], names=["dim", "route", "sub", "id", "v", "bound"])

        some = asked.select("id", "v", "dim", "bound").mapInArrow(reach, "dim int, route int, sub int, id long, v array<double>, bound double")
        out = some if out is None else out.union(some)
    return out


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest integer inner products over all other rows.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows with another id and as many components. Ties go to smaller ids. Rows
    with a null id or an unusable vector take no part; fewer candidates than k
    give fewer rows, an empty table none. Repeated rows are candidates each.
    Exact while scores stay under 2^53. Other columns don't take part.
    """
    points = written(scaled(vectors, id_col, embedding, scale), "mtree_points")
    spark = points.sparkSession
    facts = points.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    rows, most = facts[0], float(facts[1] or 0.0)
    few = points.orderBy(F.xxhash64("id"), "id").limit(max(8, min(MOST_ROUTES, rows // PER_ROUTE))).toArrow()
    routes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in set(few["dim"].to_pylist()):
        part = few.filter(pa.compute.equal(few["dim"], dim))
        routes[dim] = (part["id"].to_numpy(), _matrix(part["v"], dim))
    shared = spark.sparkContext.broadcast(routes)

    @F.arrow_udf("int")
    def route(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            sizes = np.array(pa.compute.list_value_length(column).to_pylist())
            out = np.zeros(len(column), dtype=np.int32)
            for dim in np.unique(sizes).tolist():
                if dim in shared.value:
                    at = np.flatnonzero(sizes == dim)
                    out[at] = _nearest(_lifted(_matrix(column.take(pa.array(at)), dim), most), _lifted(shared.value[dim][1], most))
            yield pa.array(out)

    @F.arrow_udf("double")
    def known_score(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # The k-th best score among routing objects: they are candidates, so the answer is no worse.
        for ids, column in columns:
            own, sizes = ids.to_numpy(), pa.compute.list_value_length(column).to_numpy()
            out = np.full(len(own), -np.inf)
            for dim in np.unique(sizes).tolist():
                known, x = shared.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                mine = np.flatnonzero(sizes == dim)
                for lo in range(0, len(mine) if len(known) >= k else 0, max(1, CELLS // max(1, len(known)))):
                    at = mine[lo : lo + max(1, CELLS // len(known))]
                    score = _matrix(column.take(pa.array(at)), dim) @ x.T
                    score[known[None, :] == own[at][:, None]] = -np.inf
                    out[at] = np.partition(score, len(known) - k, axis=1)[:, len(known) - k]
            yield pa.array(out)

    routed = written(points.withColumn("route", route("v")), "mtree_routed")
    sizes = routed.groupBy("dim", "route").agg(F.count("*").alias("n"))
    # A route that holds more than a segment is dealt to several, so one group of copies can't fill a task.
    placed = routed.join(sizes, ["dim", "route"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SEGMENT)).cast("int"))

    def pages_of(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        raw, ids = _matrix(t["v"], dim), t["id"].to_numpy()
        lifted = _lifted(raw, most)
        out: dict[str, list] = {n: [] for n in ("page", "parent", "radius", "to_parent", "object", "ids", "entries", "dist")}
        for n, p in enumerate(build(lifted)):
            leaf = p["entries"] is not None
            at = p["entries"] if leaf else np.zeros(0, dtype=np.int64)
            for name, value in zip(out, (n, p["parent"], p["radius"], p["to_parent"], p["route"].tolist(), ids[at].tolist(), raw[at].ravel().tolist(), p["dist"].tolist() if leaf else []), strict=True):
                out[name].append(value)
        n = len(out["page"])
        first = {c: pa.array([t[c][0].as_py()] * n, pa.int32()) for c in ("dim", "route", "sub")}
        kinds = {"page": pa.int32(), "parent": pa.int32(), "radius": pa.float64(), "to_parent": pa.float64(), "ids": pa.list_(pa.int64())}
        return pa.table(first | {c: pa.array(v, kinds.get(c, pa.list_(pa.float64()))) for c, v in out.items()})

    page_schema = (
        "dim int, route int, sub int, page int, parent int, radius double, to_parent double, object array<double>,"
        " ids array<long>, entries array<double>, dist array<double>"
    )
    pages = written(placed.select("dim", "route", "sub", "id", "v").groupBy("dim", "route", "sub").applyInArrow(pages_of, page_schema), "mtree_pages")
    asked = points.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", "dim", known_score("id", "v").alias("bound"))
    sent = written(_sent(written(asked, "mtree_asked"), pages, most), "mtree_sent")
    # A segment's pages move once for each block of the queries that reach it, which are no less than its pages.
    reached = sent.groupBy("dim", "route", "sub").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    reached = few_or_shuffled(written(reached, "mtree_reached"))
    left = pages.join(reached, ["dim", "route", "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = sent.join(reached, ["dim", "route", "sub"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")

    def search(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if len(trees) and len(queries):
            dim = trees["dim"][0].as_py()
            trees = trees.sort_by("page")
            ids = trees["ids"].combine_chunks()
            counts = np.array(pa.compute.list_value_length(ids).to_pylist())
            flat = ids.flatten().to_numpy()
            raw = _matrix(trees["entries"], dim)
            dist = trees["dist"].combine_chunks().flatten().to_numpy()
            ends = np.cumsum(counts)
            made = [
                {"parent": parent, "radius": radius, "to_parent": up, "route": np.array(o), "entries": np.arange(e - n, e), "dist": dist[e - n : e]}
                for parent, radius, up, o, n, e in zip(
                    trees["parent"].to_pylist(), trees["radius"].to_pylist(), trees["to_parent"].to_pylist(), trees["object"].to_pylist(), counts.tolist(), ends.tolist(), strict=True
                )
            ]
            tree = Tree(flat, raw, raw, made)
            for i, v, b in zip(queries["id"].to_pylist(), _matrix(queries["v"], dim), queries["bound"].to_pylist(), strict=True):
                out += [(i, j, int(s)) for s, j in tree.search(i, v, k, b, most)]
        q, j, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec": pa.array(j, pa.int64()), "score": pa.array(s, pa.int64())})

    keys = ("dim", "route", "sub", "block")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec").alias(id_col), "score")
