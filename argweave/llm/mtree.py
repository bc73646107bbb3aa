"""Exact top-k inner products with M-trees.

Every component x becomes floor(256 x). Inner products become distances by one more component: with M the longest norm
of a tree, a vector v gets sqrt(M^2 - |v|^2) and a query q gets 0, so d(q, v)^2 = |q|^2 + M^2 - 2 q.v and the nearest
vector has the highest product. A tree has paged nodes: inner pages hold routing vectors with covering radii and
distances to the parent, leaf pages hold vectors with distances to the parent. The search takes pages in the order of
the best product they can hold; stored parent distances and the triangle inequality dismiss entries without computing
their distance. Products are computed in whole numbers, and a page goes only if its bound is truly below the k-th best.

Vectors are dealt by digest of vec_id into trees of about `TREE` vectors. Queries go to every tree (blocks of a query
set against all rows), each tree gives its k best, and the k best of those remain. A task holds one tree; one third of
all rows being equal vectors changes nothing, as they are dealt like others and their pages have radius 0.

NULL or empty vectors and such with NULL or non-finite components take no part; only vectors of one length meet. vec_id
is the key: a query row's own vec_id is no candidate, repeated query rows count once, repeated candidate rows each
count. Products are exact while they stay below 2^63.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argweave.llm.common import store

TREE, PAGE, FAN, SCALE = 8192, 512, 32, 256


class Tree:
    """A bulk-loaded M-tree over whole-number vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], vectors[order]
        self.exact = self.whole.astype(float) if np.abs(self.whole).max(initial=0).astype(float) ** 2 * vectors.shape[1] < 2**52 else self.whole
        norms = (self.whole.astype(float) ** 2).sum(axis=1)
        self.top = float(norms.max(initial=0))
        self.points = np.concatenate([self.whole.astype(float), np.sqrt(self.top - norms)[:, None]], axis=1)
        self.chance = np.random.default_rng(7)
        self.root = self._page(np.arange(len(self.ids)), None)

    def _far(self, rows: np.ndarray, point: np.ndarray | None) -> np.ndarray:
        return np.zeros(len(rows)) if point is None else np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))

    def _page(self, rows: np.ndarray, parent: np.ndarray | None) -> tuple:
        """A leaf (True, rows, parent distances), or (False, routing vectors, radii, parent distances, children)."""
        if len(rows) <= PAGE:
            return True, rows, self._far(rows, parent)
        heads = self.points[self.chance.choice(rows, min(FAN, -(-len(rows) // PAGE)), replace=False)]
        far = (heads**2).sum(axis=1)[None, :] - 2 * self.points[rows] @ heads.T
        near = far.argmin(axis=1)
        if np.bincount(near, minlength=len(heads)).max() > 0.9 * len(rows):  # many equal vectors: any even split will do
            near = np.arange(len(rows)) * len(heads) // len(rows)
        routes, radii, children = [], [], []
        for k in np.unique(near):
            own = rows[near == k]
            route = self.points[own].mean(axis=0)
            routes.append(route)
            radii.append(self._far(own, route).max())
            children.append(self._page(own, route))
        routes_at = np.array(routes)
        to_parent = np.zeros(len(routes)) if parent is None else np.sqrt(((routes_at - parent) ** 2).sum(axis=1))
        return False, routes_at, np.array(radii), to_parent, children

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, vec_id), ties to the smaller vec_id."""
        point = np.append(query.astype(float), 0.0)
        size = float((point**2).sum())
        slack = 1e-9 * (size + self.top + 1)
        exact = query.astype(self.exact.dtype)
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id), the worst first
        queue: list[tuple[float, int, tuple, float]] = [(0.0, 0, self.root, 0.0)]
        count = 0

        def reach() -> float:
            """The distance beyond which nothing can be among the k best."""
            return np.sqrt(max(0.0, size + self.top - 2 * best[0][0] + slack)) + 1e-6 if len(best) == k else np.inf

        while queue:
            least, _, page, at = heapq.heappop(queue)
            most = reach()
            if least > most:
                break
            if page[0]:
                rows = page[1]
                if page is not self.root:
                    rows = rows[np.abs(at - page[2]) <= most]
                products = self.exact[rows] @ exact
                floor = best[0][0] if len(best) == k else -np.inf
                good = np.flatnonzero((products >= floor) & (self.ids[rows] != query_id))
                if len(good) > k:
                    good = good[np.lexsort((self.ids[rows[good]], -products[good]))[:k]]
                for j in good:
                    found = (int(products[j]), -int(self.ids[rows[j]]))
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                continue
            _, routes, radii, to_parent, children = page
            chosen = np.arange(len(radii)) if page is self.root else np.flatnonzero(np.abs(at - to_parent) - radii <= most)
            far = np.sqrt(((routes[chosen] - point) ** 2).sum(axis=1))
            for j, d in zip(chosen, far, strict=True):
                bound = max(0.0, d - radii[j])
                if bound <= most:
                    count += 1
                    heapq.heappush(queue, (bound, count, children[j], float(d)))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) over `vectors` (vec_id, embedding), for the rows where `is_query` holds."""
    sound = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> coalesce(not isnan(x) and abs(x) < double('Infinity'), false))"
    whole = F.expr(f"transform(embedding, x -> cast(floor({SCALE} * cast(x as double)) as bigint))")
    rows = store(vectors.where(F.col("vec_id").isNotNull()).where(sound).select(F.col("vec_id").cast("long"), whole.alias("v"), is_query.alias("asks")), "vectors")
    trees = max(1, -(-rows.count() // TREE))
    tree = F.pmod(F.xxhash64("vec_id"), F.lit(trees)).cast("int").alias("tree")
    points = rows.select(tree, F.size("v").alias("width"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = rows.where("asks").select("vec_id", "v").dropDuplicates(["vec_id"])
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.size("v").alias("width"), F.lit(1).alias("kind"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        built, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("tree", "width", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1), batch.num_rows]
            out: list[tuple[int, int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                ids = part.column("vec_id").to_numpy()
                whole = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if tuple(unit[a][:2]) != last:
                    held, built, last = [], None, tuple(unit[a][:2])
                if unit[a][2] == 0:
                    held.append((ids, whole))
                    continue
                if built is None and held:
                    built = Tree(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                if built is not None:
                    out += [(int(i), s, v) for i, q in zip(ids, whole, strict=True) for s, v in built.search(int(i), q, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "score", "vec_id"])

    dealt = points.unionByName(asked).repartition("tree", "width").sortWithinPartitions("tree", "width", "kind", "vec_id")
    found = dealt.mapInArrow(run, "query_id long, score long, vec_id long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
