"""Nearest vectors by inner product, through few stable projections indexed by kd-trees.

A candidate x becomes (x, sqrt(M^2 - |x|^2)) with M the largest norm, a query q becomes (M q / |q|, 0):
then the nearest candidates by Euclidean distance are those with the largest inner product. DIMS
Gaussian (2-stable) projections of these give points; the squared distance of two points over the
squared distance of their vectors is chi-square distributed with DIMS degrees of freedom.

A kd-tree over a bounded sample of points splits space into cells. Every candidate goes to its cell, and a cell
with many candidates is split by hash into blocks of bounded size. Each block has a kd-tree of its own,
whose leaves are passed over where the test below rules out their boxes. The points of the other leaves come one after
the other by projected distance d, in steps that double, and are verified in double precision. A query stops at the first
point with chi2(d^2 / D^2) >= CONFIDENCE, with D the distance of the k-th nearest so far: a vector nearer than D
would have been met before with that probability. The cells are visited in two rounds: the query's own
one, then those that the test with the D so found doesn't rule out.

What a query costs depends on how near its k-th neighbour is: on clusters a few leaves, on vectors
without any structure a good part of all (README); queries times such vectors is then the work.

All rows are indexed; nothing caps candidates. Of equal vectors only the k + 1 with the least ids can be
among anyone's k nearest, so the others, such as a hot vector's copies, are left out before the search. Inputs: vectors that are null or zero, or hold null or
non-finite components, or whose length isn't the most frequent one (ties: the longer), take no part.
A vec_id names a row: of rows that repeat one, the smallest vector counts; null ids take no part. With fewer than k other rows, all are found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.store import write_table

DIMS, CONFIDENCE = 16, 0.9
#: Vectors of a block, at most about; queries that meet them at a time; sampled points for the cells; cells.
BLOCK, QUERIES, SAMPLE, CELLS = 4096, 2048, 20_000, 1024
LEAF = 64
#: Points verified in a query's first step; queries whose distances are worked out at a time.
STEP, LOT = 64, 128


def chi_square(x: float, m: int = DIMS) -> float:
    """P(chi-square with an even number m of degrees of freedom <= x)."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_point(p: float, m: int = DIMS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


class Tree(NamedTuple):
    """A kd-tree: the order of the points by leaf, the leaves' ends, and their boxes."""

    order: np.ndarray
    ends: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distances of a point to all boxes."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(1)


def build_tree(points: np.ndarray, leaf: int) -> Tree:
    """Halve the points at the median of their widest axis until no part has more than leaf."""
    parts, done = [np.arange(len(points))], []
    while parts:
        own = parts.pop()
        spread = np.ptp(points[own], 0)
        if len(own) <= leaf or not spread.any():
            done.append(own)
            continue
        axis, half = int(spread.argmax()), len(own) // 2
        own = own[np.argpartition(points[own, axis], half)]
        parts += [own[half:], own[:half]]
    low = np.array([points[x].min(0) for x in done])
    high = np.array([points[x].max(0) for x in done])
    return Tree(np.concatenate(done), np.cumsum([len(x) for x in done]), low, high)


class Space(NamedTuple):
    """The projections, the largest norm, and the boxes of the cells."""

    matrix: np.ndarray
    norm: float
    low: np.ndarray
    high: np.ndarray

    def candidates(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1) @ self.matrix

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.norm / np.linalg.norm(q, axis=1))[:, None]) @ self.matrix[:-1]

    def cell(self, points: np.ndarray) -> np.ndarray:
        """The nearest cell of each point (ties: the first)."""
        out = np.empty(len(points), np.int32)
        for k, point in enumerate(points):
            gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
            out[k] = (gap * gap).sum(1).argmin()
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(~bad & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added one after the other: equal vectors have equal scores wherever they lie."""
    return np.add.accumulate(vectors * query, axis=1)[:, -1] if len(vectors) else np.empty(0)


def _incremental(
    near: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int, least: float, reach: Callable[[float], float]
) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best of a block, not under least, and how many points were verified.

    near: squared projected distances; reach: the squared projected distance at which a search with a k-th best score stops.
    """
    best_ids, best = np.empty(0, np.int64), np.empty(0)
    left, step, verified = np.flatnonzero(near < reach(least)), STEP, 0
    slack = 1e-9 * max(1.0, float(np.abs(query).sum()) * float(np.abs(vectors).max(initial=0)))
    while len(left):
        if len(left) > step:
            parts = np.argpartition(near[left], step - 1)
            now, left = left[parts[:step]], left[parts[step:]]
        else:
            now, left = left, left[:0]
        verified += len(now)
        now = now[vectors[now] @ query >= least - slack]
        scores = _products(vectors[now], query)
        keep = (scores >= least) & (ids[now] != own)
        best_ids, best = np.concatenate([best_ids, ids[now][keep]]), np.concatenate([best, scores[keep]])
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
        if len(best) == k:
            least = max(least, float(best[-1]))
        left, step = left[near[left] < reach(least)], 2 * step
    return best_ids, best, verified


def _found(batch_ids: np.ndarray, vectors: np.ndarray, space: Space, visits: pa.Table, k: int, point: float) -> Iterator[tuple]:
    """(query_id, vec_id, score, verified) of the nearest of a block, for each query that visits it."""
    points = space.candidates(vectors)
    tree = build_tree(points, LEAF)
    ids, vectors, points = batch_ids[tree.order], np.ascontiguousarray(vectors[tree.order]), points[tree.order]
    leaf = np.repeat(np.arange(len(tree.ends)), np.diff(tree.ends, prepend=0))
    squares = (points * points).sum(1)
    queries = _matrix(visits["vector"].combine_chunks())
    norms = np.linalg.norm(queries, axis=1)
    bounds, query_ids = visits["bound"].to_numpy(), visits["query_id"].to_pylist()
    for lot in range(0, len(queries), LOT):
        at = space.queries(queries[lot : lot + LOT])
        all_near = squares - 2 * (at @ points.T) + (at * at).sum(1)[:, None]
        for n, near in enumerate(all_near, lot):
            reach = lambda score, norm=norms[n]: point * 2 * space.norm * (space.norm * (1 + 1e-9) - score / norm)
            if bounds[n] > -np.inf:
                near = np.where((tree.distances(at[n - lot]) < reach(bounds[n]))[leaf], near, np.inf)
            found = _incremental(near, ids, vectors, queries[n], query_ids[n], k, bounds[n], reach)
            yield from ((query_ids[n], vec_id, score, found[2]) for vec_id, score in zip(found[0].tolist(), found[1].tolist(), strict=True))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest candidates of each query; both: (vec_id, vector), see usable()."""
    spark = candidates.sparkSession
    copies = Window.partitionBy("vector").orderBy("vec_id")
    candidates = candidates.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    candidates = write_table(candidates, "candidates")
    length = candidates.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = length.n if length else 1
    candidates, queries = candidates.filter(F.size("vector") == n), queries.filter(F.size("vector") == n)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    facts = candidates.agg(F.max(square).alias("square"), F.count(F.lit(1)).alias("rows")).first()
    norm = math.sqrt(facts.square or 1.0) * (1 + 1e-12)
    matrix = np.random.default_rng(5).standard_normal((n + 1, DIMS))
    whole = Space(matrix, norm, np.zeros((1, DIMS)), np.zeros((1, DIMS)))
    share = min(1.0, SAMPLE / max(facts.rows, 1))
    sample = candidates.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    vectors = [row.vector for row in sample.select("vector").toLocalIterator()]
    points = whole.candidates(np.array(vectors, np.float64).reshape(-1, n)) if vectors else np.zeros((1, DIMS))
    cells = min(CELLS, max(1, 2 * facts.rows // BLOCK))
    tree = build_tree(points, max(1, -(-len(points) // cells)))
    space = spark.sparkContext.broadcast(Space(matrix, norm, tree.low, tree.high))
    point = chi_square_point(confidence)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Space(*space.value)
        for batch in batches:
            if batch.num_rows:
                cell = own.cell(own.candidates(_matrix(batch["vector"])))
                yield pa.record_batch({"vec_id": batch["vec_id"], "vector": batch["vector"], "cell": pa.array(cell)})

    placed = write_table(candidates.mapInArrow(locate, "vec_id long, vector array<double>, cell int"), "placed")
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))  # CELLS rows at most
    parts = write_table(parts, "parts")

    def visit(visits: DataFrame) -> DataFrame:
        """Let (query_id, vector, bound, cell) search their cells."""
        visits = write_table(visits, "visits")
        groups = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("groups"))
        sizes = F.broadcast(parts.join(groups, "cell", "left").withColumn("groups", F.coalesce("groups", F.lit(0))))
        blocks = (
            placed.join(sizes, "cell").filter("groups > 0").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("cell", "part", "group", "vec_id", "vector")
        )
        asked = (
            visits.join(sizes, "cell").withColumn("group", F.pmod(F.xxhash64("query_id"), "groups").cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "group", "query_id", "vector", "bound")
        )
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            if left.num_rows and right.num_rows:
                own = _matrix(left["vector"].combine_chunks())
                found = _found(left["vec_id"].to_numpy(), own, Space(*space.value), right, k, point)
                rows = [row[:3] for row in found]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 3, schema, strict=True)], schema=schema)

        keys = ["cell", "part", "group"]
        found = blocks.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
        return write_table(_best(found, k).select("query_id", "vec_id", "score"), "found")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Space(*space.value)
        for batch in batches:
            if batch.num_rows:
                cell = own.cell(own.queries(_matrix(batch["vector"])))
                least = pa.array(np.full(batch.num_rows, -np.inf))
                yield pa.record_batch({"query_id": batch["vec_id"], "vector": batch["vector"], "bound": least, "cell": pa.array(cell)})

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Space(*space.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, bounds, cells = _matrix(batch["vector"]), batch["bound"].to_numpy(), batch["cell"].to_numpy()
            points, scale = own.queries(vectors), 2 * own.norm / np.linalg.norm(vectors, axis=1)
            rows, to = [], []
            for k, p in enumerate(points):
                gap = np.maximum(np.maximum(own.low - p, p - own.high), 0)
                meets = (gap * gap).sum(1) < point * (2 * own.norm**2 - scale[k] * bounds[k])
                meets[cells[k]] = False
                to.append(np.flatnonzero(meets).astype(np.int32))
                rows += [k] * len(to[-1])
            take = batch.select(["query_id", "vector", "bound"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*take.columns, pa.array(np.concatenate(to))], names=["query_id", "vector", "bound", "cell"])

    fields = "query_id long, vector array<double>, bound double, cell int"
    first = write_table(queries.mapInArrow(home, fields), "first")
    near = visit(first)
    bounds = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    second = first.join(bounds, "query_id", "left").select(
        "query_id", "vector", F.coalesce("least", "bound").alias("bound"), "cell"
    )
    return _best(near.union(visit(second.mapInArrow(others, fields))), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    along = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
