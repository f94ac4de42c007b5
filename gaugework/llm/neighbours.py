"""Approximate nearest neighbours by a forest of random-projection trees.

Fit: ``trees`` trees are grown on a bounded sample (``sample_rows`` rows, chosen by hash). A node takes the random
direction, of eight, along which its sample spreads most, and cuts at the sample's median. The number of leaves
follows the rows (``leaf_rows`` in a leaf), as far as the sample and ``model_bytes`` reach; beyond that leaves grow.

Index: every row falls into one leaf of each tree. Leaf sizes (trees x leaves numbers) are all that reaches the driver.

Search: a query walks all trees through one priority queue. An entry's cost is the sum of the squared distances to
the planes that its path crosses; a popped entry descends to its leaf and puts the other sides on the queue. The
walk ends when the leaves hold the budget of candidates. The budget is calibrated: for ``calibration`` queries the true
neighbours are found among all rows, and the budget is the smallest that reaches ``recall`` of them. Where nothing
separates the neighbours the budget grows to all rows, so recall is kept at the price of time.

Reranking: a leaf and the queries that chose it meet in cells of at most ``CELL_ROWS`` rows and ``CELL_QUERIES``
queries, so a leaf that holds a third of all rows, or that a third of all queries choose, is many tasks. A cell
holds its vectors, and queries stream past. Candidates are picked by matrix products and scored again term by term
in double precision, so equal vectors have equal scores. Each task gives at most ``k`` rows for a query, or for each of
its cells where it meets more than ``COMBINED`` queries.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; shorter vectors count as padded
with zeros; rows that share id and vector are one row, and of several vectors under one id each is a query and
a candidate of its own, never for its own id; null ids take no part; an empty table, or one row, gives no rows; other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import ref
from gaugework.llm.common import in_pieces, written

CELL_ROWS = 2048
CELL_QUERIES = 1024
COMBINED = 20_000
_DIRECTIONS = 8
_SLACK = 1e-9


@dataclass(frozen=True)
class ForestOptions:
    trees: int = 6
    leaf_rows: int = 800
    sample_rows: int = 16_384
    sample_per_leaf: int = 16
    model_bytes: int = 64 << 20
    calibration: int = 200
    recall: float = 0.96
    seed: int = 7


@dataclass
class Forest:
    """Inner nodes of a tree are numbered like a heap; node i has the sides 2i + 1 (not above the cut) and 2i + 2."""

    planes: np.ndarray  # trees, nodes, dim
    cuts: np.ndarray  # trees, nodes
    depth: int

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf numbers, counted through all trees."""
        found = np.empty((len(rows), len(self.planes)), np.int64)
        inner = (1 << self.depth) - 1
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                above = np.einsum("ij,ij->i", rows, planes[node]) > cuts[node]
                node = 2 * node + 1 + above
            found[:, t] = node - inner + (t << self.depth)
        return found

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, in the order in which the shared priority queue gives them."""
        inner = (1 << self.depth) - 1
        margins = (self.planes @ query - self.cuts).tolist()
        queue = [(0.0, t, 0) for t in range(len(margins))]
        while queue:
            cost, t, node = heapq.heappop(queue)
            margin = margins[t]
            while node < inner:
                m = margin[node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (cost + m * m, t, far))
                node = near
            yield node - inner + (t << self.depth)


def grown(sample: np.ndarray, leaves: int, options: ForestOptions) -> Forest:
    """The forest over a sample (rows, dim), of at least ``leaves`` leaves a tree."""
    random, dim = np.random.default_rng(options.seed), sample.shape[1]
    depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
    inner = (1 << depth) - 1
    planes, cuts = np.zeros((options.trees, inner, dim)), np.zeros((options.trees, inner))
    for t in range(options.trees):
        side = np.zeros(len(sample), np.int64)
        for node in range(inner):
            ways = random.standard_normal((_DIRECTIONS, dim))
            ways /= np.linalg.norm(ways, axis=1, keepdims=True)
            here = np.flatnonzero(side == node)
            seen = sample[here] @ ways.T
            best = int(np.argmax(seen.var(axis=0))) if len(here) else 0
            planes[t, node] = ways[best]
            cuts[t, node] = np.median(seen[:, best]) if len(here) else 0.0
            side[here] = 2 * node + 1 + (seen[:, best] > cuts[t, node])
    return Forest(planes, cuts, depth)


def packed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part, components as doubles."""
    v = ref(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        rows.select(ref(key).cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(whole & F.exists("v", lambda x: x != 0))
    )


def vectors_of(column: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors of a batch as rows of one length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(flat) else []] = flat
    return out


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, terms added from the first to the last in double precision."""
    return np.cumsum(rows * query, axis=1)[:, -1]


def nearest(ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, query: np.ndarray, own: int, k: int,
            least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` first rows by (score falling, id); ``rough`` are the products up to rounding.

    Rows below ``least`` may be left out.
    """
    slack = _SLACK * (np.abs(query).sum() * np.abs(rows).max(initial=0) + 1e-300)
    near = np.flatnonzero((rough >= least - slack) & (ids != own))
    if len(near) > k:
        bar = np.partition(rough[near], len(near) - k)[len(near) - k]
        near = near[rough[near] >= bar - slack]
    scores = products(rows[near], query)
    first = np.lexsort((ids[near], -scores))[:k]
    return near[first], scores[first]


def _sampled(rows: DataFrame, n: int, salt: int) -> DataFrame:
    """The n rows of the smallest hashes: a function of the rows alone."""
    mark = F.xxhash64(F.lit(salt), F.col("id"), F.col("v"))
    return rows.select("id", "v", mark.alias("h")).orderBy("h", "id").limit(n)


def _true_neighbours(rows: DataFrame, queries: pa.Table, forest: Forest, dim: int, k: int) -> DataFrame:
    """(q, leaves): for each of a few queries the leaves of each of its k true neighbours, over all rows."""
    ids = np.array(queries["id"], np.int64)
    wanted = vectors_of(queries["v"].combine_chunks(), dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = [(np.empty(0, np.int64), np.empty((0, dim)), np.empty(0)) for _ in ids]
        for batch in batches:
            of, seen = batch.column(0).to_numpy(), vectors_of(batch.column(1), dim)
            rough = wanted @ seen.T
            for q, (kept_ids, kept, _) in enumerate(best):
                at, scores = nearest(of, seen, rough[q], wanted[q], ids[q], k)
                both = np.concatenate([kept_ids, of[at]])
                both_scores = np.concatenate([best[q][2], scores])
                first = np.lexsort((both, -both_scores))[:k]
                best[q] = (both[first], np.concatenate([kept, seen[at]])[first], both_scores[first])
        for q, (of, seen, scores) in enumerate(best):
            if len(of):
                yield pa.RecordBatch.from_arrays([
                    pa.array([q] * len(of), pa.int64()), pa.array(of), pa.array(scores),
                    pa.array(forest.leaves(seen).tolist(), pa.list_(pa.int64())),
                ], names=["q", "id", "score", "leaves"])

    found = rows.mapInArrow(search, "q long, id long, score double, leaves array<long>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "leaves")


def _budget(forest: Forest, sizes: np.ndarray, queries: np.ndarray, found: pa.Table, recall: float) -> int:
    """Candidates that a walk has to gather to meet ``recall`` of the true neighbours."""
    reached = np.zeros((len(queries), len(sizes)))
    for i, query in enumerate(queries):
        order = np.fromiter(forest.walk(query), np.int64, len(sizes))
        reached[i, order] = np.cumsum(sizes[order])
    needs = np.sort([reached[q, leaves].min() for q, leaves in zip(found["q"].to_pylist(), found["leaves"].to_pylist())])
    return int(needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))) - 1)])


def _placed(forest: Forest, dim: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors_of(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(rows), pa.array(forest.leaves(rows).tolist(), pa.list_(pa.int64()))],
                names=["id", "v", "leaves"],
            )

    return place


def _walked(forest: Forest, sizes: np.ndarray, budget: int, dim: int):
    counts = sizes.tolist()

    def chosen(query: np.ndarray) -> list[int]:
        leaves, held = [], 0
        for leaf in forest.walk(query):
            if counts[leaf]:
                leaves.append(leaf)
                held += counts[leaf]
            if held >= budget:
                break
        return leaves

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors_of(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(rows), pa.array([chosen(r) for r in rows], pa.list_(pa.int64()))], names=["id", "v", "leaves"],
            )

    return walk


def _reranked(dim: int, k: int):
    """Rows sorted by (cell, kind): a cell's vectors (kind 0) are held, its queries (kind 1) stream past.

    A task meets a query in several cells and combines what it finds, for up to ``COMBINED`` queries at a time.
    """

    def told(best: dict) -> Iterator[pa.RecordBatch]:
        rows = ((own, mark, i, -falling) for (own, mark), found in best.items() for falling, i in found)
        return in_pieces(rows, _FOUND)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, rows = None, [], []
        best: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            of, seen = batch.column(2).to_numpy(), vectors_of(batch.column(3), dim)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                if start == end:
                    continue
                if cells[start] != cell:
                    cell, ids, rows = cells[start], [], []
                if kinds[start] == 0:
                    ids.append(of[start:end])
                    rows.append(seen[start:end])
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                for at in range(start, end, 512):
                    block = seen[at:min(end, at + 512)]
                    rough = block @ rows[0].T
                    for i, query in enumerate(block):
                        own = int(of[at + i])
                        key = own, _mark(query)
                        found = best.get(key, [])
                        near, scores = nearest(ids[0], rows[0], rough[i], query, own, k, -found[-1][0] if len(found) == k else -np.inf)
                        if len(near):
                            # trees share candidates: equal pairs are one
                            best[key] = sorted({*found, *zip((-scores).tolist(), ids[0][near].tolist())})[:k]
                if len(best) >= COMBINED:
                    yield from told(best)
                    best = {}
        yield from told(best)

    return rerank


_FOUND = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _mark(query: np.ndarray) -> int:
    """Tells vectors under one id apart."""
    return int(np.uint64(xxhash.xxh64_intdigest(query.tobytes())).view(np.int64))


def neighbours(rows: DataFrame, wanted: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
               options: ForestOptions = ForestOptions()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``wanted`` holds."""
    spark = rows.sparkSession
    index, queries = packed(rows, key, vector), packed(rows.where(wanted), key, vector)
    if index.groupBy("id").count().where("count > 1").limit(1).count():
        index, queries = index.dropDuplicates(["id", "v"]), queries.dropDuplicates(["id", "v"])
    n, dim = index.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = _sampled(index, options.sample_rows, 0).select("v").toArrow()
    width = min(
        -(-n // options.leaf_rows), max(1, sample.num_rows // options.sample_per_leaf),
        max(1, options.model_bytes // (8 * dim * options.trees)),
    )
    forest = grown(vectors_of(sample["v"].combine_chunks(), dim), max(width, 4), options)
    leaves = options.trees << forest.depth

    placed = written(index.mapInArrow(_placed(forest, dim), "id long, v array<double>, leaves array<long>"), "forest-index")
    counted = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().toArrow()
    sizes = np.zeros(leaves, np.int64)
    sizes[np.array(counted["leaf"])] = np.array(counted["count"])

    tried = _sampled(queries, options.calibration, 1).select("id", "v").toArrow()
    if not tried.num_rows:
        return spark.createDataFrame([], schema)
    found = _true_neighbours(index, tried, forest, dim, k).toArrow()
    if not found.num_rows:
        return spark.createDataFrame([], schema)
    budget = _budget(forest, sizes, vectors_of(tried["v"].combine_chunks(), dim), found, options.recall)

    walked = written(queries.mapInArrow(_walked(forest, sizes, budget, dim), "id long, v array<double>, leaves array<long>"), "forest-walks")
    asked = walked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().toArrow()
    asking = np.zeros(leaves, np.int64)
    asking[np.array(asked["leaf"])] = np.array(asked["count"])

    # the cells of leaf l are numbered from first[l]; block a of its rows meets block b of its queries
    row_blocks, query_blocks = np.maximum(-(-sizes // CELL_ROWS), 1), np.maximum(-(-asking // CELL_QUERIES), 1)
    first = np.concatenate([[0], np.cumsum(row_blocks * query_blocks)[:-1]])
    table = spark.createDataFrame(
        [(i, *map(int, x)) for i, x in enumerate(zip(row_blocks, query_blocks, first, asking)) if x[3]],
        "leaf long, a long, b long, first long, asking long",
    )
    cells = F.broadcast(table.select("leaf", "a", "b", "first"))  # trees x leaves rows, bounded by model_bytes

    def dealt(side: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(kind), "id", "v"), F.col(own))
        met = F.sequence(F.lit(0).cast("long"), F.col(other) - 1)
        number = (lambda j: F.col("first") + block * F.col("b") + j) if kind == 0 else (lambda j: F.col("first") + j * F.col("b") + block)
        return (
            side.select("id", "v", F.explode("leaves").alias("leaf")).join(cells, "leaf")
            .select(F.explode(F.transform(met, number)).alias("cell"), F.lit(kind).alias("kind"), "id", "v")
        )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    meeting = dealt(placed, 0, "a", "b").unionByName(dealt(walked, 1, "b", "a"))
    met = meeting.repartition(parts, "cell").sortWithinPartitions("cell", "kind")
    scored = met.mapInArrow(_reranked(dim, k), "query_id long, mark long, vec_id long, score double")
    scored = scored.repartition(parts, "query_id", "mark").dropDuplicates()
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
