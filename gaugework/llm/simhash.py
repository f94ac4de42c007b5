"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

Fingerprint: A-Z is lower-cased, words are runs without ASCII white space, shingles are four words joined by a space
(a shorter text is one shingle), and a bit is set if more than half of the shingles' XXH64 values (seed 42) have it.

Embedding: the 64 bits are 32 segments of two bits, and a fingerprint maps to its 32 segment counts (0, 1 or 2). The
Manhattan distance of two embeddings never exceeds the number of differing bits. Counts are kept in unary (00, 01,
11), so that distance is the bit count of an exclusive or.

Grid: the 32 coordinates form eight groups. Two embeddings within Manhattan distance four differ in four groups at
most, so they agree on four whole groups: each choice of four groups is one grid, and a fingerprint has one cell in
each of the 70 grids. Members of a cell are compared in one task: first the Manhattan bound, then the differing bits.
A task writes a spanning forest of the links it finds, never all pairs. A cell above ``CELL`` members is only named
there; its members are dealt as pairs of blocks to several tasks, so every pair still meets.

Equal fingerprints are one node from the start; a group of copies of any size is one row. Components are found on
the forest. Nothing but counts reaches the driver.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; rows
with the same key are documents of their own in the report; ``component_id`` ignores null keys and is null where a
component has no other; an empty table gives an empty result; other columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.columns import ref
from gaugework.llm.common import attached, fact_column, keyed, written
from gaugework.llm.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
CELL = 4096
_LOW = 0x5555555555555555
_GROUP_SEGMENTS = (4,) * 8
_ROWS = 16_384  # shingles whose bits are added at once


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0] + ends[:-SHINGLE]
    hashes = np.array([digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[SHINGLE - 1:])], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS):
        bits = np.unpackbits(hashes[at:at + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    made = np.array([fingerprint(t.as_py()) for t in texts], np.uint64)
    return pa.array(made.view(np.int64), pa.int64())


def embedded(bits: Column) -> Column:
    """Unary segment counts of a fingerprint."""
    low, high = bits.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def _embedded_array(bits: np.ndarray) -> np.ndarray:
    low, high = bits & np.uint64(_LOW), (bits >> np.uint64(1)) & np.uint64(_LOW)
    return ((low & high) << np.uint64(1)) | (low | high)


def grid_masks() -> list[int]:
    """For each grid the bits of its coordinates, as signed 64-bit numbers."""
    groups, at = [], 0
    for segments in _GROUP_SEGMENTS:
        groups.append(((1 << (2 * segments)) - 1) << at)
        at += 2 * segments
    masks = [sum(c) for c in combinations(groups, len(groups) - DISTANCE)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def cells(nodes: DataFrame) -> DataFrame:
    """(cell, fp): each fingerprint in its cell of every grid."""
    marks = [F.xxhash64(F.lit(i), F.col("e").bitwiseAND(F.lit(m))) for i, m in enumerate(grid_masks())]
    return nodes.select("fp", embedded(F.col("fp")).alias("e")).select(F.explode(F.array(*marks)).alias("cell"), "fp")


def forest(fps: np.ndarray, sides: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``fps`` (unsigned)."""
    shape = _embedded_array(fps)
    open_ = np.arange(len(fps))
    while len(open_):
        front, open_ = [int(open_[0])], open_[1:]
        while front and len(open_):
            i = front.pop()
            near = open_[np.bitwise_count(shape[open_] ^ shape[i]) <= DISTANCE]
            if len(near):
                near = near[np.bitwise_count(fps[near] ^ fps[i]) <= DISTANCE]
            if len(near):
                for j in near.tolist():
                    yield i, j
                open_ = open_[~np.isin(open_, near, assume_unique=True)]
                front.extend(near.tolist())


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("large", pa.int64())])


def _edges(a: list[np.ndarray], b: list[np.ndarray], large: list[int]) -> pa.RecordBatch:
    none = len(large)
    left, right = (np.concatenate([*side, np.empty(0, np.int64)]) for side in (a, b))
    return pa.RecordBatch.from_arrays([
        pa.array(left.tolist() + [None] * none, pa.int64()), pa.array(right.tolist() + [None] * none, pa.int64()),
        pa.array([None] * len(left) + large, pa.int64()),
    ], schema=_EDGE)


def _run_edges(rows: np.ndarray, cell: int) -> pa.RecordBatch:
    """Forest edges of each run of equal cells in ``rows`` (cell, fp); runs above ``cell`` members are only named."""
    starts = np.append(np.concatenate([[0], (rows[1:, 0] != rows[:-1, 0]).nonzero()[0] + 1]), len(rows))
    sizes = np.diff(starts)
    # cells of two members at once
    two = starts[:-1][sizes == 2]
    p, q = rows[two, 1], rows[two + 1, 1]
    x, y = p.view(np.uint64), q.view(np.uint64)
    link = np.bitwise_count(_embedded_array(x) ^ _embedded_array(y)) <= DISTANCE
    link &= (np.bitwise_count(x ^ y) <= DISTANCE) & (p != q)
    a, b, large = [p[link]], [q[link]], rows[starts[:-1][sizes > cell], 0].tolist()
    middle = (sizes > 2) & (sizes <= cell)
    for s, n in zip(starts[:-1][middle].tolist(), sizes[middle].tolist()):
        members = np.unique(rows[s:s + n, 1])
        tree = list(forest(members.view(np.uint64)))
        if tree:
            a.append(members[[i for i, _ in tree]])
            b.append(members[[j for _, j in tree]])
    return _edges(a, b, large)


def _cell_edges(cell: int):
    """The edges of sorted (cell, fp) rows; a run that outgrows ``cell`` is named and not held."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, skipped = np.empty((0, 2), np.int64), None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)], axis=1)
            if skipped is not None:
                rows = rows[rows[:, 0] != skipped]
            rows = np.concatenate([rest, rows]) if len(rest) else rows
            if not len(rows):
                continue
            # the last run may go on in the next batch
            last = int(np.argmax(rows[:, 0] == rows[-1, 0]))
            rest = rows[last:]
            if last:
                yield _run_edges(rows[:last], cell)
            if len(rest) > cell:
                skipped = rest[0, 0]
                yield _edges([], [], [int(skipped)])
                rest = rest[:0]
        if len(rest):
            yield _run_edges(rest, cell)

    return read


def links(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all links of ``nodes`` (fp: distinct) do."""
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cells(nodes.repartition(width, "fp"))

    def searched(rows: DataFrame, most: int) -> DataFrame:
        runs = rows.repartition(width, "cell").sortWithinPartitions("cell")
        return runs.mapInArrow(_cell_edges(most), "a long, b long, large long")

    found = written(searched(placed, cell), "grid-edges")
    edges = found.where("a IS NOT NULL").select("a", "b")
    large = found.where("large IS NOT NULL").select(F.col("large").alias("c")).distinct()
    if large.limit(1).count():
        # members of the large cells are dealt in blocks, and block i meets block j in a cell of their own
        members = written(placed.join(large, F.col("cell") == F.col("c"), "left_semi"), "large-cells")
        counts = members.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks"))
        sized = members.join(counts, F.col("cell") == F.col("c"))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.xxhash64("cell", F.least(own, j), F.greatest(own, j)),
        )
        dealt = sized.select(F.explode(pairs).alias("cell"), "fp")
        # a pair of blocks has two blocks' members, give or take the hash; it is never named again
        edges = edges.unionByName(searched(dealt, 1 << 62).select("a", "b"))
    return edges.distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints (k, m, fp), and per fingerprint its component: fp, root."""
    prints = written(keyed(docs, key, text).select("k", "m", _fingerprints("text").alias("fp")), "fingerprints")
    nodes = written(prints.select("fp").distinct(), "fingerprint-nodes")
    roots = components(links(nodes))
    linked = written(
        nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "fingerprint-roots"
    )
    return prints, linked


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest key of its component)."""
    prints, linked = classes(docs, key, text)
    firsts = prints.groupBy("fp").agg(F.min("k").alias("k"))
    named = linked.join(firsts, "fp").groupBy("root").agg(F.min("k").alias("component_id"))
    of = written(linked.join(named, "root").select(F.col("fp").alias("node"), "component_id"), "fingerprint-components")
    return prints.join(of, prints["fp"] == of["node"]).select(
        F.col("k").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the smallest (key, text mark); rows equal in both stay once."""
    prints, linked = classes(docs, key, text)
    firsts = prints.groupBy("fp").agg(F.min(F.struct("k", "m")).alias("p"))
    kept = linked.join(firsts, "fp").groupBy("root").agg(F.min("p").alias("p"))
    facts = written(kept.select("p.k", "p.m", F.struct(F.lit(True).alias("kept")).alias("f")), "group-heads")
    fact = fact_column(docs)
    rows = attached(docs, key, text, facts, "inner").drop(fact)
    twice = prints.groupBy("k", "m").count().where("count > 1").limit(1).count()
    return rows if not twice else rows.dropDuplicates([key, text])
