"""Hard negatives of anchors by a secondary-sort shuffle over scored pairs.

A pair's score is the integer inner product of two integer vectors. An anchor's positives are its first rows of the same
label, by falling score and then id. For each positive the first rows of other labels are returned whose score s
satisfies low * p <= 100 * s <= high * p, where p is the positive's score.

Scoring: anchors go in blocks of at most ``BLOCK_BYTES``, one pass over the rows for each, and a row is read where it
lies. A task scores its rows against the block in tiles and keeps, for each anchor, what can be among the
results at all: its own first positives and, once the positives are known, its own first negatives in the window of each
positive. Any row that is among the first of all rows is among the first of its task, so nothing is lost.

Sort: the kept pairs carry the key (anchor, falling score, positives first, id). They are partitioned by anchor and
sorted by the whole key; an iterator reads the order once, opens a window at each positive, and writes the
negatives that pass through open windows. It holds the open windows of one anchor and nothing else.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of
different lengths are compared as if padded with zeros; rows that share id, label and vector are one row, rows that
share an id only are rows of their own, never paired with each other; scores beyond 64 bits are cut to the
largest; an anchor without positives or without negatives in a window has no rows there; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import ref
from gaugework.llm.common import written
from gaugework.llm.neighbours import vectors_of

BLOCK_BYTES = 16 << 20
_TILE = 256
_LARGEST = np.iinfo(np.int64).max
_PAIR = "anchor int, falling long, kind int, id long"


def taking_part(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(id, label, v) of the rows that take part; components are whole numbers held as doubles."""
    v = ref(vector).cast("array<double>")
    kept = rows.select(ref(key).cast("long").alias("id"), ref(label).alias("label"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    )
    kept = kept.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return kept.withColumn("label", F.xxhash64("label"))


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, cut to 64 bits."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    bound = float(width) * max(1.0, np.abs(left).max(initial=0)) * max(1.0, np.abs(right).max(initial=0))
    if bound < 2.0**53:
        return (left @ right.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in left], [[int(x) for x in row] for row in right]
    made = [[min(_LARGEST, max(-_LARGEST, sum(map(int.__mul__, a, b)))) for b in exact[1]] for a in exact[0]]
    return np.array(made, np.int64).reshape(len(left), len(right))


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group by (score falling, id)."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])) if len(order) else np.empty(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


class Block:
    """Some of the anchors: what every task needs of them."""

    def __init__(self, table: pa.Table):
        self.ids = np.array(table["id"], np.int64)
        self.labels = np.array(table["label"], np.int64)
        lists = table["v"].combine_chunks()
        self.rows = vectors_of(lists, int(np.diff(lists.offsets.to_numpy()).max(initial=0)))

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(first anchor of the tile, scores, same label, ids): a tile of anchors against the rows of a batch."""
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lists = batch.column(2)
        rows = vectors_of(lists, int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
        for at in range(0, len(self.ids), _TILE):
            tile = slice(at, at + _TILE)
            made = scores(self.rows[tile], rows)
            yield at, made, self.labels[tile, None] == labels[None, :], ids

    def positives(self, k: int):
        """The first ``k`` rows of the anchor's label in each task."""

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = tuple(np.empty(0, np.int64) for _ in range(3))
            least = np.full(len(self.ids), -_LARGEST)
            for batch in batches:
                found = [kept]
                for at, made, same, ids in self.tiles(batch):
                    same &= self.ids[at:at + _TILE, None] != ids[None, :]
                    bar = least[at:at + _TILE].copy()
                    if made.shape[1] > k:
                        inside = np.where(same, made, -_LARGEST)
                        bar = np.maximum(bar, np.partition(inside, made.shape[1] - k, axis=1)[:, made.shape[1] - k])
                    a, b = np.nonzero(same & (made >= bar[:, None]))
                    found.append((a + at, made[a, b], ids[b]))
                group, score, of = (np.concatenate(x) for x in zip(*found))
                first = first_of_each(group, score, of, k)
                kept = group[first], score[first], of[first]
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(self.ids)) >= k)
                lowest = np.full(len(self.ids), _LARGEST)
                np.minimum.at(lowest, kept[0], kept[1])
                least[full] = lowest[full]
            yield pairs(*kept, 0)

        return search

    def negatives(self, windows: np.ndarray, k: int):
        """The first ``k`` rows of other labels in each task, for each window (anchor, least, most)."""
        anchors = windows[:, 0]
        lowest, highest = np.full(len(self.ids), _LARGEST), np.full(len(self.ids), -_LARGEST)
        np.minimum.at(lowest, anchors, windows[:, 1])
        np.maximum.at(highest, anchors, windows[:, 2])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = tuple(np.empty(0, np.int64) for _ in range(3))
            for batch in batches:
                found = [kept]
                for at, made, same, ids in self.tiles(batch):
                    tile = slice(at, at + _TILE)
                    near = ~same & (made >= lowest[tile, None]) & (made <= highest[tile, None])
                    near &= self.ids[tile, None] != ids[None, :]
                    a, b = np.nonzero(near)
                    score, of = made[a, b], ids[b]
                    # windows of an anchor lie together; each pair meets all windows of its anchor
                    begin, end = np.searchsorted(anchors, a + at), np.searchsorted(anchors, a + at, "right")
                    for j in range(int((end - begin).max(initial=0))):
                        window = begin + j
                        inside = np.flatnonzero(window < end)
                        inside = inside[(score[inside] >= windows[window[inside], 1]) & (score[inside] <= windows[window[inside], 2])]
                        found.append((window[inside], score[inside], of[inside]))
                window, score, of = (np.concatenate(x) for x in zip(*found))
                first = first_of_each(window, score, of, k)
                kept = window[first], score[first], of[first]
            once = np.unique(np.stack([anchors[kept[0]], kept[1], kept[2]]), axis=1)
            yield pairs(*once, 1)

        return search


def pairs(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(anchor.astype(np.int32)), pa.array(-score), pa.array(np.full(len(anchor), kind, np.int32)), pa.array(ids),
    ], names=["anchor", "falling", "kind", "id"])


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest negative score for a positive's score."""
    return -(-low * score // 100), high * score // 100


def streamed(ids: np.ndarray, k: int, low: int, high: int):
    """Reads pairs in key order: positives open windows, negatives pass through the open ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, open_ = None, []
        for batch in batches:
            out = []
            for a, falling, kind, of in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != anchor:
                    anchor, open_ = a, []
                score = -falling
                if kind == 0:
                    open_.append([of, score, *window_of(score, low, high), 0])
                    continue
                # windows that the order has left, or that are full, are closed
                open_ = [w for w in open_ if score >= w[2] and w[4] < k]
                for w in open_:
                    if score <= w[3]:
                        w[4] += 1
                        out.append((int(ids[a]), w[0], w[4], of, w[1], score))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), _TYPES)],
                    names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
                )

    return read


_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors`` tells which rows are anchors."""
    if not 0 <= low <= high <= 100:
        raise ValueError("0 <= low <= high <= 100 is needed: the order passes a positive before its negatives")
    spark = rows.sparkSession
    part, own = taking_part(rows, key, label, vector), taking_part(rows.where(anchors), key, label, vector).distinct()
    if part.groupBy("id").count().where("count > 1").limit(1).count():
        part = part.dropDuplicates()
    own = written(own, "anchors")
    size = own.agg(F.coalesce(F.sum(8 * F.size("v") + 16), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    results = []
    for b in range(blocks):
        block = Block(own.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).orderBy("id", "label").toArrow())
        if not len(block.ids):
            continue
        order = Window.partitionBy("anchor").orderBy("falling", "id")
        best = part.mapInArrow(block.positives(positives), _PAIR).withColumn("n", F.row_number().over(order))
        best = written(best.where(F.col("n") <= positives).drop("n"), "positive-pairs")
        # at most ``positives`` rows for each anchor of the block
        known = best.select("anchor", "falling").orderBy("anchor").toArrow()
        windows = [(a, *window_of(-f, low, high)) for a, f in zip(known["anchor"].to_pylist(), known["falling"].to_pylist())]
        if not windows:
            continue
        found = part.mapInArrow(block.negatives(np.array(windows, np.int64), negatives), _PAIR)
        keyed = best.unionByName(found).repartition(width, "anchor").sortWithinPartitions("anchor", "falling", "kind", "id")
        result = keyed.mapInArrow(streamed(block.ids, negatives, low, high), RESULT)
        results.append(result if blocks == 1 else written(result, "negatives"))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], RESULT)
