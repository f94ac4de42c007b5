"""Random forests on binned features, grown level by level for several training sets at once.

A tree only sees in which bin a value lies, so rows that agree in all bins (and in the class) are one item with a count: the
rows are read once, put in bins, counted and stored as shards of items. A level of all trees of all training sets is then one job:
tasks sum the histograms of their shards, a group per tree adds them up and chooses the splits, and what reaches the driver is the
splits. Where hardly any rows agree, the items are the rows, and the work is in proportion to them.

The model is that of Spark ML with its defaults: bootstrap weights drawn from Poisson(1) for each row and tree, a random
subset of the features for each node (square root of their number for classes, a third for numbers), Gini or variance, at least
``leaf`` drawn rows on either side. The weight of an item of n rows of a class is drawn from Poisson(n), which is the sum of their
draws. For numbers each row's weight is drawn by itself, and an item keeps the sums for every tree; these rows are not shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.operators.lineage import stored

CHUNK = 200_000  # rows that are put in bins, or scored, at once
SHARD = 200_000  # items of a shard
SUMS = 40_000  # items of a shard that keep sums for every tree
HELD = 64 << 20  # bytes of histograms that a task holds before it hands them on
# Poisson(0) to Poisson(8) by inversion of 16 random bits
_POISSON = np.concatenate([np.searchsorted(
    np.cumsum([math.exp(-n) * n**i / math.factorial(i) for i in range(40)]), (np.arange(1 << 16) + 0.5) / (1 << 16)) for n in range(9)]).astype(np.uint8)
_SHARD_SCHEMA = "part int, items long, seed long, summed boolean, codes binary, label binary, weight binary"


@dataclass
class Forest:
    """Trees of one training set: in level d, node p goes to 2p of level d + 1 if its feature's bin is at most its cut, else to 2p + 1.

    A leaf sends all to the left, and its statistics are those of the node that they reach in the last level.
    """

    feature: list[np.ndarray]  # for each level: trees x nodes
    cut: list[np.ndarray]
    stats: list[np.ndarray]  # for each level and the one below the last: trees x nodes x (classes, or weight and sum)

    @classmethod
    def empty(cls, trees: int, depth: int, width: int) -> Forest:
        return cls(
            [np.zeros((trees, 1 << d), np.int64) for d in range(depth)], [np.full((trees, 1 << d), 255, np.uint8) for d in range(depth)],
            [np.zeros((trees, 1 << d, width)) for d in range(depth + 1)])

    def scores(self, codes: np.ndarray, classes: int) -> np.ndarray:
        """Mean class shares of the trees (items x classes), or their mean (items x 1). ``codes``: features x items."""
        flat, items = codes.ravel(), codes.shape[1]
        rows = np.arange(items)
        last = self.stats[-1]
        if classes:
            n = last.sum(-1, keepdims=True)
            values = np.where(n > 0, last / np.maximum(n, 1), 1 / classes)
        else:
            values = last[:, :, 1:] / np.where(last[:, :, :1] > 0, last[:, :, :1], 1)
        out = np.zeros((items, values.shape[-1]))
        for t in range(len(last)):
            out += values[t][_places(flat, items, rows, self.feature, self.cut, t, len(self.feature))]
        return out / len(last)


def _places(flat: np.ndarray, items: int, rows: np.ndarray, feature: list, cut: list, tree: int, level: int) -> np.ndarray:
    """The node of ``level`` that each of the items ``rows`` reaches."""
    place = np.zeros(len(rows), np.int64)
    for d in range(level):
        further = flat[(feature[d][tree] * items)[place] + rows] > cut[d][tree][place]
        place = 2 * place + further
    return place


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _codes(table: pa.Table, slots: list[str], cuts: list[np.ndarray]) -> np.ndarray:
    """features x rows: how many cut points of its feature lie below each value."""
    return np.array([np.searchsorted(c, table.column(s).to_numpy()) for s, c in zip(slots, cuts)], np.uint8)


def _words(codes: np.ndarray) -> np.ndarray:
    """words x items: the bytes of each item as whole numbers."""
    padded = np.zeros((codes.shape[1], -(-codes.shape[0] // 8) * 8), np.uint8)
    padded[:, :codes.shape[0]] = codes.T
    return np.ascontiguousarray(padded.view(np.uint64).T)


def _alike(words: np.ndarray, *further: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts equal items beside each other, ties by ``further``; first of each kind in that order)."""
    order = np.lexsort((*further, *words))
    placed = words[:, order]
    first = np.ones(len(order), bool)
    first[1:] = (placed[:, 1:] != placed[:, :-1]).any(0)
    return order, np.flatnonzero(first)


def _bytes_of(words: np.ndarray, rows: int) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(words.T).view(np.uint8)[:, :rows].T)


def _weights(seed: int, tree: int, counts: np.ndarray | None, items: int) -> np.ndarray:
    """The bootstrap weight of each item in a tree."""
    draw = np.random.Generator(np.random.PCG64([seed, tree]))
    random = draw.integers(0, 1 << 16, items, np.uint16)
    if counts is None:
        return _POISSON[1 << 16:2 << 16][random].astype(np.float64)
    out = _POISSON[random + (np.minimum(counts, 8) << 16)].astype(np.float64)
    many = np.flatnonzero(counts > 8)
    if len(many):
        out[many] = draw.poisson(counts[many])
    return out


class _Items:
    """Items of one training set, gathered over the chunks of a task."""

    def __init__(self, part: int, features: int, classes: int, trees: int, seed: int):
        self.part, self.features, self.classes, self.trees, self.seed = part, features, classes, trees, seed
        self.words = self.sums = None  # sums: counts x items, or (weight and sum of every tree) x items

    def counted(self, words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Items of classes; no two are alike."""
        for start in range(0, len(counts), SHARD):
            part = slice(start, start + SHARD)
            yield from self._merge(words[:, part], counts[None, part].astype(np.float64), SHARD)

    def rows(self, codes: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows with numbers."""
        if not len(label):
            return
        words = _words(codes)
        order, first = _alike(words, label)
        words, y = words[:, order], label[order]
        seed = zlib.crc32(y.tobytes(), zlib.crc32(words.tobytes(), self.seed + self.part))
        if len(first) * 8 > len(order):
            yield self._row(len(order), seed, False, _bytes_of(words, self.features), y, np.empty(0))
            return
        sums = []
        for t in range(self.trees):
            w = _weights(seed, t, None, len(y))
            sums += [np.add.reduceat(w, first), np.add.reduceat(w * y, first)]
        yield from self._merge(words[:, first], np.array(sums), SUMS)

    def _merge(self, words: np.ndarray, sums: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
        if self.words is None:
            self.words, self.sums = words, sums
            return
        both = np.concatenate([self.words, words], axis=1)
        order, first = _alike(both)
        if len(first) > most:
            yield from self.rest()
            self.words, self.sums = words, sums
        else:
            self.words = both[:, order[first]]
            self.sums = np.add.reduceat(np.concatenate([self.sums, sums], axis=1)[:, order], first, axis=1)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.words is None:
            return
        items = self.words.shape[1]
        seed = zlib.crc32(self.words.tobytes(), self.seed + self.part)
        if self.classes:
            raw = _bytes_of(self.words, self.features + 4)
            label = np.ascontiguousarray(raw[self.features:].T).view("<u4").ravel().astype(np.int64)
            yield self._row(items, seed, False, raw[:self.features], label, self.sums[0].astype(np.int64))
        else:
            yield self._row(items, seed, True, _bytes_of(self.words, self.features), np.empty(0), self.sums)
        self.words = None

    def _row(self, items: int, seed: int, summed: bool, codes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "part": self.part, "items": items, "seed": seed, "summed": summed,
            "codes": np.ascontiguousarray(codes).tobytes(), "label": label.tobytes(), "weight": np.ascontiguousarray(weight).tobytes(),
        }], pa.schema([("part", pa.int32()), ("items", pa.int64()), ("seed", pa.int64()), ("summed", pa.bool_()),
                       ("codes", pa.binary()), ("label", pa.binary()), ("weight", pa.binary())]))


def _coded(slots: list[list[str]], cuts: list[list[np.ndarray]], trains: list[list[int]]):
    """(training set, codes, labels) of each chunk; ``slots`` and ``cuts`` hold one list for all training sets or one for each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for table in _chunks(batches):
            fold, label = table.column("fold").to_numpy(), table.column("_label").to_numpy()
            codes = [_codes(table, s, c) for s, c in zip(slots, cuts)]
            for i, train in enumerate(trains):
                inside = np.isin(fold, train)
                yield i, codes[i if len(codes) > 1 else 0][:, inside], label[inside]

    return made


def _cells(coded, words: int):
    """part, k0.., n: how often each item of classes occurs in a chunk."""
    names = ["part", *[f"k{i}" for i in range(words)], "n"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, codes, label in coded(batches):
            keys = _words(np.concatenate([codes, label.astype("<u4").view(np.uint8).reshape(-1, 4).T]))
            order, first = _alike(keys)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(first), part, np.int32)), *[pa.array(k.view(np.int64)) for k in keys[:, order[first]]],
                pa.array(np.diff(first, append=len(order)))], names)

    return made


def _shards(gathered, parts: int, features: int, classes: int, trees: int, seed: int):
    """Shards of items: of counted ones, or of the rows that ``gathered`` puts in bins."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [_Items(i, features, classes, trees, seed) for i in range(parts)]
        if classes:
            for table in _chunks(batches):
                part, *keys, n = (table.column(i).to_numpy() for i in range(table.num_columns))
                keys = np.array(keys).view(np.uint64)
                for i in np.unique(part):
                    yield from items[i].counted(keys[:, part == i], n[part == i])
        else:
            for part, codes, label in gathered(batches):
                yield from items[part].rows(codes, label)
        for one in items:
            yield from one.rest()

    return made


def _histograms(forests: list[Forest], chosen: dict, level: int, features: int, bins: int, classes: int):
    """Sums by (open node, feature of its subset, bin) of each tree over the shards of a task.

    ``chosen``: (training set, tree) -> (place of each node among the open ones or -1, subset of each open node).
    """
    width = classes or 2

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([h.tobytes() for h in held.values()], pa.binary()),
            ], ["part", "tree", "sums"])
            held.clear()
            return out

        for batch in batches:
            for r in range(batch.num_rows):
                part, items, seed, summed, codes, label, weight = (batch.column(i)[r].as_py() for i in range(7))
                flat = np.frombuffer(codes, np.uint8)
                label = np.frombuffer(label, np.int64 if classes else np.float64)
                weight = np.frombuffer(weight, np.int64 if classes else np.float64)
                if summed:
                    weight = weight.reshape(-1, 2, items)
                forest = forests[part]
                for tree in range(len(forest.stats[0])):
                    if (part, tree) not in chosen:
                        continue
                    place_of, subset = chosen[part, tree]
                    w = weight[tree, 0] if summed else _weights(seed, tree, weight if classes else None, items)
                    rows = np.flatnonzero(w)
                    place = place_of[_places(flat, items, rows, forest.feature, forest.cut, tree, level)]
                    if (place_of < 0).any():
                        rows = rows[place >= 0]
                        place = place[place >= 0]
                    w, key = w[rows], place * bins
                    total = w if classes else weight[tree, 1][rows] if summed else w * label[rows]
                    sums = held.setdefault((part, tree), np.zeros((subset.shape[1], len(subset), bins, width)))
                    for s in range(subset.shape[1]):
                        at = key + flat[(subset[:, s] * items)[place] + rows]
                        if classes:
                            sums[s] += np.bincount(at * width + label[rows], w, len(subset) * bins * width).reshape(-1, bins, width)
                        else:
                            sums[s, :, :, 0] += np.bincount(at, w, len(subset) * bins).reshape(-1, bins)
                            sums[s, :, :, 1] += np.bincount(at, total, len(subset) * bins).reshape(-1, bins)
                    if sum(h.nbytes for h in held.values()) > HELD:
                        yield handed()
        if held:
            yield handed()

    return made


def best_splits(sums: np.ndarray, classes: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node (place in its subset or -1, cut, its statistics, those of the left side). ``sums``: subset x nodes x bins x statistics."""
    total = sums[0].sum(1)
    left = sums.cumsum(2)
    right = total[None, :, None] - left
    size = (lambda s: s.sum(-1)) if classes else (lambda s: s[..., 0])
    square = (lambda s: (s * s).sum(-1)) if classes else (lambda s: s[..., 1] * s[..., 1])
    pure = lambda s: square(s) / np.maximum(size(s), 1e-300)
    gain = pure(left) + pure(right) - pure(total)[None, :, None]
    gain[(size(left) < leaf) | (size(right) < leaf) | (gain <= 1e-12 * pure(total)[None, :, None])] = -1
    by_node = gain.transpose(1, 0, 2).reshape(len(total), -1)
    best = by_node.argmax(1)
    at, cut = np.divmod(best, sums.shape[2])
    nodes = np.arange(len(total))
    return np.where(by_node[nodes, best] > 0, at, -1), cut, total, left[at, nodes, cut]


def _choose(counts: dict[tuple[int, int], int], subset: int, bins: int, classes: int, leaf: int):
    width = classes or 2

    def made(key: tuple, group: pa.Table) -> pa.Table:
        part, tree = (k.as_py() for k in key)
        shape = (subset, counts[part, tree], bins, width)
        sums = np.zeros(shape)
        for one in group.column("sums"):
            sums += np.frombuffer(one.as_py(), np.float64).reshape(shape)
        at, cut, total, left = best_splits(sums, classes, leaf)
        return pa.table({
            "part": pa.array([part], pa.int32()), "tree": pa.array([tree], pa.int32()), "at": pa.array([at.tolist()], pa.list_(pa.int32())),
            "cut": pa.array([cut.tolist()], pa.list_(pa.int32())), "total": pa.array([total.ravel().tolist()], pa.list_(pa.float64())),
            "lower": pa.array([left.ravel().tolist()], pa.list_(pa.float64()))})

    return made


def grow(
    table: DataFrame, slots: list[list[str]], cuts: list[list[np.ndarray]], trains: list[list[int]], classes: int,
    trees: int, depth: int, leaf: int, seed: int,
) -> list[Forest]:
    """One forest for each list of folds in ``trains``.

    ``table`` has ``fold``, ``_label`` (class codes, or a number where ``classes`` is 0) and the features named in ``slots``; ``slots`` and
    ``cuts`` (sorted, at most 255 a feature) hold one list for all training sets or one for each.
    """
    features, width = len(slots[0]), classes or 2
    rows, coded = table.select("fold", "_label", *dict.fromkeys(s for one in slots for s in one)), _coded(slots, cuts, trains)
    if classes:
        keys = [f"k{i}" for i in range(-(-(features + 4) // 8))]
        rows = rows.mapInArrow(_cells(coded, len(keys)), f"part int, {', '.join(f'{k} long' for k in keys)}, n long")
        rows = rows.groupBy("part", *keys).agg(F.sum("n").alias("n"))
    shards = stored(rows.mapInArrow(_shards(coded, len(trains), features, classes, trees, seed), _SHARD_SCHEMA), "forest-items")
    bins = max(len(c) for one in cuts for c in one) + 1
    size = min(features, math.ceil(math.sqrt(features)) if classes else math.ceil(features / 3))
    forests = [Forest.empty(trees, depth, width) for _ in trains]
    opened = {(i, t): np.array([0]) for i in range(len(trains)) for t in range(trees)}
    for level in range(depth):
        chosen = {}
        for (i, t), nodes in opened.items():
            draw = np.random.Generator(np.random.PCG64([seed, i, t, level]))
            place_of = np.full(1 << level, -1)
            place_of[nodes] = np.arange(len(nodes))
            chosen[i, t] = place_of, np.argsort(draw.random((len(nodes), features)), axis=1)[:, :size]
        summed = shards.mapInArrow(_histograms(forests, chosen, level, features, bins, classes), "part int, tree int, sums binary")
        counts = {k: len(n) for k, n in opened.items()}
        found = summed.groupBy("part", "tree").applyInArrow(
            _choose(counts, size, bins, classes, leaf), "part int, tree int, at array<int>, cut array<int>, total array<double>, lower array<double>").collect()
        further = {}
        for r in found:
            forest, t, nodes = forests[r["part"]], r["tree"], opened[r["part"], r["tree"]]
            total, left = (np.reshape(r[c], (-1, width)) for c in ("total", "lower"))
            at = np.array(r["at"])
            split = at >= 0
            forest.stats[level][t, nodes] = total
            forest.feature[level][t, nodes[split]] = chosen[r["part"], t][1][split, at[split]]
            forest.cut[level][t, nodes[split]] = np.array(r["cut"])[split]
            forest.stats[level + 1][t, 2 * nodes[split]] = left[split]
            forest.stats[level + 1][t, 2 * nodes[split] + 1] = (total - left)[split]
            children = np.sort(np.concatenate([2 * nodes[split], 2 * nodes[split] + 1]))
            own = forest.stats[level + 1][t, children]
            rows = own.sum(1) if classes else own[:, 0]
            children = children[(rows >= 2 * leaf) & ((own.max(1) < rows) if classes else True)]
            if len(children):
                further[r["part"], t] = children
        opened = further
        if not opened:
            break
    for forest in forests:  # what ends early ends in the last level, to the left
        for d in range(depth):
            ends = forest.cut[d] == 255
            for t, p in zip(*ends.nonzero()):
                forest.stats[d + 1][t, 2 * p] = forest.stats[d][t, p]
    return forests


def scored(table: DataFrame, slots: list[str], cuts: list[np.ndarray], forest: Forest, classes: int) -> DataFrame:
    """``table`` without ``slots``, with ``prediction`` and ``probability`` (of the second class; null for numbers)."""
    kept = [f for f in table.schema.fields if f.name not in slots]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            codes = _codes(rows, slots, cuts)
            order, first = _alike(_words(codes))
            kind = np.empty(len(order), np.int64)
            kind[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
            scores = forest.scores(np.ascontiguousarray(codes[:, order[first]]), classes)
            best = scores.argmax(1).astype(np.float64) if classes else scores[:, 0]
            second = pa.array(scores[:, 1][kind]) if classes else pa.nulls(len(kind), pa.float64())
            out = rows.select([f.name for f in kept]).append_column("prediction", pa.array(best[kind])).append_column("probability", second)
            yield from out.to_batches()

    schema = T.StructType([*kept, T.StructField("prediction", T.DoubleType()), T.StructField("probability", T.DoubleType())])
    return table.mapInArrow(made, schema)
