"""Mixing sources to target weights by balanced sampling (the cube method).

Every source has a target in words. The ratio target / size of the source is split into whole copies of each document
and a fraction; the fraction is each document's inclusion probability for one more copy. The flight phase moves the
probabilities inside the null space of two constraints, the source's words and its documents, until they are zero or
one. What cannot move any more, with ``LANDING`` documents that wait for it, is the landing problem of each source: of
all roundings of these few documents, the one nearest to the totals is taken.

The flight runs in blocks of about ``BLOCK`` documents of one source, dealt by a hash, so a source of any size is many
blocks. Each block leaves at most three undecided documents; these form the blocks of the next round, until one block
per source is left, which also lands. All random draws are seeded with the source, the round and the block, so
reruns agree.

Sizes: the driver sees one row per source, at most ``MAX_SOURCES`` (more raise an error); the shuffles carry keys and
sizes, no texts.

Defined cases: a null text has no words; a null source is a source of its own and comes last; documents without
words are taken with no words; rows with equal key, source and size share one decision; an empty table gives an
empty result; extra columns are carried along, and result columns that clash get a number.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import ref
from gaugework.llm.common import free_name, written

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 5_000
MAX_SOURCES = 100_000
LANDING = 14
WORD = r"[^\x20\x09-\x0D]+"
_EVEN = 1e-9


def target_words(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Target per source: weights repeat in code point order (null last); what is above ``cap`` sizes is shared anew."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed, open_ = float(sum(sizes.values())), {}, list(order)
    target: dict[str | None, float] = {}
    while open_:
        left, share = total - sum(fixed.values()), sum(weight[s] for s in open_)
        target = {s: left * weight[s] / share for s in open_}
        above = [s for s in open_ if target[s] > cap * sizes[s]]
        if not above:
            break
        fixed |= {s: float(cap * sizes[s]) for s in above}
        open_ = [s for s in open_ if s not in fixed]
        target = {}
    return target | fixed


def flight(x: list[float], count: list[int], words: list[int], draw: random.Random) -> None:
    """Move ``x`` (in place) to zeros and ones, keeping sum(count * x) and sum(words * x); at most three values stay
    between."""
    open_ = []
    for i, v in enumerate(x):
        if _EVEN < v < 1 - _EVEN:
            open_.append(i)
        else:
            x[i] = float(round(v))
    open_.reverse()
    held: list[int] = []
    while True:
        while len(held) < 3 and open_:
            held.append(open_.pop())
        u = _direction(held, count, words)
        if u is None:
            return
        up = min(((1 - x[i]) / d if d > 0 else -x[i] / d) for i, d in zip(held, u) if d)
        down = min((x[i] / d if d > 0 else (x[i] - 1) / d) for i, d in zip(held, u) if d)
        step = up if draw.random() * (up + down) < down else -down
        still = []
        for i, d in zip(held, u):
            v = x[i] + step * d
            if v <= _EVEN:
                x[i] = 0.0
            elif v >= 1 - _EVEN:
                x[i] = 1.0
            else:
                x[i] = v
                still.append(i)
        if len(still) == len(held):  # rounding kept the nearest value open
            i = min(still, key=lambda j: min(x[j], 1 - x[j]))
            x[i] = float(round(x[i]))
            still.remove(i)
        held = still


def landing(x: list[float], count: list[int], words: list[int]) -> None:
    """Round the values still between (in place) so that the words, and less strictly the documents, stay nearest to
    what they sum to; every rounding of this small set is looked at."""
    left = [i for i, v in enumerate(x) if 0 < v < 1]
    if not left:
        return
    choice = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    w, n, at = (np.array([v[i] for i in left], float) for v in (words, count, x))
    off = np.abs(choice @ w - at @ w) + 0.05 * w.mean() * np.abs(choice @ n - at @ n)
    best = choice[int(off.argmin())]
    for i, v in zip(left, best):
        x[i] = float(v)


def _direction(held: list[int], count: list[int], words: list[int]) -> tuple[float, ...] | None:
    if len(held) == 3:
        (a, b, c), (p, q, r) = (count[i] for i in held), (words[i] for i in held)
        u = (b * r - c * q, c * p - a * r, a * q - b * p)
        if any(u):
            top = max(abs(v) for v in u)
            return tuple(v / top for v in u)
        return (float(b), float(-a), 0.0)
    if len(held) == 2:
        (a, b), (p, q) = (count[i] for i in held), (words[i] for i in held)
        if a * q == b * p:
            return (float(b), float(-a))
    return None


def _blocks(source_rows: int, block: int) -> int:
    return max(1, -(-source_rows // block))


def decisions(units: DataFrame, block: int = BLOCK, seed: int = 0, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Copies per unit. ``units``: k, source, size, n (rows of that key, source and size)."""
    spark = units.sparkSession
    stats = (
        units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("rows"))
        .limit(MAX_SOURCES + 1).collect()
    )
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to weigh")
    sizes = {s["source"]: int(s["words"]) for s in stats}
    target = target_words(sizes, weights, cap)
    facts = spark.createDataFrame(
        [(s, sizes[s], float(target[s]), target[s] / sizes[s] if sizes[s] else 0.0) for s in sizes],
        "fact_source string, source_size long, target double, ratio double",
    )
    rows = units.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("fact_source"))).drop("fact_source")
    rows = rows.withColumn("whole", F.floor("ratio")).withColumn("x", F.col("ratio") - F.col("whole")).drop("ratio")
    # documents without words take no part: they change no total
    rows = rows.withColumn("x", F.when(F.col("size") > 0, F.col("x")).otherwise(0.0))
    done, counts, turn = [], {s["source"]: s["rows"] for s in stats}, 0
    while True:
        last = max(counts.values(), default=0) <= block
        dealt = spark.createDataFrame([(s, _blocks(c, block)) for s, c in counts.items()], "deal_source string, deals int")
        placed = rows.join(F.broadcast(dealt), F.col("source").eqNullSafe(F.col("deal_source"))).drop("deal_source")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("k", "size", F.lit(seed + turn)), F.col("deals"))).drop("deals")
        flown = written(_flown(placed, turn, last, seed), f"mix-round{turn}")
        done.append(flown.where((F.col("x") == 0) | (F.col("x") == 1)))
        if last:
            break
        rows = flown.where((F.col("x") != 0) & (F.col("x") != 1)).drop("block")
        counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
        turn += 1
        if not counts:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("k", "source", "size", "source_size", "target", (F.col("whole") + F.col("x")).cast("long").alias("copies"))


def _flown(placed: DataFrame, turn: int, land: bool, seed: int) -> DataFrame:
    def fly(table: pa.Table) -> pa.Table:
        source, block = table["source"][0].as_py(), table["block"][0].as_py()
        # large documents first: those left over for the landing are small
        table = table.sort_by([("size", "descending"), ("n", "descending"), ("order", "ascending")])
        x, n = table["x"].to_pylist(), table["n"].to_pylist()
        words = [a * b for a, b in zip(n, table["size"].to_pylist())]
        draw = random.Random(f"{seed}/{turn}/{source is None}/{source}/{block}")
        if land:  # a few documents, chosen by hash, wait for the landing
            waiting = sorted((o, i) for i, o in enumerate(table["order"].to_pylist()) if _EVEN < x[i] < 1 - _EVEN)[:LANDING]
            rest = {i for _, i in waiting}
            flying = [i for i in range(len(x)) if i not in rest]
            part = [x[i] for i in flying]
            flight(part, [n[i] for i in flying], [words[i] for i in flying], draw)
            for i, v in zip(flying, part):
                x[i] = v
            landing(x, n, words)
        else:
            flight(x, n, words, draw)
        return table.set_column(table.schema.get_field_index("x"), "x", pa.array(x, pa.float64())).drop_columns(["order"])

    schema = placed.schema
    return placed.withColumn("order", F.xxhash64(F.lit(seed), "size", "k")).groupBy("source", "block").applyInArrow(fly, schema)


def mixed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 0,
    weights: Sequence[float] = WEIGHTS, cap: float = CAP,
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (size, source_size, target, copies, taken), and that column's name."""
    size = F.coalesce(F.regexp_count(ref(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    fact = free_name(docs, "_gw_mix")
    n_words, name = free_name(docs, "_gw_size"), free_name(docs, "_gw_source")
    sized = docs.withColumn(n_words, size).withColumn(name, ref(source).cast("string"))
    units = written(
        sized.groupBy(ref(key).alias("k"), ref(name).alias("source"), ref(n_words).alias("size")).agg(F.count("*").alias("n")), "mix-units"
    )
    made = decisions(units, block, seed, weights, cap).select(
        F.col("k").alias("_gw_k"), F.col("source").alias("_gw_s"), F.col("size").alias("_gw_n"),
        F.struct("size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")).alias(fact),
    )
    on = sized[f"`{key}`"].eqNullSafe(made["_gw_k"]) & sized[name].eqNullSafe(made["_gw_s"]) & (sized[n_words] == made["_gw_n"])
    return sized.join(made, on).drop("_gw_k", "_gw_s", "_gw_n", n_words, name), fact


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    narrow = docs.select(ref(key).alias("doc_id"), ref(text).alias("text"), ref(source).alias("source"))
    out, fact = mixed(narrow)
    return out.select("doc_id", *[f"{fact}.{c}" for c in ("size", "source_size", "target", "taken")])


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes, with ``copies`` (how often each is to be read) and ``taken`` (its words times copies)."""
    out, fact = mixed(docs, key, text, source)
    copies, taken = free_name(docs, "copies"), free_name(docs, "taken")
    return out.where(ref(fact)["copies"] > 0).select(
        *[ref(c) for c in docs.columns], ref(fact)["copies"].alias(copies), ref(fact)["taken"].alias(taken)
    )
