"""A trie of conversation prefixes, screened by a count-min sketch of prefix digests.

Digests: a conversation's turns are hashed (SHA-256 of role and text) and its prefixes by a polynomial in those hashes modulo
2^127 - 1. Such digests compose: turns are sorted by range over all tasks, a task digests what it holds, and the
few conversations that cross a border are completed from one number per task. So a conversation that holds a third of
all turns is read by many tasks, and prefixes change their head (``forks``) without reading a turn again. Two different
prefixes have the same digest with a chance of about depth / 2^127.

Screening: each prefix adds one to a cell in each of two rows. Of the counts only "more than one" is kept, one bit
a cell. The smaller of a prefix's counts is never below its conversations, so where one of its cells counts one, the prefix
is a singleton, and so are those that continue it: its nodes are written from the row alone. Only prefixes that may be shared
go through the exact grouping. Sketches hold at most ``SKETCH_BITS`` bits a row; more prefixes are screened in
slices, one sketch at a time, each at the same load.

Node sums without walking the trie: a conversation is the smallest member of its nodes from some depth r on, so

* a node's leaves are its members that are the smallest of a childless last node, and
* the savings below a node, sum of (members - 1) * words, are the sum over its members c of
  max(0, words of c before depth r(c) - words before the node).

Both are sums over the members' rows, combined before the shuffle. Digests of members are streamed in order.

Defined cases: null roles and texts are empty; turns are ordered by turn (null first), then by the hash of role and text; equal
rows are turns of their own; rows with a null conversation id take no part; a conversation of ``forks`` without any turn is
a member of the root only; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import ref
from gaugework.llm.common import written

SKETCH_BITS = 1 << 28
_LOAD = 4  # cells of a row for each prefix
_PRIME = (1 << 127) - 1
_BASE = int.from_bytes(hashlib.sha256(b"conversation prefixes").digest()[:15], "big")
_ROOT = (1).to_bytes(16, "big")
_NONE = hashlib.sha256(b"").hexdigest()
_PREFIX = "c long, d long, p binary, q binary, w long, before long, last boolean"


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big")


def _bytes(number: int) -> bytes:
    return number.to_bytes(16, "big")


def _made(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], types[n]) for n in types], names=list(types))


_LOCAL = {
    "part": pa.int32(), "c": pa.int64(), "d": pa.int64(), "p": pa.binary(), "q": pa.binary(), "w": pa.int64(), "upto": pa.int64(),
    "last": pa.bool_(),
}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes within a task. The first conversation may have begun elsewhere: it is digested from 0, others from 1.

    ``last`` is null at the end of a task, where the next turn is not known.
    """
    part, first, now = TaskContext.get().partitionId(), None, None
    place = digest = upto = 0
    rest = None  # the latest row, held until the next one is seen
    for batch in batches:
        out = {name: [] for name in _LOCAL}
        for c, h, w in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if rest is not None:
                for name, x in zip(_LOCAL, (*rest, c != now)):
                    out[name].append(x)
            if c != now:
                first, digest = (c, 0) if first is None else (first, 1)
                now, place, upto = c, 0, 0
            before, digest = digest, (digest * _BASE + _number(h)) % _PRIME
            place, upto = place + 1, upto + w
            rest = (part, c, place, _bytes(digest), _bytes(before), w, upto)
        yield _made(out, _LOCAL)
    if rest is not None:
        yield _made({name: [x] for name, x in zip(_LOCAL, (*rest, None))}, _LOCAL)


def _carries(local: DataFrame) -> dict[int, tuple]:
    """For each task: its first conversation, what earlier tasks hold of it (digest, turns, words), and whether its
    last row ends a conversation. One row per task."""
    ends = local.groupBy("part").agg(F.min("c").alias("first"), F.max(F.struct("c", "d", "p", "upto")).alias("end")).orderBy("part")
    found, before, previous = {}, (None, 1, 0, 0), None
    for part, first, (c, d, p, upto) in ends.collect():
        carry = before[1:] if before[0] == first else (1, 0, 0)
        if previous is not None:
            found[previous][2] = before[0] != first
        found[part] = [first, carry, True]
        digest = _number(p)
        if c == first:
            digest, d, upto = (carry[0] * pow(_BASE, d, _PRIME) + digest) % _PRIME, d + carry[1], upto + carry[2]
        before, previous = (c, digest, d, upto), part
    return found


def _completed(carries: dict[int, tuple]):
    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {n: batch.column(i).to_pylist() for i, n in enumerate(_LOCAL)}
            for i, (part, c, d) in enumerate(zip(rows["part"], rows["c"], rows["d"])):
                first, (digest, turns, words), ends = carries[part]
                if rows["last"][i] is None:
                    rows["last"][i] = ends
                if c == first:
                    rows["p"][i] = _bytes((digest * pow(_BASE, d, _PRIME) + _number(rows["p"][i])) % _PRIME)
                    rows["q"][i] = _bytes((digest * pow(_BASE, d - 1, _PRIME) + _number(rows["q"][i])) % _PRIME)
                    rows["d"][i] += turns
                    rows["upto"][i] += words
            rows["before"] = [a - b for a, b in zip(rows["upto"], rows["w"])]
            yield _made(rows, _TYPES)

    return complete


_TYPES = {
    "c": pa.int64(), "d": pa.int64(), "p": pa.binary(), "q": pa.binary(), "w": pa.int64(), "before": pa.int64(), "last": pa.bool_(),
}


def prefixes(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: c, depth d, digest p and parent's digest q, words w of the turn and before it, last."""
    part = F.coalesce(ref(role).cast("string"), F.lit(""))
    body = F.coalesce(ref(text).cast("string"), F.lit(""))
    lean = turns.where(ref(conversation).isNotNull()).select(
        ref(conversation).cast("long").alias("c"), ref(turn).alias("t"),
        F.unhex(F.sha2(F.concat(F.length(part).cast("string"), F.lit(":"), part, body), 256)).alias("h"),
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"),
    )
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lean.repartitionByRange(width, "c", "t", "h").sortWithinPartitions("c", "t", "h").select("c", "h", "w")
    local = written(
        placed.mapInArrow(_local, "part int, c long, d long, p binary, q binary, w long, upto long, last boolean"), "turn-digests"
    )
    return local.mapInArrow(_completed(_carries(local)), _PREFIX)


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes behind a fork: the own head's digest is taken out and the borrowed one put in."""
    for batch in batches:
        rows = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for i, (d, h) in enumerate(zip(rows["d"], rows["h"])):
            change = _number(rows["new_p"][i]) - _number(rows["old_p"][i])
            if change:
                step = change * pow(_BASE, d - 1 - h, _PRIME)
                rows["q"][i] = _bytes((_number(rows["q"][i]) + step) % _PRIME)
                rows["p"][i] = _bytes((_number(rows["p"][i]) + step * _BASE) % _PRIME)
            rows["d"][i] = d - h + rows["taken"][i]
            rows["before"][i] += rows["new_w"][i] - rows["old_w"][i]
        yield _made(rows, _TYPES)


def forked(own: DataFrame, forks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes of the conversations of ``forks`` (c, source, h), and all of those conversations (c, turns).

    Conversation c is the first h turns of ``source`` and then its own turns after its first h. The heads, up to the
    largest h, are carried as one array for each conversation.
    """
    own = written(own, "own-prefixes")
    forks = written(forks, "forks")
    longest = forks.agg(F.coalesce(F.max("h"), F.lit(0))).first()[0]
    head = F.struct("d", "p", "q", "w", "before")
    heads = written(own.groupBy("c").agg(
        F.max("d").alias("n"), F.sort_array(F.collect_list(F.when(F.col("d") <= longest, head))).alias("heads")), "heads")
    mine = heads.select(F.col("c").alias("mine"), F.col("n").alias("own_n"), F.col("heads").alias("own_heads"))
    theirs = heads.select(F.col("c").alias("theirs"), F.col("n").alias("n"), F.col("heads").alias("heads"))
    at = lambda heads, i: F.when(i > 0, F.element_at(heads, F.greatest(i, F.lit(1)).cast("int")))
    both = (
        forks.join(mine, forks["c"] == mine["mine"], "left").join(theirs, forks["source"] == theirs["theirs"], "left")
        .withColumn("own_n", F.coalesce("own_n", F.lit(0)))
        .withColumn("taken", F.least("h", F.coalesce("n", F.lit(0))))
    )
    both = written(both.select(
        "c", "h", "own_n", "taken", F.slice(F.coalesce("heads", F.array().cast(theirs.schema["heads"].dataType)), 1, F.col("taken").cast("int")).alias("heads"),
        at(F.col("heads"), F.col("taken")).alias("new"), F.when(F.col("own_n") > F.col("h"), at(F.col("own_heads"), F.col("h"))).alias("old"),
    ), "forked-heads")
    borrowed = both.select("c", "h", "own_n", "taken", F.explode("heads").alias("x")).select(
        "c", "x.d", "x.p", "x.q", "x.w", "x.before", ((F.col("x.d") == F.col("taken")) & (F.col("own_n") <= F.col("h"))).alias("last"),
    )
    cut = both.where(F.col("own_n") > F.col("h")).select(
        F.col("c").alias("k"), "h", "taken",
        *(F.coalesce(f"{side}.p", F.lit(_ROOT)).alias(f"{side}_p") for side in ("new", "old")),
        *(F.coalesce(F.col(f"{side}.before") + F.col(f"{side}.w"), F.lit(0)).alias(f"{side}_w") for side in ("new", "old")),
    )
    behind = own.join(cut, own["c"] == cut["k"]).where(F.col("d") > F.col("h")).drop("k")
    members = both.select("c", (F.col("taken") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))).alias("turns"))
    return borrowed.unionByName(behind.mapInArrow(_moved, _PREFIX)), members


def _cells(digest: str, width: int) -> list[Column]:
    """A prefix's cell in each of the two rows; the second row's cells lie behind those of the first."""
    return [F.pmod(F.xxhash64(F.lit(row), F.col(digest)), F.lit(width)) + row * width for row in range(2)]


def _sketch(rows: DataFrame, width: int) -> np.ndarray:
    """One bit a cell: set where the cell counts more than one prefix row. At most 2 * width bits."""
    cell = F.col("cell") + 1  # buckets and positions of bitmaps count from one
    often = rows.select(F.explode(F.array(*_cells("p", width))).alias("cell")).groupBy("cell").count().where("count > 1")
    maps = often.groupBy(F.bitmap_bucket_number(cell).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("m"))
    bits = np.zeros(-(-2 * width // 32_768) * 4096, np.uint8)
    for b, m in maps.toLocalIterator():
        bits[(b - 1) * 4096:b * 4096] = np.frombuffer(m, np.uint8)
    return bits


def _screened(shared, column: str):
    """Adds a column: may the digest whose two cells stand last be shared, by the broadcast sketch."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            n = batch.num_columns
            may = np.ones(batch.num_rows, bool)
            for i in (n - 2, n - 1):
                cell = batch.column(i).to_numpy()
                may &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            kept = [batch.column(i) for i in range(n - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(may)], names=[*batch.schema.names[:-2], column])

    return screen


def screened(rows: DataFrame, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``rows`` with ``own`` and ``above``: may the prefix, and its parent, have more than one conversation.

    A prefix below a proven singleton is one as well. The root (the parent at depth one) counts as shared.
    """
    spark, n = rows.sparkSession, rows.count()
    width = min(sketch_bits, 1 << max(10, (_LOAD * n - 1).bit_length()))
    slices = -(-_LOAD * n // width) if n else 1
    for digest, column in (("p", "own"), ("q", "above")):
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        done = []
        for s in range(slices):
            mine = lambda x, s=s: F.pmod(F.xxhash64(F.lit("slice"), F.col(x)), F.lit(slices)) == s
            shared = spark.sparkContext.broadcast(_sketch(rows.where(mine("p")), width))
            part = rows.where(mine(digest)).select("*", *_cells(digest, width))
            part = written(part.mapInArrow(_screened(shared, column), f"{fields}, {column} boolean"), "screened-prefixes")
            shared.destroy()
            done.append(part)
        rows = done[0]
        for part in done[1:]:
            rows = rows.unionByName(part)
    above = (F.col("d") == 1) | F.col("above")
    return rows.withColumn("own", F.col("own") & above).withColumn("above", above)


def _member_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, sha): runs of equal p, each in the order of its pieces of ids; a run's text is never held."""
    now, digest = None, None
    for batch in batches:
        out = []
        for p, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = p, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["p", "sha"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["p", "sha"])


def ended_digests(ends: DataFrame) -> DataFrame:
    """(p, sha): SHA-256 of the ids c that end at p, ascending, joined by commas.

    Ids are first joined within ranges of 1,024 numbers, so that a node where a third of all conversations end is
    a few long pieces; the hash itself has to read them one after the other.
    """
    width = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.groupBy("p", F.shiftright("c", 10).alias("range")).agg(
        F.array_join(F.sort_array(F.collect_set("c")).cast("array<string>"), ",").alias("piece"))
    ordered = pieces.repartition(width, "p").sortWithinPartitions("p", "range").select("p", "piece")
    return ordered.mapInArrow(_member_digests, "p binary, sha string")


def trie(rows: DataFrame, members: DataFrame | None = None, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """The nodes of the trie over prefixes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and digest and parent_digest (hex), which tell the node apart.

    ``members`` are all conversations (c, turns); left out, those that have a row.
    """
    spark = rows.sparkSession
    rows = written(screened(written(rows, "prefixes"), sketch_bits), "screened")
    if members is None:
        members = rows.where("last").select("c", F.col("d").alias("turns"))
    head, convs = members.agg(F.min("c"), F.count("*")).first()
    if not convs:
        return spark.createDataFrame([], _RESULT)
    may, tails = rows.where("own"), rows.where("NOT own")
    exact = may.groupBy("p").agg(F.min(F.struct("c", "d", "q", "before")).alias("x"), F.count("*").alias("n"))
    root = spark.createDataFrame(
        [(_ROOT, head, 0, None, 0, convs)], "p binary, c long, d long, q binary, before long, n long")
    nodes = exact.select("p", "x.c", "x.d", "x.q", "x.before", "n").unionByName(root)
    nodes = written(nodes, "exact-nodes")
    children = nodes.where("d > 0").select("q").unionByName(tails.where("above").select("q")).groupBy(F.col("q").alias("above")).agg(
        F.count("*").alias("n_children"))
    nodes = written(
        nodes.join(children, nodes["p"] == children["above"], "left").drop("above").fillna(0, ["n_children"]), "counted-nodes")

    # from where on is a conversation the smallest member, and does it end there in a childless node
    first = nodes.select("c", "before", (F.col("n_children") == 0).alias("leaf")).unionByName(
        tails.select("c", "before", F.col("last").alias("leaf"))).groupBy("c").agg(F.min("before").alias("r"), F.max("leaf").alias("leaf"))
    totals = rows.where("last").select(F.col("c").alias("k"), (F.col("before") + F.col("w")).alias("total"))
    facts = (
        members.select("c").join(first, "c", "left").join(totals, F.col("c") == F.col("k"), "left")
        .select(F.col("c").alias("k"), F.coalesce("r", "total", F.lit(0)).alias("r"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"))
    )
    facts = written(facts, "members")
    summed = may.select("c", "p", "before").join(facts, F.col("c") == F.col("k")).select("p", F.greatest(F.col("r") - F.col("before"), F.lit(0)).alias("saved"), "leaf")
    summed = summed.unionByName(facts.select(F.lit(_ROOT).alias("p"), F.col("r").alias("saved"), "leaf"))
    summed = summed.groupBy(F.col("p").alias("at")).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ends = may.where("last").select("p", "c").unionByName(members.where("turns = 0").select(F.lit(_ROOT).alias("p"), "c"))
    ends = ended_digests(ends).withColumnRenamed("p", "end")
    parents = nodes.where("d > 0").select(F.col("p").alias("parent"), F.col("c").alias("parent_c"))

    def below(some: DataFrame) -> DataFrame:
        """``some`` with parent_conv_id; a parent outside the exact nodes is a singleton of the same conversation."""
        named = some.join(parents, (F.col("q") == F.col("parent")) & (F.col("d") > 1), "left")
        upper = F.when(F.col("d") == 1, F.lit(head)).when(F.col("d") > 1, F.coalesce("parent_c", "c"))
        return named.withColumn("parent_conv_id", upper.cast("long")).drop("parent", "parent_c")

    inner = nodes.join(summed, F.col("p") == F.col("at")).join(ends, F.col("p") == F.col("end"), "left")
    inner = below(inner).select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        "saved_tokens", F.coalesce("sha", F.lit(_NONE)).alias("ends_sha256"), F.hex("p").alias("digest"), F.hex("q").alias("parent_digest"))

    def local(some: DataFrame) -> DataFrame:
        return some.select(
            F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.lit(1).cast("long").alias("n_convs"),
            (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.when(F.col("last"), F.sha2(F.col("c").cast("string"), 256)).otherwise(_NONE).alias("ends_sha256"),
            F.hex("p").alias("digest"), F.hex("q").alias("parent_digest"))

    alone = tails.where("NOT above").withColumn("parent_conv_id", F.col("c"))
    return inner.unionByName(local(alone)).unionByName(local(below(tails.where("above"))))


_RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, digest string, parent_digest string"
)


def conversation_trie(turns: DataFrame, forks: DataFrame | None = None, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """The trie of all conversations of ``turns`` (conv_id, turn, role, text), with heads exchanged as ``forks`` says."""
    own = prefixes(turns)
    return trie(own, None, sketch_bits) if forks is None else trie(*forked(own, forks), sketch_bits)
