"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are the runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. An item's
windows are its runs of ``n`` words; an item of fewer words is one window of its own length. A document word is hit
if it lies inside any occurrence of a window. Set membership compares the whole window, so a hash match is verified.

The set is built from the benchmark alone. It is broadcast in blocks of at most ``block_bytes``. One block is read with
the documents; each block of a larger benchmark is a pass of its own, which stores the hits of the texts that have any
and frees its set before the next one is sent. Those hits meet the documents by the digests of their texts. An item
larger than a block is dealt over several, its windows overlapping.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; items with the
same id count once, a null id counts as the item named by the empty string; repeated rows each get their own result;
an empty benchmark hits nothing; other columns are carried along unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.columns import ref
from gaugework.llm.common import free_name, written

WINDOW = 10
BLOCK_BYTES = 64 << 20
_ENTRY = 300  # bytes that a window takes in the set besides its text

# ASCII to its word form: lower case for letters, digits as they are, a space for all else. Other bytes stay.
_FOLD = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _windows(items: list[tuple[str, str]], n: int) -> dict[int, dict[bytes, set[str]]]:
    """Per window length: the window's bytes -> ids of its items."""
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(b" ".join(words[i:i + size]), set()).add(item)
    return found


def scan(words: list[bytes], windows: dict[int, dict[bytes, set[str]]], heads: dict[int, set[bytes]], n: int):
    """Covered spans [start, end) of the words, and the ids of the items whose windows occur."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    if not words:
        return spans, items
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0] + ends[:-1]
    for size, known in windows.items():
        if len(words) < size:
            continue
        if size == n:
            hits = [i for i, (s, e) in enumerate(zip(starts, ends[size - 1:])) if joined[s:e - 1] in known]
        else:
            head = heads[size]
            hits = [
                i for i, w in enumerate(words[:len(words) - size + 1])
                if w in head and joined[starts[i]:ends[i + size - 1] - 1] in known
            ]
        for i in hits:
            items |= known[joined[starts[i]:ends[i + size - 1] - 1]]
            spans.append((i, i + size))
    return spans, items


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as sorted, disjoint spans."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [(s, e) for s, e in merged]


_HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_HITS_ARROW = pa.struct([
    ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
    ("items", pa.list_(pa.string())),
])


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, n: int, block_bytes: int) -> Iterator[list]:
    """Items (id, words) in blocks whose windows take at most about ``block_bytes``, read one after the other from Spark."""
    block: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.select(
        F.coalesce(ref(item).cast("string"), F.lit("")).alias("item"), F.coalesce(ref(text).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        cost = [_ENTRY + min(n, len(words)) * (len(w) + 1) for w in words]
        at = 0
        while at < len(words):
            end, more = at, 0
            while end < len(words) and (end == at or size + more + cost[end] <= block_bytes):
                more += cost[end]
                end += 1
            if block and size + more > block_bytes:
                yield block
                block, size = [], 0
                continue
            # the windows that start in this stretch
            block.append((row["item"], b" ".join(words[at:end + n - 1]).decode("utf-8", "surrogatepass")))
            size += more
            at = len(words) if end + n > len(words) else end
            if size >= block_bytes:
                yield block
                block, size = [], 0
    if block:
        yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = WINDOW, block_bytes: int = BLOCK_BYTES, column: str = "hits",
) -> DataFrame:
    """``docs`` with a struct column: number of words, covered word spans (disjoint, sorted) and item ids (sorted)."""
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents already have a column {column!r}")
    spark, body = docs.sparkSession, ref(text).cast("string")
    blocks = benchmark_blocks(benchmark, item, item_text, n, block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return docs.withColumn(column, _scanner(_shared(spark, block, n))(body))
    texts = docs.where(body.isNotNull()).select(F.sha2(body, 256).alias("mark"), body.alias("text"))
    passes = []
    while block is not None:
        shared = _shared(spark, block, n)
        found = texts.select("mark", _scanner(shared)("text").alias("h")).where(F.size("h.starts") > 0)
        passes.append(written(found.dropDuplicates(["mark"]), "benchmark-hits"))
        shared.destroy()
        block, following = following, next(blocks, None)
    mark, words, hit, hit_mark = (free_name(docs, f"_gw_{x}") for x in ("text_mark", "words", "hit", "hit_mark"))
    every = reduce(DataFrame.unionByName, passes).groupBy("mark").agg(F.collect_list("h").alias("parts"))
    every = every.select(F.col("mark").alias(hit_mark), _joined()("parts").alias(hit))
    rows = docs.withColumn(mark, F.sha2(body, 256)).withColumn(words, _scanner(_shared(spark, [], n))(body))
    joined = rows.join(every, F.col(mark) == F.col(hit_mark), "left")
    return joined.withColumn(column, F.coalesce(hit, words)).drop(hit_mark, hit, mark, words)


def _shared(spark, block: list[tuple[str, str]], n: int):
    windows = _windows(block, n)
    heads = {size: {w.split(b" ", 1)[0] for w in known} for size, known in windows.items()}
    return spark.sparkContext.broadcast((windows, heads, n))


def _scanner(shared) -> Callable:
    @F.arrow_udf(_HITS)
    def find(texts: pa.Array) -> pa.Array:
        known, first, n = shared.value
        out = []
        for text in texts:
            words = words_of(text.as_py())
            spans, items = scan(words, known, first, n)
            spans = covered(spans)
            out.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(items)))
        return _hits(out)

    return find


def _joined() -> Callable:
    @F.arrow_udf(_HITS)
    def join(found: pa.Array) -> pa.Array:
        out = []
        for parts in found.to_pylist():
            spans = covered([x for p in parts for x in zip(p["starts"], p["ends"])])
            out.append((
                parts[0]["n_words"], [s for s, _ in spans], [e for _, e in spans], sorted({i for p in parts for i in p["items"]}),
            ))
        return _hits(out)

    return join


def _hits(rows: list[tuple]) -> pa.Array:
    columns = list(zip(*rows)) or [()] * 4
    return pa.StructArray.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, _HITS_ARROW)], fields=list(_HITS_ARROW)
    )


def hit_report(hits: DataFrame, key: str = "doc_id", column: str = "hits") -> DataFrame:
    """Counts and the digest of the item ids, one row per document."""
    h = ref(column)
    n_hit = F.aggregate(
        F.zip_with(h["starts"], h["ends"], lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return hits.select(
        ref(key).alias("doc_id"), h["n_words"].alias("n_words"), n_hit.alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", h["items"]), 256).alias("items_sha256"), (F.size(h["starts"]) > 0).alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = WINDOW, remove: str = "documents", max_share: float = 0.0,
) -> DataFrame:
    """``docs`` without what the benchmark has: whole documents, or the hit spans.

    ``remove="documents"`` drops documents whose share of hit words is above ``max_share``. ``remove="spans"`` cuts the
    hit spans out of the text, from the first hit word's start to the last one's end, and keeps every document.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    column = free_name(docs, "_gw_hits")
    found = contamination(docs, benchmark, text, item, item_text, n, column=column)
    h = ref(column)
    if remove == "spans":
        return found.withColumn(text, _cut()(ref(text).cast("string"), h["starts"], h["ends"])).select(*[ref(c) for c in docs.columns])
    n_hit = F.aggregate(F.zip_with(h["starts"], h["ends"], lambda s, e: e - s), F.lit(0), lambda a, x: a + x)
    return found.where(n_hit <= F.lit(max_share) * h["n_words"]).select(*[ref(c) for c in docs.columns])


def _cut() -> Callable:
    import re

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for text, s, e in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            if text is not None and s:
                places = [m.span() for m in pattern.finditer(text)]
                parts, at = [], 0
                for a, b in zip(s, e):
                    parts.append(text[at:places[a][0]])
                    at = places[b - 1][1]
                text = "".join(parts) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    return cut


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
