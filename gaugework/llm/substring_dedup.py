"""Substring deduplication with an FM-index per shard of text segments.

A word goes if it lies in a window of ``WINDOW`` words whose word sequence also starts anywhere else, in the same or
another document.

1. Routing. The anchor of a window is its ``GRAM``-word run with the smallest hash, so equal windows have equal
   anchors. A segment is a longest run of windows of one document with one anchor place: 35 to 62 words. Anchors that
   occur once are dropped, equal segments become one row with a count.
2. Index. Segments go to shards by their anchor, and all segments with an anchor meet in one shard. A shard builds a
   suffix array of its words, the Burrows-Wheeler transform and a wavelet matrix of it, and streams its segments
   through backward search. The interval of a suffix weighs as much as the segments in it occur; a match is extended
   to the left while its weight is two or more, and matches of ``WINDOW`` words or more are reported.
3. A segment that occurs twice as a whole is a match by itself and is only indexed. An anchor with more than ``HOT``
   different segments would outgrow a shard: its windows are counted one by one, by their whole text.

Words are compared, not hashes: hashes only decide who meets whom (segments are grouped by 64-bit hashes of their
words together with the anchor's).

Sizes: a shard holds about ``SHARD_WORDS`` words; what is shuffled are segment places, the texts of segments whose
anchor has several forms, and the documents' words (compressed) twice.

Defined cases: a null text has no words; documents under ``WINDOW`` words keep all; rows with equal key and text
occur as often as there are rows, and get one result each; null keys are fine; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.columns import ref
from gaugework.llm.common import keyed, same_document, written

WINDOW = 35
GRAM = 8
SHARD_WORDS = 400_000
HOT = 4_000

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers have inverses modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


# --- segments -----------------------------------------------------------------------------------


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def segments(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, segment hash, first word and number of windows of each segment of a document."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.int32), none.astype(np.int32)
    joined = b" ".join(words) + b" "
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    power = _powers(_BASE, len(joined))
    back = _powers(_INVERSE, len(joined))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)) * power)])

    def run(first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hash of the bytes of words [first, first + size)."""
        a = starts[first]
        return _mixed((sums[ends[first + size - 1]] - sums[a]) * back[a])

    grams = run(np.arange(len(words) - GRAM + 1), GRAM)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    place = np.arange(n) + view.argmin(axis=1)
    first = np.concatenate([[0], (np.diff(place) != 0).nonzero()[0] + 1])
    count = np.diff(np.append(first, n))
    return (
        grams[place[first]].view(np.int64), run(first, count + WINDOW - 1).view(np.int64),
        first.astype(np.int32), count.astype(np.int32),
    )


_SEGMENTS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("anchor", T.ArrayType(T.LongType())), T.StructField("segment", T.ArrayType(T.LongType())),
    T.StructField("start", T.ArrayType(T.IntegerType())), T.StructField("count", T.ArrayType(T.IntegerType())),
])


@F.arrow_udf(_SEGMENTS)
def _segments(texts: pa.Array) -> pa.Array:
    made = []
    for t in texts:
        words = words_of(t.as_py())
        made.append((len(words), *segments(words)))
    columns = list(zip(*made)) or [()] * 5
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], _SEGMENTS.names)


@F.arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    """The words of a text, joined by one space and compressed: half of what the shuffle would make of them."""
    pack = zstandard.ZstdCompressor(level=1)
    return pa.array([pack.compress(b" ".join(words_of(t.as_py()))) for t in texts], pa.binary())


def _unpacked(value: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(value).split()


# --- the index ----------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start places of all suffixes, sorted by at least their first ``depth`` symbols (prefix doubling)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    size = 1
    while size < depth:
        ahead = np.zeros(n, np.int64)
        ahead[:n - size] = rank[size:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        size *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol before any place, one bit vector with its running counts for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.zeros: list[int] = []
        self.ones: list[np.ndarray] = []
        row = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            zero = bit == 0
            self.zeros.append(int(zero.sum()))
            row = np.concatenate([row[zero], row[~zero]])

    def rank(self, symbol: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``place``; ``first`` is the symbol's start in the last row."""
        at = place
        for level in range(self.bits):
            ones = self.ones[level][at]
            bit = (symbol >> (self.bits - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at - first

    def last_row(self, symbol: np.ndarray) -> np.ndarray:
        return self.rank(symbol, np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64))


class FmIndex:
    """Backward search over the words of weighted segments."""

    def __init__(self, rows: list[list[bytes]], weights: np.ndarray):
        ids: dict[bytes, int] = {}
        flat: list[int] = []
        for words in rows:
            flat.extend(ids.setdefault(w, len(ids) + 1) for w in words)
            flat.append(0)  # no match crosses a segment's end: no query has this symbol
        self.text = np.array(flat, np.int64)
        lengths = np.array([len(r) for r in rows])
        self.ends = np.cumsum(lengths + 1) - 1  # of each segment, exclusive
        self.starts = self.ends - lengths
        order = suffix_order(self.text, 2 * WINDOW)
        owner = np.repeat(np.arange(len(rows)), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])])
        before = self.text[order - 1]  # the first suffix follows the last separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=len(ids) + 1))])
        self.tree = WaveletMatrix(before)
        self.base = self.tree.last_row(np.arange(len(ids) + 1))

    def matches(self, query: np.ndarray, least: int = 2) -> list[tuple[int, int, int]]:
        """(segment, a, b): the parts [a, b) of ``WINDOW`` words or more of the ``query`` segments that weigh ``least``.

        All segments search at once, each from its own end to the left. A match that cannot grow to the left ends the
        windows that begin in it; the next one has to end before, and early enough for a window to begin further left.
        """
        start, end = self.starts[query], self.ends[query]
        place, stop = end.copy(), end.copy()
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(self.text), np.int64)
        live = np.arange(len(query))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            symbol = self.text[place[live] - 1]
            base, first = self.base[symbol], self.first[symbol]
            lo = first + self.tree.rank(symbol, low[live], base)
            hi = first + self.tree.rank(symbol, high[live], base)
            grows = self.weight[hi] - self.weight[lo] >= least
            on = live[grows]
            low[on], high[on] = lo[grows], hi[grows]
            place[on] -= 1
            whole = on[place[on] == start[on]]
            failed = live[~grows]
            done = np.concatenate([whole, failed])
            long = done[stop[done] - place[done] >= WINDOW]
            if len(long):
                found.append((query[long], place[long] - start[long], stop[long] - start[long]))
            stop[failed] = np.minimum(stop[failed] - 1, place[failed] + WINDOW - 1)
            again = failed[stop[failed] - start[failed] >= WINDOW]
            place[again] = stop[again]
            low[again], high[again] = 0, len(self.text)
            live = np.concatenate([on[place[on] > start[on]], again])
        if not found:
            return []
        return list(zip(*(np.concatenate(c).tolist() for c in zip(*found))))


_COVER = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _indexed(table: pa.Table) -> pa.Table:
    """The covered parts of a shard's segments that occur once as a whole."""
    table = table.sort_by([("anchor", "ascending"), ("segment", "ascending")])
    rows = [w.split(b" ") for w in table["words"].to_pylist()]
    times = table["times"].to_numpy()
    anchor, segment = table["anchor"].to_numpy(), table["segment"].to_numpy()
    found = FmIndex(rows, times).matches((times == 1).nonzero()[0]) if len(rows) else []
    at = np.array([f[0] for f in found], np.int64)
    return pa.Table.from_arrays([
        pa.array(anchor[at]), pa.array(segment[at]), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()),
    ], schema=_COVER)


# --- the job ------------------------------------------------------------------------------------


def covers(docs: DataFrame) -> DataFrame:
    """``docs``: k, m, text. (k, m, parts): the covered word ranges of each document that has any."""
    cut = written(docs.select("k", "m", _segments("text").alias("s")), "segments")
    places = cut.select("k", "m", F.inline(F.arrays_zip(*[F.col(f"s.{c}").alias(c) for c in ("anchor", "segment", "start", "count")])))
    again = written(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("ra")), "anchors")
    live = written(places.join(again, F.col("anchor") == F.col("ra"), "left_semi"), "segment-places")
    forms = written(
        live.groupBy("anchor", "segment").agg(F.count("*").alias("times"), F.min(F.struct("k", "m", "start", "count")).alias("at")), "segment-forms"
    )
    kinds = written(
        forms.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("at.count") + WINDOW - 1).alias("words")).where("kinds > 1"), "anchor-kinds"
    )
    total = kinds.where(F.col("kinds") <= HOT).agg(F.sum("words")).collect()[0][0] or 0
    shards = max(1, -(-int(total) // SHARD_WORDS))
    mixed = forms.join(kinds.select(F.col("anchor").alias("ka"), "kinds"), F.col("anchor") == F.col("ka"))
    wanted = mixed.select(
        "at.k", "at.m", F.struct("anchor", "segment", "times", "at.start", "at.count", (F.col("kinds") > HOT).alias("hot")).alias("w")
    ).groupBy("k", "m").agg(F.collect_list("w").alias("wanted"))
    texts = written(_fetched(docs, wanted), "segment-texts")
    cool = texts.where("NOT hot").select("anchor", "segment", "times", "words").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    indexed = cool.groupBy("shard").applyInArrow(
        lambda t: _indexed(t), "anchor long, segment long, a int, b int"
    )
    # windows of hot anchors, by their whole text; equal ones combine in each task
    hot = texts.where("hot")
    common = hot.groupBy(F.col("anchor").alias("ha"), F.col("words").alias("hw")).agg(F.sum("times").alias("n")).where("n > 1")
    single = hot.join(common, (F.col("anchor") == F.col("ha")) & (F.col("words") == F.col("hw")), "left_semi").where("times = 1")
    counted = single.select("anchor", "segment", F.col("offset").alias("a"), (F.col("offset") + WINDOW).alias("b"))
    whole = forms.where("times > 1").select("anchor", "segment", F.lit(0).alias("a"), (F.col("at.count") + WINDOW - 1).alias("b"))
    found = written(
        whole.unionByName(indexed).unionByName(counted).groupBy(F.col("anchor").alias("ca"), F.col("segment").alias("cs"))
        .agg(F.collect_list(F.struct("a", "b")).alias("covered")), "segment-covers",
    )
    hit = live.join(found, (F.col("anchor") == F.col("ca")) & (F.col("segment") == F.col("cs")))
    # rows with equal key and text report the same places
    part = F.explode(F.transform("covered", lambda c: F.struct((F.col("start") + c["a"]).alias("a"), (F.col("start") + c["b"]).alias("b"))))
    ranges = hit.select("k", "m", part.alias("p"))
    return written(ranges.groupBy("k", "m").agg(F.sort_array(F.collect_set("p")).alias("parts")), "covered-words")


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, segment, times, hot, offset, words: the wanted segments with their words, from one document that has them."""
    wanted = wanted.select(F.col("k").alias("wk"), F.col("m").alias("wm"), "wanted")
    packed = docs.dropDuplicates(["k", "m"]) if _has_repeats(docs) else docs
    packed = packed.select("k", "m", _packed("text").alias("z"))
    joined = packed.join(wanted, packed["k"].eqNullSafe(wanted["wk"]) & (packed["m"] == wanted["wm"])).select("z", "wanted")
    schema = pa.schema([
        ("anchor", pa.int64()), ("segment", pa.int64()), ("times", pa.int64()), ("hot", pa.bool_()), ("offset", pa.int32()), ("words", pa.binary()),
    ])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gaugework.llm.common import in_pieces

        def rows():
            for batch in batches:
                for z, asked in zip(batch.column(0), batch.column(1)):
                    words = _unpacked(z.as_py())
                    for w in asked.as_py():
                        s, n = w["start"], w["count"]
                        if not w["hot"]:
                            yield w["anchor"], w["segment"], w["times"], False, 0, b" ".join(words[s:s + n + WINDOW - 1])
                            continue
                        for i in range(n):
                            yield w["anchor"], w["segment"], w["times"], True, i, b" ".join(words[s + i:s + i + WINDOW])

        yield from in_pieces(rows(), schema, 5_000)

    return joined.mapInArrow(take, "anchor long, segment long, times long, hot boolean, offset int, words binary")


def _has_repeats(docs: DataFrame) -> bool:
    return bool(docs.groupBy("k", "m").count().where("count > 1").limit(1).count())


_KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])


def _merged(parts: list[dict]) -> Iterator[tuple[int, int]]:
    at, to = 0, 0
    for p in parts:
        if p["a"] > to:
            if to > at:
                yield at, to
            at, to = p["a"], p["b"]
        else:
            to = max(to, p["b"])
    if to > at:
        yield at, to


def _without(words: list[bytes], parts: list[dict] | None) -> tuple[list[bytes], int]:
    if not parts:
        return words, 0
    kept, at, gone = [], 0, 0
    for a, b in _merged(parts):
        kept.extend(words[at:a])
        gone += b - a
        at = b
    return kept + words[at:], gone


_REPORT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


@F.arrow_udf(_REPORT)
def _report(packed: pa.Array, parts: pa.Array) -> pa.Array:
    made = []
    for z, p in zip(packed, parts):
        words = _unpacked(z.as_py())
        kept, gone = _without(words, p.as_py())
        made.append((len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
    columns = list(zip(*made)) or [()] * 3
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], _REPORT.names)


@F.arrow_udf(T.StringType())
def _kept_text(texts: pa.Array, parts: pa.Array) -> pa.Array:
    return pa.array([
        None if not t.is_valid else t.as_py() if not p.as_py() else b" ".join(_without(words_of(t.as_py()), p.as_py())[0]).decode("utf-8", "surrogatepass")
        for t, p in zip(texts, parts)
    ], pa.string())


def _with_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    right = parts.select(F.col("k").alias("rk"), F.col("m").alias("rm"), "parts")
    return rows.join(right, rows["k"].eqNullSafe(right["rk"]) & (rows["m"] == right["rm"]), "left").drop("rk", "rm")


def removal_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words, one row per document."""
    rows = keyed(docs, key, text)
    packed = rows.select("k", "m", _packed("text").alias("z"))
    done = _with_parts(packed, covers(rows)).select(F.col("k").alias("doc_id"), _report("z", "parts").alias("r"))
    return done.select("doc_id", "r.*")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, m and the text that is left: unchanged where nothing was removed, else its kept words joined by one space."""
    rows = docs.select(ref(key).alias("k"), F.xxhash64(F.coalesce(ref(text).cast("string"), F.lit("\x00"))).alias("m"), ref(text).cast("string").alias("text"))
    return _with_parts(rows, covers(keyed(docs, key, text))).select("k", "m", _kept_text("text", "parts").alias("text"))
