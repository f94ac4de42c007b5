"""Line deduplication by content-defined chunks of lines, in DataFrame operations only.

A line's hash and the hash of the line before it form a rolling value; a line whose rolling value is below those of
both neighbours starts a new chunk. The rule reads four lines, so an insertion moves only the boundaries beside it and
the chunks after it are cut as before. Chunks have two lines at least, three on average.

Chunks of two or more lines, with any word, that occur more than once in the corpus are removed except for their first
occurrence (smallest key, then smallest text mark, then place). Occurrences are grouped by a 64-bit hash and then
compared byte by byte: the smallest and the largest text of a group are equal only if all its texts are. A group whose
texts differ (a hash collision) is taken apart by its whole texts.

The chunk rule is that of the ``op2`` query. It leaves both ends of a repeat and most repeats of two to four lines, as a
chunk must lie inside the repeat. ``whole=True`` takes every repeat of two or more whole lines instead, line by line:
each two neighbouring lines with words, ``PAIR_WORDS`` or more in both, that occurred before go, with the empty lines between
lines that go; lines without a word never make a pair, so headings and braces stay. They are told apart by the SHA-256 of both lines. The first occurrence of every line stays, and an occurrence that overlaps the
first one of its own document loses the second line only. Repeats inside one line are not looked for.

Sizes: counting combines in each task before the shuffle, so a chunk that fills a third of the corpus sends one row per
task. The shuffled rows are the chunks, their places, and the documents once.

Defined cases: a null text has no lines and stays null; an empty text is one empty line and stays; a chunk never spans
documents; rows with equal key and text are one document and get the same result; null keys sort first; an empty
table gives an empty result; other columns are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import once, ref
from gaugework.llm.common import attached, fact_column, keyed, written

MIN_LINES = 2
PAIR_WORDS = 8
_HASH_MODULUS = 2147483647
_ROLL = 65599


def line_hash(line: Column) -> Column:
    """48 bits of the line's MD5 as a number."""
    return F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("long")


def with_chunks(rows: DataFrame) -> DataFrame:
    """``rows`` (k, m, text) with ``lines`` and ``chunks``: an array of (first, count), lines counted from 1."""
    lines = once(rows, lines=F.split("text", "\n", -1))
    hashed = once(lines, h=F.transform("lines", lambda x: line_hash(x) % _HASH_MODULUS))
    # the rolling value of line i joins line i with line i - 1 (the first line stands alone)
    rolled = once(hashed, r=F.zip_with(
        "h", F.slice(F.concat(F.array(F.lit(0).cast("long")), F.col("h")), 1, F.size("h")),
        lambda here, before: (here * F.lit(_ROLL).cast("long") + before) % _HASH_MODULUS,
    ))
    # neighbours beyond the ends never win, so the first and the last line start no chunk by themselves
    none = F.array(F.lit(-1).cast("long"))
    sides = once(
        rolled,
        pairs=F.arrays_zip(
            F.col("r").alias("here"),
            F.slice(F.concat(none, F.col("r")), 1, F.size("r")).alias("before"),
            F.concat(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), none).alias("after"),
        ),
    )
    starts = once(sides, starts=F.concat(F.array(F.lit(1)), F.filter(
        F.transform("pairs", lambda p, i: F.when((p["here"] < p["before"]) & (p["here"] < p["after"]), i + 1)),
        lambda x: x.isNotNull(),
    )))
    chunks = once(starts, chunks=F.zip_with(
        "starts", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("lines") + 1)),
        lambda s, e: F.struct(s.alias("first"), (e - s).alias("count")),
    ))
    return chunks.select("k", "m", "text", "lines", "chunks")


def _multi_line(rows: DataFrame) -> DataFrame:
    """One row per chunk of two or more lines with any word: k, m, first, count, body."""
    exploded = with_chunks(rows).select("k", "m", "lines", F.explode("chunks").alias("c")).where(F.col("c.count") >= MIN_LINES)
    body = F.array_join(F.slice("lines", F.col("c.first"), F.col("c.count")), "\n")
    return exploded.select("k", "m", "c.first", "c.count", body.alias("body")).where(F.col("body").rlike(r"\S"))


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """Places (k, m, first, count) of all occurrences but the first of repeated chunks."""
    chunks = _multi_line(rows).select("k", "m", "first", "count", "body", F.xxhash64("body").alias("c"))
    place = F.struct("k", "m", "first")
    groups = written(
        chunks.groupBy("c").agg(
            F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high"), F.min(place).alias("origin"),
        ).where(F.col("n") > 1).select("c", "origin", (F.col("low") == F.col("high")).alias("equal")), "repeated-chunks",
    )
    places = chunks.select("k", "m", "first", "count", "c")
    sure = groups.where("equal").select(F.col("c").alias("gc"), "origin")
    again = places.join(sure, places["c"] == sure["gc"]).where(F.struct("k", "m", "first") != F.col("origin"))
    columns = ["k", "m", "first", "count"]
    if not groups.where(~F.col("equal")).limit(1).count():
        return again.select(*columns).distinct()
    # collisions: the few groups with different texts, by whole text
    mixed = chunks.join(groups.where(~F.col("equal")).select("c"), "c", "left_semi")
    firsts = mixed.groupBy(F.col("body").alias("gb")).agg(F.count("*").alias("n"), F.min(place).alias("origin")).where(F.col("n") > 1)
    apart = mixed.join(firsts, F.col("body") == F.col("gb")).where(F.struct("k", "m", "first") != F.col("origin"))
    return again.select(*columns).unionByName(apart.select(*columns)).distinct()


def removals(rows: DataFrame) -> DataFrame:
    """Per document with removed chunks: k, m and f, a struct with the sorted places of its removed chunks."""
    places = repeated_chunks(rows).groupBy("k", "m").agg(F.sort_array(F.collect_list(F.struct("first", "count"))).alias("gone"))
    return places.select("k", "m", F.struct("gone").alias("f"))


def line_pairs(rows: DataFrame) -> DataFrame:
    """One row per two neighbouring lines with words: k, m, first, second (lines counted from 1), h (SHA-256 of both).

    Lines without a word between the two don't count. Pairs of fewer than ``PAIR_WORDS`` words are left out: a heading over
    another text, a closing brace or an item of a list is no passage.
    """
    staged = once(rows, lines=F.split("text", "\n", -1)).where(F.size("lines") >= MIN_LINES)
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), x.alias("body")))
    worded = once(staged.select("k", "m", numbered.alias("lines")), said=F.filter("lines", lambda x: x["body"].rlike(r"\S")))
    pairs = F.zip_with(
        F.slice("said", 1, F.greatest(F.size("said") - 1, F.lit(0))), F.slice("said", 2, F.greatest(F.size("said") - 1, F.lit(0))),
        lambda a, b: F.struct(a["at"].alias("first"), b["at"].alias("second"), F.concat(a["body"], F.lit("\n"), b["body"]).alias("body")),
    )
    exploded = worded.select("k", "m", F.explode(pairs).alias("p")).where(F.regexp_count("p.body", F.lit(r"\S+")) >= PAIR_WORDS)
    return exploded.select("k", "m", "p.first", "p.second", F.unhex(F.sha2("p.body", 256)).alias("h"))


def line_removals(rows: DataFrame) -> DataFrame:
    """Per document with repeated lines: k, m and f, a struct with the sorted numbers of the lines that go."""
    pairs = line_pairs(rows)
    place = F.struct("k", "m", "first", "second")
    groups = written(
        pairs.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("origin")).where("n > 1")
        .select(F.col("h").alias("gh"), "origin"), "repeated-lines",
    )
    again = pairs.join(groups, F.col("h") == F.col("gh")).where(place != F.col("origin"))
    overlaps = F.col("origin.k").eqNullSafe(F.col("k")) & (F.col("origin.m") == F.col("m")) & (F.col("origin.second") == F.col("first"))
    lines = again.select("k", "m", F.explode(F.when(overlaps, F.array("second")).otherwise(F.array("first", "second"))).alias("line"))
    gone = lines.distinct().groupBy("k", "m").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    return gone.select("k", "m", F.struct("gone").alias("f"))


def _runs(lines: Column, gone: Column) -> Column:
    """Sorted line numbers as (first, count); numbers with only empty lines between them are one run."""
    beside = F.zip_with(F.slice(gone, 1, F.size(gone) - 1), F.slice(gone, 2, F.size(gone) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    breaks = F.filter(
        beside,
        lambda p: (p["b"] - p["a"] > 1) & F.exists(F.slice(lines, p["a"] + 1, p["b"] - p["a"] - 1), lambda x: x.rlike(r"\S")),
    )
    firsts = F.concat(F.slice(gone, 1, 1), F.transform(breaks, lambda p: p["b"]))
    lasts = F.concat(F.transform(breaks, lambda p: p["a"]), F.slice(gone, -1, 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("count")))


def _kept_lines(lines: Column, gone: Column) -> Column:
    """The lines outside the removed chunks: the stretches between them, put together."""
    ends = F.concat(F.array(F.lit(1)), F.transform(gone, lambda g: g["first"] + g["count"]))
    starts = F.concat(F.transform(gone, lambda g: g["first"]), F.array(F.size(lines) + 1))
    return F.flatten(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.slice(lines, p["a"], p["b"] - p["a"])))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``docs`` with the repeated chunks (``whole``: all repeats of two or more lines) taken out of their text, and a
    struct column with what was removed.

    The struct column is the last one; its fields are n_lines, n_removed_lines, n_removed_chunks and emptied (true
    where every line was removed; ``whole``: where no word is left).
    """
    fact = fact_column(docs)
    rows = keyed(docs, key, text)
    found = attached(docs, key, text, line_removals(rows) if whole else removals(rows))
    staged = once(found, _gw_lines=F.split(ref(text).cast("string"), "\n", -1))
    gone = F.coalesce(
        F.when(ref(fact).isNotNull(), _runs(F.col("_gw_lines"), ref(fact)["gone"])) if whole else ref(fact)["gone"],
        F.array().cast("array<struct<first:int,count:int>>"),
    )
    staged = once(staged, _gw_gone=gone)
    removed = F.aggregate("_gw_gone", F.lit(0), lambda a, g: a + g["count"])
    total = F.coalesce(F.size("_gw_lines"), F.lit(0))
    left = _kept_lines(F.col("_gw_lines"), F.col("_gw_gone"))
    kept = F.when(F.size("_gw_gone") == 0, ref(text)).otherwise(F.array_join(left, "\n"))
    nothing = ~F.exists(left, lambda x: x.rlike(r"\S")) if whole else removed == total
    report = F.struct(
        F.when(ref(text).isNull(), 0).otherwise(total).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed_lines"),
        F.size("_gw_gone").cast("long").alias("n_removed_chunks"),
        ((F.size("_gw_gone") > 0) & nothing).alias("emptied"),
    )
    return staged.select(
        *[kept.alias(c) if c == text else ref(c) for c in docs.columns], report.alias(fact)
    )


def without_repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated chunks taken out; documents of which nothing is left go."""
    fact = fact_column(docs)
    return deduplicated(docs, key, text).where(~ref(fact)["emptied"]).drop(fact)


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every repeat of two or more whole lines taken out; documents without a word left by that go."""
    fact = fact_column(docs)
    return deduplicated(docs, key, text, whole=True).where(~ref(fact)["emptied"]).drop(fact)


def removal_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of lines and chunks, and the digest of the text that is left (null: null)."""
    narrow = docs.select(ref(key).alias("doc_id"), ref(text).alias("text"))
    fact = fact_column(narrow)
    out = deduplicated(narrow, "doc_id", "text")
    return out.select(
        "doc_id", *[ref(fact)[c].alias(c) for c in ("n_lines", "n_removed_lines", "n_removed_chunks", "emptied")],
        F.sha2("text", 256).alias("kept_sha256"),
    )
