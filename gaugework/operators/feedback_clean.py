"""Cleaning of free-text feedback: text, dates, categories, numbers, duplicates, status and report."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.columns import KEY_HEAD, families, once, ref
from gaugework.operators.lineage import stored
from gaugework.operators.ordered import running_totals
from gaugework.operators.semantic import parsed_datetime

# Column name aliases in order of preference, numeric name hints, placeholder texts.
TEXT_ALIASES = (
    "feedback_text", "feedbacktext", "review_text", "comment_text", "response_text", "feedback",
    "review", "comment", "response", "message", "description", "text",
)
DATE_ALIASES = ("created_at", "submitted_at", "timestamp", "date", "datetime", "time")
CATEGORY_ALIASES = ("category", "department", "type", "group", "class", "faculty", "course", "program")
NUMERIC_HINTS = ("rating", "score", "count", "number", "amount", "age", "rank")
PLACEHOLDERS = ("n/a", "na", "n.a.", "nan", "null", "none", "nil", "-", "--")
# Byte sequences left behind when UTF-8 was read as a Western code page.
DAMAGE_MARKERS = ("Ã", "Â", "â€", "ðŸ", "ï¿½")

GROUP_BLOCK = 128
# Bytes of a hash in a broadcast table.
_HASH_BYTES = 16


class FeedbackInputError(ValueError):
    """The input has no usable feedback column."""


@dataclass(frozen=True)
class Mapping:
    """Input columns found for each logical field."""

    text: str
    date: str | None
    category: str | None
    candidates: tuple[str, ...]
    numeric: tuple[str, ...]


def normal_name(name: str) -> str:
    folded = unicodedata.normalize("NFKC", name).casefold()
    return re.sub(r"[^a-z0-9]+", "_", folded).strip("_")


def _matches(names: dict[str, str], aliases: tuple[str, ...]) -> list[str]:
    """Columns named like an alias (in alias order), then columns ending in ``_<alias>`` (in column order)."""
    exact = [c for a in aliases for c, n in names.items() if n == a]
    suffix = tuple("_" + a for a in aliases)
    return exact + [c for c, n in names.items() if c not in exact and n.endswith(suffix)]


def detect_mapping(columns: list[str]) -> Mapping:
    """Find the text, date, category and numeric columns by name; the text column is required."""
    names = {c: normal_name(c) for c in columns}
    texts = _matches(names, TEXT_ALIASES)
    if not texts:
        raise FeedbackInputError(
            "No feedback/text column found; expected a name such as feedback, review, comment or text.")
    dates, categories = _matches(names, DATE_ALIASES), _matches(names, CATEGORY_ALIASES)
    taken = {texts[0], dates[0] if dates else None, categories[0] if categories else None}
    numeric = tuple(c for c, n in names.items() if c not in taken and any(h in n for h in NUMERIC_HINTS))
    return Mapping(
        texts[0], dates[0] if dates else None, categories[0] if categories else None, tuple(texts), numeric)


def _repaired(text: str) -> str:
    """Undo one round of UTF-8 text read as Latin-1 or cp1252; anything else stays as it is."""
    if not any(m in text for m in DAMAGE_MARKERS):
        return text
    best = text
    for encoding in ("cp1252", "latin1"):
        try:
            attempt = text.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
        if attempt.count("�") <= best.count("�"):
            best = attempt
    return best


def _beyond_ascii(text: str) -> Column:
    """The text if it has a character beyond ASCII, else null: ASCII texts need no Python."""
    return F.when(F.length(text) != F.octet_length(text), F.col(text))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("repaired", T.BooleanType())]))
def unicode_text(values: pd.Series) -> pd.DataFrame:
    """NFKC form and repaired encoding: the two steps that have no built-in counterpart."""
    composed = [None if v is None else unicodedata.normalize("NFKC", v) for v in values]
    fixed = [None if v is None else _repaired(v) for v in composed]
    return pd.DataFrame({"text": fixed, "repaired": [a != b for a, b in zip(composed, fixed)]})


def _where_needed(needed: Column, step: Column, text: str) -> Column:
    """The step on the texts that it changes; the others are told apart by a plainer look."""
    return F.when(needed, step).otherwise(F.col(text))


def cleaned_text(df: DataFrame, text: str) -> DataFrame:
    """Add cleaned_text and the array ``_warnings`` (in the order in which the steps run)."""
    staged = df.withColumn("_raw", ref(text).cast("string")).withColumn("_u", unicode_text(_beyond_ascii("_raw")))
    # each step once per row: inlined into each other, the steps and warnings would repeat the expressions of all steps before
    staged = once(staged, _composed=F.coalesce("_u.text", "_raw"))
    staged = once(staged, _no_nul=F.expr("replace(_composed, '\\0', '')"))
    staged = once(staged, _visible=_where_needed(
        ~F.col("_no_nul").rlike(r"\A[\t\n\r -~\xA0-\x{10FFFF}]*\z"),
        F.regexp_replace("_no_nul", r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""), "_no_nul"))
    staged = once(staged, _spaced=_where_needed(
        F.expr(r"contains(_visible, '  ') OR contains(_visible, '\t') OR contains(_visible, '\r')"),
        F.regexp_replace("_visible", r"[ \t\r]+", " "), "_visible"))
    staged = once(staged, _lined=_where_needed(F.expr(r"contains(_spaced, '\n ')"), F.regexp_replace("_spaced", r"\n +", "\n"), "_spaced"))
    staged = once(staged, _clean=_where_needed(
        F.expr(r"concat(left(_lined, 1), right(_lined, 1))").rlike(r"(?U)\s"),
        F.regexp_replace("_lined", r"(?U)^\s+|\s+\z", ""), "_lined"))
    warnings = F.expr(
        "CASE WHEN _raw IS NULL THEN array('missing_text') ELSE array_compact(array("
        "CASE WHEN _u.repaired THEN 'encoding_repaired' END, "
        "CASE WHEN _no_nul <> _composed THEN 'null_bytes_removed' END, "
        "CASE WHEN _visible <> _no_nul THEN 'invisible_control_characters_removed' END, "
        "CASE WHEN _clean <> _visible THEN 'whitespace_normalized' END, "
        "CASE WHEN _clean = '' THEN 'empty_text' END)) END")
    return staged.withColumn("cleaned_text", F.coalesce("_clean", F.lit(""))).withColumn("_warnings", warnings).drop(
        "_raw", "_u", "_composed", "_no_nul", "_visible", "_spaced", "_lined", "_clean")


@F.pandas_udf(T.StringType())
def _folded_letters(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


def case_folded(text: str) -> Column:
    """Full case folding, which has no built-in counterpart beyond ASCII: a regular expression of all special letters costs ten times as much."""
    return F.coalesce(_folded_letters(_beyond_ascii(text)), F.lower(text))


def is_placeholder(text: Column) -> Column:
    # lower case has no fewer characters, so longer texts need not be put in lower case
    bare = F.trim(text)
    return (F.length(bare) <= max(map(len, PLACEHOLDERS))) & F.lower(bare).isin(*PLACEHOLDERS)


def normalized_date(value: Column) -> Column:
    """UTC timestamp: day-first for d-m-yyyy and d/m/yyyy, else ISO and the usual notations."""
    text = F.trim(value.cast("string"))
    day_first = text.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}$")
    first = F.try_to_timestamp(F.translate(text, "/", "-"), F.lit("d-M-yyyy"))
    return F.when(day_first, first).when(text != "", parsed_datetime(text))


def normalized_category(value: Column) -> Column:
    collapsed = F.regexp_replace(value.cast("string"), r"(?U)\s+", " ")
    return F.nullif(F.trim(collapsed), F.lit(""))


def normalized_number(value: Column) -> Column:
    bare = F.regexp_replace(F.replace(value.cast("string"), F.lit(","), F.lit("")), r"^\s*[$%]|[$%]\s*$", "")
    return F.trim(bare).try_cast("double")


def _row_position(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, position: 1-based place of each distinct value in sorted order."""
    one = df.selectExpr("'all' AS g", key, value, "1L AS one")
    return running_totals(one, ["g"], value, ["one"]).selectExpr(key, "cum_one AS position")


# Pairs of texts up to this product of lengths go to difflib itself; multiplier of the window hashes.
_PLAIN_PAIR = 250_000
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class _Hashed:
    """Code points of a text with what gives the hash of any stretch of it."""

    codes: np.ndarray
    sums: np.ndarray
    unshift: np.ndarray

    @classmethod
    def of(cls, text: str) -> _Hashed:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
        mixed ^= mixed >> np.uint64(29)
        shift = np.cumprod(np.full(len(codes), _BASE, dtype=np.uint64))
        unshift = np.cumprod(np.full(len(codes), _BASE_INVERSE, dtype=np.uint64))
        return cls(codes, np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * shift)]), unshift)

    def windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the stretches of ``size`` characters: equal stretches have equal hashes wherever they stand."""
        return (self.sums[starts + size] - self.sums[starts]) * self.unshift[starts]


def _runs(rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rare characters and, for each, the end of its unbroken run."""
    at = np.flatnonzero(rare)
    last = np.append(np.diff(at) != 1, True)[: len(at)]
    ends = np.flatnonzero(last)
    return at, at[ends[np.searchsorted(ends, np.arange(len(at)))]] + 1 if len(at) else at


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def _longest_match(a: _Hashed, b: _Hashed, runs_a, runs_b, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int] | None:
    """What ``SequenceMatcher.find_longest_match`` returns; None if two different stretches share a hash.

    The longest common stretch of rare characters (the first in ``a``, then the first in ``b``) is found by halving
    its length, then lengthened to both sides by any equal characters.
    """
    sides = []
    for (at, ends), low, high in ((runs_a, alo, ahi), (runs_b, blo, bhi)):
        part = slice(*np.searchsorted(at, (low, high)))
        sides.append((at[part], np.minimum(ends[part], high) - at[part]))
    (at_a, room_a), (at_b, room_b) = sides
    i, j, size = alo, blo, 0
    low, high = 0, int(min(room_a.max(initial=0), room_b.max(initial=0)))
    tried = high
    while low < high:
        mine, other = at_a[room_a >= tried], at_b[room_b >= tried]
        keys, others = a.windows(mine, tried), b.windows(other, tried)
        shared = np.isin(keys, others)
        if shared.any():
            first = int(shared.argmax())
            i, j, size = int(mine[first]), int(other[int((others == keys[first]).argmax())]), tried
            if not np.array_equal(a.codes[i:i + size], b.codes[j:j + size]):
                return None
            low = tried
        else:
            high = tried - 1
        tried = (low + high + 1) // 2
    back = _agreeing(a.codes[alo:i][::-1], b.codes[blo:j][::-1])
    ahead = _agreeing(a.codes[i + size:ahi], b.codes[j + size:bhi])
    return i - back, j - back, back + size + ahead


def sequence_ratio(text: str, other: str, hashed: Callable[[str], _Hashed] = _Hashed.of) -> float:
    """``SequenceMatcher(None, text, other).ratio()``, the same number.

    difflib tries every two places of a character that is not frequent, so its time grows with the square of long
    texts; here each matching block costs a few passes over the hashes of its range. A text that begins the other is
    matched whole: the first place of the longest stretch in one is its first place in the other, and it lengthens
    to the start and to the end of the shorter text.
    """
    if text.startswith(other) or other.startswith(text):
        return 2.0 * min(len(text), len(other)) / (len(text) + len(other)) if text or other else 1.0
    if len(text) * len(other) <= _PLAIN_PAIR:
        return SequenceMatcher(None, text, other).ratio()
    a, b = hashed(text), hashed(other)
    seen, counts = np.unique(b.codes, return_counts=True)
    rare = seen[counts <= len(other) // 100 + 1] if len(other) >= 200 else seen
    runs_a, runs_b = _runs(np.isin(a.codes, rare)), _runs(np.isin(b.codes, rare))
    matched, ranges = 0, [(0, len(text), 0, len(other))]
    while ranges:
        alo, ahi, blo, bhi = ranges.pop()
        block = _longest_match(a, b, runs_a, runs_b, alo, ahi, blo, bhi)
        if block is None:
            return SequenceMatcher(None, text, other).ratio()
        i, j, size = block
        if size:
            matched += size
            if alo < i and blo < j:
                ranges.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                ranges.append((i + size, ahi, j + size, bhi))
    return 2.0 * matched / (len(text) + len(other))


def _best_ratios(asking: list[tuple[str, str]], answering: list[tuple[str, str]]) -> list[float]:
    """For each (digest, text) that asks, the best similarity ratio with the text of another digest that answers.

    A pair cannot score above twice its shared characters over its total length, so partners are tried
    in falling order of that bound until it drops to the best ratio found.
    """
    hashed = lru_cache(maxsize=8)(_Hashed.of)
    bag = lru_cache(maxsize=None)(Counter)
    out = []
    for digest, text in asking:
        partners = [other for key, other in answering if key != digest]
        if len(partners) > 1:
            bounds = sorted(((2.0 * sum((bag(text) & bag(t)).values()) / max(1, len(text) + len(t)), t) for t in partners), reverse=True)
        else:
            bounds = [(1.0, t) for t in partners]
        best = 0.0
        for bound, other in bounds:
            if bound <= best:
                break
            best = max(best, sequence_ratio(text, other, hashed))
        out.append(best)
    return out


def block_pairs(df: DataFrame, group: str | None, key: str, block: int) -> DataFrame:
    """Replicate rows so that every two blocks of a group meet in one bounded (mine, other) group.

    Groups are cut into blocks of about ``block`` rows. Each row is sent once per other block of its own
    group as a question (``asks``), once as an answer (``answers``), and once as both to its own block;
    no pair of rows is ever written out.
    """
    by = [group] if group else ["_all"]
    rows = df if group else df.withColumn("_all", F.lit("all"))
    # only the groups of several blocks, stored: where they are few they are broadcast by their size, and no text is sent to meet them
    sizes = stored(rows.groupBy(*by).agg(F.expr(f"CAST(ceil(count(1) / {block}) AS int) AS _blocks")).where("_blocks > 1"), "group-blocks")
    placed = rows.join(sizes, by, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_part", F.expr(f"CAST(pmod(xxhash64({key}, 'part'), _blocks) AS int)"))
    met = placed.withColumn("_with", F.explode(F.expr("sequence(0, _blocks - 1)")))
    side = F.explode(F.expr(
        "CASE WHEN _part = _with THEN array(struct(_part AS mine, _part AS other, true AS asks, true AS answers)) "
        "ELSE array(struct(_part AS mine, _with AS other, true AS asks, false AS answers), "
        "struct(_with AS mine, _part AS other, false AS asks, true AS answers)) END"))
    return met.withColumn("_side", side).select(*by, *[c for c in df.columns if c not in by], "_side.*")


def near_duplicate_ratios(texts: DataFrame, block: int = GROUP_BLOCK) -> DataFrame:
    """group, digest, similarity: best pair ratio of each distinct text within its group.

    ``texts`` has one row per (group, digest) with the folded text. Every pair is covered exactly,
    only the best ratio per text leaves a task. A task streams its (mine, other) cells in order, as most are
    pairs and a call per cell would cost more than the comparison.
    """
    cell = ["group", "mine", "other"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in zip(*(pdf[c] for c in (*cell, "digest", "text", "asks", "answers"))))
        found: list[tuple[str, str, float]] = []
        for key, members in groupby(rows, key=lambda row: row[:3]):
            members = list(members)
            asking = [(r[3], r[4]) for r in members if r[5]]
            ratios = _best_ratios(asking, [(r[3], r[4]) for r in members if r[6]])
            found += [(key[0], digest, ratio) for (digest, _), ratio in zip(asking, ratios)]
            if len(found) >= 1000:
                yield pd.DataFrame(found, columns=["group", "digest", "similarity"])
                found = []
        yield pd.DataFrame(found, columns=["group", "digest", "similarity"])

    met = block_pairs(texts, "group", "digest", block).select(*cell, "digest", "text", "asks", "answers")
    return met.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(
        compare, "group string, digest string, similarity double"
    ).groupBy("group", "digest").agg(F.round(F.max("similarity"), 4).alias("similarity"))


def _broadcast_limit(spark: SparkSession) -> int:
    """The size in bytes up to which this session broadcasts a table; 0 for a unit that is not known."""
    said = re.fullmatch(r"(-?\d+)\s*([kmg]?)i?b?", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower())
    return int(said[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[said[2]] if said else 0


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Add is_duplicate, duplicate_group_id, duplicate_type and duplicate_similarity.

    Texts are grouped by a short key of the whole case-folded text (itself, or its head and digest), and copies are
    counted by these keys alone. Whole texts are fetched only for long keys with copies or near copies, once per key and
    folded again: group numbers follow their order. These keys are stored, so that the fetch goes by their measured size
    and few of them send no text of the others. The rows are stored once with their keys, and the marks of keys with copies or near
    copies are joined back: rows without a key stay out of that join, a small table of marks is broadcast by its
    measured size, and adaptive execution splits a hot key. Near duplicates share all word characters and are looked
    for among texts that are not exact copies.
    """
    bare = r"[^\p{L}\p{N}_]+"
    staged = once(df.withColumn("_folded", case_folded("cleaned_text")), _bare=F.regexp_replace("_folded", bare, ""))
    short = f"CASE WHEN {{c}} = '' THEN NULL WHEN length({{c}}) <= {KEY_HEAD} THEN {{c}} ELSE concat(substring({{c}}, 1, {KEY_HEAD}), sha2({{c}}, 256)) END"
    keyed = stored(staged.withColumn("_key", F.expr(short.format(c="_folded"))).withColumn("_near", F.expr(short.format(c="_bare"))).drop("_folded", "_bare"), "feedback-keys")
    counted = stored(keyed.where("_key IS NOT NULL").groupBy("_key", "_near").agg(F.expr("count(1) AS copies")), "feedback-counts")
    near = counted.where("copies = 1 AND _near IS NOT NULL")
    # one member of each group stands for the word characters that all share
    shared = near.groupBy("_near").agg(F.expr("count(1) AS members"), F.min("_key").alias("_head")).where("members > 1").select("_near", "_head")
    wanted = stored(counted.where("copies > 1").withColumn("_first", F.lit(False)).unionByName(
        near.join(shared, "_near").withColumn("_first", F.expr("_key = _head")).drop("_head")), "feedback-wanted")
    long = f"length(_key) > {KEY_HEAD}"
    # the hashes of far more keys than the keys themselves are small enough to be broadcast; the join by key that follows decides
    # (beyond that the texts would be sent twice, to meet the hashes and to meet the keys)
    hashed = wanted.where(long).select(F.xxhash64("_key").alias("_hash"))
    asked = keyed.where(long).select("_key", "cleaned_text")
    if hashed.count() * _HASH_BYTES <= _broadcast_limit(df.sparkSession):
        asked = asked.withColumn("_hash", F.xxhash64("_key")).join(F.broadcast(hashed), "_hash", "left_semi").drop("_hash")
    fetched = asked.join(wanted.where(long), "_key").groupBy("_key", "_near", "copies", "_first").agg(F.min("cleaned_text").alias("_whole"))
    texts = stored(wanted.where(f"NOT {long}").withColumn("_folded", F.col("_key")).unionByName(
        fetched.select("_key", "_near", "copies", "_first", case_folded("_whole").alias("_folded"))), "feedback-texts")
    exact = texts.where("copies > 1").select("_key", "_folded")
    exact_ids = _row_position(exact, "_key", "_folded").selectExpr(
        "_key", "'exact' AS kind", "position AS number", "1.0D AS similarity")
    single = texts.where("copies = 1")
    groups = stored(single.where("_first").select("_near", F.regexp_replace("_folded", bare, "").alias("_bare")), "feedback-groups")
    # one row: how many numbers the exact groups have used
    used = exact.agg(F.expr("count(1) AS used")).withColumn("_one", F.lit(1))
    numbers = _row_position(groups, "_near", "_bare").withColumn("_one", F.lit(1)).join(F.broadcast(used), "_one").selectExpr(
        "_near", "position + used AS number")
    members = single.selectExpr("_near AS group", "_key AS digest", "_folded AS text")
    near_ids = near_duplicate_ratios(members).withColumnRenamed("group", "_near").join(numbers, "_near").selectExpr(
        "digest AS _key", "'near_duplicate' AS kind", "number", "similarity")
    marks = stored(exact_ids.unionByName(near_ids), "feedback-marks")
    rows = keyed.drop("_near")
    given = rows.where("_key IS NOT NULL").join(marks, "_key", "left")
    absent = rows.where("_key IS NULL").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in marks.schema.fields if f.name != "_key"])
    return given.unionByName(absent).select(
        *[ref(c) for c in df.columns], F.expr("kind IS NOT NULL AS is_duplicate"),
        F.expr("concat('duplicate-', number) AS duplicate_group_id"),
        F.col("kind").alias("duplicate_type"), F.col("similarity").alias("duplicate_similarity"))


def clean_rows(df: DataFrame, mapping: Mapping) -> DataFrame:
    """All row-wise steps (no shuffle): works on batch and streaming input alike."""
    out = cleaned_text(df, mapping.text)
    extra = [F.when(
        is_placeholder(F.col("cleaned_text")) & ~F.array_contains("_warnings", "missing_text"), "missing_text")]
    if mapping.date is not None:
        out = out.withColumn("normalized_date", normalized_date(ref(mapping.date)))
        given = F.coalesce(F.trim(ref(mapping.date).cast("string")), F.lit("")) != ""
        extra.append(F.when(~given, "missing_optional_date").when(F.col("normalized_date").isNull(), "invalid_date"))
    if mapping.category is not None:
        out = out.withColumn("normalized_category", normalized_category(ref(mapping.category)))
    for c in mapping.numeric:
        name = f"normalized_{normal_name(c)}"
        out = out.withColumn(name, normalized_number(ref(c)))
        extra.append(F.when(ref(c).isNotNull() & ref(name).isNull(), f"invalid_numeric:{c}"))
    # told here, so that what follows the duplicate search need not carry the text for it
    out = out.withColumn("_rejected", (F.col("cleaned_text") == "") | is_placeholder(F.col("cleaned_text")))
    return out.withColumn("_warnings", F.concat("_warnings", F.array_compact(F.array(*[e.cast("string") for e in extra]))))


def with_status(df: DataFrame) -> DataFrame:
    """Join the warnings, without repeats, and derive the quality status."""
    return df.withColumn("quality_warnings", F.array_join(F.array_distinct("_warnings"), ";")).withColumn(
        "quality_status",
        F.when(F.col("_rejected"), "rejected").when(F.col("quality_warnings") != "", "accepted_with_warning").otherwise("accepted")
    ).drop("_warnings", "_rejected")


def clean_feedback(df: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """Input columns plus cleaned text, normalised fields, duplicate columns, warnings and status."""
    families(df)
    mapping = mapping or detect_mapping(df.columns)
    marked = duplicate_columns(clean_rows(df, mapping))
    copies = F.when(F.col("duplicate_type") == "exact", F.array(F.lit("exact_duplicate"))).when(
        F.col("duplicate_type") == "near_duplicate", F.array(F.lit("near_duplicate"))).otherwise(F.array().cast("array<string>"))
    return with_status(marked.withColumn("_warnings", F.concat("_warnings", copies)))


def clean_and_rejected(cleaned: DataFrame, columns: list[str], mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with the input columns and cleaned text, rejected rows with all columns)."""
    kept = cleaned.where("quality_status <> 'rejected'")
    shown = [
        F.date_format("normalized_date", "yyyy-MM-dd").alias(c) if c == mapping.date else ref(c) for c in columns
    ]
    return kept.select(*shown, "cleaned_text"), cleaned.where("quality_status = 'rejected'")


# Report counters and the condition each one counts.
REPORT_COUNTERS = {
    "rows_received": "true",
    "rows_accepted": "quality_status <> 'rejected'",
    "rows_accepted_with_warning": "quality_status = 'accepted_with_warning'",
    "rows_rejected": "quality_status = 'rejected'",
    "rows_with_warnings": "quality_warnings <> ''",
    "duplicate_rows_flagged": "is_duplicate",
    "exact_duplicates": "duplicate_type = 'exact'",
    "near_duplicates": "duplicate_type = 'near_duplicate'",
    "invalid_date_rows": "contains(quality_warnings, 'invalid_date')",
    "encoding_repairs": "contains(quality_warnings, 'encoding_repaired')",
    "null_bytes_removed": "contains(quality_warnings, 'null_bytes_removed')",
    "control_characters_removed": "contains(quality_warnings, 'control_characters_removed')",
    "whitespace_normalizations": "contains(quality_warnings, 'whitespace_normalized')",
    "missing_text_rows": "contains(quality_warnings, 'missing_text') OR contains(quality_warnings, 'empty_text')",
    "duplicates_detected": "is_duplicate",
}


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """One row with all counters, from a single aggregate."""
    return cleaned.agg(*[F.expr(f"count_if({c}) AS {n}") for n, c in REPORT_COUNTERS.items()]).withColumn(
        "cleaning_operations", F.struct(
            F.col("encoding_repairs"), F.col("null_bytes_removed"), F.col("control_characters_removed"),
            F.col("whitespace_normalizations").alias("whitespace_repairs")))
