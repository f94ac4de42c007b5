"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features. Letters are lower-cased, every run of other characters is one space, and the 1-, 2- and 3-grams of that
sequence are hashed to ``2**bits`` buckets. A bucket's value is (1 + ln count) * idf, and a document is scaled to
length one. Document frequencies are counted over all documents that may be learned from.

Training. At most ``sample_per_language`` documents of each language and ``sample_rows`` in all, the smallest by a hash
of the key, are fitted on the driver with follow-the-regularised-leader updates and elastic-net penalties, so that
most weights are exactly zero. Every fifth sampled document is kept back; on those a temperature is fitted that makes
the scores calibrated probabilities.

Defined cases: a null text or one without letters is ``und`` with score 0; a null key counts as the empty string; null
languages are not learned; without any document to learn from all predictions are ``und``; ties go to the
language that comes first by code point; repeated rows get equal predictions; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.columns import ref
from gaugework.llm.common import free_name

UNKNOWN = "und"
FOLDS = 5


@dataclass(frozen=True)
class LanguageOptions:
    bits: int = 15
    sample_per_language: int = 1000
    sample_rows: int = 20_000
    max_languages: int = 1000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.001


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    bits: int


# --- features -----------------------------------------------------------------------------------

_LETTERS: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point -> its lower-case form if it is a letter, else a space."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
        _LETTERS = table
    return _LETTERS


def letters(text: str) -> np.ndarray:
    """Lower-case letters with single spaces between them; empty if there is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _letter_table()[points]
    space = folded == 32
    if space.all():
        return folded[:0]
    keep = ~space
    keep[1:] |= ~space[:-1]
    return folded[keep]


def buckets(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of a text and their counts."""
    seq = letters(text)
    if not len(seq):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shift = np.uint32(32 - bits)
    one = seq * np.uint32(0x9E3779B1)
    counts = np.bincount(one >> shift, minlength=1 << bits)
    if len(seq) > 1:
        two = (one[:-1] ^ (seq[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
        counts += np.bincount(two >> shift, minlength=1 << bits)
        if len(seq) > 2:
            three = (two[:-1] ^ (seq[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
            counts += np.bincount(three >> shift, minlength=1 << bits)
    found = counts.nonzero()[0]
    return found, counts[found]


def vector(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[found]
    length = math.sqrt(float(values @ values))
    return values / length if length else values


# --- learning -----------------------------------------------------------------------------------


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(ref(key).cast("string"), F.lit(""))) % FOLDS == 0


def document_frequencies(docs: DataFrame, text: str, bits: int) -> tuple[np.ndarray, int]:
    """Documents per bucket and documents in all: counted per task, summed by Spark; 2**bits rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(1 << bits, np.int64)
        for batch in batches:
            for value in batch.column(0):
                found, _ = buckets(value.as_py() or "", bits)
                if len(found):
                    total += 1
                    df[found] += 1
        seen = df.nonzero()[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(df[seen], total), pa.int64())], ["bucket", "n"]
        )

    rows = (
        docs.select(ref(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    )
    df, total = np.zeros(1 << bits, np.int64), 0
    for row in rows:
        if row["bucket"] < 0:
            total = row["n"]
        else:
            df[row["bucket"]] = row["n"]
    return df, total


def training_sample(docs: DataFrame, key: str, text: str, lang: str, options: LanguageOptions) -> list[tuple]:
    """(language, buckets, counts) of the sampled documents, in a fixed order.

    The sample takes the smallest hashes of (key, text) per language. Only hashes below a share that follows the
    language's row count are ranked, so a language of a third of all rows ranks no more rows than any other.
    """
    bits = options.bits
    named = docs.select(ref(lang).cast("string").alias("lang"), ref(text).cast("string").alias("text"), ref(key).cast("string").alias("key"))
    named = named.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = named.groupBy("lang").count().limit(options.max_languages + 1).collect()
    if len(counts) > options.max_languages:
        raise ValueError(f"more than {options.max_languages} languages to learn")
    each = max(1, min(options.sample_per_language, options.sample_rows // max(len(counts), 1)))
    # hashes below a share that holds some times the sample; the window then sees no more than that, at any input size
    shares = named.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, (4 * each + 1000) / r["count"])) for r in counts], "of string, share double"
    )
    marked = named.withColumn("h", F.xxhash64("key", "text"))
    few = marked.select("lang", "h").join(F.broadcast(shares), F.col("lang") == F.col("of"))
    few = few.where(F.pmod("h", F.lit(1 << 40)) < F.col("share") * float(1 << 40)).select("lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h")
    chosen = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("lang", "h")
    sample = marked.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "h", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [buckets(t.as_py(), bits) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                pa.array([m[1].astype(np.int32) for m in made], pa.list_(pa.int32())),
            ], ["lang", "h", "found", "counts"])

    made = sample.mapInArrow(features, "lang string, h long, found array<int>, counts array<int>").dropDuplicates(["lang", "h"])
    table = made.toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    return [
        (lang_, np.asarray(f.values, np.int64), np.asarray(c.values, np.int64))
        for lang_, f, c in zip(table["lang"].to_pylist(), table["found"].combine_chunks() if table.num_rows else [], table["counts"].combine_chunks() if table.num_rows else [])
        if len(f.values)
    ]


def fit(sample: list[tuple], df: np.ndarray, total: int, options: LanguageOptions) -> LanguageModel | None:
    languages = tuple(sorted({s[0] for s in sample}))
    if not languages:
        return None
    place = {name: i for i, name in enumerate(languages)}
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    rows = [(place[s[0]], s[1], vector(s[1], s[2], idf)) for s in sample]
    kept_back = rows[::5] if len(rows) >= 50 else rows
    fitted = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    n, k = len(df), len(languages)
    z, g2, w = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    zb, gb, bias = np.zeros(k), np.zeros(k), np.zeros(k)

    def leader(z_, g_):
        return np.where(
            np.abs(z_) > options.l1,
            -(z_ - np.sign(z_) * options.l1) / ((options.beta + np.sqrt(g_)) / options.alpha + options.l2), 0.0,
        )

    for epoch in range(options.epochs):
        for i in np.random.default_rng(epoch).permutation(len(fitted)):
            y, found, values = fitted[i]
            at = w[found]
            scores = values @ at + bias
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[y] -= 1.0
            grad = values[:, None] * p
            old = g2[found]
            new = old + grad * grad
            z[found] += grad - (np.sqrt(new) - np.sqrt(old)) / options.alpha * at
            g2[found] = new
            w[found] = leader(z[found], new)
            fresh = gb + p * p
            zb += p - (np.sqrt(fresh) - np.sqrt(gb)) / options.alpha * bias
            gb = fresh
            bias = -zb / ((options.beta + np.sqrt(gb)) / options.alpha + options.l2)
    logits = np.array([values @ w[found] + bias for _, found, values in kept_back])
    truth = np.array([y for y, _, _ in kept_back])
    return LanguageModel(languages, w.astype(np.float32), bias, idf, temperature(logits, truth), options.bits)


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden section on its logarithm."""

    def loss(log_t: float) -> float:
        s = logits / math.exp(log_t)
        top = s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s - top).sum(axis=1)) + top[:, 0] - s[np.arange(len(s)), truth]))

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", options: LanguageOptions = LanguageOptions()) -> LanguageModel | None:
    """A model from the documents that are not held out; None if none of them has a language."""
    known = docs.where(~held_out(key) & ref(lang).isNotNull())
    sample = training_sample(known, key, text, lang, options)
    if not sample:
        return None
    df, total = document_frequencies(known, text, options.bits)
    return fit(sample, df, total, options)


# --- prediction ---------------------------------------------------------------------------------

_VERDICT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def judge(text: str | None, model: LanguageModel | None) -> tuple[str, float]:
    if not text or model is None:
        return UNKNOWN, 0.0
    found, counts = buckets(text, model.bits)
    if not len(found):
        return UNKNOWN, 0.0
    s = (vector(found, counts, model.idf) @ model.weights[found] + model.bias) / model.temperature
    p = np.exp(s - s.max())
    best = int(p.argmax())
    return model.languages[best], float(p[best] / p.sum())


def predicted(docs: DataFrame, model: LanguageModel | None, text: str = "text", column: str = "verdict") -> DataFrame:
    """``docs`` with a struct column (lang_pred, score): ``column``, or its first free form."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_VERDICT)
    def decide(texts: pa.Array) -> pa.Array:
        made = [judge(t.as_py(), shared.value) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], ["lang_pred", "score"]
        )

    return docs.withColumn(free_name(docs, column), decide(ref(text).cast("string")))


def language_report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", options: LanguageOptions = LanguageOptions()) -> DataFrame:
    model = learn(docs, key, text, lang, options)
    rows = predicted(docs.select(ref(key).alias("doc_id"), ref(text).alias("text")), model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "verdict.lang_pred", "verdict.score")


def in_known_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = 0.3, options: LanguageOptions = LanguageOptions()) -> DataFrame:
    """The documents whose language is recognised with at least ``min_score``; the others go."""
    column = free_name(docs, "_gw_verdict")
    rows = predicted(docs, learn(docs, key, text, lang, options), text, column)
    v = ref(column)
    return rows.where((v["lang_pred"] != UNKNOWN) & (v["score"] >= min_score)).drop(column)
