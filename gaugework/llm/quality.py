r"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Every line with a word is described by a few shares of its characters and words. The field scores a labelling by the
lines' features and by the change from line to line; Viterbi decoding finds the best labelling of the whole text, and
the share of words in content lines decides whether the document stays.

Training. No line labels exist; a document's label only says how much of it is content: at least ``good_share`` of
the words of a good one, at most ``bad_share`` of a bad one. Line labels are latent. The first round takes every
line for what its document is and fits lines alone; each later round finds the expected labelling under the field that is nearest to it
among those that keep the shares (posterior regularisation), and fits lines and changes to it by gradient
ascent. So a footer in a good document, which reads like the lines of bad ones, turns to boilerplate, and the
change scores are learnt from labels that change. At most ``sample`` documents of either label (the smallest hashes) and
``segments`` stretches of ``segment`` lines of each, chosen by hash over the whole text, reach the driver.
Prediction reads whole texts.

Base rules count words, symbols, repeated lines and words in 8-word windows that occur twice or more; documents of
fewer than ``MIN_WORDS`` words, or with over 30 % such words, fail without regard to the field.

Defined cases: a null or empty text has no words and fails; a line equal to an earlier one counts as repeated
whatever stands between; without labels of both kinds the field is not fitted and base rules alone decide; labels of
one document that differ count as good; rows with equal keys get results of their own; an empty table gives an empty
result; other columns are carried along unread, and a new column takes the first free form of its name.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.columns import ref
from gaugework.llm.common import free_name

MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class QualityOptions:
    sample: int = 1000
    segments: int = 2
    segment: int = 32
    rounds: int = 5
    steps: int = 100
    good_share: float = 0.7
    bad_share: float = 0.3
    rate: float = 0.1
    ridge: float = 0.002
    min_content: float = 0.5


@dataclass(frozen=True)
class LineField:
    weights: np.ndarray  # log odds of content per feature
    change: np.ndarray  # 2 x 2: score of label b behind label a
    first: np.ndarray  # score of the first label


# --- features -----------------------------------------------------------------------------------

_CLASSES: np.ndarray | None = None
_LETTER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _MARK, _STOP, _OTHER = range(8)


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        table = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isupper():
                table[c] = _UPPER
            elif ch.isalpha():
                table[c] = _LETTER
            elif ch.isdigit():
                table[c] = _DIGIT
        for chars, kind in ((_SPACES, _SPACE), (SYMBOLS, _SYMBOL), ("!?", _MARK), (".,;:", _STOP)):
            for ch in chars:
                table[ord(ch)] = kind
        _CLASSES = table
    return _CLASSES


N_FEATURES = 13


def line_features(text: str) -> tuple[np.ndarray, list[int], list[list[bytes]], int]:
    """Features and word counts of the lines with a word, the words of all lines, and the number of repeated lines."""
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    words = [line.split() for line in lines]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[points]
    starts = np.concatenate([[0], (points == 10).nonzero()[0] + 1]).astype(np.int64)
    padded = np.append(kinds, np.uint8(_SPACE))  # each line then ends with a break, so no stretch is empty
    shares = np.stack([np.add.reduceat(padded == k, starts, dtype=np.int64) for k in range(8)], axis=1)
    seen: set[bytes] = set()
    rows, counts, again = [], [], 0
    for i, ws in enumerate(words):
        n = len(ws)
        if not n:
            continue
        repeated = lines[i] in seen
        again += repeated
        seen.add(lines[i])
        letter, upper, digit, _, symbol, mark, stop, other = shares[i].tolist()
        chars = max(1, letter + upper + digit + symbol + mark + stop + other)
        last = ws[-1][-1:]
        rows.append((
            1.0, min(n, 60) / 60, (letter + upper) / chars, upper / max(1, letter + upper), digit / chars,
            min(1.0, 4 * symbol / chars), min(1.0, 4 * mark / chars), min(1.0, 4 * stop / chars), ws.count(b"|") / n,
            sum(map(operator.eq, ws, ws[1:])) / n, len(set(ws)) / n, float(repeated), float(last in (b".", b"!", b"?", b":")),
        ))
        counts.append(n)
    return np.array(rows).reshape(-1, N_FEATURES), counts, words, again


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words covered by windows whose word sequence occurs twice or more."""
    if len(words) <= window:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0] + ends[:-window]
    first: dict[bytes, int] = {}
    hits: set[int] = set()
    for i, (s, e) in enumerate(zip(starts, ends[window - 1:])):
        j = first.setdefault(joined[s:e], i) if e < len(joined) else first.setdefault(joined[s:] + b" ", i)
        if j != i:
            hits.add(i)
            hits.add(j)
    covered, end = 0, 0
    for i in sorted(hits):
        covered += i + window - max(i, end)
        end = i + window
    return covered


# --- the field ----------------------------------------------------------------------------------


def best_labels(features: np.ndarray, field: LineField) -> np.ndarray:
    """Viterbi: the most likely labelling (1: content) of a text's lines."""
    scores = (features @ field.weights).tolist()
    (aa, ab), (ba, bb) = field.change.tolist()
    s0, s1 = float(field.first[0]), float(field.first[1]) + scores[0]
    back = []
    for e in scores[1:]:
        f0, f1 = s0 + aa >= s1 + ba, s0 + ab >= s1 + bb
        back.append((f0, f1))
        s0, s1 = (s0 + aa if f0 else s1 + ba), (s0 + ab if f1 else s1 + bb) + e
    label = int(s1 >= s0)
    path = [label]
    for f in reversed(back):
        label = int(not f[label])
        path.append(label)
    return np.array(path[::-1])


def fit_field(texts: list[tuple[np.ndarray, np.ndarray, int]], options: QualityOptions) -> LineField:
    """The field of stretches (features, words, label of the document): rounds of expected labels and gradient ascent (Adam)."""
    size = max(len(x) for x, _, _ in texts)
    data, words = np.zeros((len(texts), size, N_FEATURES)), np.zeros((len(texts), size))
    mask = np.zeros((len(texts), size), bool)
    good = np.array([y for _, _, y in texts]) == 1
    for i, (x, n, _) in enumerate(texts):
        data[i, :len(x)], words[i, :len(x)], mask[i, :len(x)] = x, n, True
    words /= words.sum(axis=1, keepdims=True)
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    theta = np.zeros(N_FEATURES + 6)
    wanted = of_documents(good, mask)
    # documents' labels never change from line to line, so the first round must not learn changes from them
    learnt = np.arange(N_FEATURES + 6) < N_FEATURES
    for turn in range(options.rounds):
        if turn:
            wanted, learnt = expected_labels(theta, data, words, mask, good, options), True
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, options.steps + 1):
            g = (_gradient(theta, data, mask, wanted, weight) - options.ridge * theta) * learnt
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + options.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineField(theta[:N_FEATURES], theta[N_FEATURES:N_FEATURES + 4].reshape(2, 2), theta[-2:])


def of_documents(good: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (1: content) and label pairs of lines that all carry their document's label."""
    single = np.stack([~good[:, None] & mask, good[:, None] & mask], axis=2).astype(float)
    pair = np.zeros((len(good), 2, 2))
    pair[np.arange(len(good)), good.astype(int), good.astype(int)] = mask[:, 1:].sum(axis=1)
    return single, pair


def marginals(emit: np.ndarray, change: np.ndarray, first: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: the chance of each label of each line, and the expected number of each pair of labels."""
    n, size, _ = emit.shape
    alpha = np.zeros((n, size, 2))
    alpha[:, 0] = first + emit[:, 0]
    for t in range(1, size):
        step = np.logaddexp(alpha[:, t - 1, 0, None] + change[0], alpha[:, t - 1, 1, None] + change[1]) + emit[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    beta = np.zeros((n, size, 2))
    for t in range(size - 2, -1, -1):
        ahead = beta[:, t + 1] + emit[:, t + 1]
        step = np.logaddexp(ahead[:, 0, None] + change[:, 0], ahead[:, 1, None] + change[:, 1])
        beta[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    single = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
    pair = alpha[:, :-1, :, None] + change + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
    return single, np.einsum("ntab,nt->nab", np.exp(np.minimum(pair, 0.0)), mask[:, 1:].astype(float))


def expected_labels(theta, data, words, mask, good, options: QualityOptions) -> tuple[np.ndarray, np.ndarray]:
    """The labelling nearest to the field's that keeps the documents' shares of words in content lines.

    It is the field's with a constant times a line's share of words added for content. The constant is 0 where the share holds
    and is otherwise found by halving.
    """
    w, change, first = theta[:N_FEATURES], theta[N_FEATURES:N_FEATURES + 4].reshape(2, 2), theta[-2:]
    base = data @ w
    bound, sign = np.where(good, options.good_share, options.bad_share), np.where(good, 1.0, -1.0)

    def of(push: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        content = base + (sign * push)[:, None] * words
        return marginals(np.stack([np.zeros_like(content), content], axis=2), change, first, mask)

    def holds(single: np.ndarray) -> np.ndarray:
        return sign * ((single[:, :, 1] * words).sum(axis=1) - bound) >= 0

    low, high = np.zeros(len(good)), np.full(len(good), 256.0)
    free = holds(of(low)[0])
    for _ in range(14):
        middle = (low + high) / 2
        ok = holds(of(middle)[0])
        low, high = np.where(ok, low, middle), np.where(ok, middle, high)
    return of(np.where(free, 0.0, high))


def _gradient(theta, data, mask, wanted, weight) -> np.ndarray:
    """Wanted minus expected features, stretches weighted."""
    w, change, first = theta[:N_FEATURES], theta[N_FEATURES:N_FEATURES + 4].reshape(2, 2), theta[-2:]
    content = data @ w
    single, pair = marginals(np.stack([np.zeros_like(content), content], axis=2), change, first, mask)
    g = np.empty_like(theta)
    g[:N_FEATURES] = np.einsum("nt,ntf->f", (wanted[0][:, :, 1] - single[:, :, 1]) * weight[:, None], data)
    g[N_FEATURES:N_FEATURES + 4] = np.einsum("nab,n->ab", wanted[1] - pair, weight).ravel()
    g[-2:] = np.einsum("na,n->a", wanted[0][:, 0] - single[:, 0], weight)
    return g


def stretches(features: np.ndarray, words: list[int], mark: int, options: QualityOptions) -> list[tuple[np.ndarray, list[int]]]:
    """At most ``segments`` stretches of lines, from anywhere in the text: those with the smallest hashes of mark and place."""
    starts = range(0, len(words), options.segment)
    chosen = sorted(starts, key=lambda s: xxhash.xxh64_intdigest(f"{mark}:{s}"))[:options.segments]
    return [(features[s:s + options.segment], words[s:s + options.segment]) for s in sorted(chosen)]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", options: QualityOptions = QualityOptions()) -> LineField | None:
    """The field, or None where there are not documents of both labels."""
    known = labels.where(ref(label).isNotNull() & ref(key).isNotNull()).groupBy(ref(key).alias("k")).agg((F.max(ref(label)) > 0).alias("good"))
    known = known.withColumn("h", F.pmod(F.xxhash64("k"), F.lit(1 << 40)))
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    if len(counts) < 2:
        return None
    share = F.lit(0.0)
    for good, n in counts.items():
        share = F.when(F.col("good") == good, min(1.0, options.sample / n)).otherwise(share)
    chosen = known.where(F.col("h") < share * float(1 << 40)).select("k", F.col("good").cast("int").alias("good"))
    rows = docs.select(ref(key).alias("k"), F.coalesce(ref(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "k")
    # rows that repeat a document, or share its key, don't widen the sample
    place = Window.partitionBy("good").orderBy("h")
    rows = (
        rows.select("text", "good", F.xxhash64("k", "text").alias("h")).dropDuplicates(["good", "h"])
        .withColumn("n", F.row_number().over(place)).where(F.col("n") <= options.sample)
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, good, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                features, words, _, _ = line_features(t)
                parts = stretches(features, words, h, options)
                yield pa.RecordBatch.from_arrays([
                    pa.array([good] * len(parts), pa.int32()), pa.array([h] * len(parts), pa.int64()),
                    pa.array([x.ravel() for x, _ in parts], pa.list_(pa.float64())), pa.array([n for _, n in parts], pa.list_(pa.int64())),
                ], ["good", "h", "x", "words"])

    table = rows.select("text", "good", "h").mapInArrow(describe, "good int, h long, x array<double>, words array<long>").toArrow()
    table = table.sort_by([("h", "ascending")])
    texts = [
        (np.asarray(x, float).reshape(-1, N_FEATURES), np.asarray(n, float), y)
        for x, n, y in zip(table["x"].to_pylist(), table["words"].to_pylist(), table["good"].to_pylist())
    ]
    return fit_field(texts, options) if len({y for _, _, y in texts}) == 2 else None


_VERDICT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType()),
    T.StructField("boilerplate", T.ArrayType(T.IntegerType())),
])


def verdict(text: str, field: LineField | None, min_content: float) -> tuple:
    features, counts, lines, again = line_features(text)
    words = [w for line in lines for w in line]
    n = len(words)
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
    share, boilerplate = 1.0 if n else 0.0, []
    if n and field is not None:
        content = best_labels(features, field)
        share = float(content @ np.array(counts)) / n
        boilerplate = np.array([i for i, ws in enumerate(lines) if ws])[content == 0].tolist()
    return (
        n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), again, repeated, failed, share,
        not failed and share >= min_content, boilerplate,
    )


def judged(docs: DataFrame, field: LineField | None, text: str = "text", column: str = "quality", options: QualityOptions = QualityOptions()) -> DataFrame:
    """``docs`` with a struct column of the base counts, the share of words in content lines, the verdict, and the
    numbers (from 0) of the boilerplate lines. Where ``docs`` has a column of that name, the next free form is taken."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    least = options.min_content

    @F.arrow_udf(_VERDICT)
    def decide(texts: pa.Array) -> pa.Array:
        made = [verdict(t.as_py() or "", shared.value, least) for t in texts]
        columns = list(zip(*made)) or [()] * 9
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_(), pa.list_(pa.int32())]
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], _VERDICT.names)

    return docs.withColumn(free_name(docs, column), decide(ref(text).cast("string")))


def quality_report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", options: QualityOptions = QualityOptions()) -> DataFrame:
    rows = docs.select(ref(key).alias("doc_id"), ref(text).alias("text"))
    return judged(rows, learn(docs, labels, key, text, options=options), options=options).select("doc_id", "quality.*").drop("boilerplate")
