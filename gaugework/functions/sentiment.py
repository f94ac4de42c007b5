"""Sentiment, emotion and aspects of a feedback text as column expressions (no shuffle, streamable)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Problem phrasings, evidence words, factual phrasings, neutral short texts, clause breaks.
PROBLEM_PATTERNS = (
    r"\bnot\s+enough\b",
    r"\b(?:too|very)\s+(?:many|much|high|low|late|early|slow|expensive)\b",
    r"\b(?:doesn['’]?t|dont|doesnt|didn['’]?t|wasn['’]?t|isn['’]?t|aren['’]?t)\s+(?:work|working|function)\b",
    r"\b(?:barely|hardly)\s+works?\b",
    r"\b(?:dies|fails|failure|outdated|missing|confusing|disappointing|terrible|awful|poor)\b",
    r"\bneeds?\s+(?:better\s+)?(?:maintenance|improvement|attention|repair)\b",
)
POSITIVE_EVIDENCE = (
    r"\b(?:great|good|excellent|amazing|helpful|improved|beautiful|supportive|love|loved|enjoy)\b"
    r"|[😊😄😁😍👍]|(?::\)|:d|;\))"
)
NEGATIVE_EVIDENCE = (
    r"\b(?:bad|terrible|awful|poor|outdated|confusing|fails?|failure|dies|slow|barely|disappointing|angry|hate|hated)\b"
    r"|[😡😠😭]|(?:\:\(|\:\/)"
)
FACTUAL_PATTERNS = (
    r"\b(?:is|are)\s+(?:available|open|located|closed)\b",
    r"\b(?:scheduled|held|runs?)\s+(?:from|at|on)\b",
    r"\bfrom\s+\d+\s*(?:am|pm)?\s+to\s+\d+\s*(?:am|pm)?\b",
    r"\b(?:there is|there are)\b",
)
NEUTRAL_SHORT = ("okay", "fine", "average", "nothing special")
NEGATED_POSITIVE = r"\bnot\s+(?:good|great|helpful|excellent)\b"
NEGATED_NEGATIVE = r"\bnot\s+(?:bad|terrible|awful)\b"
CLAUSE_BREAK = r"(?iU)\b(?:but|however|although|though)\b|[;]"
SAD_MARKS, GLAD_MARKS = ("😡", "😠", "😭", ":(", ":/"), ("😊", "😄", "👍", ":)", ":D")
ANGRY_MARKS, UPSET_MARKS = ("😡", "😠"), ("😭", ":(", ":/")
MARGIN = 0.12

# Default lexicon of our own: word -> (polarity, subjectivity). Callers may pass another one.
LEXICON = {
    "great": (0.8, 0.75), "good": (0.7, 0.6), "excellent": (1.0, 1.0), "amazing": (0.6, 0.9),
    "helpful": (0.5, 0.3), "improved": (0.3, 0.3), "beautiful": (0.85, 1.0), "supportive": (0.4, 0.3),
    "love": (0.5, 0.6), "loved": (0.7, 0.8), "enjoy": (0.4, 0.5),
    "bad": (-0.7, 0.67), "terrible": (-1.0, 1.0), "awful": (-1.0, 1.0), "poor": (-0.4, 0.6),
    "outdated": (-0.4, 0.4), "confusing": (-0.3, 0.4), "disappointing": (-0.6, 0.7), "angry": (-0.5, 1.0),
    "hate": (-0.8, 0.9), "hated": (-0.9, 0.7), "slow": (-0.3, 0.4),
}
NEGATION_FACTOR = -0.5


def matches(text: Column, pattern: str) -> Column:
    return text.rlike("(?iU)" + pattern)


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return matches(text, "|".join(f"(?:{p})" for p in patterns))


def any_mark(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def clauses(text: Column) -> Column:
    """Trimmed non-empty parts between contrast words and semicolons."""
    parts = F.transform(F.split(text, CLAUSE_BREAK), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def _found(text: Column, lexicon: dict[str, tuple[float, float]]) -> Column:
    """Lexicon words of a text in order, each with an optional preceding negation."""
    words = "|".join(sorted(lexicon, key=len, reverse=True))
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b(?:not\s+)?(?:{words})\b"), F.lit(0))


def _weights(lexicon: dict[str, tuple[float, float]], part: int) -> Column:
    return F.create_map(*[F.lit(x) for w, v in lexicon.items() for x in (w, float(v[part]))])


def polarity(text: Column, lexicon: dict[str, tuple[float, float]] = LEXICON) -> Column:
    """Mean weight of the lexicon words; a directly preceding "not" halves and flips a weight."""
    table = _weights(lexicon, 0)
    scores = F.transform(
        _found(text, lexicon),
        lambda m: F.element_at(table, F.regexp_replace(m, r"(?U)^not\s+", ""))
        * F.when(F.startswith(m, F.lit("not ")), F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0)))
    return _mean(scores)


def subjectivity(text: Column, lexicon: dict[str, tuple[float, float]] = LEXICON) -> Column:
    table = _weights(lexicon, 1)
    return _mean(F.transform(_found(text, lexicon), lambda m: F.element_at(table, F.regexp_replace(m, r"(?U)^not\s+", ""))))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def adjusted_polarity(text: Column, base: Column) -> Column:
    """Base polarity pushed by problem phrasing and by emoticons."""
    p = F.when(any_match(text, PROBLEM_PATTERNS), F.least(F.lit(-0.35), base - 0.35)).otherwise(base)
    p = F.when(any_mark(text, SAD_MARKS), F.least(F.lit(-0.25), p - 0.15)).otherwise(p)
    return F.when(any_mark(text, GLAD_MARKS), F.greatest(F.lit(0.25), p + 0.15)).otherwise(p)


def opposed(clause_polarities: Column) -> Column:
    """Some clause is clearly positive and another one clearly negative."""
    return F.exists(clause_polarities, lambda v: v > MARGIN) & F.exists(clause_polarities, lambda v: v < -MARGIN)


def simple_label(p: Column) -> Column:
    return F.when(p > MARGIN, "Positive").when(p < -MARGIN, "Negative").otherwise("Neutral")


def judged_clauses(text: Column, lexicon: dict[str, tuple[float, float]] = LEXICON) -> Column:
    """array<struct<clause, base, adjusted>>: each clause with its lexicon and its adjusted polarity."""
    based = F.transform(clauses(text), lambda c: F.struct(c.alias("clause"), polarity(c, lexicon).alias("base")))
    return F.transform(based, lambda m: F.struct(
        m["clause"].alias("clause"), m["base"].alias("base"), adjusted_polarity(m["clause"], m["base"]).alias("adjusted")))


def sentiment(text: Column, p: Column, clause_polarities: Column) -> Column:
    """struct(label, confidence, polarity) from the adjusted polarity and those of the clauses."""
    mixed = (F.size(clause_polarities) > 1) & opposed(clause_polarities)
    label = F.when(mixed, "Mixed").otherwise(simple_label(p))
    confidence = F.least(F.lit(1.0), 0.5 + F.abs(p) * 0.5 + F.when(mixed, 0.08).otherwise(0.0))
    blank = F.trim(text) == ""
    return F.struct(
        F.when(blank, "Neutral").otherwise(label).alias("label"),
        F.when(blank, 0.0).otherwise(F.round(confidence, 4)).alias("confidence"),
        F.when(blank, 0.0).otherwise(p).alias("polarity"))


def corrected_sentiment(
    text: Column, label: Column, confidence: Column, polarity_in: Column, clause_polarities: Column,
    margin: Column | None = None,
) -> Column:
    """struct(label, confidence, polarity): model output corrected for problems, contrast and neutrality."""
    parts = clause_polarities
    problem = any_match(text, PROBLEM_PATTERNS)
    not_good, not_bad = matches(text, NEGATED_POSITIVE), matches(text, NEGATED_NEGATIVE)
    positive = (matches(text, POSITIVE_EVIDENCE) | not_bad) & ~not_good
    negative = (matches(text, NEGATIVE_EVIDENCE) | problem | not_good) & ~not_bad
    contrast = opposed(parts)
    raised = F.when(problem | contrast, F.greatest(confidence, F.lit(0.78))).otherwise(confidence)
    gap = margin if margin is not None else F.lit(None).cast("double")
    unsure = (raised < 0.78) | F.coalesce(gap < 0.56, F.lit(False))
    plain = unsure | any_match(text, FACTUAL_PATTERNS) | F.lower(F.trim(text)).isin(*NEUTRAL_SHORT)
    neutral = ~positive & ~negative & plain
    out_label = F.when(neutral, "Neutral").when(contrast, "Mixed").when(problem, "Negative").otherwise(label)
    out_confidence = F.when(
        neutral, F.greatest(F.lit(0.5), F.least(F.lit(0.8), 1.0 - F.coalesce(gap, F.lit(0.0))))).otherwise(raised)
    return F.struct(
        out_label.alias("label"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out_confidence)), 4).alias("confidence"),
        F.when(problem, F.least(F.lit(-0.35), polarity_in)).otherwise(polarity_in).alias("polarity"))


def emotion(label: Column, polarity_in: Column, subjective: Column, text: Column) -> Column:
    return (
        F.when(any_mark(text, ANGRY_MARKS), "Anger").when(any_mark(text, UPSET_MARKS), "Frustration")
        .when((label == "Positive") & (subjective >= 0.35), "Satisfaction").when(label == "Positive", "Joy")
        .when((label == "Negative") & (polarity_in <= -0.45), "Frustration").when(label == "Negative", "Disappointment")
        .when(label == "Mixed", "Concern").otherwise("Neutral"))
