r"""Personal data: fixed patterns, and terms of which the corpus shows that they disclose a protected entity.

Patterns. Emails, IP addresses, card numbers (Luhn) and phone numbers, leftmost and non-overlapping per kind; a match
that fails its test is dropped without a retry. Secrets are strings in which letters and digits take turns and whose own
information (length times the entropy of their characters) reaches ``secret_bits``, as keys and access tokens have.

Entities. A find protects three: its value, its owner (the domain of an address) and its kind.

Disclosure. p(c) is the share of documents with entity c, p(t) that with term t, p(c, t) that with t within ``reach``
words of a mention of c, whatever lines lie between. A term discloses log(p(c,t) / (p(c) p(t))) of the entity's
information -log p(c). Where that share reaches ``generalise`` the term is a disclosing one in every document in which
it stands near c, at all its places: it is generalised to its class, or removed from ``remove`` on. Shares are
believed only from ``support`` different contexts on (contexts that read the same count once, so copies of a document
prove nothing).

Sizes: a document is swept once, pairs are at most 6 * reach per mention, they combine in each task before the
shuffle, and the documents themselves are not shuffled unless the table of disclosing terms is too large for Spark to
broadcast. An entity that a third of all documents mention (a kind, a large domain) is only ever joined together with
a term.

Defined cases: a null text is empty; a text without finds has no spans; rows with equal key and text are one document
for the statistics only once per row; null keys are fine; an empty table gives an empty result; other columns are
not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.columns import ref
from gaugework.llm.common import in_pieces, keyed, same_document, written

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
TERM = "term"


@dataclass(frozen=True)
class PiiOptions:
    reach: int = 10
    support: int = 3
    generalise: float = 0.8
    remove: float = 0.95
    min_term: int = 3
    secret_bits: float = 64.0
    broadcast_chars: int = 4_000_000  # characters of terms counted by a broadcast set; more are counted by a shuffle


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match always ends with its run of digits, so no later match starts inside a run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_STRING = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[^0-9\s]*[0-9])[A-Za-z0-9_+/=-]{16,}+(?![@.][A-Za-z0-9])")
_TURN = re.compile(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Local characters hold no @, so each match is the run before an @ and the domain behind it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed in ``KINDS``."""
    spans = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                spans.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append((*m.span(), "phone"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def bits(value: str) -> float:
    """Length times the entropy of the characters."""
    n = len(value)
    return sum(-c * math.log2(c / n) for c in Counter(value).values())


def secret_spans(text: str, spans: list[tuple[int, int, str]], options: PiiOptions) -> list[tuple[int, int, str]]:
    """Secrets that lie outside the base spans."""
    found = []
    ends = list(accumulate((e for _, e, _ in spans), max))
    starts = [s for s, _, _ in spans]
    for m in _STRING.finditer(text):
        value = m[0]
        # letters and digits take turns in a drawn string, not in words joined by hyphens or in numbered names
        if len(_TURN.findall(value)) < max(4, len(value) // 8) or bits(value) < options.secret_bits:
            continue
        i = bisect_right(starts, m.end() - 1)
        if not i or ends[i - 1] <= m.start():
            found.append((*m.span(), SECRET))
    return found


def found_spans(text: str, options: PiiOptions) -> list[tuple[int, int, str]]:
    """Base spans and secrets, by start, then kind."""
    base = base_spans(text)
    secrets = secret_spans(text, base, options) if len(text) >= 16 else []
    return sorted(base + secrets, key=_by_place) if secrets else base


_ORDER = {k: i for i, k in enumerate((*KINDS, SECRET, TERM))}


def _by_place(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], _ORDER[span[2]]


def entities(text: str, span: tuple[int, int, str]) -> list[str]:
    """What a find protects: its value as one name (emails in lower case, numbers as their digits), its owner, its kind."""
    start, end, kind = span
    value = text[start:end]
    if kind == "email":
        value = value.lower()
        return [f"email:{value}", f"owner:{value.rpartition('@')[2]}", "kind:email"]
    return [f"{kind}:{value if kind in ('ip', SECRET) else re.sub('[^0-9]', '', value)}", f"kind:{kind}"]


def _terms(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0].casefold()) for m in _WORD.finditer(text)]


def _is_term(term: str, options: PiiOptions) -> bool:
    return len(term) >= options.min_term and not term.isdigit()


def contexts(text: str, options: PiiOptions) -> Iterator[tuple[str, str | None, int]]:
    """(entity, term, hash of the context) around each mention, and (entity, null, 0) for the mention itself.

    One sweep: both words and finds are in order. Terms inside any find are left out.
    """
    spans = found_spans(text, options)
    if not spans:
        return
    words = _outside(_terms(text), spans)
    at = 0
    for span in spans:
        while at < len(words) and words[at][0] < span[0]:
            at += 1
        behind = at  # no word reaches into a find, so the next word starts behind it
        around = [w[2] for w in words[max(0, at - options.reach):behind + options.reach]]
        mark = int.from_bytes(hashlib.blake2b(" ".join(around).encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
        near = {w for w in around if _is_term(w, options)}
        for name in entities(text, span):
            yield name, None, 0
            for term in near:
                yield name, term, mark


def _outside(words: list[tuple[int, int, str]], spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    kept, i = [], 0
    merged: list[list[int]] = []
    for s, e, _ in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for w in words:
        while i < len(merged) and merged[i][1] <= w[0]:
            i += 1
        if i == len(merged) or w[1] <= merged[i][0]:
            kept.append(w)
    return kept


# --- statistics ---------------------------------------------------------------------------------


def mentions(rows: DataFrame, options: PiiOptions) -> DataFrame:
    """Per mention and entity the terms near it: k, m, entity, term (null for the mention itself), context."""
    key_type = rows.schema["k"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([
        ("k", to_arrow_type(key_type)), ("m", pa.int64()), ("entity", pa.string()), ("term", pa.string()), ("context", pa.int64()),
    ])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for batch in batches:
                keys, marks = batch.column(0), batch.column(1)
                for i, value in enumerate(batch.column(2)):
                    key, mark = keys[i].as_py(), marks[i].as_py()
                    for name, term, context in contexts(value.as_py(), options):
                        yield key, mark, name, term, context

        yield from in_pieces(made(), schema)

    out = T.StructType([
        T.StructField("k", key_type), T.StructField("m", T.LongType()), T.StructField("entity", T.StringType()),
        T.StructField("term", T.StringType()), T.StructField("context", T.LongType()),
    ])
    return rows.select("k", "m", "text").mapInArrow(find, out)


def term_documents(rows: DataFrame, terms: DataFrame, options: PiiOptions) -> DataFrame:
    """(term, df): in how many documents each of ``terms`` (term: distinct) occurs as a word."""
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("term") + 60), F.lit(0))).first()
    wanted = None
    if not n:
        return terms.select("term", F.lit(0).cast("long").alias("df"))
    if chars <= options.broadcast_chars:
        wanted = rows.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value if wanted is not None else None
        schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

        for batch in batches:
            tally: dict[str, int] = {}
            for value in batch.column(0):
                words = {w.casefold() for w in _WORD.findall(value.as_py())}
                for w in words if known is None else words & known:
                    tally[w] = tally.get(w, 0) + 1
            yield from in_pieces(iter(tally.items()), schema)

    counted = rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return counted if wanted is not None else counted.join(terms, "term", "left_semi")


def disclosures(rows: DataFrame, near: DataFrame, options: PiiOptions) -> DataFrame:
    """(entity, term, share): terms that disclose at least ``generalise`` of an entity's information."""
    total = rows.count()
    mentioned = near.where("term IS NULL").select("entity", "k", "m").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    by_context = near.where("term IS NOT NULL").groupBy("entity", "term", "context").agg(F.count_distinct("k", "m").alias("n"))
    pairs = by_context.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts"))
    pairs = written(pairs.where(F.col("contexts") >= options.support), "pii-pairs")
    df = term_documents(rows, pairs.select("term").distinct(), options)
    joined = pairs.join(df, "term").join(mentioned, "entity")
    both = F.least("n_both", "df", "n_entity").cast("double")
    share = F.log(both * total / (F.col("n_entity") * F.col("df"))) / F.log(total / F.col("n_entity"))
    scored = joined.where(F.col("n_entity") < total).select("entity", "term", share.alias("share"))
    return scored.where(F.col("share") >= options.generalise)


_FOUND = T.StructType([
    T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("clean", T.StringType()),
])


def general_form(term: str) -> str:
    """The class that stands for a generalised term."""
    if any(c.isdigit() for c in term):
        return "[CODE]"
    return "[NAME]" if term[:1].isupper() else "[TERM]"


def spans_of(text: str, terms: dict[str, float], options: PiiOptions) -> list[tuple[int, int, str]]:
    """Finds and disclosing terms, by start, then kind (terms last)."""
    spans = found_spans(text, options)
    if terms:
        words = _outside(_terms(text), spans)
        spans = sorted(spans + [(s, e, TERM) for s, e, w in words if w in terms], key=_by_place)
    return spans


def sanitised(text: str, spans: list[tuple[int, int, str]], terms: dict[str, float], remove: float) -> str:
    """Entities become their kind; terms become their class, or go if they disclose ``remove`` or more."""
    parts, at = [], 0
    for s, e, kind in spans:
        if s < at:
            at = max(at, e)
            continue
        parts.append(text[at:s])
        if kind != TERM:
            parts.append(f"[{kind.upper()}]")
        elif terms[text[s:e].casefold()] < remove:
            parts.append(general_form(text[s:e]))
        at = e
    return "".join(parts) + text[at:]


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", options: PiiOptions = PiiOptions()) -> DataFrame:
    """k, m, text and ``found``: spans (starts, ends, kinds) and the sanitised text, one row per document."""
    rows = keyed(docs, key, text)
    near = written(mentions(rows, options), "pii-mentions")
    bad = written(disclosures(rows, near, options), "pii-disclosures")
    told = near.where("term IS NOT NULL").select("k", "m", "entity", "term").distinct().join(bad, ["entity", "term"])
    terms = written(
        told.groupBy("k", "m", "term").agg(F.max("share").alias("share")).groupBy("k", "m")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "share")))).alias("terms")), "pii-document-terms",
    ).select(F.col("k").alias("tk"), F.col("m").alias("tm"), "terms")
    joined = rows.join(terms, rows["k"].eqNullSafe(terms["tk"]) & (rows["m"] == terms["tm"]), "left")
    remove = options.remove

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array, of: pa.Array) -> pa.Array:
        out = []
        for value, pairs in zip(texts, of):
            body, known = value.as_py(), dict(pairs.as_py() or ())
            spans = spans_of(body, known, options)
            out.append((
                [s for s, _, _ in spans], [e for _, e, _ in spans], [k for _, _, k in spans],
                sanitised(body, spans, known, remove) if spans else body,
            ))
        s, e, k, c = zip(*out) if out else ((), (), (), ())
        return pa.StructArray.from_arrays([
            pa.array(s, pa.list_(pa.int32())), pa.array(e, pa.list_(pa.int32())), pa.array(k, pa.list_(pa.string())), pa.array(c, pa.string()),
        ], ["starts", "ends", "kinds", "clean"])

    return joined.select("k", "m", "text", find("text", "terms").alias("found"))


def pii_report(docs: DataFrame, key: str = "doc_id", text: str = "text", options: PiiOptions = PiiOptions()) -> DataFrame:
    """Counts per kind, the digest of the base spans, all spans, whether there are any, and the digest of the sanitised text."""
    found = sanitise(docs, key, text, options)
    spans = F.arrays_zip(F.col("found.kinds").alias("kind"), F.col("found.starts").alias("a"), F.col("found.ends").alias("b"))

    def said(items):
        return F.concat_ws(",", F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("found.kinds", lambda k: k == kind)).cast("long")

    return found.select(
        F.col("k").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(said(F.filter(spans, lambda x: x["kind"].isin(*KINDS))), 256).alias("base_sha256"), said(spans).alias("spans"),
        count(SECRET).alias("n_secret"), count(TERM).alias("n_term"), (F.size("found.kinds") > 0).alias("private"),
        F.sha2("found.clean", 256).alias("clean_sha256"),
    )
