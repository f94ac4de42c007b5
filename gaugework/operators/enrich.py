"""Text enrichment: sentiment, emotion, aspects, keywords, topics, phrase merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import sentiment as st
from gaugework.functions import terms as tm
from gaugework.functions.columns import once, ref
from gaugework.operators.lineage import stored

MAX_TERMS, MAX_KEYWORDS, MAX_TOPICS = 4000, 5, 2
MERGE_COSINE = 0.84
SENTIMENT_COLUMNS = ("sentiment", "sentiment_score", "sentiment_confidence", "emotion", "aspect_sentiments")
VECTOR_BLOCK = 2048
# Blocks of a comparison of all phrases, and the least and the most rows of one; beyond these there are fewer or more.
VECTOR_BLOCKS, LEAST_BLOCK, MOST_BLOCK = 8, 1024, 65536


def sentiment_columns(df: DataFrame, text: str = "cleaned_text", lexicon: dict | None = None) -> DataFrame:
    """Add sentiment, sentiment_score, sentiment_confidence, emotion and aspect_sentiments, row by row."""
    words = lexicon or st.LEXICON
    staged = once(df, _body=F.coalesce(ref(text), F.lit("")))
    body = F.col("_body")
    staged = once(staged, _parts=st.judged_clauses(body, words), _p=st.adjusted_polarity(body, st.polarity(body, words)))
    return _finish(once(staged, _s=st.sentiment(body, F.col("_p"), F.col("_parts.base"))), df, words)


def corrected_sentiment_columns(
    df: DataFrame, text: str, label: str, confidence: str, polarity: str, margin: str | None = None,
    lexicon: dict | None = None,
) -> DataFrame:
    """The same columns from the output columns of any upstream model, after contextual correction."""
    words = lexicon or st.LEXICON
    staged = once(df, _body=F.coalesce(ref(text), F.lit("")))
    body = F.col("_body")
    staged = once(staged, _parts=st.judged_clauses(body, words))
    fixed = st.corrected_sentiment(
        body, ref(label), ref(confidence), ref(polarity), F.col("_parts.base"), ref(margin) if margin else None)
    return _finish(once(staged, _s=fixed), df, words)


def _finish(staged: DataFrame, df: DataFrame, words: dict) -> DataFrame:
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s.confidence"))), 4)
    mentions = F.filter(
        F.transform("_parts", lambda m: F.struct(
            tm.aspect(m["clause"]).alias("aspect"), st.simple_label(m["adjusted"]).alias("sentiment"))),
        lambda m: m["aspect"] != "")
    mood = st.emotion(F.col("_s.label"), F.col("_s.polarity"), st.subjectivity(F.col("_body"), words), F.col("_body"))
    kept = [ref(c) for c in df.columns if c not in SENTIMENT_COLUMNS]
    added = once(
        staged.select(*kept, "_body", "_parts", "_s"),
        sentiment=F.col("_s.label"), sentiment_score=score, emotion=mood, aspect_sentiments=mentions)
    return added.select(
        *kept, "sentiment", "sentiment_score", F.col("sentiment_score").alias("sentiment_confidence"), "emotion", "aspect_sentiments")


def sentiment_once_per_text(df: DataFrame, text: str = "cleaned_text", lexicon: dict | None = None) -> DataFrame:
    """The sentiment columns, worked out once per distinct text and joined back by a key of the whole text."""
    body = F.coalesce(ref(text), F.lit(""))
    keyed = df.withColumn("_text_key", F.sha2(body, 256))
    distinct = keyed.select("_text_key", body.alias("_t")).dropDuplicates(["_text_key"])
    per_text = sentiment_columns(distinct, "_t", lexicon).drop("_t")
    kept = [ref(c) for c in df.columns if c not in SENTIMENT_COLUMNS]
    return keyed.join(per_text, "_text_key").select(*kept, *SENTIMENT_COLUMNS)


def lexicon_polarity(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, clause (-1 is the whole text), polarity, subjectivity from a lexicon table of any size.

    ``lexicon`` has word, polarity, subjectivity. Tokens are counted per clause before the join, and
    the join strategy follows the measured size of the lexicon.
    """
    body = F.coalesce(ref(text), F.lit(""))
    parts = F.concat(
        F.array(F.struct(F.lit(-1).alias("clause"), body.alias("part"))),
        F.transform(st.clauses(body), lambda c, i: F.struct(i.alias("clause"), c.alias("part"))))
    rows = df.select(ref(key).alias("key"), F.explode(parts).alias("p")).select("key", "p.clause", "p.part")
    words = rows.select("key", "clause", F.explode_outer(tm.tokens(F.col("part"))).alias("word")).groupBy(
        "key", "clause", "word").agg(F.count(F.lit(1)).alias("n"))
    joined = words.join(lexicon.select("word", "polarity", "subjectivity"), "word", "left")
    weight = F.sum(F.when(F.col("polarity").isNotNull(), F.col("n")))
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("n")) / weight, F.lit(0.0))
    return joined.groupBy("key", "clause").agg(mean("polarity").alias("polarity"), mean("subjectivity").alias("subjectivity"))


def term_weights(df: DataFrame, key: str, text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """key, term, tf, weight: L2-normalised TF-IDF over the most frequent 1- to 3-grams of the corpus.

    Term counts combine within each input partition. The vocabulary is at most ``max_terms`` rows, so
    it is broadcast, and terms outside it are dropped before the per-document norm.
    """
    # the words are evaluated once per row before n-grams refer to them
    words = once(df.select(ref(key).alias("key"), ref(text).alias("text")), words=tm.vocabulary_words(F.coalesce("text", F.lit(""))))
    grams = F.concat(*[tm.ngrams(F.col("words"), size) for size in (1, 2, 3)])
    counted = words.select("key", F.explode(grams).alias("term")).groupBy("key", "term").agg(F.expr("count(1) AS tf"))
    documents = df.agg(F.expr("count(1) AS documents")).withColumn("_one", F.lit(1))
    vocabulary = counted.groupBy("term").agg(F.expr("sum(tf) AS total"), F.expr("count(1) AS df")).orderBy(
        F.desc("total"), "term").limit(max_terms).withColumn("_one", F.lit(1))
    # broadcast: one row, then at most max_terms rows
    idf = vocabulary.join(F.broadcast(documents), "_one").selectExpr("term", "ln((1 + documents) / (1 + df)) + 1 AS idf")
    weighted = counted.join(F.broadcast(idf), "term").selectExpr("key", "term", "tf", "tf * idf AS raw")
    # at most max_terms rows per document
    return weighted.selectExpr("key", "term", "tf", "raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS weight")


def pick_phrases(candidates: Column, weights: Column) -> tuple[Column, Column]:
    """Best non-overlapping keywords and topics of one document, given its candidate phrases and its term weights (a map).

    Phrases with a known term are sorted once by falling weight, equals in order of appearance. A phrase is taken unless it
    contains one that is taken or lies in one.
    """
    words = lambda p: F.split(p, r"\s+")
    known = F.filter(candidates, lambda p: F.map_contains_key(weights, p) | F.exists(words(p), lambda w: F.map_contains_key(weights, w)))
    best = lambda p: F.array_max(F.transform(words(p), lambda w: F.coalesce(F.try_element_at(weights, w), F.lit(0.0))))
    ranked = F.transform(
        F.sort_array(F.transform(known, lambda p, i: F.struct((-best(p) * F.size(words(p))).alias("falling"), i.alias("at"), p.alias("p")))),
        lambda x: x["p"])
    topical = F.filter(ranked, lambda p: ~F.element_at(words(p), -1).isin(*tm.NON_TOPIC_TERMS))

    def greedy(phrases: Column, limit: int) -> Column:
        def taken(kept: Column, p: Column) -> Column:
            overlaps = F.exists(kept, lambda k: F.contains(k, p) | F.contains(p, k))
            return F.when((F.size(kept) < limit) & ~overlaps, F.array_append(kept, p)).otherwise(kept)

        return F.aggregate(phrases, F.array().cast("array<string>"), taken)

    return greedy(ranked, MAX_KEYWORDS), greedy(topical, MAX_TOPICS)


def keywords_and_topics(df: DataFrame, key: str, text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """key, keywords (up to 5), topics (up to 2, capitalised).

    Document frequencies count every row, repeated texts included.
    """
    per_document = term_weights(df, key, text, max_terms).groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("_w"))
    candidates = df.select(ref(key).alias("key"), tm.candidate_phrases(F.coalesce(ref(text), F.lit(""))).alias("_c"))
    # candidates and weights are evaluated once per row before the choice refers to them
    joined = once(candidates.join(per_document, "key", "left"), _found=F.col("_c"), _known=F.coalesce("_w", F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<double>"))))
    keywords, topics = pick_phrases(F.col("_found"), F.col("_known"))
    return joined.select("key", keywords.alias("keywords"), F.transform(topics, lambda t: tm.title(t)).alias("topics"))


def _vector_block(rows: int) -> int:
    """Rows of a block: a fixed number of blocks, so that what is sent grows with the rows, between two bounds of a task's memory."""
    return min(MOST_BLOCK, max(LEAST_BLOCK, -(-rows // VECTOR_BLOCKS)))


def merge_phrases(phrases: DataFrame, block: int | None = None) -> DataFrame:
    """position, representative: near-identical phrases mapped to the position of one of them.

    ``phrases`` has a unique ``position`` (order of first appearance) and ``vector``. In order, each
    phrase without an earlier representative at cosine >= 0.84 becomes one; every other phrase maps to
    its latest representative. Rounds pick all phrases that precede their open neighbours, which gives
    the sequential result; a round emits one number per phrase, never the pairs.

    A question is sent once to each block and an answer once from each, and only rows that ask or answer are sent. A task
    holds two blocks of ``MOST_BLOCK`` rows at most and compares ``VECTOR_BLOCK`` rows at a time.
    """
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    unit = stored(phrases.select("position", F.col("vector").cast("array<double>").alias("vector")).withColumn("_n", size).select(
        "position", F.transform("vector", lambda v: v / F.col("_n")).alias("vector")), "phrase-vectors")
    blocks = max(1, -(-(n := unit.count()) // (block or _vector_block(n))))

    def extreme(latest: bool):
        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
            if a.empty or b.empty:
                return pd.DataFrame({"position": [], "found": []})
            best, none = (np.maximum, -np.inf) if latest else (np.minimum, np.inf)
            found = np.full(len(a), none)
            own, at = np.vstack(a["vector"]), b["position"].to_numpy(float)
            for j in range(0, len(b), VECTOR_BLOCK):
                other = np.vstack(b["vector"].iloc[j:j + VECTOR_BLOCK]).T
                for i in range(0, len(a), VECTOR_BLOCK):
                    close = own[i:i + VECTOR_BLOCK] @ other >= MERGE_COSINE
                    part = found[i:i + VECTOR_BLOCK]
                    best(part, best.reduce(np.where(close, at[j:j + VECTOR_BLOCK], none), axis=1), out=part)
            return pd.DataFrame({"position": a["position"], "found": found})[np.isfinite(found)]
        return compare

    def nearest(rows: DataFrame, latest: bool) -> DataFrame:
        """``rows``: position, seeks, offers. The extreme offering neighbour of each seeking row."""
        part = F.expr(f"CAST(pmod(xxhash64(position, 'part'), {blocks}) AS int)")
        meets = rows.where("seeks OR offers").join(unit, "position").withColumn("_part", part).withColumn(
            "_with", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
        side = F.explode(F.array_compact(F.array(
            F.when(F.col("seeks"), F.struct(F.col("_part").alias("mine"), F.col("_with").alias("other"), F.lit(True).alias("asks"))),
            F.when(F.col("offers"), F.struct(F.col("_with").alias("mine"), F.col("_part").alias("other"), F.lit(False).alias("asks"))))))
        sent = meets.withColumn("_side", side).select("position", "vector", "_side.*")
        return sent.groupBy("mine", "other").applyInPandas(
            extreme(latest), "position bigint, found double").groupBy("position").agg(
            (F.max if latest else F.min)("found").cast("bigint").alias("found"))

    state = unit.select("position", F.lit(True).alias("open"), F.lit(False).alias("chosen"))
    while True:
        ahead = nearest(state.select("position", F.col("open").alias("seeks"), F.col("open").alias("offers")), latest=False)
        # a phrase is its own neighbour, so the earliest open neighbour is itself exactly when it may be chosen
        fresh = stored(state.join(ahead, "position", "left").select(
            "position", "open", (F.col("chosen") | F.coalesce(F.col("open") & (F.col("found") >= F.col("position")), F.lit(False))).alias("now"), "chosen"), "phrase-round")
        covered = nearest(fresh.select("position", (F.col("open") & ~F.col("now")).alias("seeks"), (F.col("now") & ~F.col("chosen")).alias("offers")), latest=True)
        state = stored(fresh.join(covered, "position", "left").select(
            "position", (F.col("open") & F.col("found").isNull() & ~F.col("now")).alias("open"), F.col("now").alias("chosen")), "phrase-round")
        if state.where("open").limit(1).count() == 0:
            break
    # a representative is its own
    mapped = nearest(state.select("position", (~F.col("chosen")).alias("seeks"), F.col("chosen").alias("offers")), latest=True)
    return state.join(mapped, "position", "left").select(
        "position", F.when(F.col("chosen"), F.col("position")).otherwise(F.col("found")).alias("representative"))


def enrich_feedback(
    df: DataFrame, key: str, text: str = "cleaned_text", lexicon: dict | None = None,
    scores: dict[str, str] | None = None,
) -> DataFrame:
    """Input rows plus sentiment columns, topics and keywords.

    Sentiment and aspects are worked out once per distinct text (short key of the whole text) unless
    model outputs are given per row in ``scores`` (label, confidence, polarity, optional margin);
    topics use all rows. ``key`` is a unique row key.
    """
    if scores:
        judged = corrected_sentiment_columns(
            df, text, scores["label"], scores["confidence"], scores["polarity"], scores.get("margin"), lexicon)
    else:
        judged = sentiment_once_per_text(df, text, lexicon)
    phrases = keywords_and_topics(df, key, text)
    return judged.join(phrases, judged[key] == phrases["key"]).drop(phrases["key"])
