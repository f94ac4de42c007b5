"""Check queries of the feedback cleaning, enrichment, triage and insight operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import terms as tm
from gaugework.operators import enrich, feedback_clean, insights, triage
from gaugework.plans.checks_profile import rounded_sql, union_sql
from gaugework.plans.registry import register
from gaugework.plans.views import FEEDBACK_SENTENCES, cte, view

# --- cleaning --------------------------------------------------------------------------------------

_PLACEHOLDERS = ", ".join(f"'{p}'" for p in feedback_clean.PLACEHOLDERS)
_CLEAN = (
    "SELECT *, trim(regexp_replace(regexp_replace(coalesce(review_text, ''), '[ \\t\\r]+', ' ', 'g'), '\\n +', chr(10), 'g'), ' ' || chr(10)) AS cleaned, "
    "CASE WHEN regexp_matches(trim(created_at), '^\\d{1,2}[-/]\\d{1,2}[-/]\\d{4}$') THEN try_strptime(replace(trim(created_at), '/', '-'), '%d-%m-%Y') "
    "ELSE try_cast(created_at AS TIMESTAMP) END AS day, "
    "nullif(trim(regexp_replace(category, '\\s+', ' ', 'g')), '') AS cat, "
    "try_cast(regexp_replace(regexp_replace(replace(rating, ',', ''), '^\\s*[$%]', ''), '[$%]\\s*$', '') AS DOUBLE) AS num FROM reviews_audit"
)
# case folding of the letters that the documents have: lower case, and sharp s as two letters
_FOLDED = "replace(lower(cleaned), 'ß', 'ss')"
_KEYED = (
    f"SELECT *, nullif({_FOLDED}, '') AS k, nullif(regexp_replace({_FOLDED}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g'), '') AS nk FROM cl"
)
_DUPLICATES = (
    "kc AS (SELECT k, min(nk) AS nk, count(*) AS copies FROM ky WHERE k IS NOT NULL GROUP BY k), "
    "ex AS (SELECT k, row_number() OVER (ORDER BY k) AS number FROM kc WHERE copies > 1), "
    "ng AS (SELECT nk, row_number() OVER (ORDER BY nk) + (SELECT count(*) FROM ex) AS number FROM kc WHERE copies = 1 AND nk IS NOT NULL GROUP BY nk HAVING count(*) > 1)"
)
_CLEAN_CTE = f"{cte('reviews_audit')}, cl AS ({_CLEAN}), ky AS ({_KEYED}), {_DUPLICATES}"
_WARN = (
    "concat_ws(';', CASE WHEN review_text IS NULL THEN 'missing_text' END, "
    "CASE WHEN review_text IS NOT NULL AND cleaned <> review_text THEN 'whitespace_normalized' END, "
    "CASE WHEN review_text IS NOT NULL AND cleaned = '' THEN 'empty_text' END, "
    f"CASE WHEN lower(cleaned) IN ({_PLACEHOLDERS}) THEN 'missing_text' END, "
    "CASE WHEN coalesce(trim(created_at), '') = '' THEN 'missing_optional_date' WHEN day IS NULL THEN 'invalid_date' END, "
    "CASE WHEN rating IS NOT NULL AND num IS NULL THEN 'invalid_numeric:rating' END, "
    "CASE WHEN ky.k IN (SELECT k FROM ex) THEN 'exact_duplicate' "
    "WHEN ky.nk IN (SELECT nk FROM ng) AND ky.k IN (SELECT k FROM kc WHERE copies = 1) THEN 'near_duplicate' END)"
)
_STATUS = f"CASE WHEN cleaned = '' OR lower(cleaned) IN ({_PLACEHOLDERS}) THEN 'rejected' WHEN w <> '' THEN 'accepted_with_warning' ELSE 'accepted' END"


def _reviews(spark, sf_dir):
    return view(spark, sf_dir, "reviews_audit")


@register(
    "feedback_text_cleaning_documents",
    f"{cte('reviews_audit')}, cl AS ({_CLEAN}) SELECT doc_id, md5(cleaned) AS text_md5, length(cleaned) AS n_chars FROM cl",
)
def feedback_text_cleaning_documents(spark, sf_dir):
    out = feedback_clean.cleaned_text(_reviews(spark, sf_dir), "review_text")
    return out.select("doc_id", F.md5("cleaned_text").alias("text_md5"), F.length("cleaned_text").alias("n_chars"))


@register(
    "feedback_field_normalisation_documents",
    f"{cte('reviews_audit')}, cl AS ({_CLEAN}) SELECT doc_id, CAST(CAST(day AS DATE) AS VARCHAR) AS day, cat AS category, num AS rating FROM cl",
)
def feedback_field_normalisation_documents(spark, sf_dir):
    df = _reviews(spark, sf_dir)
    out = feedback_clean.clean_rows(df, feedback_clean.detect_mapping(df.columns))
    return out.select("doc_id", F.date_format("normalized_date", "yyyy-MM-dd").alias("day"),
                      F.col("normalized_category").alias("category"), F.col("normalized_rating").alias("rating"))


@register(
    "feedback_duplicates_documents",
    f"{_CLEAN_CTE} SELECT doc_id, ex.k IS NOT NULL OR ng.nk IS NOT NULL AS is_duplicate, "
    "concat('duplicate-', CAST(coalesce(ex.number, ng.number) AS VARCHAR)) AS duplicate_group_id, "
    "CASE WHEN ex.k IS NOT NULL THEN 'exact' WHEN ng.nk IS NOT NULL THEN 'near_duplicate' END AS duplicate_type "
    "FROM ky LEFT JOIN ex ON ky.k = ex.k LEFT JOIN kc ON ky.k = kc.k LEFT JOIN ng ON kc.copies = 1 AND ky.nk = ng.nk".replace(
        "concat('duplicate-', CAST(coalesce(ex.number, ng.number) AS VARCHAR))",
        "'duplicate-' || CAST(coalesce(ex.number, ng.number) AS VARCHAR)"),
)
def feedback_duplicates_documents(spark, sf_dir):
    df = feedback_clean.cleaned_text(_reviews(spark, sf_dir), "review_text").select("doc_id", "cleaned_text")
    return feedback_clean.duplicate_columns(df).select("doc_id", "is_duplicate", "duplicate_group_id", "duplicate_type")


@register("feedback_near_duplicate_ratios_documents")
def feedback_near_duplicate_ratios_documents(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # every text once as it is and once with another ending: near copies with a known group
    variants = base.selectExpr("doc_id", "stack(2, text, concat(text, ' !')) AS cleaned_text")
    out = feedback_clean.duplicate_columns(variants)
    return out.where("duplicate_type = 'near_duplicate'").select("doc_id", "duplicate_group_id", "duplicate_similarity")


@register(
    "feedback_quality_status_documents",
    f"{_CLEAN_CTE}, wa AS (SELECT *, {_WARN} AS w FROM ky) SELECT doc_id, w AS quality_warnings, {_STATUS} AS quality_status FROM wa",
)
def feedback_quality_status_documents(spark, sf_dir):
    out = feedback_clean.clean_feedback(_reviews(spark, sf_dir))
    return out.select("doc_id", "quality_warnings", "quality_status")


def _counter(name: str) -> str:
    return {
        "rows_received": "count(*)", "rows_accepted": f"count(*) FILTER (WHERE {_STATUS} <> 'rejected')",
        "rows_accepted_with_warning": f"count(*) FILTER (WHERE {_STATUS} = 'accepted_with_warning')",
        "rows_rejected": f"count(*) FILTER (WHERE {_STATUS} = 'rejected')", "rows_with_warnings": "count(*) FILTER (WHERE w <> '')",
        "duplicate_rows_flagged": "count(*) FILTER (WHERE contains(w, 'exact_duplicate') OR contains(w, 'near_duplicate'))",
        "exact_duplicates": "count(*) FILTER (WHERE contains(w, 'exact_duplicate'))",
        "near_duplicates": "count(*) FILTER (WHERE contains(w, 'near_duplicate'))",
        "invalid_date_rows": "count(*) FILTER (WHERE contains(w, 'invalid_date'))",
        "whitespace_normalizations": "count(*) FILTER (WHERE contains(w, 'whitespace_normalized'))",
        "missing_text_rows": "count(*) FILTER (WHERE contains(w, 'missing_text') OR contains(w, 'empty_text'))",
    }[name] + f" AS {name}"


REPORTED = ["rows_received", "rows_accepted", "rows_accepted_with_warning", "rows_rejected", "rows_with_warnings",
            "duplicate_rows_flagged", "exact_duplicates", "near_duplicates", "invalid_date_rows",
            "whitespace_normalizations", "missing_text_rows"]


@register(
    "feedback_cleaning_report_documents",
    f"{_CLEAN_CTE}, wa AS (SELECT *, {_WARN} AS w FROM ky) SELECT {', '.join(_counter(c) for c in REPORTED)} FROM wa",
)
def feedback_cleaning_report_documents(spark, sf_dir):
    return feedback_clean.cleaning_report(feedback_clean.clean_feedback(_reviews(spark, sf_dir))).select(*REPORTED)


@register(
    "feedback_clean_and_rejected_documents",
    f"{_CLEAN_CTE}, wa AS (SELECT *, {_WARN} AS w FROM ky) SELECT CASE WHEN {_STATUS} = 'rejected' THEN 'rejected' ELSE 'clean' END AS part, "
    "count(*) AS n, sum(doc_id) AS ids, count(day) AS dated FROM wa GROUP BY 1",
)
def feedback_clean_and_rejected_documents(spark, sf_dir):
    df = _reviews(spark, sf_dir)
    mapping = feedback_clean.detect_mapping(df.columns)
    clean, rejected = feedback_clean.clean_and_rejected(feedback_clean.clean_feedback(df, mapping), df.columns, mapping)
    sums = lambda d, part, day: d.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.count(day).alias("dated")).select(
        F.lit(part).alias("part"), "n", "ids", "dated")
    return sums(clean, "clean", "created_at").unionByName(sums(rejected, "rejected", "normalized_date"))


# --- enrichment ------------------------------------------------------------------------------------

# Expected label of each sentence of the feedback view, in the order of the sentences.
LABELS = ["Neutral", "Positive", "Mixed", "Negative", "Neutral", "Negative", "Negative", "Positive", "Neutral",
          "Neutral", "Neutral", "Positive"]
_LABEL = "CASE feedback " + " ".join(f"WHEN '{s}' THEN '{v}'" for s, v in zip(FEEDBACK_SENTENCES, LABELS)) + " END"


@register("feedback_sentiment_events", f"{cte('feedback_audit')} SELECT feedback_id, {_LABEL} AS sentiment FROM feedback_audit")
def feedback_sentiment_events(spark, sf_dir):
    df = view(spark, sf_dir, "feedback_audit")
    return enrich.sentiment_columns(df, "feedback").select("feedback_id", "sentiment")


@register("feedback_sentiment_details_events")
def feedback_sentiment_details_events(spark, sf_dir):
    df = view(spark, sf_dir, "feedback_audit")
    out = enrich.sentiment_columns(df, "feedback")
    return out.groupBy("feedback", "sentiment", "sentiment_score", "emotion", F.to_json("aspect_sentiments").alias("aspects")).count()


_WORDS = {
    "problem": r"\b(too (many|much|high|low|late|early|slow|expensive)|wasnt working|needs? better maintenance|terrible)\b",
    "positive": r"\b(great|helpful|supportive)\b|😊|not bad", "negative": r"\bterrible\b",
}


@register(
    "feedback_corrected_sentiment_events",
    f"{cte('feedback_audit')}, m AS (SELECT feedback_id, feedback, CASE WHEN feedback_id % 2 = 0 THEN 'Positive' ELSE 'Negative' END AS l, "
    "CAST((feedback_id % 50) + 50 AS DOUBLE) / 100 AS c FROM feedback_audit), p AS (SELECT *, "
    f"regexp_matches(lower(feedback), '{_WORDS['problem']}') AS pr, regexp_matches(lower(feedback), '{_WORDS['positive']}') AS po, "
    f"regexp_matches(lower(feedback), '{_WORDS['negative']}') AS ne, contains(feedback, 'great but') AS mx, "
    "feedback IN ('okay', 'Yoga runs from 9 to 11 on weekdays.') AS pl FROM m) "
    "SELECT feedback_id, CASE WHEN NOT po AND NOT ne AND NOT pr AND (pl OR c < 0.78) THEN 'Neutral' WHEN mx THEN 'Mixed' WHEN pr THEN 'Negative' ELSE l END AS sentiment, "
    "round(CASE WHEN NOT po AND NOT ne AND NOT pr AND (pl OR c < 0.78) THEN 0.8 WHEN pr OR mx THEN greatest(c, 0.78) ELSE c END, 4) AS sentiment_score FROM p",
)
def feedback_corrected_sentiment_events(spark, sf_dir):
    df = view(spark, sf_dir, "feedback_audit").selectExpr(
        "*", "CASE WHEN feedback_id % 2 = 0 THEN 'Positive' ELSE 'Negative' END AS model_label",
        "((feedback_id % 50) + 50) / 100 AS model_confidence", "0.0D AS model_polarity")
    out = enrich.corrected_sentiment_columns(df, "feedback", "model_label", "model_confidence", "model_polarity")
    return out.select("feedback_id", "sentiment", "sentiment_score")


_LEXICON_ROWS = "('that', 0.5, 0.4), ('for', -0.25, 0.8), ('the', 0.1, 0.2), ('and', -0.6, 0.1), ('de', 0.3, 0.9)"


@register(
    "lexicon_polarity_conversations",
    f"WITH lx(word, p, s) AS (VALUES {_LEXICON_ROWS}), t AS (SELECT conv_id * 1000 + turn AS key, "
    "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_''-]*')) AS w FROM conversations), "
    "a AS (SELECT key, avg(p) AS p, avg(s) AS s FROM t JOIN lx ON w = word GROUP BY key) "
    f"SELECT c.conv_id * 1000 + c.turn AS key, {rounded_sql('coalesce(p, 0.0) + 0.0000001')} AS polarity, {rounded_sql('coalesce(s, 0.0)')} AS subjectivity "
    "FROM conversations c LEFT JOIN a ON a.key = c.conv_id * 1000 + c.turn",
)
def lexicon_polarity_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id * 1000 + turn AS id", "text")
    lexicon = spark.sql(f"SELECT col1 AS word, CAST(col2 AS double) AS polarity, CAST(col3 AS double) AS subjectivity FROM VALUES {_LEXICON_ROWS}")
    out = enrich.lexicon_polarity(df, "id", "text", lexicon).where("clause = -1")
    return out.select("key", F.round(F.col("polarity") + 1e-7, 4).alias("polarity"), F.round("subjectivity", 4).alias("subjectivity"))


_STOP = ", ".join(f"'{t}'" for t in tm.GENERIC_TERMS)
_GRAMS = (
    "g AS (SELECT key, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), "
    "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM ("
    "SELECT conv_id * 1000 + turn AS key, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]([\\p{L}\\p{N}_''-]*[\\p{L}\\p{N}_])?'), "
    f"lambda t: NOT list_contains([{_STOP}], t)) AS w FROM conversations)), "
    "tf AS (SELECT key, term, count(*) AS tf FROM g GROUP BY key, term), "
    "v AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 300), "
    "r AS (SELECT key, tf.term, tf, tf * (ln((1.0 + (SELECT count(*) FROM conversations)) / (1 + df)) + 1) AS raw FROM tf JOIN v ON tf.term = v.term)"
)


@register(
    "term_weights_conversations",
    f"WITH {_GRAMS} SELECT key, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)), 4) AS weight FROM r",
)
def term_weights_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id * 1000 + turn AS id", "text")
    return enrich.term_weights(df, "id", "text", 300).select("key", "term", "tf", F.round("weight", 4).alias("weight"))


@register(
    "content_tokens_events",
    f"{cte('feedback_audit')} SELECT feedback_id, array_to_string(list_filter(regexp_extract_all(lower(feedback), '[A-Za-z0-9_][A-Za-z0-9_''-]*'), "
    f"lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t)), ' ') AS tokens FROM feedback_audit",
)
def content_tokens_events(spark, sf_dir):
    df = view(spark, sf_dir, "feedback_audit")
    return df.select("feedback_id", F.array_join(tm.content_tokens(F.col("feedback")), " ").alias("tokens"))


@register("feedback_keywords_and_topics_events")
def feedback_keywords_and_topics_events(spark, sf_dir):
    df = view(spark, sf_dir, "feedback_audit")
    return enrich.keywords_and_topics(df, "feedback_id", "feedback")


@register("feedback_candidate_phrases_conversations")
def feedback_candidate_phrases_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return df.select("conv_id", "turn", F.size(tm.candidate_phrases(F.col("text"))).alias("phrases"))


ASPECTS = ["Wifi Down", "Teaching Quality", "Library", "Pool Area", "Yoga Runs", "Rents", "Old Projector", "", "Emergency Exit", "",
           "Many Students", "Placement Team"]
_ASPECT = "CASE feedback " + " ".join(f"WHEN '{s}' THEN '{v}'" for s, v in zip(FEEDBACK_SENTENCES, ASPECTS)) + " END"


@register("feedback_first_aspect_events", f"{cte('feedback_audit')} SELECT feedback_id, {_ASPECT} AS aspect FROM feedback_audit")
def feedback_first_aspect_events(spark, sf_dir):
    out = enrich.sentiment_columns(view(spark, sf_dir, "feedback_audit"), "feedback")
    return out.select("feedback_id", F.coalesce(F.get("aspect_sentiments", F.lit(0))["aspect"], F.lit("")).alias("aspect"))


@register("feedback_enriched_once_per_text_events")
def feedback_enriched_once_per_text_events(spark, sf_dir):
    out = enrich.enrich_feedback(view(spark, sf_dir, "feedback_audit"), "feedback_id", "feedback")
    return out.groupBy("feedback", "sentiment", "emotion", F.array_join("topics", ",").alias("topics"), F.array_join("keywords", ",").alias("keywords")).count()


_COS = (
    "v AS (SELECT vec_id AS position, embedding AS e FROM embeddings), "
    "p AS (SELECT a.position AS a, b.position AS b FROM v a JOIN v b ON list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) >= 0.84)"
)


@register(
    "merged_phrases_embeddings",
    # the sequential rule, one phrase per recursion step
    f"WITH RECURSIVE {_COS}, s(step, chosen) AS (SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL "
    "SELECT step + 1, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.a = step + 1 AND list_contains(chosen, p.b)) THEN chosen ELSE list_append(chosen, step + 1) END "
    "FROM s WHERE step < (SELECT max(position) FROM v)), c AS (SELECT unnest(chosen) AS r FROM (SELECT chosen FROM s ORDER BY step DESC LIMIT 1)) "
    "SELECT v.position, coalesce((SELECT max(c.r) FROM c WHERE c.r = v.position), (SELECT max(p.b) FROM p JOIN c ON c.r = p.b WHERE p.a = v.position)) AS representative FROM v",
)
def merged_phrases_embeddings(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS position", "embedding AS vector")
    return enrich.merge_phrases(vectors)


# --- triage ----------------------------------------------------------------------------------------

def triaged(spark, sf_dir):
    """The feedback view with lists of its own and the full decision."""
    df = enrich.sentiment_once_per_text(view(spark, sf_dir, "feedback_audit"), "feedback")
    lists = df.withColumn("cleaned_text", F.col("feedback")).withColumn("topics", tm.content_tokens(F.col("feedback"))).withColumn(
        "keywords", F.slice(F.col("topics"), 1, 2))
    return triage.triage(lists)


_LOWERED = "lower(feedback)"
_TERMS = " ".join(f"WHEN contains({_LOWERED}, '{t}') THEN '{c}'" for t, c in triage.COLLEGE.terms)
_TRIAGE = (
    f"{cte('feedback_audit')}, a AS (SELECT *, {_LABEL} AS sentiment, "
    f"regexp_matches({_LOWERED}, '\\b(emergency|danger|unsafe|fire|medical|injur|security threat)\\b') AS sa, "
    f"regexp_matches({_LOWERED}, '\\b(campus|everyone|all students|whole college|entire)\\b') AS wi, "
    f"regexp_matches({_LOWERED}, '\\b(now|urgent|immediately|cannot access|down|outage)\\b') AS ur, "
    f"regexp_matches({_LOWERED}, '\\b(several|many|multiple|students|users|department)\\b') AS gr FROM feedback_audit), "
    "b AS (SELECT *, CASE WHEN sa THEN 'CRITICAL' WHEN wi AND (ur OR sentiment IN ('Negative', 'Mixed')) THEN 'CRITICAL' WHEN ur THEN 'HIGH' "
    "WHEN sentiment IN ('Negative', 'Mixed') THEN 'MEDIUM' ELSE 'LOW' END AS severity, "
    f"coalesce(department, CASE {_TERMS} ELSE 'General' END) AS dept FROM a), "
    "c AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 'P1' WHEN 'HIGH' THEN 'P2' WHEN 'MEDIUM' THEN 'P3' ELSE 'P4' END AS priority, "
    "CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.75 WHEN 'MEDIUM' THEN 0.5 ELSE 0.25 END AS priority_score, "
    "CASE WHEN wi AND sentiment IN ('Negative', 'Mixed') THEN 'CAMPUS_WIDE' WHEN gr THEN 'SMALL_GROUP' WHEN dept IN ('IT', 'Facilities') AND ur THEN 'DEPARTMENT_WIDE' ELSE 'INDIVIDUAL' END AS impact_level FROM b), "
    "d AS (SELECT *, CASE WHEN severity = 'CRITICAL' AND impact_level = 'CAMPUS_WIDE' THEN 'IMMEDIATE_ESCALATION' WHEN severity = 'HIGH' THEN 'ESCALATE' "
    "WHEN severity = 'MEDIUM' THEN 'CREATE_TASK' WHEN sentiment IN ('Negative', 'Mixed') THEN 'RESPOND' ELSE 'MONITOR' END AS action FROM c), "
    "e AS (SELECT *, CASE WHEN severity = 'CRITICAL' AND action NOT IN ('ESCALATE', 'IMMEDIATE_ESCALATION') THEN 'INVALID' ELSE 'VALID' END AS validation_status FROM d) "
)


@register(
    "feedback_triage_events",
    _TRIAGE + "SELECT feedback_id, severity, priority, CAST(priority_score AS DOUBLE) AS priority_score, dept AS department, impact_level, action, validation_status FROM e",
)
def feedback_triage_events(spark, sf_dir):
    return triaged(spark, sf_dir).select(
        "feedback_id", "severity", "priority", "priority_score", "department", "impact_level", "action", "validation_status")


@register(
    "feedback_required_fields_events",
    f"{cte('feedback_audit')} SELECT feedback_id, 9 - 1 - CASE WHEN department IS NULL THEN 0 ELSE 1 END AS errors, 'INVALID' AS validation_status FROM feedback_audit",
)
def feedback_required_fields_events(spark, sf_dir):
    df = view(spark, sf_dir, "feedback_audit").withColumn("emotion", F.col("department")).select("feedback_id", "feedback", "emotion")
    return triage.triage(df).select("feedback_id", F.size("validation_errors").alias("errors"), "validation_status")


@register(
    "feedback_final_decisions_events",
    _TRIAGE + "SELECT severity, action, count(*) AS n, sum(feedback_id) AS ids FROM e WHERE validation_status = 'VALID' GROUP BY severity, action",
)
def feedback_final_decisions_events(spark, sf_dir):
    done = triage.final_decisions(triaged(spark, sf_dir))
    return done.groupBy("severity", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("feedback_id").alias("ids"))


@register(
    "feedback_recommendations_events",
    _TRIAGE + "SELECT feedback_id, concat(dept, ' reviews the feedback: ', lower(replace(action, '_', ' ')), '.') AS suggested_next_step, 'FALLBACK' AS recommendation_status FROM e",
)
def feedback_recommendations_events(spark, sf_dir):
    return triaged(spark, sf_dir).select("feedback_id", "suggested_next_step", "recommendation_status")


@register(
    "feedback_contradictions_events",
    "SELECT event_id, CASE WHEN s = 'CRITICAL' AND p <> 'P1' OR s = 'HIGH' AND p NOT IN ('P1', 'P2') OR s = 'MEDIUM' AND p NOT IN ('P2', 'P3') OR s = 'LOW' AND p NOT IN ('P3', 'P4') THEN 1 ELSE 0 END "
    "+ CASE WHEN s = 'CRITICAL' AND a NOT IN ('ESCALATE', 'IMMEDIATE_ESCALATION') THEN 1 ELSE 0 END + CASE WHEN i = 'CAMPUS_WIDE' AND a = 'MONITOR' THEN 1 ELSE 0 END AS errors "
    "FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS s, concat('P', CAST(1 + user_id % 4 AS VARCHAR)) AS p, "
    "CASE WHEN event_id % 3 = 0 THEN 'MONITOR' WHEN event_id % 3 = 1 THEN 'ESCALATE' ELSE 'CREATE_TASK' END AS a, CASE WHEN user_id % 2 = 0 THEN 'CAMPUS_WIDE' ELSE 'INDIVIDUAL' END AS i FROM events)",
)
def feedback_contradictions_events(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity",
        "concat('P', 1 + user_id % 4) AS priority",
        "CASE WHEN event_id % 3 = 0 THEN 'MONITOR' WHEN event_id % 3 = 1 THEN 'ESCALATE' ELSE 'CREATE_TASK' END AS action",
        "CASE WHEN user_id % 2 = 0 THEN 'CAMPUS_WIDE' ELSE 'INDIVIDUAL' END AS impact_level",
        *[f"'x' AS {c}" for c in ("department", "recommendation", "recommendation_reason", "suggested_next_step", "recommendation_status")])
    return triage.validate_decision(df).select("event_id", F.size("validation_errors").alias("errors"))


# --- insights --------------------------------------------------------------------------------------

_POINTS = "CASE priority WHEN 'P1' THEN 4 WHEN 'P2' THEN 3 WHEN 'P3' THEN 2 WHEN 'P4' THEN 1 ELSE 0 END"
_MEASURES = (
    f"count(*) AS count, round(avg({_POINTS}), 2) AS mean_priority, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS high_critical, "
    "count(*) FILTER (WHERE action IN ('CREATE_TASK', 'ESCALATE', 'IMMEDIATE_ESCALATION')) AS actions_needed"
)
_TOKENS = (
    "list_filter(regexp_extract_all(lower(feedback), '[A-Za-z0-9_][A-Za-z0-9_''-]*'), "
    f"lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"
)


@register(
    "insight_dataset_summary_events",
    _TRIAGE + 'SELECT count(*) AS row_count, count(*) FILTER (WHERE validation_status = \'VALID\') AS valid_rows, CAST(min("date") AS VARCHAR) AS "start", CAST(max("date") AS VARCHAR) AS "end" FROM e',
)
def insight_dataset_summary_events(spark, sf_dir):
    out = insights.dataset_summary(triaged(spark, sf_dir))
    return out.select("row_count", "valid_rows", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


DIMENSIONS = ["department", "sentiment", "severity", "priority", "impact_level", "action", "validation_status"]
_DIMENSION = "SELECT \'{c}\' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM f"


@register(
    "insight_dimensions_events",
    _TRIAGE.rstrip() + ", f AS (SELECT dept AS department, sentiment, severity, priority, impact_level, action, validation_status FROM e) "
    + union_sql(DIMENSIONS, _DIMENSION),
)
def insight_dimensions_events(spark, sf_dir):
    return insights.dimensions(triaged(spark, sf_dir).select("feedback_id", *DIMENSIONS))


@register(
    "insight_sentiment_events",
    f"{cte('feedback_audit')} SELECT s AS sentiment, count(*) AS count, round((SELECT avg(CAST(feedback_id % 100 AS DOUBLE) / 100) FROM feedback_audit), 4) AS average_score "
    f"FROM (SELECT {_LABEL} AS s FROM feedback_audit) GROUP BY s",
)
def insight_sentiment_events(spark, sf_dir):
    df = triaged(spark, sf_dir).withColumn("sentiment_score", (F.col("feedback_id") % 100 / 100).cast("string"))
    return insights.sentiment_distribution(df)


@register(
    "insight_decision_distributions_events",
    _TRIAGE + " UNION ALL ".join(
        f"SELECT '{f}' AS field, {f} AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM e), 2) AS pct FROM e GROUP BY {f}"
        for f in ("severity", "priority", "impact_level", "action")),
)
def insight_decision_distributions_events(spark, sf_dir):
    return insights.decision_distributions(triaged(spark, sf_dir))


@register(
    "insight_categories_events",
    _TRIAGE + "SELECT 'category' AS field, dept AS value, count(*) AS count FROM e GROUP BY dept ORDER BY count DESC, value LIMIT 20",
)
def insight_categories_events(spark, sf_dir):
    return insights.category_counts(triaged(spark, sf_dir))


def _topic_sql(field: str, expr: str) -> str:
    return (
        f"{cte('feedback_audit')} SELECT '{field}' AS field, value, count(*) AS count FROM (SELECT unnest({expr}) AS value FROM feedback_audit) "
        "GROUP BY value ORDER BY count DESC, value LIMIT 20"
    )


@register("insight_top_topics_events", _topic_sql("topics", _TOKENS))
def insight_top_topics_events(spark, sf_dir):
    return insights.top_listed(triaged(spark, sf_dir), "topics")


@register("insight_top_keywords_json_events", _topic_sql("keywords", f"{_TOKENS}[1:2]"))
def insight_top_keywords_json_events(spark, sf_dir):
    df = triaged(spark, sf_dir).withColumn("keywords", F.to_json("keywords"))
    return insights.top_listed(df, "keywords")


@register("insight_top_departments_scalar_events", f"{cte('feedback_audit')} SELECT 'department' AS field, department AS value, count(*) AS count FROM feedback_audit WHERE department IS NOT NULL GROUP BY department")
def insight_top_departments_scalar_events(spark, sf_dir):
    return insights.top_listed(view(spark, sf_dir, "feedback_audit"), "department")


@register(
    "insight_aspects_events",
    "SELECT concat('a', CAST(user_id % 9 AS VARCHAR)) AS aspect, CASE WHEN event_id % 2 = 0 THEN 'Positive' ELSE 'Negative' END AS sentiment, count(*) AS count FROM events GROUP BY 1, 2",
)
def insight_aspects_events(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "to_json(array(named_struct('aspect', concat('a', user_id % 9), 'sentiment', CASE WHEN event_id % 2 = 0 THEN 'Positive' ELSE 'Negative' END))) AS aspect_sentiments")
    return insights.aspect_summary(df)


@register("insight_cross_metrics_events", _TRIAGE + "SELECT severity, action, count(*) AS count FROM e GROUP BY severity, action")
def insight_cross_metrics_events(spark, sf_dir):
    return insights.cross_metrics(triaged(spark, sf_dir))


@register(
    "insight_hotspots_events",
    _TRIAGE + "SELECT dept AS department, count(*) AS count FROM e WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY dept ORDER BY count DESC, dept LIMIT 10",
)
def insight_hotspots_events(spark, sf_dir):
    return insights.hotspots(triaged(spark, sf_dir))


@register(
    "insight_representative_cases_events",
    _TRIAGE + "SELECT CAST(feedback_id AS VARCHAR) AS feedback_id, feedback, severity, priority, dept AS department, action FROM e ORDER BY e.feedback_id LIMIT 5",
)
def insight_representative_cases_events(spark, sf_dir):
    return insights.representative_cases(triaged(spark, sf_dir), "feedback_id")


@register(
    "insight_rows_events",
    _TRIAGE + "SELECT 'summary' AS kind, 'records' AS title, 'processed' AS value, count(*) AS count FROM e "
    "UNION ALL SELECT 'summary', 'severity', severity, count(*) FROM e GROUP BY severity "
    "UNION ALL SELECT 'insight', 'decision workload', action, count(*) FROM e GROUP BY action "
    f"UNION ALL (SELECT 'theme', 'recurring topic', value, count(*) FROM (SELECT unnest({_TOKENS}) AS value FROM e) GROUP BY value ORDER BY count(*) DESC, value LIMIT 5)",
)
def insight_rows_events(spark, sf_dir):
    return insights.insight_rows(triaged(spark, sf_dir))


@register("dashboard_kpis_events", _TRIAGE + f"SELECT {_MEASURES} FROM e")
def dashboard_kpis_events(spark, sf_dir):
    return insights.kpi_row(triaged(spark, sf_dir))


@register(
    "dashboard_severity_priority_events",
    _TRIAGE + "SELECT s AS severity, " + ", ".join(f"count(CASE WHEN priority = '{p}' THEN 1 END) AS {p}" for p in ("P1", "P2", "P3", "P4"))
    + " FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) t(s) LEFT JOIN e ON severity = s GROUP BY s",
)
def dashboard_severity_priority_events(spark, sf_dir):
    return insights.severity_priority_matrix(triaged(spark, sf_dir))


@register("dashboard_category_performance_events", _TRIAGE + f"SELECT dept AS category, {_MEASURES} FROM e GROUP BY dept")
def dashboard_category_performance_events(spark, sf_dir):
    return insights.category_performance(triaged(spark, sf_dir))


@register(
    "dashboard_category_leaders_events",
    _TRIAGE.rstrip() + f", m AS (SELECT dept AS category, {_MEASURES} FROM e GROUP BY dept) " + " UNION ALL ".join(
        f"(SELECT '{m}' AS measure, category FROM m ORDER BY m.{m} DESC, m.count DESC, category LIMIT 1)"
        for m in ("count", "mean_priority", "high_critical", "actions_needed")),
)
def dashboard_category_leaders_events(spark, sf_dir):
    return insights.category_leaders(triaged(spark, sf_dir))


@register(
    "dashboard_record_search_events",
    _TRIAGE + "SELECT feedback_id FROM e WHERE severity = 'HIGH' AND contains(lower(feedback), 'library')",
)
def dashboard_record_search_events(spark, sf_dir):
    found = insights.search_records(triaged(spark, sf_dir).select(
        "feedback_id", "feedback", "sentiment", "severity", "priority", "action", "impact_level", "category"), "LIBRARY", "HIGH")
    return found.select("feedback_id")
