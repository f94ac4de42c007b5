import random
import re
import unicodedata
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugework.functions import terms
from gaugework.operators import enrich, feedback_clean, insights, triage
from gaugework.sources.readers import clean_names, read_feedback_csv, read_table
from gaugework.sources.sinks import write_csv
from gaugework.streaming.feedback_stream import cleaned_stream, triaged_stream


def _clean(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return feedback_clean.clean_feedback(df)


def test_generated_feedback(spark):
    out = _clean(spark, [
        ("  Lovely garden 😊!!!  ", "2026-09-01", " Guest Desk ", "5"),
        ("The tram was veeery slow :/ ...", "2026-09-02", "IT", "4"), ("The tram was veeery slow :/ ...", "2026-09-02", "IT", "4"),
        ("\x00", "not-a-date", "Admin", "3"), (None, "2026-09-05", "Admin", "2"),
        ("Broken letter Ã© mended?", "2026-09-06", "IT", "bad"),
    ], "`Feedback Text` string, created_at string, Department string, rating string").cache()
    report = feedback_clean.cleaning_report(out).first()
    assert (report["rows_received"], report["rows_rejected"], report["exact_duplicates"]) == (6, 2, 2)
    assert report["invalid_date_rows"] == 1 and report["encoding_repairs"] == 1 and report["null_bytes_removed"] == 1
    texts = {r["cleaned_text"] for r in out.collect()}
    assert "Lovely garden 😊!!!" in texts and "Broken letter é mended?" in texts


def test_placeholders_and_short_texts(spark):
    out = _clean(spark, [("N/A",), ("bad",), ("👍",), ("   ",), (":(",)], "response string")
    assert out.where("quality_status = 'rejected'").count() == 2
    assert feedback_clean.cleaning_report(out).first()["missing_text_rows"] == 2


def test_near_duplicates_match_brute_force_across_blocks(spark):
    texts = ["Our bus" + "." * i + " left early" + "!" * (i % 5) for i in range(1, 24)]
    df = spark.createDataFrame([("g", str(i), t) for i, t in enumerate(texts)], "group string, digest string, text string")
    want = {str(i): round(max(SequenceMatcher(None, t, o).ratio() for j, o in enumerate(texts) if j != i), 4) for i, t in enumerate(texts)}
    for block in (4, 1000):
        got = {r["digest"]: r["similarity"] for r in feedback_clean.near_duplicate_ratios(df, block).collect()}
        assert got == want


def test_ratio_equals_difflib(monkeypatch):
    monkeypatch.setattr(feedback_clean, "_PLAIN_PAIR", 0)
    draw = random.Random(8)
    for _ in range(400):
        letters = draw.choice(["ab", "etaoin shrdlu.,zqxj", "".join(chr(0x4E00 + i) for i in range(400)), "\U0001F600xyz "])
        a = "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 50, 199, 200, 201, 600])))
        b = list(a)
        for _ in range(draw.choice([0, 1, 3, 30])):
            at = draw.randrange(len(b) + 1)
            b[at:at + draw.randrange(2)] = draw.choice(letters + "!?")
        b = draw.choice(["".join(b), "".join(b[len(b) // 3:] + b[:len(b) // 3]), a + "".join(b[:5]), a[:-3]])
        for x, y in ((a, b), (b, a)):
            assert feedback_clean.sequence_ratio(x, y) == SequenceMatcher(None, x, y).ratio()


def test_long_near_duplicates_do_not_take_the_square_of_their_length(spark, monkeypatch):
    draw = random.Random(9)
    half = ["".join(chr(0x4E00 + draw.randrange(500)) for _ in range(40000)) for _ in range(2)]

    def refuse(*_):
        raise AssertionError("every two places of a character are compared")

    monkeypatch.setattr(feedback_clean, "SequenceMatcher", refuse)
    assert feedback_clean.sequence_ratio(half[0] + "," + half[1], half[0] + "; " + half[1]) == 2.0 * 80000 / 160003
    # a stretch with the hash of another one is found out, and difflib decides
    monkeypatch.setattr(feedback_clean._Hashed, "windows", lambda self, starts, size: np.zeros(len(starts), np.uint64))
    with pytest.raises(AssertionError):
        feedback_clean.sequence_ratio("x" + half[0], half[0][::-1])


def test_case_folding_is_that_of_python(spark):
    letters = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x110000) if chr(c).lower() != chr(c).casefold()] + ["\u0130\u03a3", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(letters) if t != "\0"], "id int, t string")
    got = df.select("id", feedback_clean.case_folded("t").alias("f")).collect()
    assert all(r["f"] == (None if letters[r["id"]] is None else letters[r["id"]].casefold()) for r in got)


def test_cleaning_steps_are_evaluated_once(spark):
    df = spark.createDataFrame([(1, "  Fine \t place\n  here \x02 ", "bad")], "id int, review_text string, rating string")
    rows = feedback_clean.clean_rows(df, feedback_clean.detect_mapping(df.columns)).withColumn("f", feedback_clean.case_folded("cleaned_text"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[ \\t\\r]+") == 1 and plan.count("\\s+\\z") == 1
    row = rows.first()
    assert row["f"] == "fine place\nhere" and row["_warnings"] == ["invisible_control_characters_removed", "whitespace_normalized", "invalid_numeric:rating"]


def test_steps_skip_only_texts_that_they_leave_alone(spark):
    """Each step by a plain rule on every text, whatever the look that spares it."""
    draw = random.Random(17)
    letters = ["a", "B", "ß", "é", "İ", "ﬁ", "Ã©", "😊", " ", "  ", "\t", "\r", "\n", "\n ", "\0", "\x01", "\x0b", "\x0c", "\x1c", "\x7f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000"]
    texts = ["".join(draw.choices(letters, k=draw.randrange(1, 9))) for _ in range(1500)] + letters + ["", " ", "x" * 200, "ok \x01", "\x01 ok"]
    blank = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for row in feedback_clean.cleaned_text(df, "t").withColumn("f", feedback_clean.case_folded("cleaned_text")).collect():
        composed = unicodedata.normalize("NFKC", texts[row["id"]])
        mended = feedback_clean._repaired(composed)
        bare = mended.replace("\0", "")
        visible = re.sub(r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "", bare)
        clean = re.sub(rf"\A{blank}|{blank}\Z", "", re.sub(r"\n +", "\n", re.sub(r"[ \t\r]+", " ", visible)))
        steps = [(composed, mended, "encoding_repaired"), (mended, bare, "null_bytes_removed"),
                 (bare, visible, "invisible_control_characters_removed"), (visible, clean, "whitespace_normalized")]
        assert (row["cleaned_text"], row["f"]) == (clean, clean.casefold())
        assert row["_warnings"] == [w for old, new, w in steps if old != new] + ["empty_text"] * (clean == "")


def test_ascii_texts_are_not_sent_to_python(spark, monkeypatch):
    kind, given = feedback_clean.unicode_text.returnType, feedback_clean.unicode_text.func

    @F.pandas_udf(kind)
    def strict(values: pd.Series) -> pd.DataFrame:
        assert not any(v is not None and v.isascii() for v in values)
        return given(values)

    monkeypatch.setattr(feedback_clean, "unicode_text", strict)
    df = spark.createDataFrame([("Plain  text",), ("Broken letter Ã©",), (None,)], "feedback string")
    rows = feedback_clean.cleaned_text(df, "feedback").collect()
    assert [r["cleaned_text"] for r in rows] == ["Plain text", "Broken letter é", ""]
    assert [r["_warnings"] for r in rows] == [["whitespace_normalized"], ["encoding_repaired"], ["missing_text"]]


def test_texts_without_copies_are_not_sent_for_those_with(spark, monkeypatch):
    """Rows hold the text once, and the few keys with copies are broadcast to them by their stored size."""
    kept, plans = {}, {}
    write = feedback_clean.stored

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(feedback_clean, "stored", recorded)
    long = "Much said " * 30
    texts = [f"{i} alone " + "long " * 40 for i in range(50)] + [long + "STRASSE", long + "straße", long + "end!", long + "end", "Twice", "twice"]
    out = feedback_clean.duplicate_columns(spark.createDataFrame([(t,) for t in texts], "cleaned_text string")).collect()
    assert sorted((r["cleaned_text"][-6:], r["duplicate_type"], r["duplicate_group_id"]) for r in out if r["is_duplicate"]) == [
        ("TRASSE", "exact", "duplicate-1"), ("Twice", "exact", "duplicate-2"), ("d end!", "near_duplicate", "duplicate-3"),
        ("id end", "near_duplicate", "duplicate-3"), ("straße", "exact", "duplicate-1"), ("twice", "exact", "duplicate-2")]
    assert kept["feedback-keys"].columns == ["cleaned_text", "_key", "_near"]
    assert "SortMergeJoin" not in plans["feedback-texts"] and "BroadcastHashJoin" in plans["feedback-texts"]


def test_status_does_not_carry_the_texts(spark):
    """After the duplicate search, warnings and status need no text."""
    df = spark.createDataFrame([("Plain text", "5"), (" N/A ", "bad"), ("", "1"), ("plain TEXT", "2"), ("nonexistent", "3")], "feedback string, rating string")
    out = feedback_clean.clean_feedback(df)
    status = out.select("quality_warnings", "quality_status")
    assert "cleaned_text" not in status._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in status.collect()) == [
        ("", "accepted"), ("empty_text", "rejected"), ("exact_duplicate", "accepted_with_warning"), ("exact_duplicate", "accepted_with_warning"),
        ("whitespace_normalized;missing_text;invalid_numeric:rating", "rejected")]
    assert not [c for c in out.columns if c.startswith("_")]


def test_placeholders_by_plain_rule(spark):
    texts = list(feedback_clean.PLACEHOLDERS) + ["N/A", "  NULL  ", "   None", "nones", "n a", "-", "---", "", "İ", "niİ", "NA\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("t", feedback_clean.is_placeholder(F.col("t")).alias("p")).collect():
        assert r["p"] == (None if r["t"] is None else r["t"].lower().strip(" ") in feedback_clean.PLACEHOLDERS)


def test_only_texts_with_copies_are_fetched(spark, monkeypatch):
    kept = {}
    write = feedback_clean.stored

    def recorded(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(feedback_clean, "stored", recorded)
    texts = [f"{i} alone " + "long " * 40 for i in range(50)] + ["Twice", "twice", "Near!", "near", "...", "!!!", "...", None, ""]
    out = feedback_clean.duplicate_columns(spark.createDataFrame([(t,) for t in texts], "cleaned_text string")).collect()
    assert sorted((r["cleaned_text"], r["duplicate_type"], r["duplicate_group_id"]) for r in out if r["is_duplicate"]) == [
        ("...", "exact", "duplicate-1"), ("...", "exact", "duplicate-1"), ("Near!", "near_duplicate", "duplicate-3"),
        ("Twice", "exact", "duplicate-2"), ("near", "near_duplicate", "duplicate-3"), ("twice", "exact", "duplicate-2")]
    assert len(out) == len(texts) and sorted(r["_folded"] for r in kept["feedback-texts"].collect()) == ["...", "near", "near!", "twice"]
    assert "_folded" not in kept["feedback-counts"].columns


def test_texts_meet_hashes_of_keys_where_the_keys_are_too_large(spark, monkeypatch):
    plans, write = {}, feedback_clean.stored

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        made = write(df, name)
        if name == "feedback-wanted":  # too large to be broadcast, as with many copies
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(sum(Path(f.removeprefix("file://")).stat().st_size for f in made.inputFiles()) // 2))
        return made

    monkeypatch.setattr(feedback_clean, "stored", recorded)
    texts = [f"{i // 2} told " + "long " * 40 for i in range(40)] + ["alone " * 30]
    try:
        out = feedback_clean.duplicate_columns(spark.createDataFrame([(t,) for t in texts], "cleaned_text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["is_duplicate"] for r in out) == 40 and len({r["duplicate_group_id"] for r in out}) == 21
    assert "LeftSemi" in plans["feedback-texts"] and "BroadcastHashJoin" in plans["feedback-texts"]


def test_near_duplicates_are_flagged_without_deletion(spark):
    out = _clean(spark, [("The ramp is steep",), ("The ramp is steep!",), ("The ramp is icy",)], "feedback string")
    assert out.count() == 3 and out.where("duplicate_type = 'near_duplicate'").count() == 2


def test_exact_copies_hide_from_near_search(spark):
    out = _clean(spark, [("A!",), ("A!",), ("A.",)], "feedback string").orderBy("cleaned_text").collect()
    assert [r["duplicate_type"] for r in out] == ["exact", "exact", None]


def test_column_detection():
    found = feedback_clean.detect_mapping(["  COMMENT  ", "feedback_text"])
    assert found.text == "feedback_text" and found.candidates == ("feedback_text", "  COMMENT  ") and found.date is None
    with pytest.raises(feedback_clean.FeedbackInputError):
        feedback_clean.detect_mapping(["department", "rating"])


ASPECTS = {
    "heating dies on cold nights": "Heating", "parking lot needs attention": "Parking Lot", "not enough shaded benches": "Shaded Benches",
    "too many broken lamps": "Broken Lamps", "rents are too high": "Rents", "gate doesnt work at night": "Gate",
    "old scanner isnt working again": "Old Scanner", "pool closes too early": "Pool", "intercom hardly works": "Intercom",
}
LABELS = {
    "The pool is open after noon.": "Neutral", "Yoga runs from 9 to 11.": "Neutral", "The key is available at the desk.": "Neutral",
    "okay": "Neutral", "fine": "Neutral", "average": "Neutral", "nothing special": "Neutral", "not bad": "Positive", "not good": "Negative",
    "heating dies on cold nights": "Negative", "evening yoga is really great": "Positive",
    "The garden is great but the noise is awful.": "Mixed",
}


def test_label_and_aspect_tables(spark):
    texts = list(LABELS) + [t for t in ASPECTS if t not in LABELS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, cleaned_text string")
    rows = {r["cleaned_text"]: r for r in enrich.enrich_feedback(df, "id").collect()}
    assert {t: rows[t]["sentiment"] for t in LABELS} == LABELS
    for text, aspect in ASPECTS.items():
        assert rows[text]["sentiment"] == "Negative" and rows[text]["aspect_sentiments"][0]["aspect"].startswith(aspect)
    assert any("Yoga" in t for t in rows["evening yoga is really great"]["topics"])
    assert "attention" in " ".join(rows["parking lot needs attention"]["keywords"])


def test_phrase_choice_equals_a_plain_loop(spark):
    draw = random.Random(6)
    pool = ["pool", "pool heating", "heating", "late bus", "bus", "service", "late bus stop", "garden", "issue", "bus stop sign"]
    rows = []
    for i in range(60):
        found = draw.sample(pool, draw.randrange(len(pool)))
        rows.append((i, found, {t: draw.choice([0.1, 0.3, 0.3, 0.7]) for t in draw.sample(pool + ["stop", "sign"], 5)}))

    def plain(found, table, topics):
        known = [p for p in found if p in table or any(w in table for w in p.split())]
        ranked = sorted(known, key=lambda p: -max(table.get(w, 0.0) for w in p.split()) * len(p.split()))
        kept = []
        for p in ranked:
            if len(kept) < (2 if topics else 5) and not (topics and p.split()[-1] in terms.NON_TOPIC_TERMS) and not any(p in k or k in p for k in kept):
                kept.append(p)
        return kept

    df = spark.createDataFrame(rows, "id int, c array<string>, w map<string,double>")
    keywords, topics = enrich.pick_phrases(F.col("c"), F.col("w"))
    for r in df.select("id", keywords.alias("k"), topics.alias("t")).collect():
        _, found, table = rows[r["id"]]
        assert (r["k"], r["t"]) == (plain(found, table, False), plain(found, table, True))


def test_rows_without_text_have_no_duplicates(spark):
    out = _clean(spark, [("same text",), ("same text",), (None,), (None,), ("",), ("same, text",), ("other",)], "feedback string")
    assert sorted((r["feedback"] or "", r["duplicate_type"] or "") for r in out.collect()) == [
        ("", "")] * 3 + [("other", ""), ("same text", "exact"), ("same text", "exact"), ("same, text", "")]


def test_model_output_is_corrected(spark):
    df = spark.createDataFrame([("okay", "Positive", 0.99, 0.9, 0.1), ("rents are too high", "Positive", 0.6, 0.6, 0.9)], "t string, l string, c double, p double, m double")
    rows = {r["t"]: r for r in enrich.corrected_sentiment_columns(df, "t", "l", "c", "p", "m").collect()}
    assert rows["okay"]["sentiment"] == "Neutral" and rows["rents are too high"]["sentiment"] == "Negative"


def test_merging_matches_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 4))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want: dict[int, int] = {}
    for i in range(len(unit)):
        if i not in want:
            want.update({int(j): i for j in np.where(unit @ unit[i] >= 0.84)[0]})
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "position long, vector array<double>")
    got = {r["position"]: r["representative"] for r in enrich.merge_phrases(df, block=16).collect()}
    assert got == want


RECORD = ("FB001", "The campus Wi-Fi is down and all students are offline.", "The campus Wi-Fi is down and all students are offline.", "Negative", 0.95, 0.95, ["Wi-Fi"],
          ["campus", "down", "students"], "Frustration", [("Wi-Fi", "Negative")])
RECORD_SCHEMA = ("feedback_id string, feedback string, cleaned_text string, sentiment string, sentiment_score double, sentiment_confidence double, "
                 "topics array<string>, keywords array<string>, emotion string, aspect_sentiments array<struct<aspect:string,sentiment:string>>")


def test_triage_of_one_record(spark):
    row = triage.triage(spark.createDataFrame([RECORD], RECORD_SCHEMA)).first()
    assert (row["severity"], row["priority"], row["department"]) == ("CRITICAL", "P1", "IT")
    assert (row["impact_level"], row["action"], row["validation_status"]) == ("CAMPUS_WIDE", "IMMEDIATE_ESCALATION", "VALID")


def test_contradictions_are_invalid(spark):
    base = triage.triage(spark.createDataFrame([RECORD], RECORD_SCHEMA))
    row = triage.validate_decision(base.withColumn("priority", F.lit("P4")).withColumn("action", F.lit("MONITOR")).drop("validation_errors")).first()
    assert row["validation_status"] == "INVALID" and len(row["validation_errors"]) == 3


def test_insights_on_sparse_tables(spark):
    empty = spark.createDataFrame([], "feedback string")
    assert insights.dataset_summary(empty).first()["row_count"] == 0
    assert insights.hotspots(empty).count() == 0 and insights.top_listed(empty, "topics").count() == 0
    mixed = spark.createDataFrame([('["a","b"]',), ("plain",), (None,)], "topics string")
    assert {r["value"] for r in insights.top_listed(mixed, "topics").collect()} == {"a", "b", "plain"}


def test_streams_use_the_same_steps(spark, tmp_path):
    spark.createDataFrame([("The wifi is down now",), ("N/A",)], "feedback string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("feedback string").json(str(tmp_path / "in"))
    out = triaged_stream(cleaned_stream(stream))
    query = out.writeStream.format("memory").queryName("triaged").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    rows = {r["feedback"]: r for r in spark.table("triaged").collect()}
    assert rows["N/A"]["quality_status"] == "rejected" and rows["The wifi is down now"]["sentiment"] == "Neutral"


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tval \n1\t2\n")
    assert read_table(spark, str(tmp_path / "a.tsv")).columns == ["id", "val"]
    assert clean_names([" a", "a ", "b"]) == ["a", "a_1", "b"]
    (tmp_path / "f.csv").write_bytes("feedback,note\n\"café\",\n".encode("cp1252"))
    assert read_feedback_csv(spark, str(tmp_path / "f.csv")).first().asDict() == {"feedback": "café", "note": ""}
    write_csv(spark.createDataFrame([], "a string, b array<int>"), str(tmp_path / "empty"))
    assert spark.read.option("header", True).csv(str(tmp_path / "empty")).columns == ["a", "b"]


@pytest.mark.parametrize("limit", ["10m", "1b"])
def test_whole_texts_are_sent_once_to_be_found_and_once_to_be_compared(spark, monkeypatch, limit):
    """Groups take their characters from one member, and texts meet hashes only where these are broadcast."""
    plans, write = {}, feedback_clean.stored
    monkeypatch.setattr(feedback_clean, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(df, name))
    texts = [f"{i // 3} told " + "long " * 40 + "!" * (i % 3) for i in range(60)] + ["alone " * 30, "twice " * 30, "twice " * 30]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        out = feedback_clean.duplicate_columns(spark.createDataFrame([(t,) for t in texts], "cleaned_text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = {r["cleaned_text"]: r["duplicate_group_id"] for r in out if r["is_duplicate"]}
    bare = sorted({re.sub(r"\W", "", t) for t in texts[:60]})
    assert found == {t: f"duplicate-{bare.index(re.sub(r'\W', '', t)) + 2}" for t in texts[:60]} | {texts[-1]: "duplicate-1"}
    assert "Exchange" not in plans["feedback-groups"] and ("LeftSemi" in plans["feedback-texts"]) == (limit == "10m")
    assert plans["feedback-texts"].count("Exchange hashpartitioning(_key") <= 2  # the texts and the keys
