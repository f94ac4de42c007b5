"""Rule-based triage of analysed feedback: severity, priority, routing, impact, action, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import once, ref

# Term patterns and required fields.
SAFETY = r"(?i)\b(emergency|danger|unsafe|fire|medical|injur|security threat)\b"
WIDE = r"(?i)\b(campus|everyone|all students|whole college|entire)\b"
URGENT = r"(?i)\b(now|urgent|immediately|cannot access|down|outage)\b"
GROUP = r"(?i)\b(several|many|multiple|students|users|department)\b"
REQUIRED = (
    "feedback", "cleaned_text", "sentiment", "sentiment_score", "sentiment_confidence", "topics",
    "keywords", "emotion", "aspect_sentiments",
)
# Columns of a persisted decision.
DECISION_COLUMNS = (
    "feedback_id", "severity", "severity_reason", "priority", "priority_score", "priority_reason",
    "department", "department_reason", "impact_level", "impact_reason", "action", "action_reason",
    "recommendation", "recommendation_reason", "suggested_next_step", "recommendation_status",
)
# The priorities that go with each severity, and the scores behind them.
ALLOWED_PRIORITIES = {"CRITICAL": ("P1",), "HIGH": ("P1", "P2"), "MEDIUM": ("P2", "P3"), "LOW": ("P3", "P4")}
SEVERITY_SCORES = {"LOW": 0.25, "MEDIUM": 0.5, "HIGH": 0.75, "CRITICAL": 1.0}


@dataclass(frozen=True)
class RoutingProfile:
    """Where feedback goes: an optional category column first, then the first matching term."""

    name: str = "generic"
    category_field: str | None = None
    terms: tuple[tuple[str, str], ...] = ()


# Routing terms of a college, tried in this order.
COLLEGE = RoutingProfile(
    "college", "department", (
        ("wifi", "IT"), ("wi-fi", "IT"), ("network", "IT"), ("internet", "IT"),
        ("computer", "IT"), ("pc", "IT"), ("projector", "IT"),
        ("classroom equipment", "Facilities"), ("lab equipment", "Facilities"),
        ("fans", "Facilities"), ("ac", "Facilities"), ("lift", "Facilities"),
        ("washroom", "Facilities"), ("maintenance", "Facilities"),
        ("library", "Library"), ("placement", "Placement Cell"), ("career", "Placement Cell"),
        ("companies", "Placement Cell"), ("professor", "Academic Affairs"),
        ("faculty", "Academic Affairs"), ("teaching quality", "Academic Affairs"),
        ("attendance", "Academic Affairs"), ("class", "Academic Affairs"),
        ("food", "Cafeteria"), ("canteen", "Cafeteria"), ("price", "Administration"),
        ("billing", "Finance"), ("fee", "Finance"),
    ))


def _listed(df: DataFrame, name: str) -> Column:
    return F.array_join(ref(name), " ") if name in df.columns else F.lit("")


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(ref(name), F.lit("")) if name in df.columns else F.lit("")


def validate_input(df: DataFrame) -> DataFrame:
    """Add validation_errors for required fields that are absent or null."""
    checks = [
        F.lit(f"Missing required field: {c}") if c not in df.columns
        else F.when(ref(c).isNull(), f"Missing required field: {c}") for c in REQUIRED
    ]
    return df.withColumn("validation_errors", F.array_compact(F.array(*checks)))


def triage(df: DataFrame, profile: RoutingProfile = COLLEGE) -> DataFrame:
    """Add the whole decision to each record: column expressions only, so streams work too.

    Records that lack required fields get validation errors and no decision. Priority is derived
    before impact; its bonus applies only where the input already carries an impact level.
    """
    checked = validate_input(df)
    valid = F.size("validation_errors") == 0
    context = F.lower(F.concat_ws(
        " ", _text(df, "feedback"), _text(df, "cleaned_text"), _listed(df, "topics"), _listed(df, "keywords")))
    routing_text = F.lower(F.concat_ws(" ", _text(df, "feedback"), _listed(df, "topics"), _listed(df, "keywords")))
    mood = F.coalesce(ref("sentiment"), F.lit("Neutral")) if "sentiment" in df.columns else F.lit("Neutral")
    made = (
        "severity", "severity_reason", "priority", "priority_score", "priority_reason", "department", "department_reason",
        "category", "category_reason", "impact_level", "impact_reason", "action", "action_reason",
        "recommendation", "recommendation_reason", "suggested_next_step", "recommendation_status",
    )
    given_impact = ref("impact_level") if "impact_level" in df.columns else F.lit(None).cast("string")
    field = profile.category_field
    given_category = ref(field).cast("string") if field and field in df.columns else F.lit(None).cast("string")
    staged = once(checked, _valid=valid, _t=context, _r=routing_text, _mood=mood, _given_impact=given_impact, _given_category=given_category)
    staged = staged.select(*[ref(c) for c in staged.columns if c not in made])
    upset = F.col("_mood").isin("Negative", "Mixed")
    staged = once(staged, _safety=F.col("_t").rlike(SAFETY), _wide=F.col("_t").rlike(WIDE), _urgent=F.col("_t").rlike(URGENT))
    safety, wide, urgent = F.col("_safety"), F.col("_wide"), F.col("_urgent")

    def chosen(rules: list[tuple[Column | None, str, str]]) -> Column:
        """First rule that holds, as (value, reason); the last one has no condition."""
        out = None
        for cond, value, reason in rules:
            pair = F.struct(F.lit(value).alias("value"), F.lit(reason).alias("reason"))
            if cond is None:
                return out.otherwise(pair)
            out = F.when(cond, pair) if out is None else out.when(cond, pair)
        return out

    severity = chosen([
        (safety, "CRITICAL", "The text mentions danger or an emergency."),
        (wide & (urgent | upset), "CRITICAL", "An urgent or negative issue concerns everybody."),
        (urgent, "HIGH", "The wording is urgent."),
        (F.col("_mood") == "Negative", "MEDIUM", "Negative feedback without an emergency."),
        (F.col("_mood") == "Mixed", "MEDIUM", "Mixed feedback with a concern."),
        (None, "LOW", "No sign of danger or disruption."),
    ])
    route = F.when(F.coalesce("_given_category", F.lit("")) != "", F.struct(
        F.col("_given_category").alias("value"), F.lit(f"Taken from column {field}.").alias("reason")))
    for term, category in profile.terms:
        route = route.when(F.contains(F.col("_r"), F.lit(term.lower())), F.struct(
            F.lit(category).alias("value"), F.lit(f"Contains the term {term}.").alias("reason")))
    route = route.otherwise(F.struct(F.lit("General").alias("value"), F.lit("No routing term matched.").alias("reason")))
    staged = once(staged, _sev=severity, _route=route)
    staged = staged.select(
        "*", F.col("_sev.value").alias("severity"), F.col("_sev.reason").alias("severity_reason"),
        F.col("_route.value").alias("department"), F.col("_route.reason").alias("department_reason"))

    score = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_SCORES.items() for x in kv]), F.col("severity"))
    bonus = F.coalesce(F.col("_given_impact").isin("DEPARTMENT_WIDE", "CAMPUS_WIDE"), F.lit(False))
    impact = chosen([
        (wide & upset, "CAMPUS_WIDE", "Everybody is concerned."),
        (F.col("_t").rlike(GROUP), "SMALL_GROUP", "Several people are concerned."),
        (F.col("department").isin("IT", "Facilities") & urgent, "DEPARTMENT_WIDE", "An urgent service issue."),
        (None, "INDIVIDUAL", "One person or nobody in particular is concerned."),
    ])
    staged = once(
        staged, priority_score=F.round(F.least(F.lit(1.0), score + F.when(bonus, 0.1).otherwise(0.0)), 2), _imp=impact)
    staged = staged.select("*", F.col("_imp.value").alias("impact_level"), F.col("_imp.reason").alias("impact_reason"))
    action = chosen([
        ((F.col("severity") == "CRITICAL") & (F.col("impact_level") == "CAMPUS_WIDE"), "IMMEDIATE_ESCALATION", "Critical and wide."),
        (F.col("severity") == "HIGH", "ESCALATE", "High severity goes to the department."),
        (F.col("severity") == "MEDIUM", "CREATE_TASK", "Medium severity becomes a task."),
        (upset, "RESPOND", "A reply suits the concern."),
        (None, "MONITOR", "Low risk is watched."),
    ])
    points = F.col("priority_score")
    staged = once(
        staged, _act=action,
        priority=F.when(points >= 0.9, "P1").when(points >= 0.65, "P2").when(points >= 0.4, "P3").otherwise("P4"))
    words = "lower(replace(_act.value, '_', ' '))"
    decided = {
        "severity": "severity", "severity_reason": "severity_reason", "priority": "priority", "priority_score": "priority_score",
        "priority_reason": "concat('Follows from severity ', severity, '.')", "department": "department",
        "department_reason": "department_reason", "category": "department", "category_reason": "department_reason",
        "impact_level": "impact_level", "impact_reason": "impact_reason", "action": "_act.value", "action_reason": "_act.reason",
        "recommendation": f"concat(initcap({words}), ': ', lower(severity), '-severity issue for ', department, '.')",
        "recommendation_reason": "concat('Severity ', severity, ', priority ', priority, '.')",
        "suggested_next_step": f"concat(department, ' reviews the feedback: ', {words}, '.')",
        "recommendation_status": "'FALLBACK'",
    }
    kept = staged.select(*[ref(c) for c in df.columns if c not in made], "validation_errors", F.struct(
        *[F.expr(f"CASE WHEN _valid THEN {e} END").alias(c) for c, e in decided.items()]).alias("_d"))
    whole = kept.select("*", F.inline(F.array("_d"))).drop("_d")
    return validate_decision(whole)


def validate_decision(df: DataFrame) -> DataFrame:
    """Check the decision columns against each other; adds validation_status and validation_errors."""
    filled = (
        "severity", "priority", "department", "impact_level", "action", "recommendation",
        "recommendation_reason", "suggested_next_step", "recommendation_status",
    )
    before = F.col("validation_errors") if "validation_errors" in df.columns else F.array().cast("array<string>")
    checks = [F.when(F.coalesce(ref(c), F.lit("")) == "", f"Decision field is empty: {c}") for c in filled]
    clash = F.lit(False)
    for severity, allowed in ALLOWED_PRIORITIES.items():
        clash = clash | ((F.col("severity") == severity) & ~F.coalesce(F.col("priority").isin(*allowed), F.lit(False)))
    checks.append(F.when(clash, F.concat(F.lit("Priority "), F.coalesce("priority", F.lit("None")), F.lit(" does not fit severity "), F.col("severity"))))
    checks.append(F.when(
        (F.col("severity") == "CRITICAL") & ~F.coalesce(F.col("action").isin("ESCALATE", "IMMEDIATE_ESCALATION"), F.lit(False)),
        "A critical decision must escalate"))
    checks.append(F.when((F.col("impact_level") == "CAMPUS_WIDE") & (F.col("action") == "MONITOR"), "A campus-wide decision must not be MONITOR"))
    found = F.when(F.size(before) > 0, before).otherwise(F.array_compact(F.array(*checks)))
    plain = df.select(*[ref(c) for c in df.columns if c not in ("validation_errors", "validation_status")], found.alias("_found"))
    return once(plain, validation_errors=F.col("_found")).select(
        *[ref(c) for c in plain.columns if c != "_found"], "validation_errors",
        F.when(F.size("validation_errors") > 0, "INVALID").otherwise("VALID").alias("validation_status"))


def final_decisions(triaged: DataFrame) -> DataFrame:
    """Valid decisions with the persisted columns only."""
    present = [c for c in DECISION_COLUMNS if c in triaged.columns]
    return triaged.where("validation_status = 'VALID'").select(*present)
