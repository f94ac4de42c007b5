"""Deterministic audit views over the supplied tables.

Each view is one list of ``(name, expression)`` pairs written in the SQL that Spark and DuckDB share,
so the DataFrame side and the check SQL read exactly the same data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"

ORDERS = [
    ("order_id", "o_orderkey"),
    ("customer_id", "o_custkey"),
    ("segment", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_mktsegment END"),
    ("balance", "c_acctbal"),
    ("total_price", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"),
    ("income_score", f"CASE WHEN {_URGENT} AND o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice / 100 + o_custkey % 13 END"),
    ("tail_amount", "CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice * 40 ELSE o_totalprice END"),
    ("order_status", "o_orderstatus"),
    ("order_date", "o_orderdate"),
    ("split", "CASE WHEN o_orderkey % 10 < 7 THEN 'train' ELSE 'test' END"),
    ("refund_flag", f"CASE WHEN o_orderkey % 50 = 0 THEN CASE WHEN {_URGENT} THEN 0 ELSE 1 END ELSE CASE WHEN {_URGENT} THEN 1 ELSE 0 END END"),
    ("region_tag", "CASE WHEN o_orderkey > 0 THEN 'all' ELSE 'all' END"),
    ("urgent", f"CASE WHEN {_URGENT} THEN 1 ELSE 0 END"),
]
LINEITEM = [
    ("line_key", "l_orderkey * 8 + l_linenumber"),
    ("quantity", "l_quantity"),
    ("extended_price", "l_extendedprice"),
    ("discount", "l_discount"),
    ("tax", "l_tax"),
    ("return_flag", "l_returnflag"),
    ("line_status", "l_linestatus"),
    ("ship_date", "l_shipdate"),
    ("net_price", "l_extendedprice * (1 - l_discount)"),
]
EVENTS = [
    ("event_id", "event_id"),
    ("ts", "ts"),
    ("user_id", "user_id"),
    ("event_type", "event_type"),
    ("value", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END"),
    ("shifted", "CASE WHEN ts >= TIMESTAMP '2024-01-20 00:00:00' THEN value * 2 + 15 ELSE value END"),
    ("channel", "CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' AND event_id % 3 <> 0 THEN 'app' WHEN event_id % 2 = 0 THEN 'web' ELSE 'store' END"),
]
# Sentences of the templated feedback view.
FEEDBACK_SENTENCES = [
    "The wifi is down in the library and nobody can study",
    "teaching quality is actually great",
    "The library is great but the food is terrible.",
    "the pool area needs maintenance",
    "Yoga runs from 9 to 11 on weekdays.",
    "rents are too high",
    "The old projector isnt working again",
    "not bad",
    "Emergency exit blocked, this is unsafe for everyone",
    "okay",
    "Many students cannot access the internet now",
    "Placement team was helpful and supportive 😊",
]


def _templated() -> str:
    cases = " ".join(
        f"WHEN {i} THEN '{s}'" for i, s in enumerate(FEEDBACK_SENTENCES)
    )
    return f"CASE event_id % {len(FEEDBACK_SENTENCES)} {cases} END"


FEEDBACK = [
    ("feedback_id", "event_id"),
    ("feedback", _templated()),
    ("department", "CASE WHEN user_id % 5 = 0 THEN 'IT' WHEN user_id % 5 = 1 THEN 'Facilities' ELSE NULL END"),
    ("date", "ts"),
]
REVIEWS = [
    ("doc_id", "doc_id"),
    ("review_text",
     "CASE WHEN doc_id % 17 = 0 THEN 'N/A' WHEN doc_id % 19 = 0 THEN '   ' WHEN doc_id % 23 = 0 THEN NULL "
     "WHEN doc_id % 5 = 0 THEN concat('Late parcel ', CAST(doc_id % 40 AS VARCHAR(20))) "
     "WHEN doc_id % 7 = 0 THEN concat('Good  service ', CAST(doc_id AS VARCHAR(20)), ' !') ELSE text END"),
    ("created_at",
     "CASE WHEN doc_id % 4 = 0 THEN '2026-09-01' WHEN doc_id % 4 = 1 THEN '05/11/2025' "
     "WHEN doc_id % 4 = 2 THEN 'not-a-date' ELSE '' END"),
    ("category", "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('  ', source, '  desk ') END"),
    ("rating",
     "CASE WHEN doc_id % 3 = 0 THEN '$1,200' WHEN doc_id % 3 = 1 THEN 'bad' ELSE '45%' END"),
]
LABELLED = [
    ("doc_id", "d.doc_id"),
    ("lang", "CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE d.lang END"),
    ("source", "d.source"),
    ("length_score", "d.n_chars"),
    ("truth", "l.quality"),
    ("prediction", "CASE WHEN d.lang = 'en' THEN 1 - l.quality ELSE l.quality END"),
    ("amount", "CAST(d.n_chars AS DOUBLE) / 10"),
    ("estimate", "CAST(d.n_chars AS DOUBLE) / 10 + CASE WHEN d.lang = 'en' THEN 60 ELSE 4 END"),
]

_SOURCES = {
    "orders_audit": (ORDERS, "orders JOIN customer ON o_custkey = c_custkey"),
    "lineitem_audit": (LINEITEM, "lineitem"),
    "events_audit": (EVENTS, "events"),
    "feedback_audit": (FEEDBACK, "events"),
    "reviews_audit": (REVIEWS, "documents"),
    "labelled_audit": (LABELLED, "documents d JOIN labels l ON d.doc_id = l.doc_id"),
}


def sql(name: str) -> str:
    """The view as a query over the base tables."""
    columns, source = _SOURCES[name]
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns) + f" FROM {source}"


def cte(*names: str) -> str:
    """``WITH`` clause that defines the named views for the check SQL."""
    return "WITH " + ", ".join(f"{n} AS ({sql(n)})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the parquet tables."""
    columns, _ = _SOURCES[name]
    exprs = [f"{e} AS {n}" for n, e in columns]
    if name == "orders_audit":
        joined = table(spark, sf_dir, "orders").join(
            table(spark, sf_dir, "customer"), on=_equal("o_custkey", "c_custkey")
        )
        return joined.selectExpr(*exprs)
    if name == "labelled_audit":
        docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").alias("d")
        return docs.join(table(spark, sf_dir, "labels").alias("l"), on=_equal("d.doc_id", "l.doc_id")).selectExpr(*exprs)
    base = {"lineitem_audit": "lineitem", "reviews_audit": "documents"}.get(name, "events")
    return table(spark, sf_dir, base).selectExpr(*exprs)


def _equal(left: str, right: str):
    from pyspark.sql import functions as F

    return F.col(left) == F.col(right)
