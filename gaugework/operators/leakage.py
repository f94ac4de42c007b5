"""Target leakage and train/test contamination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import families, present, ref, text_key, whole_text
from gaugework.functions.numeric import rounded
from gaugework.operators import findings as fd
from gaugework.operators.lineage import settled, stored
from gaugework.operators.ordered import _stacked, running_totals
from gaugework.options import Thresholds

# Name fragments of columns that are usually filled after the outcome.
POST_EVENT_NAME = (
    r"(?i)(refund|cancel|discharge|churn_date|exit_date|closed_date|payout|payout_date|post_|after_"
    r"|resolution|approved_date|end_date)"
)
# Names of split columns.
SPLIT_NAMES = ("split", "dataset_split", "is_train", "partition", "fold")
TREE_DEPTH = 3
LEAST_ROWS = 20


def _target_value(df: DataFrame, target: str):
    kind = families(df, [target])[target]
    if kind in ("integer", "float", "boolean"):
        return present(target, kind).cast("double"), True
    return whole_text(target, kind), False


def _ranks_per_value(df: DataFrame, features: list[str], target: str, binary: bool, squares: bool = False) -> tuple[DataFrame, set[str]]:
    """(column, number, text, n, sy, yy per value of every feature, stored; which of number and text occur).

    Ranks of the target hold for the rows that have the feature. One ordered pass over the target's distinct values with one
    count per feature gives them all; rows take them by one join on the target, before they are unpivoted, and are summed
    per feature value (count, sum and sum of squares of the target's rank). So no table of value pairs exists. Ranks are
    centred on the mean rank, which keeps the sums well conditioned. ``squares`` adds s and q, the sums of a numeric target
    and of its squares, to the same rows.
    """
    kinds = families(df, features)
    y, _ = _target_value(df, target)
    numeric = [k in ("integer", "float") for k in kinds.values()]
    values = [present(c, k).cast("double") if n else whole_text(c, k) for (c, k), n in zip(kinds.items(), numeric)]
    narrow = df.select(y.alias("y"), *[v.alias(f"x{i}") for i, v in enumerate(values)]).where("y IS NOT NULL")
    counts = narrow.groupBy("y").agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(values))])
    placed = running_totals(counts.withColumn("_one", F.lit(1)), ["_one"], "y", [f"n{i}" for i in range(len(values))])
    ranks = placed.selectExpr("y AS at", *[f"cum_n{i} - (n{i} - 1) / 2.0D - (all_n{i} + 1) / 2.0D AS r{i}" for i in range(len(values))])
    # two rows where the target is binary
    ranked = narrow.join(F.broadcast(ranks) if binary else ranks, F.col("y") == F.col("at"))
    none = {True: F.lit(None).cast("string"), False: F.lit(None).cast("double")}
    slots = [
        F.struct(F.lit(c).alias("column"), *(a.alias(name) for a, name in zip((F.col(f"x{i}"), none[n]) if n else (none[n], F.col(f"x{i}")), ("number", "text"))),
                 F.col(f"r{i}").alias("r"))
        for i, (c, n) in enumerate(zip(kinds, numeric))
    ]
    kept = [F.col("y")] if squares else []
    long = ranked.select(*kept, F.inline(F.array(*slots))).where("number IS NOT NULL OR text IS NOT NULL")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("r").alias("sy"), F.sum(F.col("r") * F.col("r")).alias("yy")]
    if squares:
        sums += [F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")]
    per_value = stored(long.groupBy("column", "number", "text").agg(*sums), "ranks-per-value")
    return per_value, {"number" if n else "text" for n in numeric}


def _ordered_values(per_value: DataFrame, kinds: set[str], sums: list[str]) -> DataFrame:
    """The values of every feature with running sums, numbers by size and texts by their bytes; the values themselves are left out."""
    kept = [c for c in per_value.columns if c not in ("column", "number", "text")]
    parts = [
        running_totals(per_value.where(f"{kind} IS NOT NULL").select("column", F.col(kind).alias("x"), *kept), ["column"], "x", sums).drop("x")
        for kind in sorted(kinds)
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _rank_correlation(ordered: DataFrame) -> DataFrame:
    """column, n, spearman from the features' values in order."""
    w, a = F.col("n").cast("double"), F.col("cum_n") - (F.col("n") - 1) / 2.0 - (F.col("all_n") + 1) / 2.0
    sums = ordered.groupBy("column").agg(
        F.max("all_n").alias("rows"), F.sum(a * F.col("sy")).alias("xy"), F.sum(w * a * a).alias("xx"), F.sum("yy").alias("yy"))
    norm = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
    return sums.where(F.col("rows") >= LEAST_ROWS).select(
        "column", F.col("rows").alias("n"), F.when(norm > 0, F.col("xy") / norm).otherwise(F.lit(0.0)).alias("spearman"))


def spearman(df: DataFrame, features: list[str], target: str, binary: bool) -> DataFrame:
    """column, n, spearman with average-rank ties; texts rank in byte order of the whole text."""
    return _rank_correlation(_ordered_values(*_ranks_per_value(df, features, target, binary), ["n"]))


def regression_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """column, metric, score, spearman against a numeric target.

    Trees and rank correlation read the same values in order: rows are unpivoted and counted once for both, and ordered once.
    """
    ordered = _ordered_values(*_ranks_per_value(df, features, target, False, squares=True), ["n", "s", "q"])
    placed = stored(ordered.where(F.col("all_n") >= LEAST_ROWS), "placed-values")
    trees = _tree_scores(placed.withColumnsRenamed({"n": "w", "cum_n": "cum_w", "all_n": "all_w"}), False)
    # broadcast: one row per feature
    return trees.drop("spearman").join(F.broadcast(_rank_correlation(placed).drop("n")), "column")


def _with_leaves(placed: DataFrame) -> DataFrame:
    """One row per (column, leaf) of the best depth-``TREE_DEPTH`` tree over all thresholds: w, s, q.

    ``placed`` has the running sums of each distinct value. Within a node, which is a run of values, running sums are
    those of the column less what lies before the node; the best threshold is a grouped maximum of the gain, the first
    of equals. Nodes are pure or deep enough, or they are split; there are at most 2**TREE_DEPTH per column.
    """
    whole = placed.groupBy("column").agg(F.max("all_w").alias("w"), F.max("all_s").alias("s"), F.max("all_q").alias("q"))
    nodes = whole.select(
        "column", F.lit(0).cast("long").alias("low"), F.col("w").cast("long").alias("high"), F.lit(0.0).alias("s0"), F.lit(0.0).alias("q0"), "s", "q"
    )
    for _ in range(TREE_DEPTH):
        # broadcast: a few rows per column
        inside = placed.join(F.broadcast(nodes.select("column", "low", "high", "s0", F.col("s").alias("ns"), F.col("q").alias("nq"))), "column").where(
            (F.col("cum_w") > F.col("low")) & (F.col("cum_w") < F.col("high")))
        cw, nw = F.col("cum_w") - F.col("low"), F.col("high") - F.col("low")
        cs = F.col("cum_s") - F.col("s0")
        impure = F.col("nq") - F.col("ns") * F.col("ns") / nw
        # guarded, as a filter on the gain may be evaluated before the one on the place
        gain = F.when((cw > 0) & (cw < nw), cs * cs / cw + (F.col("ns") - cs) * (F.col("ns") - cs) / (nw - cw))
        tried = inside.where(impure > 1e-12 * F.greatest(F.lit(1.0), F.col("nq"))).withColumn("gain", gain)
        # a plain maximum is hashed; only rows that round to the same gain as the best are then compared and sorted
        best = tried.groupBy("column", "low").agg(F.max("gain").alias("best"))
        equals = tried.join(F.broadcast(best), ["column", "low"]).where(
            (F.col("gain") >= F.col("best") - 2e-9) & (F.round("gain", 9) == F.round("best", 9)))
        cuts = equals.groupBy("column", "low").agg(
            F.min_by(F.struct(F.col("cum_w").alias("at"), F.col("cum_s").alias("s"), F.col("cum_q").alias("q")), "cum_w").alias("cut"))
        split = nodes.join(F.broadcast(cuts), ["column", "low"], "left")
        left = F.struct(
            F.col("low").alias("low"), F.coalesce("cut.at", "high").cast("long").alias("high"), F.col("s0").alias("s0"), F.col("q0").alias("q0"),
            F.coalesce(F.col("cut.s") - F.col("s0"), "s").alias("s"), F.coalesce(F.col("cut.q") - F.col("q0"), "q").alias("q"))
        right = F.when(F.col("cut").isNotNull(), F.struct(
            F.col("cut.at").cast("long").alias("low"), F.col("high").alias("high"), F.col("cut.s").alias("s0"), F.col("cut.q").alias("q0"),
            (F.col("s") + F.col("s0") - F.col("cut.s")).alias("s"), (F.col("q") + F.col("q0") - F.col("cut.q")).alias("q")))
        nodes = settled(split.select("column", F.explode(F.array_compact(F.array(left, right))).alias("n")).select("column", "n.*"))
    return nodes.select("column", (F.col("high") - F.col("low")).cast("double").alias("w"), "s", "q")


def _score_leaves(leaves: pd.DataFrame, binary: bool) -> float | None:
    """AUC (binary target) or R-squared of a tree from its leaves."""
    w, s, q = (leaves[c].to_numpy(float) for c in ("w", "s", "q"))
    if binary:
        pos, neg = s, w - s
        if pos.sum() == 0 or neg.sum() == 0:
            return None
        rate = np.round(s / w, 12)
        order = np.unique(rate, return_inverse=True)[1]
        p, n = np.bincount(order, pos), np.bincount(order, neg)
        auc = float((p * (np.cumsum(n) - n / 2)).sum() / (p.sum() * n.sum()))
        return max(auc, 1 - auc)
    spread = q.sum() - s.sum() ** 2 / w.sum()
    return float(1 - (q - s ** 2 / w).sum() / spread) if spread > 0 else None


def _coded_target(df: DataFrame, target: str, binary: bool) -> Column:
    """The target as a number; the larger of two values is 1 (a one-row lookup)."""
    y, numeric = _target_value(df, target)
    if not binary:
        return y
    top = df.select(y.alias("y")).agg(F.max("y").alias("top")).first()["top"]
    return F.when(y.isNotNull(), (y == F.lit(top)).cast("double"))


def _tree_scores(placed: DataFrame, binary: bool) -> DataFrame:
    """column, metric, score, spearman (binary target only) from the stored values in order."""
    metric = "AUC" if binary else "R2"
    rank = F.col("cum_w") - (F.col("w") - 1) / 2.0 - (F.col("all_w") + 1) / 2.0
    sums = placed.groupBy("column").agg(
        F.sum(rank * F.col("s")).alias("xy"), F.sum(F.col("w") * rank * rank).alias("xx"), F.max("all_w").alias("tw"),
        F.max("all_s").alias("ts"), F.max("all_q").alias("tq"))

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.iloc[0]
        norm = np.sqrt(t["xx"] * max(t["tq"] - t["ts"] ** 2 / t["tw"], 0.0))
        rho = (t["xy"] / norm if norm > 0 else 0.0) if binary else None
        return pd.DataFrame({
            "column": [key[0]], "metric": [metric], "score": [_score_leaves(pdf, binary)], "spearman": [rho]})

    # broadcast: one row per feature
    return _with_leaves(placed).join(F.broadcast(sums), "column").groupBy("column").applyInPandas(
        score, "column string, metric string, score double, spearman double")


def single_feature_scores(df: DataFrame, features: list[str], target: str, binary: bool) -> DataFrame:
    """column, metric, score of a depth-3 tree on each feature alone; for a binary target also spearman.

    Every threshold between distinct values is tried, at any number of values. What reaches Python is a tree's leaves,
    eight rows per feature at most. A binary target has only two ranks, so its rank correlation follows from the
    feature's ranks.
    """
    y = _coded_target(df, target, binary).cast("double")
    kinds = families(df, features)
    parts = []
    for numeric in (True, False):
        exprs = {
            c: present(c, k).cast("double") if numeric else whole_text(c, k)
            for c, k in kinds.items() if (k in ("integer", "float")) == numeric
        }
        if not exprs:
            continue
        long = _stacked(df, exprs, [y], "x").where(F.col("_k0").isNotNull())
        per_value = long.groupBy("column", "x").agg(
            F.count(F.lit(1)).alias("w"), F.sum("_k0").alias("s"), F.sum(F.col("_k0") * F.col("_k0")).alias("q"))
        parts.append(running_totals(per_value, ["column"], "x", ["w", "s", "q"]).where(F.col("all_w") >= LEAST_ROWS).drop("x"))
    # the tree reads this table once per level, without the values
    placed = stored(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "placed-values")
    return _tree_scores(placed, binary)


def post_event_names(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, post_event_name: a look at names only."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.withColumn("post_event_name", F.col("column").rlike(POST_EVENT_NAME))


def feature_target_scores(df: DataFrame, features: list[str], target: str, target_type: str) -> DataFrame:
    """column, metric, score, spearman, post_event_name."""
    binary, regression = target_type == "binary_classification", target_type == "regression"
    names = post_event_names(df, features)
    if binary:
        scored = single_feature_scores(df, features, target, True)
    elif regression and _target_value(df, target)[1]:
        scored = regression_scores(df, features, target)
    else:
        scored = spearman(df, features, target, False).select("column", "spearman")
        if regression:
            trees = single_feature_scores(df, features, target, False).drop("spearman")
            scored = scored.join(F.broadcast(trees), "column", "left")
        else:
            scored = scored.withColumn("metric", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    # all tables have one row per feature
    return names.join(F.broadcast(scored), "column", "left").select(
        "column", F.lit("R2" if regression else "AUC").alias("metric"), rounded("score").alias("score"),
        rounded("spearman").alias("spearman"), "post_event_name",
    )


def leakage_rule(scores: DataFrame, classification: bool, limits: Thresholds = Thresholds()) -> DataFrame:
    """Flagged features with the list of reasons; every flag is a suspicion, never a proof."""
    score, size = F.col("score"), F.abs("spearman")
    tree = F.lit(classification) & score.isNotNull()
    strong_tree, weak_tree = tree & (score >= limits.leak_auc_strong), tree & (score >= limits.leak_auc_weak)
    strong_rank, weak_rank = size >= limits.leak_corr_strong, size >= limits.leak_corr_weak
    warned = F.coalesce(weak_tree & ~strong_tree, F.lit(False)) | F.coalesce(weak_rank & ~strong_rank, F.lit(False))
    named = F.col("post_event_name") & (
        warned | F.coalesce(score > 0.80, F.lit(False)) | F.coalesce(size > 0.50, F.lit(False))
    )
    reasons = F.filter(
        F.array(
            F.when(strong_tree, "single_feature_score_very_high").when(weak_tree, "single_feature_score_high"),
            F.when(strong_rank, "rank_correlation_extreme").when(weak_rank, "rank_correlation_high"),
            F.when(named, "post_event_name"),
        ),
        lambda r: r.isNotNull(),
    )
    return scores.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def leakage_findings(
    df: DataFrame, roles: list, target: str, target_type: str, limits: Thresholds = Thresholds()
) -> DataFrame:
    """Findings F-L201...; identifiers and constants are skipped."""
    features = [r["name"] for r in roles if r["name"] != target and not r["is_id"] and not r["is_constant"]]
    if not features:
        return fd.empty(df)
    classification = target_type != "regression"
    positions = df.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(df.columns)], "column string, position int")
    rows = leakage_rule(feature_target_scores(df, features, target, target_type), classification, limits).join(
        F.broadcast(positions), "column")
    name = F.col("column")
    return fd.numbered([fd.finding(
        rows, kind="target_leakage", status="SUSPECTED", severity="WARNING", column=name,
        title=F.concat(F.lit("Possible target leakage in "), name),
        description=F.concat(name, F.lit(" predicts the target suspiciously well: "), F.array_join("reasons", ", ")),
        evidence=fd.evidence(
            single_feature_metric=F.lit("AUC" if classification else "R2"), single_feature_score=F.col("score"),
            correlation_with_target=F.col("spearman"), post_event_name_match=F.col("post_event_name"),
            reasons=F.array_join("reasons", ";"),
        ),
        confidence=0.85, recommendation="Measure the score without this feature.",
        question=F.concat(F.lit("How much of the score rests on "), name, F.lit("?")),
        order=[fd.padded(F.col("position"))],
    )], "F-L", 201)


def first_two_values(df: DataFrame, column: str, order_by: str, nulls_as_text: bool = False) -> list[str]:
    """The first two distinct values of a split column by row key (a two-row collect)."""
    value = ref(column).cast("string")
    if nulls_as_text:
        value = F.coalesce(value, F.lit("nan"))
    seen = df.select(value.alias("v"), ref(order_by).alias("k")).where("v IS NOT NULL").groupBy("v").agg(F.min("k").alias("k"))
    return [r["v"] for r in seen.orderBy("k", "v").limit(2).collect()]


def contamination(
    df: DataFrame, split_column: str, id_column: str, split_values: tuple[str, str]
) -> DataFrame:
    """One row: distinct ids per partition, shared ids, their share of the second partition, 5 samples.

    One map-side combined count per id; nothing is intersected on the driver.
    """
    first, second = split_values
    part = F.coalesce(ref(split_column).cast("string"), F.lit("nan"))
    ids = (
        df.where(part.isin(first, second) & ref(id_column).isNotNull())
        .groupBy(ref(id_column).alias("id"))
        .agg(F.max((part == first).cast("int")).alias("a"), F.max((part == second).cast("int")).alias("b"))
    )
    shared = (F.col("a") == 1) & (F.col("b") == 1)
    totals = ids.agg(
        F.sum("a").alias("first_ids"), F.sum("b").alias("second_ids"),
        F.sum(shared.cast("bigint")).alias("shared_ids"),
    )
    # the report shows five examples: a top-k, not a cut of the result
    examples = ids.where(shared).orderBy("id").limit(5).agg(
        F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("sample_ids"))
    one = F.lit(1)
    return totals.withColumn("_one", one).join(F.broadcast(examples.withColumn("_one", one)), "_one").select(
        F.lit(split_column).alias("split_column"), F.lit(id_column).alias("id_column"), "first_ids", "second_ids",
        F.coalesce("shared_ids", F.lit(0)).alias("shared_ids"),
        F.when(F.col("second_ids") > 0, F.round(F.col("shared_ids") / F.col("second_ids"), 4)).otherwise(F.lit(0.0)).alias("shared_pct"),
        "sample_ids",
    )


def contamination_findings(
    df: DataFrame, roles: list, order_by: str, split_column: str | None = None, id_column: str | None = None
) -> DataFrame:
    """Finding F-C101 when identifiers occur in both partitions."""
    split = split_column if split_column in df.columns else next(
        (c for c in df.columns if c.lower() in SPLIT_NAMES), None)
    key = id_column if id_column in df.columns else next((r["name"] for r in roles if r["is_id"]), None)
    if split is None or key is None:
        return fd.empty(df)
    values = first_two_values(df, split, order_by, nulls_as_text=True)
    if len(values) < 2:
        return fd.empty(df)
    rows = contamination(df, split, key, (values[0], values[1])).where("shared_ids > 0")
    found = fd.finding(
        rows, kind="train_test_contamination", status="SUSPECTED", severity="WARNING", column=F.col("id_column"),
        title=F.concat(F.lit("Identifiers shared by both partitions: "), F.col("id_column")),
        description=F.concat(F.col("shared_ids").cast("string"), F.lit(" identifiers occur in both partitions.")),
        evidence=fd.evidence(
            shared_id_count=F.col("shared_ids"), contamination_pct=F.col("shared_pct"),
            split_column=F.col("split_column"), sample_shared_ids=F.col("sample_ids"),
        ),
        confidence=0.95, recommendation="Split by entity so that no identifier is on both sides.",
        question=F.concat(F.lit("Does splitting by "), F.col("id_column"), F.lit(" change the measured score?")),
    )
    return fd.numbered([found], "F-C", 101)
