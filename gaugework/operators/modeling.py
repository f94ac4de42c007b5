"""Cross-validated random forests: folds, fold-isolated preparation, metrics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import KEY_HEAD, families, present, quoted, ref
from gaugework.functions.numeric import rounded
from gaugework.operators import forests
from gaugework.operators.lineage import stored
from gaugework.operators.ordered import interpolated_quantiles, running_totals, value_counts
from gaugework.operators.semantic import parsed_datetime
from gaugework.operators.profile import NUMERIC, quantiles

# The model, the seed, the fold limit and the clipping percentiles.
TREES, DEPTH, LEAF, SEED, FOLDS = 50, 6, 2, 42, 5
CLIP = (0.01, 0.99)
MISSING = "MISSING"
# A tree tells as many ranges of equally many rows apart, and each value that fills one by itself.
BINS = 32


def fold_count(rows: int, wanted: int = FOLDS) -> int:
    return min(wanted, max(2, rows // 10))


def stratified_folds(df: DataFrame, target: str, key: str, k: int, seed: int = SEED) -> DataFrame:
    """Add ``fold``: rows of each class are dealt to the folds in hash order of the row key.

    The place of a row within its class is a local row number plus the sizes of the hash ranges
    before it. Hash ranges are even by construction, so a class that holds most rows is still spread
    over all tasks.
    """
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), ref(key))).withColumn(
        "_range", F.expr(f"CAST(floor((_h / 18446744073709551616.0D + 0.5D) * {ranges}) AS int)")
    ).withColumn("_y", ref(target).cast("string"))
    sizes = hashed.groupBy("_y", "_range").agg(F.expr("count(1) AS _size"))
    before = Window.partitionBy("_y").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # broadcast candidate: classes x ranges rows, left to the measured size
    offsets = sizes.select(F.col("_y").alias("_oy"), F.col("_range").alias("_or"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_y", "_range").orderBy("_h", ref(key)))
    placed = hashed.withColumn("_local", local).join(
        offsets, F.col("_y").eqNullSafe(F.col("_oy")) & (F.col("_range") == F.col("_or")))
    return placed.withColumn("fold", F.expr(f"CAST(pmod(_before + _local - 1, {k}) AS int)")).select(
        *[ref(c) for c in df.columns], "fold")


def plain_folds(df: DataFrame, key: str, k: int, seed: int = SEED) -> DataFrame:
    """Add ``fold`` from the hash of the row key alone (no shuffle)."""
    return df.withColumn("fold", F.expr(f"CAST(pmod(xxhash64({seed}, `{key}`), {k}) AS int)"))


def chronological_folds(df: DataFrame, time: str, key: str, k: int) -> DataFrame:
    """Add ``fold``: -1 for the first rows in time, then k consecutive test blocks of n // (k + 1) rows.

    Fold i is validated by a model fitted on all rows before it. All block boundaries are found by one exact selection and
    become literal comparisons; unknown times come last.
    """
    moment = "_moment"
    timed = df.withColumn(moment, parsed_datetime(ref(time)) if families(df, [time])[time] == "string" else ref(time))
    n = df.count()
    block = n // (k + 1)
    fold = F.lit(-1)
    if not block:  # fewer rows than blocks: nothing to validate on
        return timed.withColumn("fold", fold).drop(moment)
    for i, begins in enumerate(rows_from(timed, moment, key, [n - (k - i) * block for i in range(k)])):
        fold = F.when(begins, F.lit(i)).otherwise(fold)
    return timed.withColumn("fold", fold).drop(moment)


def rows_from(df: DataFrame, order: str, key: str, positions: list[int]) -> list[Column]:
    """For each position (from 0) a condition that holds from the row there on, by (``order`` with nulls last, ``key``).

    One ordered table of the distinct values says in which value each position lies; a second one, over the keys of those values'
    rows alone, tells the row.
    """
    value = F.col(order)
    counts = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.expr("count(1) AS n")).selectExpr("'all' AS g", "value", "n")
    ordered = stored(running_totals(counts, ["g"], "value", ["n"]), "ordered-times")
    spots = ", ".join(map(str, positions))
    hits = ordered.selectExpr("value", "cum_n - n AS below", "cum_n", f"explode(array({spots})) AS at").where("below <= at AND at < cum_n").collect()
    found = {r["at"]: (r["value"], r["below"]) for r in hits}
    known = ordered.agg(F.coalesce(F.max("all_n"), F.lit(0))).first()[0]
    # the groups of equal times in which a boundary lies, -1 for rows without a time
    groups = list(dict.fromkeys(v for v, _ in found.values()))
    of = F.when(value.isNull(), F.lit(-1))
    for i, v in enumerate(groups):
        of = of.when(value == F.lit(v), F.lit(i))
    tied = df.select(of.alias("g"), ref(key).alias("key")).where("g IS NOT NULL").groupBy("g", "key").agg(F.expr("count(1) AS n"))
    wanted = [(groups.index(found[p][0]), p - found[p][1], p) if p in found else (-1, p - known, p) for p in positions]
    spots = ", ".join(f"named_struct('h', {g}, 'at', {a}L, 'p', {p}L)" for g, a, p in wanted)
    places = running_totals(tied, ["g"], "key", ["n"]).selectExpr("g", "key", "cum_n - n AS below", "cum_n", f"explode(array({spots})) AS w")
    edge = {r["p"]: r["key"] for r in places.where("g = w.h AND below <= w.at AND w.at < cum_n").select("w.p", "key").collect()}
    out = []
    for p in positions:
        if p in found:
            v = F.lit(found[p][0])
            out.append(value.isNull() | (value > v) | ((value == v) & (ref(key) >= F.lit(edge[p]))))
        else:
            out.append(value.isNull() & (ref(key) >= F.lit(edge[p])))
    return out


@dataclass(frozen=True)
class Recipe:
    """What preparation does to the features."""

    impute: str = "median"
    clip: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()


@dataclass
class Prepared:
    """Expressions of the prepared features, fitted on one set of rows."""

    columns: dict[str, Column] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    scales: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # fill, mean and scale


def feature_columns(df: DataFrame, roles: list, target: str, exclude: set[str] = frozenset()) -> list[str]:
    """All columns but the target, identifiers, constants and exclusions."""
    skip = set(exclude) | {target, "fold"} | {r["name"] for r in roles if r["is_id"] or r["is_constant"]}
    return [c for c in df.columns if c not in skip]


def fit_preparation(train: DataFrame, features: list[str], recipe: Recipe = Recipe()) -> Prepared:
    """Learn clipping bounds, fill values, scales and category codes from ``train`` only.

    Learned state is one row per numeric column and the distinct categories of text columns; codes
    follow value order and unseen values become -1. Categories join as a table when they are many.
    """
    kinds = families(train, features)
    numeric = [c for c in features if kinds[c] in NUMERIC]
    made = Prepared()
    if numeric:
        points = {r["column"]: r for r in quantiles(
            value_counts(train, numeric), {"low": CLIP[0], "mid": 0.5, "high": CLIP[1]}).collect()}
        values = {}
        for c in numeric:
            x = present(c, kinds[c]).cast("double")
            if c in recipe.clip and c in points:
                low, high = points[c]["low"], points[c]["high"]
                made.bounds[c] = (low, high)
                x = F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
            values[c] = x
        means = train.agg(*[F.avg(values[c]).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
        filled = {}
        for i, c in enumerate(numeric):
            fill = means[f"m{i}"] if recipe.impute == "mean" else (points[c]["mid"] if c in points else None)
            if c in made.bounds and recipe.impute != "mean" and fill is not None:
                low, high = made.bounds[c]
                fill = max(low, min(high, fill))
            filled[c] = F.coalesce(values[c], F.lit(float(fill if fill is not None else 0.0)))
        scales = train.agg(*[
            e for i, c in enumerate(numeric)
            for e in (F.avg(filled[c]).alias(f"m{i}"), F.stddev_pop(filled[c]).alias(f"s{i}"))]).first()
        for i, c in enumerate(numeric):
            scale = scales[f"s{i}"] or 1.0
            made.columns[c] = (filled[c] - F.lit(scales[f"m{i}"] or 0.0)) / F.lit(scale)
    for c in recipe.flags:
        if c in features:
            made.columns[f"{c}_is_missing"] = present(c, kinds[c]).isNull().cast("double")
    return made


def text_key_or_missing(name: str) -> Column:
    """Category as the short key of its whole text; a missing value is a category of its own."""
    return _short_key(F.coalesce(ref(name).cast("string"), F.lit(MISSING)))


def _short_key(text: Column) -> Column:
    return F.when(F.length(text) <= KEY_HEAD, text).otherwise(F.concat(F.substring(text, 1, KEY_HEAD), F.sha2(text, 256)))


def _trained_on(k: int, chronological: bool) -> list[list[int]]:
    """For each validated fold the folds that its model is fitted on; -1 holds the rows before all blocks."""
    every = range(-1, k)
    return [[f for f in every if (f < i if chronological else f != i)] for i in range(k)]


def fold_counts(rows: DataFrame, columns: list[str], trains: list[list[int]]) -> list[DataFrame]:
    """column, value, and for each list of folds i: w<i> (its rows with the value), cum_w<i>, all_w<i>; a table each for whole and broken numbers.

    Values are counted per fold once; a list's counts are the sums of its folds', and one ordered pass carries all lists.
    """
    folds = sorted({f for t in trains for f in t})
    names = {f: f"n_{i}" for i, f in enumerate(folds)}
    sums = {f"w{i}": " + ".join(names[f] for f in t) for i, t in enumerate(trains)}
    counted = value_counts(rows, columns, measures={n: (F.col("fold") == f).cast("bigint") for f, n in names.items()}).values()
    return [
        stored(running_totals(counts.selectExpr("column", "value", *[f"{e} AS {w}" for w, e in sums.items()]), ["column"], "value", list(sums)), "fold-counts")
        for counts in counted
    ]


def fold_points(counts: list[DataFrame], lists: int) -> list[dict]:
    """For each list of folds the clipping percentiles and the median of each numeric column, from :func:`fold_counts`."""
    points: list[dict] = [{} for _ in range(lists)]
    probs = {"low": CLIP[0], "mid": 0.5, "high": CLIP[1]}
    for ordered in counts:
        parts = [interpolated_quantiles(ordered, ["column"], "value", f"w{i}", probs).withColumn("i", F.lit(i)) for i in range(lists)]
        for r in reduce(DataFrame.unionByName, parts).collect():
            points[r["i"]][r["column"]] = r
    return points


def fold_cuts(counts: list[DataFrame], lists: int, value: str = "value") -> list[dict[str, np.ndarray]]:
    """For each list of folds and each column where a tree may split, by exact ranks over the list's rows: midway between ranges.

    ``BINS`` ranges of equally many rows; a value that fills a range stands alone, and so does each of at most ``BINS`` values.
    """
    cuts: list[dict[str, np.ndarray]] = [{} for _ in range(lists)]
    for ordered in counts:
        seen = reduce(DataFrame.unionByName, [ordered.where(f"w{i} > 0").selectExpr(
            f"{i} AS i", "column", f"CAST({value.format(i=i)} AS double) AS v", f"(cum_w{i} - 1) * {BINS} DIV all_w{i} AS bin", f"w{i} * {BINS} >= all_w{i} AS alone",
        ) for i in range(lists)])
        ends: dict[tuple, list] = {}
        for r in seen.groupBy("i", "column", "bin", "alone").agg(F.min("v").alias("low"), F.max("v").alias("v"), F.expr("count(1) AS n")).collect():
            ends.setdefault((r["i"], r["column"]), []).append(r)
        few = [k for k, found in ends.items() if sum(r["n"] for r in found) <= BINS]
        values: dict[tuple, list] = {k: [(r["low"], r["v"]) for r in found] for k, found in ends.items()}
        if few:
            values |= {k: [] for k in few}
            asked = F.concat_ws(":", "i", "column").isin([f"{i}:{c}" for i, c in few])
            for r in seen.where(asked).select("i", "column", "v").collect():
                values[r["i"], r["column"]].append((r["v"], r["v"]))
        for (i, c), found in values.items():
            low, high = np.array(sorted(found), float).T
            middle = high[:-1] + (low[1:] - high[:-1]) / 2
            cuts[i][c] = np.where(middle < low[1:], middle, high[:-1])
    return cuts


def fold_preparations(
    rows: DataFrame, features: list[str], recipe: Recipe, trains: list[list[int]],
    points: list[dict] | None = None, known: dict | None = None,
) -> tuple[list[Prepared], int]:
    """The preparation of numeric features fitted on each list of folds, and the most rows that the recipe touches in one.

    ``rows`` has ``fold``. Fills, means and scales of all lists are aggregates of one scan. Variants on the same rows and lists
    share ``points`` (:func:`fold_points`) and ``known``, which keeps the means and scales by column and treatment.
    """
    kinds = families(rows, features)
    numeric = [c for c in features if kinds[c] in NUMERIC]
    made = [Prepared() for _ in trains]
    inside = [F.col("fold").isin(t) for t in trains]
    known = {} if known is None else known
    if numeric:
        points = fold_points(fold_counts(rows, numeric, trains), len(trains)) if points is None else points
        values = [{} for _ in trains]
        for i, at in enumerate(points):
            for c in numeric:
                x = present(c, kinds[c]).cast("double")
                if c in recipe.clip and c in at:
                    low, high = made[i].bounds[c] = at[c]["low"], at[c]["high"]
                    x = F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
                values[i][c] = x
        pairs = [(i, c) for i in range(len(trains)) for c in numeric]
        fills = {(i, c): points[i][c]["mid"] if c in points[i] else None for i, c in pairs}
        if recipe.impute == "mean":
            means = {("fill", i, c, c in made[i].bounds): F.avg(F.when(inside[i], values[i][c])) for i, c in pairs}
            _aggregated(rows, means, known)
            fills = {(i, c): known["fill", i, c, c in made[i].bounds] for i, c in pairs}
        for i, c in pairs:
            fill = fills[i, c]
            if c in made[i].bounds and recipe.impute != "mean" and fill is not None:
                fill = fills[i, c] = max(made[i].bounds[c][0], min(made[i].bounds[c][1], fill))
            values[i][c] = F.coalesce(values[i][c], F.lit(float(fill if fill is not None else 0.0)))
        treated = {(i, c): (i, c, c in made[i].bounds, recipe.impute) for i, c in pairs}
        _aggregated(rows, {
            (name, *treated[i, c]): f(F.when(inside[i], values[i][c])) for i, c in pairs for name, f in (("mean", F.avg), ("scale", F.stddev_pop))
        }, known)
        for i, c in pairs:
            mean, scale = known["mean", *treated[i, c]], known["scale", *treated[i, c]]
            made[i].columns[c] = (values[i][c] - F.lit(mean or 0.0)) / F.lit(scale or 1.0)
            made[i].scales[c] = float(fills[i, c] if fills[i, c] is not None else 0.0), mean or 0.0, scale or 1.0
    for one in made:
        for c in recipe.flags:
            if c in features:
                one.columns[f"{c}_is_missing"] = present(c, kinds[c]).isNull().cast("double")
    checks = [
        F.coalesce(F.sum(F.when(inside[i], hit.cast("bigint"))), F.lit(0))
        for i, one in enumerate(made)
        for hit in [sum(((F.coalesce((ref(c) < F.lit(lo)) | (ref(c) > F.lit(hi)), F.lit(False))).cast("int") for c, (lo, hi) in one.bounds.items()), F.lit(0))
                    + sum((present(c, kinds[c]).isNull().cast("int") for c in recipe.flags if c in features), F.lit(0))]
    ] if recipe.flags or any(one.bounds for one in made) else []
    touched = max(rows.agg(*[e.alias(f"t{i}") for i, e in enumerate(checks)]).first()) if checks else 0
    return made, int(touched)


_WIDTH = 200  # aggregates in one scan


def _aggregated(rows: DataFrame, wanted: dict[tuple, Column], known: dict) -> None:
    """Add to ``known`` what it lacks of ``wanted``; very many aggregates take several scans."""
    keys = [k for k in wanted if k not in known]
    for start in range(0, len(keys), _WIDTH):
        some = keys[start:start + _WIDTH]
        row = rows.agg(*[wanted[k].alias(f"a{j}") for j, k in enumerate(some)]).first()
        known.update({k: row[f"a{j}"] for j, k in enumerate(some)})


def fold_codes(rows: DataFrame, text: list[str], trains: list[list[int]]) -> DataFrame | None:
    """column, value, codes: for each list of folds the rank of the value among those of its rows, -1 where it has none.

    And w<i>, cum_w<i>, all_w<i> as in :func:`fold_counts`.
    """
    if not text:
        return None
    filled = rows.select("fold", *[F.coalesce(ref(c).cast("string"), F.lit(MISSING)).alias(c) for c in text])
    long = filled.unpivot(["fold"], [quoted(c) for c in text], "column", "whole")
    ones, sums = ([f"{n}{i}" for i in range(len(trains))] for n in ("one", "w"))
    # counted by a short key; the order is that of whole texts, carried once per category
    seen = long.groupBy("column", _short_key(F.col("whole")).alias("value")).agg(
        F.min("whole").alias("whole"), *[F.max(F.col("fold").isin(t).cast("bigint")).alias(o) for o, t in zip(ones, trains)],
        *[F.sum(F.col("fold").isin(t).cast("bigint")).alias(w) for w, t in zip(sums, trains)])
    codes = ", ".join(f"IF({o} = 1, CAST(cum_{o} - 1 AS double), -1D)" for o in ones)
    counts = [f"{n}{w}" for w in sums for n in ("", "cum_", "all_")]
    return stored(running_totals(seen, ["column"], "whole", ones + sums).selectExpr("column", "value", f"array({codes}) AS codes", *counts), "category-codes")


class Folds:
    """Labelled rows dealt to folds, with what all variants of a comparison share.

    The rows are stored once with their fold; the quantiles and category codes of all lists of training folds, and the table of
    features that the models read, are made at their first use and serve every variant after it.
    """

    def __init__(
        self, df: DataFrame, target: str, target_type: str, key: str, features: list[str], time: str | None = None, k: int | None = None,
    ):
        self.key, self.chronological, self.classification = key, bool(time), target_type != "regression"
        # a column without a type has no Parquet form
        typed = [ref(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "void" else ref(f.name) for f in df.schema.fields]
        rows = stored(labelled(df.select(*typed), target, target_type), "labelled-rows")
        self.n = rows.count()
        self.k = k or fold_count(self.n)
        if time:
            folded = chronological_folds(rows, time, key, self.k)
        elif self.classification:
            folded = stratified_folds(rows, "_label", key, self.k)
        else:
            folded = plain_folds(rows, key, self.k)
        self.rows = stored(folded, "folded-rows")
        self.kinds = families(self.rows, features)
        self.text = [c for c in features if self.kinds[c] not in NUMERIC]
        self.numbers = [c for c in features if self.kinds[c] in NUMERIC]
        self._fitted: dict[bool, tuple] = {}

    def fitted(self, isolated: bool) -> tuple[list[list[int]], list[dict], dict, DataFrame, int, list[dict]]:
        """(lists of folds that preparation is fitted on, their quantiles, means and scales so far, model matrix, classes, cut points)."""
        if isolated not in self._fitted:
            trains = _trained_on(self.k, self.chronological)
            fits = trains if isolated else [sorted({f for t in trains for f in t} | set(range(self.k)))]
            counts = fold_counts(self.rows, self.numbers, fits) if self.numbers else []
            points, cuts = fold_points(counts, len(fits)), fold_cuts(counts, len(fits))
            codes = fold_codes(self.rows, self.text, fits)
            if codes is not None:
                cuts = [a | b for a, b in zip(cuts, fold_cuts([codes], len(fits), "codes[{i}]"))]
            matrix = self._matrix(codes)
            classes = int(matrix.agg(F.max("_label")).first()[0] or 0) + 1 if self.classification else 0
            self._fitted[isolated] = fits, points, {}, matrix, classes, cuts
        return self._fitted[isolated]

    def _matrix(self, codes: DataFrame | None) -> DataFrame:
        """_key, _label, fold, the numeric features, whether a text is there (empty or null), and the codes of its category."""
        keys = [text_key_or_missing(c).alias(f"_t{i}") for i, c in enumerate(self.text)]
        there = [F.when(ref(c).isNotNull(), F.lit("")).alias(c) for c in self.text]
        matrix = self.rows.select(
            ref(self.key).alias("_key"), F.col("_label").cast("double").alias("_label"), "fold", *[ref(c) for c in self.numbers], *there, *keys)
        for i, c in enumerate(self.text):
            # a small table is broadcast by its measured size; a hot value is split by adaptive execution
            table = codes.where(F.col("column") == c).select(F.col("value").alias(f"_t{i}"), F.col("codes").alias(f"_codes{i}"))
            matrix = matrix.join(table, f"_t{i}", "left").drop(f"_t{i}")
        return stored(matrix, "model-matrix")


def out_of_fold_predictions(folds: Folds, features: list[str], recipe: Recipe = Recipe(), isolated: bool = True, seed: int = SEED) -> tuple[DataFrame, int]:
    """(key, y, prediction, probability of validated rows; rows touched by the recipe in a fold).

    The label is numeric (class codes for classification). With ``isolated`` all preparation is fitted on the training rows of
    each fold; otherwise once on all rows. A fold's preparation is an expression over the stored features. The forests of
    all folds are grown together (:func:`forests.grow`), and each fold's predictions are stored, so a lost executor never retrains.
    """
    fits, points, known, matrix, classes, cuts = folds.fitted(isolated)
    text = [c for c in features if c in folds.text]
    made, touched = fold_preparations(folds.rows, features, recipe, fits, points, known)
    trains = _trained_on(folds.k, folds.chronological)
    slots, places, shaped = [], [], []
    for at, one in enumerate(made):
        columns = list(one.columns.values()) + [F.coalesce(F.element_at(f"_codes{folds.text.index(c)}", at + 1), F.lit(-1.0)) for c in text]
        slots.append([f"_x{at}_{j}" for j in range(len(columns))])
        places.append([prepared_cuts(one, c, cuts[at]) for c in one.columns] + [cuts[at].get(c, np.empty(0)) for c in text])
        shaped += [e.alias(n) for e, n in zip(columns, slots[-1])]
    table = matrix.select(F.col("_key").alias("key"), "_label", "fold", *shaped)
    grown = forests.grow(table, slots, places, trains, classes, TREES, DEPTH, LEAF, seed)

    def fold(i: int) -> DataFrame:
        at = i if isolated else 0
        rows = table.where(F.col("fold") == i).select("key", F.col("_label").alias("y"), *slots[at])
        return stored(forests.scored(rows, slots[at], places[at], grown[i], classes).withColumn("fold", F.lit(i)), "fold-predictions")

    with ThreadPool(max(1, folds.k)) as pool:
        parts = pool.map(inheritable_thread_target(matrix.sparkSession)(fold), range(folds.k))
    return reduce(DataFrame.unionByName, parts), touched


def prepared_cuts(made: Prepared, column: str, cuts: dict[str, np.ndarray]) -> np.ndarray:
    """Where a tree may split the prepared column: at the cut points of its values, clipped and scaled alike, and around the fill."""
    if column not in made.scales:  # whether a value is missing
        return np.zeros(1)
    fill, mean, scale = made.scales[column]
    values = cuts.get(column, np.empty(0))
    if column in made.bounds:
        values = np.clip(values, *made.bounds[column])
    filled = (fill - mean) / scale
    return np.unique(np.concatenate([(values - mean) / scale, [np.nextafter(filled, -np.inf), filled]]))


def auc(scored: DataFrame, label: str = "y", score: str = "probability") -> DataFrame:
    """One row: area under the ROC curve by rank sums over distinct scores (ties share their rank)."""
    counts = scored.groupBy(F.col(score).alias("value")).agg(
        F.expr("count(1) AS n"), F.expr(f"sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS pos")).selectExpr("'all' AS g", "value", "n", "pos")
    ordered = running_totals(counts, ["g"], "value", ["n", "pos"])
    return ordered.groupBy("g").agg(
        F.expr("sum(pos * (cum_n - (n - 1) / 2.0D)) AS ranks"), F.expr("max(all_pos) AS p"), F.expr("max(all_n - all_pos) AS q")
    ).selectExpr("CASE WHEN p > 0 AND q > 0 THEN (ranks - p * (p + 1) / 2.0D) / (p * q) END AS roc_auc")


def classification_metrics(scored: DataFrame) -> DataFrame:
    """One row: accuracy and weighted precision, recall and F1 from counts of (truth, prediction)."""
    cells = scored.groupBy(F.col("y").cast("string").alias("y"), F.col("prediction").cast("string").alias("p")).agg(F.expr("count(1) AS n"))
    truth = cells.selectExpr("y AS c", "n AS t", "0L AS m", "CASE WHEN y = p THEN n ELSE 0L END AS hit")
    guess = cells.selectExpr("p AS c", "0L AS t", "n AS m", "0L AS hit")
    per = truth.unionByName(guess).groupBy("c").agg(F.expr("sum(t) AS t"), F.expr("sum(m) AS m"), F.expr("sum(hit) AS hit"))
    out = per.agg(
        F.expr("sum(hit) / sum(t) AS accuracy"),
        F.expr("sum(t * CASE WHEN m > 0 THEN hit / m ELSE 0.0D END) / sum(t) AS precision_weighted"),
        F.expr("sum(t * CASE WHEN t > 0 THEN hit / t ELSE 0.0D END) / sum(t) AS recall_weighted"),
        F.expr("sum(t * 2.0D * hit / (t + m)) / sum(t) AS f1_weighted"))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


def regression_metrics(scored: DataFrame) -> DataFrame:
    """One row: RMSE, MAE and R-squared."""
    out = scored.agg(
        F.expr("sqrt(avg((y - prediction) * (y - prediction))) AS rmse"), F.expr("avg(abs(y - prediction)) AS mae"),
        F.expr("1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(1)) AS r2"))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


def labelled(df: DataFrame, target: str, target_type: str) -> DataFrame:
    """Rows with a target, plus ``_label``: class codes in value order or the number itself."""
    kind = families(df, [target])[target]
    known = df.where(present(target, kind).isNotNull())
    if target_type == "regression":
        if kind in NUMERIC:
            return known.withColumn("_label", present(target, kind).cast("double"))
        number = ref(target).try_cast("double")
        middle = quantiles(value_counts(known.select(number.alias("x")), ["x"]), {"mid": 0.5}).first()
        return known.withColumn("_label", F.coalesce(number, F.lit(middle["mid"] if middle else 0.0)))
    classes = known.select(ref(target).alias("_c")).distinct()
    # class codes: at most a few rows for a classification target, joined by measured size
    codes = running_totals(classes.selectExpr("'all' AS g", "_c", "1L AS one"), ["g"], "_c", ["one"]).selectExpr(
        "_c", "CAST(cum_one - 1 AS double) AS _label")
    return known.join(codes, ref(target) == F.col("_c")).drop("_c")


def model_features(df: DataFrame, roles: list, target: str, key: str, time: str | None = None, exclude: set[str] = frozenset()) -> list[str]:
    """The features of a model: see :func:`feature_columns`; the row key and the time column are none."""
    return [c for c in feature_columns(df, roles, target, set(exclude) | ({time} if time else set())) if c != key]


def cross_validate(
    df: DataFrame, roles: list, target: str, target_type: str, key: str, exclude: set[str] = frozenset(),
    recipe: Recipe = Recipe(), isolated: bool = True, time: str | None = None, k: int | None = None, folds: Folds | None = None,
) -> dict:
    """Out-of-fold predictions and metrics of one variant; the prediction table stays distributed.

    Variants of the same rows, label and split may share ``folds``, made with the features of all of them.
    """
    features = model_features(df, roles, target, key, time, exclude)
    if not features:
        raise ValueError("no predictive features are left")
    folds = folds or Folds(df, target, target_type, key, features, time, k)
    scored, touched = out_of_fold_predictions(folds, features, recipe, isolated)
    metrics = (classification_metrics if folds.classification else regression_metrics)(scored).first().asDict()
    name, score = "R2", metrics.get("r2")
    if folds.classification:
        name, score = "F1-Score", metrics["f1_weighted"]
        if target_type == "binary_classification":
            metrics["roc_auc"] = auc(scored).select(rounded("roc_auc").alias("a")).first()["a"]
            if metrics["roc_auc"] is not None:
                name, score = "ROC-AUC", metrics["roc_auc"]
    return {
        "predictions": scored, "metrics": metrics, "metric_name": name, "score": float(score or 0.0), "rows": folds.n,
        "rows_touched": touched, "folds": folds.k, "feature_count": len(features) + len([c for c in recipe.flags if c in features]),
    }
