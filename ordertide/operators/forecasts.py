"""Peer-quantile forecasts, calibration shifts, routes and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import tristate
from ordertide.operators import evaluation, ordered

QUANTILES = {"low": .05, "mid": .5, "high": .95}


def peer_quantile_forecast(rows: DataFrame, fit: DataFrame, target: str, levels: dict[str, list[str]], minimum: int = 50,
                           width: float = ordered.UNITS) -> DataFrame:
    """5/50/95 % of the first sufficiently supported context, with the global quantiles as last resort."""
    out, picks = rows, []
    for name, fields in levels.items():
        q = ordered.quantiles(fit, fields, target, QUANTILES, count="support", width=width).where(F.col("support") >= minimum)
        s = F.struct(F.lit(name).alias("route"), "support", "low", "mid", "high").alias(f"_{name}")
        out = out.join(q.select(*fields, s), fields, "left")
        picks.append(F.col(f"_{name}"))
    glob = ordered.quantiles(fit, [], target, QUANTILES, count="support", width=width)
    out = ordered.attach_one_row(out, glob.select(F.struct(F.lit("global").alias("route"), "support", "low", "mid", "high").alias("_global")))
    return out.withColumn("_p", F.coalesce(*picks, F.col("_global"))).select(*rows.columns, "_p.*")


def conformal_shift(calibration: DataFrame, target: str, width: float = ordered.UNITS) -> DataFrame:
    """One row: 5 % quantile of y - low and 95 % quantile of y - high on unseen calibration rows."""
    low = ordered.quantiles(calibration.select((F.col(target) - F.col("low")).alias("v")), [], "v", {"lower_shift": .05}, width=width)
    high = ordered.quantiles(calibration.select((F.col(target) - F.col("high")).alias("v")), [], "v", {"upper_shift": .95}, width=width)
    return ordered.attach_one_row(low, high)


def calibrate(predictions: DataFrame, shifts: DataFrame) -> DataFrame:
    """Shifted bounds that keep the order low <= mid <= high and stay non-negative."""
    mid = F.col("mid")
    return ordered.attach_one_row(predictions, shifts).withColumns({
        "low": F.greatest(F.lit(0.0), F.least(F.col("low") + F.col("lower_shift"), mid)),
        "high": F.greatest(F.col("high") + F.col("upper_shift"), mid)}).drop("lower_shift", "upper_shift")


def forecast_routes(predictions: DataFrame, fit: DataFrame, category: str, target: str) -> DataFrame:
    """Unseen-category flag and long / short / zero warnings."""
    known = fit.select(category).distinct().withColumn("_seen", F.lit(True))
    y = F.col(target)
    return predictions.join(known, category, "left").withColumns({
        "unseen_category": F.col("_seen").isNull(), "long_warning": y > F.col("high"), "short_warning": (y > 0) & (y < F.col("low")),
        "zero_warning": y == 0, "excess_above_upper": F.greatest(y - F.col("high"), F.lit(0.0))}).drop("_seen")


def interval_evaluation(predictions: DataFrame, target: str, groupings: list[list[str]]) -> DataFrame:
    """Mean interval metrics over several groupings in one grouping-sets aggregate."""
    names = sorted({k for g in groupings for k in g})
    metrics = evaluation.interval_metrics(F.col(target).cast("double"), F.col("low"), F.col("mid"), F.col("high"))
    return predictions.groupingSets([[F.col(k) for k in g] for g in groupings], *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("orders"), *[F.avg(e).alias(n) for n, e in metrics.items()])


def horizon_scores(predictions: DataFrame, target: Column, horizons: list[float], keys: list[str]) -> DataFrame:
    """Bounded mean absolute error per fixed horizon; unknown outcomes give an interval, not a guess."""
    out = None
    for h in horizons:
        low, high = evaluation.capped_error_bounds(target, F.col("mid"), h)
        part = predictions.groupBy(*keys).agg(F.lit(float(h)).alias("horizon"), F.count(F.lit(1)).alias("orders"), F.count(target).alias("known_outcomes"),
                                              F.avg(low).alias("mae_lower"), F.avg(high).alias("mae_upper"))
        out = part if out is None else out.unionByName(part)
    return out


def model_consensus(predictions: DataFrame, expected: list[str]) -> DataFrame:
    """Per order: evaluated models, warnings, completeness and disagreement; predictions = (order_id, model, warnings)."""
    n = lambda c: F.count(F.when(c, 1))
    models = F.collect_set("model")
    return predictions.groupBy("order_id").agg(
        F.count_distinct("model").alias("models_evaluated"), n(F.col("long_warning")).alias("long_warnings"), n(F.col("short_warning")).alias("short_warnings"),
        n(F.col("zero_warning")).alias("zero_warnings"), (F.size(F.array_except(F.array(*[F.lit(m) for m in expected]), models)) == 0).alias("complete_comparison"),
        (F.min(F.col("long_warning").cast("int")) != F.max(F.col("long_warning").cast("int"))).alias("disagreement"))


def model_outcome_overlap(predictions: DataFrame, outcome: Column) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    w = F.col("long_warning")
    return predictions.groupBy("model").agg(F.count(outcome).alias("orders"), n(w & outcome).alias("warned_and_late"), n(w & ~outcome).alias("warned_not_late"),
                                            n(~w & outcome).alias("late_not_warned"))


def shift_decomposition(df: DataFrame, group: str, first: Column, value: str, minimum: int = 20) -> DataFrame:
    """Between-period gap of a mean = composition + within-group part on common support; one row."""
    n = lambda c: F.count(F.when(c, 1))
    cells = df.groupBy(group).agg(n(first).alias("na"), n(~first).alias("nb"), F.sum(F.when(first, F.col(value))).alias("sa"), F.sum(F.when(~first, F.col(value))).alias("sb")).where(
        (F.col("na") >= minimum) & (F.col("nb") >= minimum))
    tot = cells.agg(F.sum("na").alias("_tot_a"), F.sum("nb").alias("_tot_b"))
    c = ordered.attach_one_row(cells, tot).select("na", "nb", "sa", "sb", (F.col("na") / F.col("_tot_a")).alias("pa"), (F.col("nb") / F.col("_tot_b")).alias("pb"),
                                                  (F.col("sa") / F.col("na")).alias("ma"), (F.col("sb") / F.col("nb")).alias("mb"))
    return c.agg(F.count(F.lit(1)).alias("common_groups"), (F.sum("sa") / F.sum("na") - F.sum("sb") / F.sum("nb")).alias("gap"),
                 F.sum((F.col("pa") - F.col("pb")) * (F.col("ma") + F.col("mb")) / 2).alias("composition_component"),
                 F.sum((F.col("ma") - F.col("mb")) * (F.col("pa") + F.col("pb")) / 2).alias("within_group_component"))


def error_concentration(errors: DataFrame, keys: list[str], error: str, signed: str, width: float = ordered.UNITS) -> DataFrame:
    """Share of total error carried by the worst tenth (ties at the cut counted pro rata) and under-prediction share.

    Reads the descending running table, so the worst rows are never ranked in one task.
    """
    t = ordered.running(errors, keys, error, {"n": F.lit(1), "_err": F.col(error)}, width=width, descending=True)
    cut = F.ceil(F.col("n_total") / 10)
    take = F.greatest(F.lit(0), F.least(F.col("n"), cut - F.col("n_before")))
    worst = t.groupBy(*keys).agg(F.max("n_total").alias("orders"), F.max("_err_total").alias("total_error"), F.sum(take * F.col(error)).alias("worst_tenth_error"))
    under = errors.groupBy(*keys).agg(F.count(F.when(F.col(signed) > 0, 1)).alias("under_predicted"))
    joined = worst.join(under, keys) if keys else ordered.attach_one_row(worst, under)
    return joined.withColumns({"worst_tenth_share": tristate.ratio(F.col("worst_tenth_error"), F.col("total_error")),
                               "under_prediction_share": F.col("under_predicted") / F.col("orders")})


def error_quantiles(errors: DataFrame, keys: list[str], actual: str, signed: str, width: float = ordered.UNITS) -> DataFrame:
    """Per group: mean, median and 90 % quantile of the outcome, mean signed error, 90 % quantile of the absolute error."""
    rows = errors.withColumn("_abs", F.abs(F.col(signed)))
    means = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"), F.avg(actual).alias("actual_mean"), F.avg(signed).alias("mean_signed_error"))
    of_actual = ordered.quantiles(rows, keys, actual, {"actual_median": .5, "actual_p90": .9}, width=width)
    return means.join(of_actual, keys).join(ordered.quantiles(rows, keys, "_abs", {"absolute_error_p90": .9}, width=width), keys)


def followup_audit(orders: DataFrame, horizons: list[int]) -> DataFrame:
    """(order, horizon) follow-up state; maturity is strictly before the cutoff.

    orders: purchased_at, carrier_at, delivered_at masked at ``cutoff``.
    """
    day = lambda c: F.unix_seconds(F.col(c).cast("timestamp")) / 86400
    invalid = tristate.known_true(F.col("carrier_at") < F.col("purchased_at")) | tristate.known_true(F.col("delivered_at") < F.col("carrier_at"))
    long = orders.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    mature = F.col("carrier_at").isNotNull() & ~invalid & (day("carrier_at") + F.col("horizon_days") < day("cutoff"))
    took = day("delivered_at") - day("carrier_at")
    return long.withColumn("followup_state", tristate.first_match([
        ("carrier_not_recorded_before_cutoff", F.col("carrier_at").isNull()), ("invalid_visible_stage_chronology", invalid),
        ("insufficient_followup", ~mature), ("no_delivery_recorded_before_cutoff", F.col("delivered_at").isNull()),
        ("delivery_recorded_within_horizon", took <= F.col("horizon_days"))], "delivery_recorded_after_horizon_before_cutoff"))


def feature_shift(df: DataFrame, features: list[str], fit: Column, period: str, width: float = ordered.UNITS) -> DataFrame:
    """Per feature and period: median and share outside the fit range, next to the fit range."""
    pieces = ", ".join(f"'{f}', cast({f} as bigint)" for f in features)
    long = df.select(F.col(period), fit.alias("_fit"), F.expr(f"stack({len(features)}, {pieces}) AS (feature, v)"))
    base = long.where("_fit").groupBy("feature").agg(F.min("v").alias("fit_min"), F.max("v").alias("fit_max"))
    later = long.where("NOT _fit").join(F.broadcast(base), "feature")  # one row per declared feature
    outside = later.groupBy("feature", period, "fit_min", "fit_max").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when((F.col("v") < F.col("fit_min")) | (F.col("v") > F.col("fit_max")), 1)).alias("outside_rows"))
    return outside.join(ordered.quantiles(later, ["feature", period], "v", {"median": .5}, width=width), ["feature", period]).withColumn(
        "outside_fraction", F.col("outside_rows") / F.col("rows"))


def fit_quantiles(df: DataFrame, features: list[str], fit: Column, width: float = ordered.UNITS) -> DataFrame:
    """Per feature over the fit rows: count, range, 1 %, 50 % and 99 % quantiles."""
    pieces = ", ".join(f"'{f}', cast({f} as bigint)" for f in features)
    long = df.where(fit).select(F.expr(f"stack({len(features)}, {pieces}) AS (feature, v)")).where("v IS NOT NULL")
    spread = long.groupBy("feature").agg(F.count(F.lit(1)).alias("fit_rows"), F.min("v").alias("fit_min"), F.max("v").alias("fit_max"))
    return spread.join(ordered.quantiles(long, ["feature"], "v", {"fit_q01": .01, "fit_median": .5, "fit_q99": .99}, width=width), "feature")


def group_support(df: DataFrame, group: list[str], fit: Column, period: str) -> DataFrame:
    """Per later period: rows, and rows and distinct groups that the fit rows never showed. Counts per group meet, not rows."""
    seen = df.where(fit).groupBy(*group).agg(F.count(F.lit(1)).alias("fit_rows"))
    later = ordered.join_groups(df.where(~fit).groupBy(period, *group).agg(F.count(F.lit(1)).alias("n")), seen, group)
    unseen = F.col("fit_rows").isNull()
    return later.groupBy(period).agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(unseen, F.col("n"))), F.lit(0)).alias("unseen_rows"), F.count(F.when(unseen, 1)).alias("unseen_groups"),
        F.min(F.coalesce("fit_rows", F.lit(0))).alias("least_fit_rows"))


def gbt_median_forecast(rows: DataFrame, fit: DataFrame, target: str, numeric: list[str], categorical: list[str], iterations: int = 20,
                        seed: int = 7) -> DataFrame:
    """Boosted trees with absolute loss (median); unseen categories get their own level."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical], handleInvalid="keep")
    pack = VectorAssembler(inputCols=[*numeric, *[f"{c}_v" for c in categorical]], outputCol="_x")
    trees = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="mid", lossType="absolute", maxIter=iterations, seed=seed)
    model = Pipeline(stages=[index, hot, pack, trees]).fit(fit)
    return model.transform(rows).select(*rows.columns, "mid")
