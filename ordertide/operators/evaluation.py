"""Evaluation, agreement, overlap, drift and sensitivity of flags and scores."""

from __future__ import annotations

import functools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordertide.functions import tristate
from ordertide.operators import ordered
from ordertide.session import materialize

ratio = tristate.ratio


def confusion(df: DataFrame, keys: list[str], y: Column, flag: Column) -> DataFrame:
    """Counts and rates over rows where both target and flag are known; undefined rates stay null."""
    n = lambda c: F.count(F.when(c, 1))
    base = df.groupBy(*keys).agg(n(y & flag).alias("tp"), n(~y & flag).alias("fp"), n(y & ~flag).alias("fn"), n(~y & ~flag).alias("tn"),
                                 n(y.isNull() | flag.isNull()).alias("unknown"))
    tp, fp, fn, tn = (F.col(c) for c in ["tp", "fp", "fn", "tn"])
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return base.withColumns({
        "precision": ratio(tp, tp + fp), "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn),
        "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2})


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = successes / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    ok = n > 0
    return (F.when(ok, (centre - spread) / (1 + z * z / n)), F.when(ok, (centre + spread) / (1 + z * z / n)))


def _score_table(df: DataFrame, keys: list[str], y: Column, score: str, descending: bool, **chunking) -> DataFrame:
    known = df.where(y.isNotNull() & F.col(score).isNotNull())
    return ordered.running(known, keys, score, {"pos": y.cast("long"), "neg": (~y).cast("long")}, descending=descending, **chunking)


def roc_auc(df: DataFrame, keys: list[str], y: Column, score: str, **chunking) -> DataFrame:
    """Ties count half; null unless both classes are present."""
    t = _score_table(df, keys, y, score, False, **chunking)
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return t.groupBy(*keys).agg(F.max("pos_total").alias("positives"), F.max("neg_total").alias("negatives"), area.alias("_a")).select(
        *keys, "positives", "negatives", ratio(F.col("_a"), F.col("positives") * F.col("negatives")).alias("roc_auc"))


def average_precision(df: DataFrame, keys: list[str], y: Column, score: str, **chunking) -> DataFrame:
    t = _score_table(df, keys, y, score, True, **chunking)
    step = F.col("pos") * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))
    return t.groupBy(*keys).agg(F.max("pos_total").alias("positives"), F.sum(step).alias("_s")).select(
        *keys, "positives", ratio(F.col("_s"), F.col("positives")).alias("average_precision"))


def curves(df: DataFrame, keys: list[str], y: Column, score: str, **chunking) -> DataFrame:
    """ROC and PR points at every distinct threshold (flag = score >= threshold)."""
    t = _score_table(df, keys, y, score, True, **chunking)
    tp, fp = F.col("pos_upto"), F.col("neg_upto")
    return t.select(*keys, F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"), ratio(tp, F.col("pos_total")).alias("tpr"),
                    ratio(fp, F.col("neg_total")).alias("fpr"), (tp / (tp + fp)).alias("precision"))


def availability(y: Column, score: Column) -> Column:
    return tristate.first_match([("missing_target_and_score", y.isNull() & score.isNull()), ("missing_target", y.isNull()),
                                 ("missing_score", score.isNull())], "evaluated")


def flag_patterns(flags: DataFrame) -> DataFrame:
    """Distinct sets of positive candidates with the number of orders; sets are bounded by the registry.

    All pair counts follow from these few patterns, so no pairs are formed per order.
    """
    per = flags.groupBy("order_id").agg(F.array_sort(F.collect_set(F.when(F.col("flag"), F.col("candidate")))).alias("positives"))
    return per.groupBy("positives").agg(F.count(F.lit(1)).alias("orders"))


def pairwise_overlap(flags: DataFrame) -> DataFrame:
    """Both / left / right / neither / union / Jaccard for every candidate pair."""
    patterns = flag_patterns(flags)
    total = patterns.agg(F.sum("orders").alias("scored_cases"))
    names = flags.select("candidate").distinct()
    single = patterns.select("orders", F.explode("positives").alias("candidate")).groupBy("candidate").agg(F.sum("orders").alias("n"))
    counts = names.join(single, "candidate", "left").select("candidate", F.coalesce("n", F.lit(0)).alias("n"))
    both = patterns.select("orders", F.explode("positives").alias("left_candidate"), "positives").select(
        "orders", "left_candidate", F.explode("positives").alias("right_candidate")).where("left_candidate < right_candidate").groupBy(
        "left_candidate", "right_candidate").agg(F.sum("orders").alias("both_flag"))
    left = counts.select(F.col("candidate").alias("left_candidate"), F.col("n").alias("l"))
    right = counts.select(F.col("candidate").alias("right_candidate"), F.col("n").alias("r"))
    registry = names.agg(F.collect_set("candidate").alias("_names"))  # the declared candidates
    pairs = ordered.attach_one_row(left, registry).select("left_candidate", "l", F.explode(F.filter(
        "_names", lambda x: x > F.col("left_candidate"))).alias("right_candidate")).join(right, "right_candidate")
    joined = ordered.attach_one_row(pairs.join(both, ["left_candidate", "right_candidate"], "left"), total)
    b = F.coalesce("both_flag", F.lit(0))
    return joined.select("left_candidate", "right_candidate", "scored_cases", b.alias("both_flag"), (F.col("l") - b).alias("left_only"),
                         (F.col("r") - b).alias("right_only"), (F.col("scored_cases") - F.col("l") - F.col("r") + b).alias("neither_flag"),
                         (F.col("l") + F.col("r") - b).alias("union_flags"), ratio(b, F.col("l") + F.col("r") - b).alias("jaccard_overlap"),
                         ((F.col("l") == b) & (F.col("r") == b)).alias("identical_observed_flags"))


def rule_overlap(flags: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidate x rule contingency; rules = (order_id, rule, signal) with unknown counted apart."""
    n = lambda c: F.count(F.when(c, 1))
    s, f = F.col("signal"), F.col("flag")
    out = flags.join(rules, "order_id").groupBy("candidate", "rule").agg(
        F.count("signal").alias("compared_cases"), n(s.isNull()).alias("rule_unavailable_cases"), n(f & s).alias("both_flag"),
        n(f & ~s).alias("candidate_only"), n(~f & s).alias("rule_only"), n(~f & ~s).alias("neither_flag"))
    return out.withColumn("jaccard_overlap", ratio(F.col("both_flag"), F.col("both_flag") + F.col("candidate_only") + F.col("rule_only")))


def observed_equivalence(flags: DataFrame) -> DataFrame:
    """Candidates with identical flag vectors: equal count and equal order-insensitive fingerprint."""
    h = F.xxhash64("order_id")
    prints = flags.groupBy("candidate").agg(
        F.count(F.when(F.col("flag"), 1)).alias("flagged"), F.coalesce(F.bit_xor(F.when(F.col("flag"), h)), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.when(F.col("flag"), h.cast("decimal(38,0)"))), F.lit(0)).alias("s"))
    return prints.groupBy("flagged", "x", "s").agg(F.array_sort(F.collect_list("candidate")).alias("members")).select(
        F.array_join("members", ",").alias("members"), F.size("members").cast("long").alias("candidates"), "flagged")


def monthly_rates(flags: DataFrame) -> DataFrame:
    return flags.groupBy("candidate", "month").agg(F.count(F.lit(1)).alias("scored_cases"), F.count(F.when(F.col("flag"), 1)).alias("flagged")).withColumn(
        "rate", F.col("flagged") / F.col("scored_cases"))


def candidate_stability(monthly: DataFrame) -> DataFrame:
    """Range and case-weighted spread of the monthly rates."""
    n, k, r = F.col("scored_cases"), F.col("flagged"), F.col("rate")
    mean = F.sum(k) / F.sum(n)
    base = monthly.groupBy("candidate").agg(F.count(F.lit(1)).alias("months"), F.sum(n).alias("scored_cases"), F.sum(k).alias("flagged"), mean.alias("rate"),
                                            F.min(r).alias("rate_min"), F.max(r).alias("rate_max"), (F.sum(n * r * r) / F.sum(n)).alias("_m2"))
    return base.select("candidate", "months", "scored_cases", "flagged", "rate", "rate_min", "rate_max",
                       (100 * (F.col("rate_max") - F.col("rate_min"))).alias("rate_range_pp"),
                       (100 * F.sqrt(F.greatest(F.lit(0.0), F.col("_m2") - F.col("rate") * F.col("rate")))).alias("rate_weighted_sd_pp"))


def calibration_gap(flags: DataFrame) -> DataFrame:
    """Per candidate: rate where its threshold was set, rate afterwards, and their difference in percentage points."""
    def side(role):
        return F.count(F.when(F.col("role") == role, 1)), F.count(F.when((F.col("role") == role) & F.col("flag"), 1))
    (n0, k0), (n1, k1) = side("calibration"), side("validation")
    per = flags.groupBy("candidate").agg(n0.alias("calibration_cases"), n1.alias("validation_cases"),
                                         tristate.ratio(k0, n0).alias("calibration_rate"), tristate.ratio(k1, n1).alias("validation_rate"))
    return per.withColumn("gap_pp", 100 * (F.col("validation_rate") - F.col("calibration_rate")))


def threshold_sensitivity(flags: DataFrame) -> DataFrame:
    """Each cutoff against the next stricter one of the same score; works on one row per candidate."""
    per = flags.groupBy("score_column", "candidate", "threshold").agg(F.count(F.lit(1)).alias("scored_cases"), F.count(F.when(F.col("flag"), 1)).alias("flags"))
    w = W.partitionBy("score_column").orderBy("threshold", "candidate")
    nxt = per.withColumns({"stricter_candidate": F.lead("candidate").over(w), "stricter_threshold": F.lead("threshold").over(w),
                           "stricter_flags": F.lead("flags").over(w)}).where("stricter_candidate IS NOT NULL")
    return nxt.select("score_column", F.col("candidate").alias("looser_candidate"), "stricter_candidate", F.col("threshold").alias("looser_threshold"),
                      "stricter_threshold", F.col("flags").alias("looser_flags"), "stricter_flags", (F.col("flags") - F.col("stricter_flags")).alias("removed_flags"),
                      (F.col("flags") == F.col("stricter_flags")).alias("observed_plateau"))


def family_summary(metrics: DataFrame, family: str, metric: str) -> DataFrame:
    """Best metric per family with every tied leader."""
    best = metrics.groupBy(family).agg(F.min(metric).alias("metric_min"), F.max(metric).alias("metric_max"), F.count(F.lit(1)).alias("candidates"))
    led = metrics.join(best, family).where(F.col(metric).eqNullSafe(F.col("metric_max")))
    return led.groupBy(family, "metric_min", "metric_max", "candidates").agg(F.array_join(F.array_sort(F.collect_list("candidate")), ",").alias("leaders"))


def _front(x: np.ndarray) -> np.ndarray:
    """Rows of distinct vectors that no other row dominates. The largest remaining sum (then the largest in order) is never dominated."""
    x = x[np.lexsort([*(-x.T[::-1]), -x.sum(axis=1)])]
    kept = []
    while len(x):
        kept.append(x[0])
        x = x[~(x <= x[0]).all(axis=1)]
    return np.array(kept)


def _fronts(metrics: list[str], batches):
    front = np.zeros((0, len(metrics)))
    for batch in batches:
        front = _front(np.unique(np.concatenate([front, batch[metrics].to_numpy(float)]), axis=0))
    yield pd.DataFrame(front, columns=metrics)


def skyline(points: DataFrame, metrics: list[str], fan: int = 8) -> DataFrame:
    """Vectors that no other dominates: each task reduces its rows to their front, then fronts meet ``fan`` at a time.

    A task holds the front of what it reads, never the rows; a front is the result's size at most times its partitions.
    """
    schema = ", ".join(f"{m} double" for m in metrics)
    found = materialize(points.select(*[F.col(m).cast("double").alias(m) for m in metrics]).dropna().mapInPandas(functools.partial(_fronts, metrics), schema), "fronts")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // fan)
        found = materialize(found.repartition(parts).mapInPandas(functools.partial(_fronts, metrics), schema), "fronts")
    return found


def pareto_frontier(df: DataFrame, key: str, metrics: list[str], **chunking) -> DataFrame:
    """Rows no other row dominates (higher is better); rows with an unknown metric are left out.

    Two metrics: one descending running maximum. More: fronts of parts, merged in a tree. Any table size.
    """
    points = df.select(*metrics).distinct()
    if len(metrics) == 2:
        x, y = metrics
        best = ordered.running(points, [], x, maxima={"m": F.col(y)}, descending=True, **chunking)
        front = best.where(F.col("m_before").isNull() | (F.col("m") > F.col("m_before"))).select(x, F.col("m").alias(y))
        return df.join(front, metrics, "left_semi").select(key, *metrics)
    front = skyline(points, metrics).select(*[F.col(m).alias(f"_front_{m}") for m in metrics])
    same = reduce(lambda a, b: a & b, [F.col(m).cast("double") == F.col(f"_front_{m}") for m in metrics])
    return df.join(front, same, "left_semi").select(key, *metrics)


def window_votes(flags: DataFrame, windows: list[str]) -> DataFrame:
    """Decisions of all windows as a bit vector: one row per distinct (candidate, family, vector) with its orders.

    ``flags`` holds (window, order_id, candidate, family, flag); bit i stands for ``windows[i]``. Every order must be
    scored once by every window, otherwise the job stops. At most 2 ** len(windows) rows per candidate come out.
    """
    bit = reduce(lambda a, b: a.when(F.col("window") == b[1], F.lit(1 << b[0])), enumerate(windows), F).cast("long")
    per = flags.groupBy("candidate", "family", "order_id").agg(
        F.sum(F.when(F.col("flag"), bit).otherwise(0)).alias("bits"), F.count("flag").alias("_n"), F.sum(bit).alias("_seen"))
    complete = (F.col("_n") == len(windows)) & (F.col("_seen") == (1 << len(windows)) - 1)
    return per.select("candidate", "family", "order_id", F.when(complete, F.col("bits")).otherwise(
        F.raise_error(F.lit("every order needs one decision of every window")).cast("long")).alias("bits"))


def window_stability(votes: DataFrame, windows: list[str]) -> DataFrame:
    """Per candidate: flag counts over training windows, and the orders on whose decision the windows disagree."""
    patterns = votes.groupBy("candidate", "family", "bits").agg(F.count(F.lit(1)).alias("orders"))
    full = (1 << len(windows)) - 1
    total = lambda c: F.sum(F.when(c, F.col("orders")).otherwise(0))
    flagged = [total(F.col("bits").bitwiseAND(1 << i) > 0) for i in range(len(windows))]
    out = patterns.groupBy("candidate", "family").agg(
        F.sum("orders").alias("scored_cases_per_window"), F.least(*flagged).alias("min_flagged_cases"), F.greatest(*flagged).alias("max_flagged_cases"),
        total(F.col("bits") == full).alias("cases_flagged_in_every_window"), total(F.col("bits") > 0).alias("cases_flagged_in_any_window"),
        total((F.col("bits") > 0) & (F.col("bits") < full)).alias("cases_with_changed_decision"))
    n = F.col("scored_cases_per_window")
    return out.withColumns({"windows_evaluated": F.lit(len(windows)).cast("long"),
                            "flag_rate_range_pp": 100.0 * (F.col("max_flagged_cases") - F.col("min_flagged_cases")) / n,
                            "changed_decision_fraction": F.col("cases_with_changed_decision") / n})


def window_changes(votes: DataFrame, windows: list[str]) -> DataFrame:
    """The orders whose decision changes, with the windows that flag them in their order."""
    named = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) > 0, F.lit(w)) for i, w in enumerate(windows)]), lambda w: w.isNotNull())
    return votes.where((F.col("bits") > 0) & (F.col("bits") < (1 << len(windows)) - 1)).select(
        "order_id", "candidate", "family", F.lit(len(windows)).cast("long").alias("windows_evaluated"),
        F.size(named).cast("long").alias("windows_flagged"), named.alias("flagged_windows"))


def window_agreement(votes: DataFrame, windows: list[str]) -> DataFrame:
    """Both / left / right / neither / Jaccard for every pair of windows, from the distinct bit vectors."""
    patterns = votes.groupBy("candidate", "family", "bits").agg(F.count(F.lit(1)).alias("orders"))
    pairs = [(a, b) for a in range(len(windows)) for b in range(a + 1, len(windows))]
    each = patterns.select("candidate", "family", "orders", "bits", F.inline(F.array(*[F.struct(
        F.lit(windows[a]).alias("left_window"), F.lit(windows[b]).alias("right_window"),
        (F.col("bits").bitwiseAND(1 << a) > 0).alias("l"), (F.col("bits").bitwiseAND(1 << b) > 0).alias("r")) for a, b in pairs])))
    total = lambda c: F.sum(F.when(c, F.col("orders")).otherwise(0))
    out = each.groupBy("candidate", "family", "left_window", "right_window").agg(
        F.sum("orders").alias("scored_cases"), total(F.col("l") & F.col("r")).alias("both_flag"), total(F.col("l") & ~F.col("r")).alias("left_only"),
        total(~F.col("l") & F.col("r")).alias("right_only"), total(~F.col("l") & ~F.col("r")).alias("neither_flag"))
    different = F.col("left_only") + F.col("right_only")
    return out.withColumns({"union_flags": F.col("both_flag") + different, "changed_decisions": different,
                            "jaccard_overlap": tristate.ratio(F.col("both_flag"), F.col("both_flag") + different),
                            "changed_decision_fraction": different / F.col("scored_cases")})


def temporal_selection(monthly: DataFrame, pooled: DataFrame, keys: list[str] | None = None, tolerance: float = 1e-12) -> DataFrame:
    """Lexicographic choice by macro, worst and pooled F1 over two-class months; ties are kept.

    monthly: (candidate, period, tp, fp, fn, tn); pooled: (candidate, pooled_f1); ``keys`` scopes.
    """
    keys = keys or []
    usable = monthly.where((F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0))
    f1 = F.coalesce(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    table = usable.groupBy(*keys, "candidate").agg(F.count(F.lit(1)).alias("eligible_months"), F.avg(f1).alias("macro_f1"), F.min(f1).alias("worst_f1")).join(
        pooled, [*keys, "candidate"])
    remaining = F.lit(True)
    out = table
    for i, key in enumerate(["macro_f1", "worst_f1", "pooled_f1"]):
        best = F.max(F.when(remaining, F.col(key))).over(W.partitionBy(*keys) if keys else W.partitionBy())
        out = out.withColumn(f"_b{i}", best)
        remaining = remaining & (F.abs(F.col(key) - F.col(f"_b{i}")) <= tolerance)
    return out.withColumn("chosen", remaining).select(*keys, "candidate", "eligible_months", "macro_f1", "worst_f1", "pooled_f1", "chosen")


def leave_one_period_out(counts: DataFrame, periods: DataFrame) -> DataFrame:
    """Winner after deleting each period; counts and periods are one row per candidate x calendar period."""
    calendar = periods.agg(F.collect_set("period").alias("_periods"))  # months or weeks of the window
    kept = ordered.attach_one_row(counts, calendar).withColumn("removed", F.explode(F.filter(
        "_periods", lambda p: p != F.col("period")))).drop("_periods")
    pooled = kept.groupBy("removed", "candidate").agg(*[F.sum(c).alias(c) for c in ["tp", "fp", "fn"]]).select(
        "removed", "candidate", (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("pooled_f1"))
    return temporal_selection(kept, pooled, ["removed"]).where("chosen")


def cost_sensitivity(confusions: DataFrame, ratios: list[float]) -> DataFrame:
    return confusions.select("candidate", "fp", "fn", F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("cost_ratio")).withColumn(
        "cost", F.col("fp") + F.col("cost_ratio") * F.col("fn"))


def ks_and_wasserstein(df: DataFrame, keys: list[str], value: str, first: Column, minimum: int = 1, **chunking) -> DataFrame:
    """Two-sample KS distance and 1-Wasserstein distance from one running table over the pooled values."""
    t = ordered.running(df.where(F.col(value).isNotNull()), keys, value, {"a": first.cast("long"), "b": (~first).cast("long")}, **chunking)
    gap = F.abs(F.col("a_upto") / F.col("a_total") - F.col("b_upto") / F.col("b_total"))
    # Wasserstein sums gap * (next value - value); the next larger value is a descending running minimum.
    up = ordered.running(df.where(F.col(value).isNotNull()), keys, value, maxima={"neg": -F.col(value)}, descending=True, **chunking).select(
        *keys, value, (-F.col("neg_before")).alias("next_value"))
    both = t.join(up, [*keys, value])
    return both.groupBy(*keys).agg(
        F.max("a_total").alias("first_cases"), F.max("b_total").alias("second_cases"), F.max(gap).alias("_ks"),
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col(value))), F.lit(0.0)).alias("wasserstein")).select(
        *keys, "first_cases", "second_cases",
        F.when((F.col("first_cases") >= minimum) & (F.col("second_cases") >= minimum), F.col("_ks")).alias("ks_distance"), "wasserstein")


def cohen_kappa(df: DataFrame, a: str, b: str, weighted: bool = False) -> DataFrame:
    """Agreement of two raters from the contingency counts; quadratic weights for ordinal labels."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    whole = cells.agg(F.sum("n").alias("N"), F.sum(F.when(x == y, n).otherwise(0)).alias("same"), F.sum(n * (x - y) * (x - y)).alias("sq"),
                      F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"))
    big = F.col("N").cast("double")
    if weighted:  # expected squared distance of independent raters needs only the moments
        out = whole.withColumns({"obs": F.col("sq") / big, "exp": (F.col("sxx") + F.col("syy")) / big - 2 * F.col("sx") / big * (F.col("sy") / big)})
    else:
        marginal = cells.groupBy("x").agg(F.sum("n").alias("nx")).join(
            cells.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("ny")), "x").agg(
            F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("chance"))
        out = ordered.attach_one_row(whole, marginal).withColumns({"obs": 1 - F.col("same") / big, "exp": 1 - F.col("chance") / big / big})
    return out.select(F.col("N").alias("cases"), (F.col("same") / big).alias("agreement"),
                      F.when(F.col("exp") > 0, 1 - F.col("obs") / F.col("exp")).alias("kappa"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """ratings: (subject, label), the same number of ratings per subject."""
    cells = ratings.groupBy("subject", "label").agg(F.count(F.lit(1)).alias("n"))
    subjects = cells.groupBy("subject").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    p = (F.col("sq") - F.col("m")) / (F.col("m") * (F.col("m") - 1))
    overall = subjects.agg(F.count(F.lit(1)).alias("subjects"), F.avg(p).alias("p_bar"), F.sum("m").alias("total"))
    labels = ordered.attach_one_row(cells.groupBy("label").agg(F.sum("n").alias("n")), overall.select("total"))
    chance = labels.agg(F.sum(F.pow(F.col("n") / F.col("total"), F.lit(2))).alias("p_e"))
    return ordered.attach_one_row(overall, chance).select("subjects", "p_bar", "p_e", ((F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e"))).alias("fleiss_kappa"))


def bootstrap_kappa(df: DataFrame, a: str, b: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """Percentile interval of the quadratically weighted kappa of two ordinal raters.

    Drawing all cases anew with replacement is one multinomial draw over the cells of the contingency table, so a
    replicate costs as many steps as there are cells (labels squared), however many rows. A draw with a single label has
    no kappa; with fewer than 90 % valid draws there is no interval.
    """
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    table = cells.agg(F.sort_array(F.collect_list(F.struct("x", "y", "n"))).alias("c")).select("c.x", "c.y", "c.n")

    @F.pandas_udf("double")
    def drawn(rep: pd.Series, x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_drawn_kappa(np.random.default_rng([seed, int(r)]), *cell) for r, *cell in zip(rep, x, y, n)], dtype="float64")

    kappa = ordered.attach_one_row(df.sparkSession.range(replicates), table).select(drawn("id", "x", "y", "n").alias("k"))
    k = F.when(~F.isnan("k"), F.col("k"))
    bound = lambda q: F.when(F.count(k) >= 0.9 * replicates, F.percentile(k, F.lit(q)))
    return kappa.agg(F.count(F.lit(1)).alias("replicates"), F.count(k).alias("valid"), bound(0.025).alias("lower"), bound(0.975).alias("upper"))


def _drawn_kappa(rng, x, y, n) -> float:
    total = int(n.sum())
    if not total:
        return float("nan")
    share = rng.multinomial(total, n / total) / total
    mx, my = (share * x).sum(), (share * y).sum()
    chance = (share * x * x).sum() + (share * y * y).sum() - 2 * mx * my  # squared distance of independent raters
    return float(1 - (share * (x - y) ** 2).sum() / chance) if chance > 1e-12 else float("nan")


def interval_metrics(y: Column, low: Column, mid: Column, high: Column, alpha: float = 0.1) -> dict[str, Column]:
    """Row-wise pinball losses, interval score, coverage and width."""
    pin = lambda q, p: F.greatest(q * (y - p), (q - 1) * (y - p))
    score = (high - low) + 2 / alpha * F.greatest(low - y, F.lit(0.0)) + 2 / alpha * F.greatest(y - high, F.lit(0.0))
    return {"absolute_error": F.abs(y - mid), "pinball_05": pin(0.05, low), "pinball_95": pin(0.95, high), "interval_score": score,
            "covered": ((y >= low) & (y <= high)).cast("double"), "width": high - low}


def capped_error_bounds(y: Column, prediction: Column, horizon: float) -> tuple[Column, Column]:
    """Bounds of min-capped absolute error; an unknown outcome is only known to exceed the horizon."""
    p = F.least(prediction, F.lit(float(horizon)))
    known = F.when(y.isNotNull(), F.abs(F.least(y, F.lit(float(horizon))) - p))
    return F.coalesce(known, F.lit(0.0)), F.coalesce(known, F.greatest(p, F.lit(float(horizon)) - p))


def paired_difference(errors: DataFrame, left: str, right: str) -> DataFrame:
    """errors: (order_id, model, error) -> per-order delta of two models on identical ids."""
    a = errors.where(F.col("model") == left).select("order_id", F.col("error").alias("l"))
    b = errors.where(F.col("model") == right).select("order_id", F.col("error").alias("r"))
    d = a.join(b, "order_id").withColumn("d", F.col("l") - F.col("r"))
    n = lambda c: F.count(F.when(c, 1))
    return d.agg(F.count(F.lit(1)).alias("orders"), F.avg("d").alias("mean_difference"), n(F.col("d") < 0).alias("left_better"),
                 n(F.col("d") > 0).alias("right_better"), n(F.col("d") == 0).alias("equal"))


def profile_compare(flags: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """Decisions of two feature profiles on the same orders: agreement and changed cases per group."""
    pick = lambda c: F.bool_or(F.when(F.col("candidate") == c, F.col("flag")))
    per = flags.where(F.col("candidate").isin(left, right)).groupBy("order_id", *keys).agg(pick(left).alias("l"), pick(right).alias("r"))
    n = lambda c: F.count(F.when(c, 1))
    return per.groupBy(*keys).agg(n(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("compared"), n(F.col("l") & F.col("r")).alias("both"),
                                  n(F.col("l") & ~F.col("r")).alias("only_left"), n(~F.col("l") & F.col("r")).alias("only_right"),
                                  n(F.col("l") != F.col("r")).alias("changed_cases"))


def holdout_scope(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """First applicable exclusion reason of a later partition; the rest is evaluated."""
    return df.withColumn("holdout_status", tristate.first_match(reasons, "evaluated"))


def contamination_sensitivity(scores: DataFrame, base_flag: Column, fractions: list[float], width: float) -> DataFrame:
    """Flag counts, overlap and kappa against a fixed detector for each contamination of one score.

    The cuts are exact score quantiles on one row; every fraction is then counted in the same pass.
    """
    names = {f"_c{i}": 1 - f for i, f in enumerate(fractions)}
    cuts = ordered.quantiles(scores, [], "score", names, width=width)
    grid = F.array(*[F.struct(F.lit(float(f)).alias("contamination"), F.col(n).alias("cut")) for f, n in zip(fractions, names)])
    rows = ordered.attach_one_row(scores.withColumn("_b", base_flag), cuts).withColumn("_g", F.explode(grid))
    f, b = F.col("score") > F.col("_g.cut"), F.col("_b")
    n = lambda c: F.count(F.when(c, 1))
    t = rows.groupBy(F.col("_g.contamination").alias("contamination")).agg(F.count(F.lit(1)).alias("cases"), n(f).alias("flagged"), n(b).alias("base_flagged"), n(f & b).alias("both_flag"))
    size, x, y = F.col("cases").cast("double"), F.col("flagged"), F.col("base_flagged")
    agree = (F.col("both_flag") + (F.col("cases") - x - y + F.col("both_flag"))) / size
    chance = (x * y + (F.col("cases") - x) * (F.col("cases") - y)) / size / size
    return t.withColumns({"jaccard": ratio(F.col("both_flag"), x + y - F.col("both_flag")), "kappa": F.when(chance < 1, (agree - chance) / (1 - chance))})


def label_evaluation(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics against reviewer labels with the completeness of the labelling; labels = (order_id, y)."""
    joined = flags.join(labels, "order_id", "left")
    c = confusion(joined, ["candidate"], F.col("y"), F.col("flag"))
    known = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.withColumn("label_status", tristate.first_match([
        ("no_labels", known == 0), ("one_class_labels", (F.col("tp") + F.col("fn") == 0) | (F.col("fp") + F.col("tn") == 0)),
        ("partially_labelled", F.col("unknown") > 0)], "fully_labelled"))
