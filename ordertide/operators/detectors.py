"""Statistical detectors: fit -> small parameter table -> score. Parameters are tables, not pickles."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.functions import tristate
from ordertide.operators import ordered
from ordertide.session import materialize

# Robust-z constant, cutoffs and tail fractions of the candidate grid.
MAD_SCALE = 0.6744897501960817
IQR_MULTIPLIERS = [1.5, 3.0]
MAD_CUTOFFS = [2.5, 3.0, 3.5]
TAIL_FRACTIONS = [0.01, 0.025, 0.05, 0.10]
UPPER_QUANTILES = [0.90, 0.95, 0.975, 0.99]
LOG_CHUNK = 0.0001


def _long(df: DataFrame, features: list[str], log: bool, keys: tuple[str, ...] | list[str] = ()) -> DataFrame:
    pieces = ", ".join(f"'{f}', {'log1p(' + f + ')' if log else 'cast(' + f + ' as double)'}" for f in features)
    return df.select(*keys, F.expr(f"stack({len(features)}, {pieces}) AS (feature, v)"))


def _counts(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, v, n): the rows of every value, counted and written once for all that is read off them."""
    return materialize(_long(df, features, False, keys).groupBy(*keys, "feature", "v").agg(F.count(F.lit(1)).alias("n")), "feature-values")


def fit_statistics(fit: DataFrame, features: list[str], log: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Per feature: exact quartiles, MAD and upper quantiles. A zero IQR or MAD raises when read.

    ``keys`` fits several populations (training windows, say) in one plan, one table of statistics each.
    """
    return _statistics(_counts(fit, features, keys or []), log, keys)


def both_statistics(fit: DataFrame, features: list[str], keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``fit_statistics`` of the values and of their logarithms, from one count."""
    counts = _counts(fit, features, keys or [])
    return _statistics(counts, False, keys), _statistics(counts, True, keys)


def _statistics(long: DataFrame, log: bool, keys: list[str] | None = None) -> DataFrame:
    keys = [*(keys or []), "feature"]
    long = long.withColumn("v", F.log1p("v")) if log else long
    chunk = {"width": LOG_CHUNK if log else ordered.UNITS, "weight": F.col("n")}
    names = {"q01": .01, "q25": .25, "median": .5, "q75": .75, **{f"u{round(q * 1000)}": q for q in UPPER_QUANTILES}}
    base = ordered.quantiles(long, keys, "v", names, count="fit_rows", **chunk)
    deviation = long.join(base.select(*keys, "median"), keys).select(*keys, F.abs(F.col("v") - F.col("median")).alias("v"), "n")
    mad = ordered.quantiles(deviation, keys, "v", {"mad": .5}, **chunk)
    out = base.join(mad, keys).withColumn("iqr", F.col("q75") - F.col("q25"))
    checked = F.when((F.col("iqr") <= 0) | (F.col("mad") <= 0), F.raise_error(F.lit("zero IQR or MAD: set an explicit feature policy")).cast("double"))
    return out.withColumn("iqr", F.coalesce(checked, F.col("iqr")))


def _wide(stats: DataFrame, features: list[str], names: list[str], keys: tuple[str, ...] | list[str] = (), prefix: str = "") -> DataFrame:
    """One row per ``keys`` with a column per (feature, statistic); bounded by the declared features."""
    return stats.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == f, F.col(n))).alias(f"{prefix}{f}__{n}") for f in features for n in names])


def base_scores(df: DataFrame, features: list[str], raw: DataFrame, logged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long (order_id, role, score_column, score) of the closed-form detectors.

    With ``keys`` every row is scored by the statistics of every population: one row more per key.
    """
    keys = keys or []
    uppers = [f"u{round(q * 1000)}" for q in UPPER_QUANTILES]
    names = ["median", "q75", "iqr", "mad", *uppers]
    plain, log = _wide(raw, features, names, keys), _wide(logged, features, names, keys, "log_")
    if keys:  # one struct per declared population, so rows meet all of them without a join of large sides
        fitted = plain.join(log, keys)
        listed = fitted.agg(F.collect_list(F.struct(*fitted.columns)).alias("_fits"))
        wide = ordered.attach_one_row(df, listed).select(*df.columns, F.inline("_fits"))
    else:
        wide = ordered.attach_one_row(ordered.attach_one_row(df, plain), log)
    scores = {}
    for kind, prefix, value in [("raw", "", lambda f: F.col(f).cast("double")), ("log1p", "log_", lambda f: F.log1p(f))]:
        p = lambda f, n: F.col(f"{prefix}{f}__{n}")  # noqa: E731, B023
        scores[f"iqr_{kind}"] = F.greatest(F.lit(0.0), *[(value(f) - p(f, "q75")) / p(f, "iqr") for f in features])
        scores[f"mad_{kind}"] = F.greatest(F.lit(0.0), *[MAD_SCALE * (value(f) - p(f, "median")) / p(f, "mad") for f in features])
    for u in uppers:
        scores[f"upper_{u}"] = F.greatest(*[F.col(f).cast("double") - F.col(f"{f}__{u}") for f in features])
    wide = wide.withColumns({f"_s_{k}": v for k, v in scores.items()})
    pieces = ", ".join(f"'{k}', _s_{k}" for k in scores)
    return wide.select(*keys, "order_id", "role", F.expr(f"stack({len(scores)}, {pieces}) AS (score_column, score)"))


def rank_ensemble(scores: DataFrame, members: list[str]) -> DataFrame:
    """Calibration-ECDF rank per member, then mean and median over members per order."""
    used = scores.where(F.col("score_column").isin(members))
    calibration = used.where("role = 'calibration'")
    ranked = ordered.ecdf(used, calibration, ["score_column"], "score", width=LOG_CHUNK * 100)
    rank = F.col("ref_upto") / F.col("ref_n")
    # An order has one score per member, so the few ranks are columns and their median needs no list.
    per = ranked.groupBy("order_id", "role").agg(F.avg(rank).alias("ensemble_rank_mean"), *[F.max(F.when(F.col("score_column") == m, rank)).alias(f"_r_{m}") for m in members],
                                                 F.max(F.when(F.col("score_column") == "mad_log1p", rank)).alias("_mad"))
    known = F.filter(F.array_sort(F.array(*[F.col(f"_r_{m}") for m in members])), lambda r: r.isNotNull())
    middle = (F.get(known, F.floor((F.size(known) - 1) / 2).cast("int")) + F.get(known, F.floor(F.size(known) / 2).cast("int"))) / 2
    per = per.withColumn("ensemble_rank_median", middle)
    return per.select("order_id", "role", F.expr(
        "stack(3, 'ensemble_rank_mean', ensemble_rank_mean, 'ensemble_rank_median', ensemble_rank_median, "
        "'hybrid_rank_mean_mad', 0.5 * ensemble_rank_mean + 0.5 * _mad) AS (score_column, score)"))


def calibrated_thresholds(scores: DataFrame, calibrated: list[str]) -> DataFrame:
    """Candidate registry: fixed multipliers, per-feature quantiles, and calibration tail quantiles."""
    spark = scores.sparkSession
    fixed = [(f"{fam}_{t}_k{round(k * 10):02d}", fam, f"{fam}_{t}", float(k), "fixed_multiplier_of_fit_statistics", None)
             for t in ["raw", "log1p"] for fam, ks in [("iqr", IQR_MULTIPLIERS), ("mad", MAD_CUTOFFS)] for k in ks]
    fixed += [(f"upper_q{round(q * 1000)}", "upper_quantile", f"upper_u{round(q * 1000)}", 0.0, "per_feature_fit_quantile", None)
              for q in UPPER_QUANTILES]
    schema = "candidate string, family string, score_column string, threshold double, threshold_origin string, tail_fraction double"
    registry = spark.createDataFrame(fixed, schema)
    if not calibrated:
        return registry
    tails = {f"t{round(f * 1000):03d}": 1 - f for f in TAIL_FRACTIONS}
    q = ordered.quantiles(scores.where((F.col("role") == "calibration") & F.col("score_column").isin(calibrated)),
                          ["score_column"], "score", tails, width=LOG_CHUNK * 100)
    pieces = ", ".join(f"'tail{n[1:]}', {n}, cast({1 - p!r} as double)" for n, p in tails.items())
    learned = q.select("score_column", F.expr(f"stack({len(tails)}, {pieces}) AS (tail, threshold, tail_fraction)")).select(
        F.concat_ws("_", "score_column", "tail").alias("candidate"),
        F.when(F.col("score_column").startswith("ensemble") | F.col("score_column").startswith("hybrid"), "ensemble").otherwise("model").alias("family"),
        "score_column", "threshold", F.lit("unseen_calibration_score_quantile").alias("threshold_origin"), F.round("tail_fraction", 4).alias("tail_fraction"))
    return registry.unionByName(learned)


def apply_thresholds(scores: DataFrame, registry: DataFrame) -> DataFrame:
    """Long flags (order_id, role, candidate, score, flag), strict ``>``. The registry is a fixed small grid."""
    return scores.join(F.broadcast(registry.select("candidate", "family", "score_column", "threshold")), "score_column").withColumn(
        "flag", F.col("score") > F.col("threshold"))


def positive_evidence(flags: DataFrame) -> DataFrame:
    return flags.where("flag").select("order_id", "candidate", "score", "threshold", (F.col("score") - F.col("threshold")).alias("excess"))


def iqr_flags(df: DataFrame, features: list[str], stats: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Names of the features above Q3 + k IQR per row."""
    wide = ordered.attach_one_row(df, _wide(stats, features, ["q75", "iqr"]))
    return wide.withColumn("outlier_features", tristate.reasons(
        [(f, F.col(f) > F.col(f"{f}__q75") + multiplier * F.col(f"{f}__iqr")) for f in features])).select(
        *df.columns, "outlier_features", (F.size("outlier_features") > 0).alias("iqr_flag"))


def threshold_grid(df: DataFrame, features: list[str]) -> DataFrame:
    """Outlier counts of every (feature, method) rule: percentile pairs, IQR multipliers, robust z."""
    long = _counts(df, features, [])
    stats = _statistics(long, False)
    j = long.join(F.broadcast(stats), "feature")
    z = MAD_SCALE * (F.col("v") - F.col("median")) / F.col("mad")
    rules = {"percentile_01_99": (F.col("v") < F.col("q01")) | (F.col("v") > F.col("u990")),
             "iqr_1_5": (F.col("v") < F.col("q25") - 1.5 * F.col("iqr")) | (F.col("v") > F.col("q75") + 1.5 * F.col("iqr")),
             "iqr_3_0": (F.col("v") < F.col("q25") - 3 * F.col("iqr")) | (F.col("v") > F.col("q75") + 3 * F.col("iqr")),
             "mad_z_3_5": F.abs(z) > 3.5}
    counts = j.groupBy("feature").agg(F.sum("n").alias("rows"), *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(m) for m, c in rules.items()])
    pieces = ", ".join(f"'{m}', {m}" for m in rules)
    return counts.select("feature", "rows", F.expr(f"stack({len(rules)}, {pieces}) AS (method, outliers)")).withColumn(
        "outlier_rate", F.col("outliers") / F.col("rows"))


def robust_scale(df: DataFrame, features: list[str], stats: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(x - median) / IQR with unit scale on a zero IQR, and the columns of ``keep`` as they are."""
    wide = ordered.attach_one_row(df, _wide(stats, features, ["median", "iqr"]))
    return wide.select("order_id", *keep, *[((F.col(f) - F.col(f"{f}__median")) / F.when(F.col(f"{f}__iqr") == 0, 1.0).otherwise(F.col(f"{f}__iqr"))).alias(f"{f}_scaled")
                                            for f in features])


def vote_hybrid(df: DataFrame, flags: list[str]) -> DataFrame:
    votes = reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(False)).cast("long") for f in flags])
    return df.withColumn("votes", votes).withColumn("hybrid_anomaly", F.col("votes") >= 2).withColumn(
        "anomaly_level", tristate.first_match(
            [("Normal", F.col("votes") == 0), ("Warning", F.col("votes") == 1), ("Anomaly", F.col("votes") == 2)], "High-confidence anomaly"))


def rule_flags(df: DataFrame) -> DataFrame:
    """fitness, missing_event_count, reversed_flag, has_negative_duration -> rule flags and text reasons."""
    rules = [("low trace fitness", F.col("fitness") < 1.0), ("missing event", F.col("missing_event_count") > 0),
             ("reversed activity order", F.col("reversed_flag")), ("negative duration", F.coalesce(F.col("has_negative_duration"), F.lit(False)))]
    return df.withColumn("rule_reasons", F.coalesce(F.nullif(F.array_join(tristate.reasons(rules), "; "), F.lit("")), F.lit("none"))).withColumn(
        "rule_flag", F.col("rule_reasons") != "none")


def severity_of_deviation(fitness: Column, reversed_flag: Column) -> Column:
    return tristate.first_match([("Severe", reversed_flag | (fitness < 0.5)), ("Significant", fitness < 0.8), ("Mild", fitness < 1.0)], "Normal")


def classify_case(missing: Column, reversed_flag: Column, fitness: Column, negative: Column, long: Column, severe: Column,
                  short: Column, near: Column) -> tuple[Column, Column]:
    """Label and confidence from evidence counts."""
    strong = reversed_flag | (negative > 0) | (missing >= 2) | (severe > 0) | (long >= 2)
    anomaly = strong | ((missing >= 1) & (long >= 1)) | ((fitness < 1.0) & (long >= 1))
    suspicious = (missing == 1) | (fitness < 1.0) | (long == 1) | (short > 0) | (near > 0)
    label = tristate.first_match([("Anomaly", anomaly), ("Suspicious", suspicious)], "Normal")
    weak = ((short > 0) | (near > 0)) & (long == 0) & (missing == 0)
    confidence = tristate.first_match([("High", strong | ~(anomaly | suspicious)), ("Medium", anomaly), ("Low", weak)], "Medium")
    return label, confidence


# --- isolation forest --------------------------------------------------------------------------

def _average_path(n):
    """Expected unsuccessful-search depth c(n) of the isolation forest paper."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


NODE = T.StructType([T.StructField(n, t) for n, t in [
    ("tree", T.IntegerType()), ("node", T.IntegerType()), ("left", T.IntegerType()), ("right", T.IntegerType()),
    ("feature", T.IntegerType()), ("split", T.DoubleType()), ("depth", T.DoubleType())]])


def _tree_grower(features: list[str], seed: int, limit: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf.sort_values("order_id")[features].to_numpy(float)
        nodes, queue = [], [(0, x, 0)]
        while queue:
            node, rows, depth = queue.pop()
            low, high = rows.min(axis=0, initial=np.inf), rows.max(axis=0, initial=-np.inf)
            spread = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(spread):
                nodes.append((tree, node, -1, -1, -1, 0.0, float(depth + _average_path(len(rows)))))
                continue
            pick, share = rng.random(2)
            f = int(spread[int(pick * len(spread))])
            at = float(low[f] + share * (high[f] - low[f]))
            mask = rows[:, f] <= at
            nodes.append((tree, node, 2 * node + 1, 2 * node + 2, f, at, 0.0))
            queue += [(2 * node + 1, rows[mask], depth + 1), (2 * node + 2, rows[~mask], depth + 1)]
        return pd.DataFrame(nodes, columns=NODE.names)
    return grow


def isolation_forest_fit(fit: DataFrame, features: list[str], trees: int = 300, samples: int = 256, seed: int = 42) -> DataFrame:
    """Grow trees in parallel, each from rows drawn over the whole fit set; returns the node table (trees x 2*samples rows at most).

    Rows get dense numbers in the order of their id by running counts. A tree draws one number from each of ``samples`` equal
    stretches of them, without replacement and whatever the size of the set; with ``samples`` rows or fewer it takes all. Only
    the drawn rows (trees x samples) meet their trees.
    """
    numbers = ordered.running(fit.select("order_id"), [], "order_id", {"n": F.lit(1)}, width=ordered.UNITS).select("order_id", F.col("n_before").alias("_row"))
    numbered = fit.select("order_id", *features).join(numbers, "order_id")
    draws = fit.sparkSession.range(trees * samples).select((F.col("id") / samples).cast("int").alias("tree"), (F.col("id") % samples).alias("_part"))
    draws = ordered.attach_one_row(draws, fit.agg(F.count(F.lit(1)).alias("_n")))
    u = F.pmod(F.xxhash64(F.lit(seed), "tree", "_part"), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.when(F.col("_n") <= samples, F.col("_part")).otherwise(F.floor((F.col("_part") + u) * F.col("_n") / samples))
    sampled = draws.select("tree", drawn.alias("_row")).join(numbered, "_row").drop("_row")
    limit = math.ceil(math.log2(max(samples, 2)))
    return sampled.groupBy("tree").applyInPandas(_tree_grower(features, seed, limit), NODE)


def isolation_forest_score(df: DataFrame, features: list[str], nodes: DataFrame, trees: int = 300, samples: int = 256) -> DataFrame:
    """score = 2^(-mean depth / c(n)). The node table is bounded by trees x 2*samples and shipped once; a larger one is refused."""
    table = nodes.limit(trees * 2 * samples + 1).toPandas()
    if len(table) > trees * 2 * samples:
        raise ValueError("the node table is larger than the declared trees and samples allow")
    packed = []
    for _, t in table.groupby("tree"):
        size = int(t["node"].max()) + 1
        levels = size.bit_length() - 1
        size = (2 << levels) - 1
        feature, split, depth, held = np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size, bool)
        feature[t["node"]], split[t["node"]], depth[t["node"]], held[t["node"]] = t["feature"], t["split"], t["depth"], True
        for level in range(1, levels + 1):  # a leaf's depth is handed down, so that every row walks the same number of steps
            own = np.arange((1 << level) - 1, (2 << level) - 1)
            up = (own - 1) // 2
            below = own[~held[own] & held[up] & (feature[up] < 0)]
            up = (below - 1) // 2
            feature[below], depth[below], held[below] = -1, depth[up], True
        packed.append((levels, np.maximum(feature, 0), split, depth))
    shared = df.sparkSession.sparkContext.broadcast(packed)
    norm = float(_average_path(samples))

    def score(batches):
        for pdf in batches:
            x = np.ascontiguousarray(pdf[features].to_numpy(float))
            total, first = np.zeros(len(x)), np.arange(len(x)) * len(features)
            for levels, feature, split, depth in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(levels):
                    at = 2 * at + 2 - (x.take(first + feature.take(at)) <= split.take(at))
                total += depth.take(at)
            yield pd.DataFrame({"order_id": pdf["order_id"], "role": pdf["role"], "score": 2.0 ** (-total / len(shared.value) / norm)})

    # A row walks every tree: worth dealing narrow rows evenly first.
    rows = df.select("order_id", "role", *features).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInPandas(score, "order_id long, role string, score double")
