"""Peer references: fallback levels, exact ranks against a historical group, signals and scores.

A reference group is never collected. Its distribution is the chunked running count of
``ordered.ranks``; a row's rank is read from it by an equi join on (group, duration).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordertide.functions import tristate
from ordertide.operators import ordered
from ordertide.session import materialize

# Minimum peers, and the order in which contexts are tried.
MINIMUM_PEERS = 30
CATEGORY_LEVELS = [["customer_state", "distance_band", "seller_attribution_scope"],
                   ["distance_band", "seller_attribution_scope"]]
PRODUCT_LEVELS = [["product_id", "single_seller_id", "item_count", "customer_state", "distance_band"],
                  ["product_id", "single_seller_id", "item_count", "distance_band"],
                  ["product_id", "item_count", "customer_state", "distance_band"],
                  ["product_id", "item_count", "distance_band"]]
DURATION = "duration_s"


def _level_key(scope: str, level: int, fields: list[str]) -> Column:
    """Group name of a row at one level; null (no group) when a field is unknown."""
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
    return F.when(known, F.concat_ws("|", F.lit(f"{scope}{level}"), F.col("stage"),
                                     *[F.col(f).cast("string") for f in fields]))


def level_rows(df: DataFrame, product_levels: list[list[str]], category_levels: list[list[str]],
               keep: list[str]) -> DataFrame:
    """One row per (row, usable level): the fallback order is the level number."""
    entries = []
    for i, fields in enumerate(product_levels):
        entries.append(F.struct(F.lit(i).alias("level"), F.when(F.col("product_attributable"), _level_key("product", i, fields)).alias("group")))
    for j, fields in enumerate(category_levels):
        entries.append(F.struct(F.lit(len(product_levels) + j).alias("level"), _level_key("category", j, fields).alias("group")))
    return df.select(*keep, F.explode(F.filter(F.array(*entries), lambda e: e["group"].isNotNull())).alias("_e")).select(
        *keep, F.col("_e.level").alias("level"), F.col("_e.group").alias("group"))


def group_statistics(reference: DataFrame, minimum: int) -> DataFrame:
    """n, sum and latest end of each sufficiently supported group; reference = (group, duration_s, ended_at)."""
    return reference.groupBy("group").agg(F.count(F.lit(1)).alias("ref_n"), F.sum(DURATION).alias("ref_sum_s"),
                                          F.max("ended_at").alias("latest_end")).where(F.col("ref_n") >= minimum)


class FrozenReference:
    """A written index of a reference: group statistics, and each group's rank as steps over the duration.

    ``counts`` has (group, duration_s, n, latest_end). A step says that ``upto`` members last at most as long as any duration from
    ``since`` until before ``until``; steps are cut at chunks of the duration axis, so a probe finds its step by an equi-join on
    (group, chunk) and a range of at most one chunk. Probes read the groups they name and never the rows behind them.
    """

    def __init__(self, counts: DataFrame, minimum: int, category_levels, product_levels, width: int = ordered.UNITS):
        self.minimum, self.category_levels, self.product_levels, self.width = minimum, list(category_levels), list(product_levels), width
        self.counts = materialize(counts, "reference-counts")
        groups = self.counts.groupBy("group").agg(F.sum("n").alias("ref_n"), F.sum(F.col("n") * F.col(DURATION)).alias("ref_sum_s"),
                                                  F.max("latest_end").alias("latest_end")).where(F.col("ref_n") >= minimum)
        self.statistics = materialize(groups, "reference-groups")
        used = self.counts.join(self.statistics.select("group"), "group", "left_semi")
        table = ordered.running(used, ["group"], DURATION, {"n": F.col("n")}, width=width)
        chunk = F.floor(F.col(DURATION) / width)
        follows = W.partitionBy("group", "_chunk").orderBy(DURATION)
        first = table.groupBy("group", chunk.alias("_chunk")).agg(F.min(DURATION).alias("first"))
        later = first.select("group", "_chunk", F.lead("first").over(W.partitionBy("group").orderBy("_chunk")).alias("later"))  # one row per chunk
        steps = table.withColumn("_chunk", chunk).join(later, ["group", "_chunk"]).select(
            "group", F.col(DURATION).alias("since"), F.coalesce(F.lead(DURATION).over(follows), "later").alias("until"), F.col("n_upto").alias("upto"))
        last = F.coalesce(F.floor((F.col("until") - 1) / width), F.floor(F.col("since") / width))
        self.steps = materialize(steps.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("since") / width), last))), "reference-steps")

    @classmethod
    def of(cls, reference: DataFrame, category_levels=CATEGORY_LEVELS, product_levels=PRODUCT_LEVELS, minimum: int = MINIMUM_PEERS) -> FrozenReference:
        return cls(_counts(reference, category_levels, product_levels), minimum, category_levels, product_levels)

    def added(self, reference: DataFrame) -> FrozenReference:
        """The index of these and further reference rows; rows already in it are not read again."""
        both = self.counts.unionByName(_counts(reference, self.category_levels, self.product_levels))
        counts = both.groupBy("group", DURATION).agg(F.sum("n").alias("n"), F.max("latest_end").alias("latest_end"))
        return FrozenReference(counts, self.minimum, self.category_levels, self.product_levels, self.width)

    def ranked(self, chosen: DataFrame) -> DataFrame:
        """``chosen`` (group, duration_s, ...) with ref_upto: members of the group that last at most as long."""
        probes = chosen.select("group", DURATION).distinct().withColumn("chunk", F.floor(F.col(DURATION) / self.width))
        step = (F.col(DURATION) >= F.col("since")) & (F.col("until").isNull() | (F.col(DURATION) < F.col("until")))
        edges = self.steps.groupBy("group").agg(F.min("since").alias("_first"))
        met = probes.join(self.steps, ["group", "chunk"], "left").where(F.col("since").isNull() | step | (F.col(DURATION) < F.col("since")))
        found = met.groupBy("group", DURATION).agg(F.max(F.when(step, F.col("upto"))).alias("upto")).join(edges, "group")
        # Outside every step: before the first member none is as short, past the last chunk all are.
        upto = F.coalesce("upto", F.when(F.col(DURATION) < F.col("_first"), F.lit(0)).otherwise(F.lit(None)))
        looked_up = found.select("group", DURATION, upto.alias("ref_upto"))
        out = chosen.join(looked_up, ["group", DURATION], "left").join(self.statistics.select("group", F.col("ref_n").alias("_all")), "group", "left")
        return out.withColumn("ref_upto", F.coalesce("ref_upto", "_all")).drop("_all")


def _counts(reference: DataFrame, category_levels, product_levels) -> DataFrame:
    bank = level_rows(reference, list(product_levels), list(category_levels), [DURATION, "ended_at"]).where(F.col(DURATION).isNotNull())
    return bank.groupBy("group", DURATION).agg(F.count(F.lit(1)).alias("n"), F.max("ended_at").alias("latest_end"))


def select_peers(rows: DataFrame, reference: DataFrame | FrozenReference, category_levels=CATEGORY_LEVELS, product_levels=(),
                 minimum: int = MINIMUM_PEERS) -> DataFrame:
    """First supported level per (order_id, stage) with the rank of its duration in that group.

    A product group is used only where a category group also qualifies, so geography is never
    dropped silently. Adds level, group, scope, ref_n, ref_sum_s, ref_upto. A frozen reference brings its own levels and minimum.
    """
    frozen = reference if isinstance(reference, FrozenReference) else None
    product_levels, category_levels = (frozen.product_levels, frozen.category_levels) if frozen else (list(product_levels), category_levels)
    if frozen:
        bank, stats = None, frozen.statistics
    else:
        bank = level_rows(reference, product_levels, category_levels, [DURATION, "ended_at"])
        stats = group_statistics(bank, minimum)
    candidates = level_rows(rows, product_levels, category_levels, ["order_id", "stage", DURATION])
    matched = candidates.join(stats, "group")
    chosen = matched.groupBy("order_id", "stage").agg(
        F.min(F.struct("level", "group", "ref_n", "ref_sum_s")).alias("_s"),
        F.max(F.col("level") >= len(product_levels)).alias("_gate"), F.first(DURATION).alias(DURATION),
    ).where("_gate").select("order_id", "stage", DURATION, F.col("_s.level").alias("level"), F.col("_s.group").alias("group"),
                            F.col("_s.ref_n").alias("n_peers"), F.col("_s.ref_sum_s").alias("ref_sum_s"))
    ranked = frozen.ranked(chosen) if frozen else ordered.ecdf(chosen, bank.select("group", DURATION), ["group"], DURATION, width=ordered.UNITS)
    scope = F.when(F.col("level") < len(product_levels), "product_context").otherwise("category_context_fallback")
    found = ranked.select("order_id", "stage", "level", "group", F.col("n_peers").alias("ref_n"), "ref_sum_s", "ref_upto",
                          scope.alias("reference_scope"))
    return rows.join(found, ["order_id", "stage"], "left")


def reference_groups(reference: DataFrame, category_levels=CATEGORY_LEVELS, minimum: int = MINIMUM_PEERS) -> DataFrame:
    """One row per supported group: size, median, P95, exact rank boundaries, latest end, member fingerprint."""
    bank = level_rows(reference, [], category_levels, ["order_id", DURATION, "ended_at"])
    stats = group_statistics(bank, minimum)
    members = bank.groupBy("group").agg(F.bit_xor(F.xxhash64("order_id")).alias("member_fingerprint"))
    distribution = ordered.ranks(bank, ["group"], DURATION, width=ordered.UNITS)
    n = F.col("n_total")
    bounds = ordered.pick_positions(distribution, ["group"], DURATION, {
        "lower_s": F.ceil(n / 20) - 1, "upper_s": F.floor(19 * n / 20)})
    points = ordered.quantiles(bank, ["group"], DURATION, {"median_days": .5, "p95_days": .95}, scale=86400, width=ordered.UNITS)
    return stats.join(bounds.drop("n_total"), "group").join(points, "group").join(members, "group").select(
        "group", "ref_n", "median_days", "p95_days", (F.col("lower_s") / 86400).alias("lower_boundary_days"),
        (F.col("upper_s") / 86400).alias("upper_boundary_days"), "latest_end", "member_fingerprint")


def stage_signals(rows: DataFrame, reference: DataFrame, minimum: int = MINIMUM_PEERS) -> DataFrame:
    """Long if rank > 0.95, short if rank < 0.05, zero note; unknown stays unknown."""
    ranked = select_peers(rows, reference, minimum=minimum)
    c, n, d = F.col("ref_upto"), F.col("ref_n"), F.col(DURATION)
    assessed = ranked.withColumn("assessment_status", tristate.first_match([
        ("source_conflict", F.col("quality_conflict")), ("endpoint_not_visible", d.isNull()),
        ("parent_complete_case_policy", ~F.col("duration_eligible")), ("context_reference_unavailable", n.isNull())], "assessable"))
    ok = F.col("assessment_status") == "assessable"
    long_stage, short_stage = ok & (d > 0) & (20 * c > 19 * n), ok & (d > 0) & (20 * c < n)
    return assessed.withColumns({
        "assessable": ok, "empirical_percentile": F.when(ok, c / n),
        "long_stage_warning": F.when(ok, long_stage), "short_stage_note": F.when(ok, short_stage),
        "zero_duration_observed": d == 0,
        "stage_signal": tristate.first_match([
            ("long_duration_warning", long_stage), ("short_duration_note", short_stage), ("zero_duration_note", ok & (d == 0)),
            ("no_tail_signal_under_reference", ok)], "not_assessable")})


def order_signals(stages: DataFrame, stage_count: int = 3) -> DataFrame:
    """Tri-state roll-up of stage flags with counts, stage lists and coverage class."""
    def flag(name):
        hits = tristate.count_true(F.col(name))
        complete = F.count(F.when(F.col("assessable"), 1)) == stage_count
        return [hits.alias(f"{name}_count"),
                F.when(hits > 0, F.lit(True)).when(complete, F.lit(False)).alias(name),
                F.array_sort(F.collect_list(F.when(F.col(name), F.col("stage")))).alias(f"{name}_stages")]
    n = F.count(F.when(F.col("assessable"), 1))
    late = F.max(F.when(F.col("performance_eligible"), F.col("performance_state") == "late"))
    out = stages.groupBy("order_id", "split").agg(
        n.alias("assessed_stage_count"), F.when(n == stage_count, "complete").when(n > 0, "partial").otherwise("unavailable")
        .alias("assessment_coverage"), *flag("long_stage_warning"), *flag("short_stage_note"),
        late.alias("calendar_late_signal"))
    primary = tristate.known_true(F.col("calendar_late_signal")) | tristate.known_true(F.col("long_stage_warning"))
    complete = F.col("calendar_late_signal").isNotNull() & (F.col("assessed_stage_count") == stage_count)
    return out.withColumn("primary_attention_status", tristate.first_match([
        ("signal_present", primary), ("no_primary_signal_under_policy", complete)], "incomplete_assessment_no_primary_signal_observed"))


def tail_score(duration: Column, upto: Column, n: Column, total: Column) -> tuple[Column, Column]:
    """Score 0-100 above the 95 % rank and above the mean, with severity by integer count comparison."""
    below = (duration * n <= total) | (duration <= 0) | (20 * upto <= 19 * n)
    score = F.when(n.isNull(), F.lit(None).cast("double")).when(below, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), 100.0 * (20 * upto - 19 * n) / n))
    severity = tristate.first_match([("unassessed", n.isNull()), ("none", below), ("low", 40 * upto <= 39 * n),
                                     ("medium", 100 * upto <= 99 * n)], "high")
    return score, severity


def stage_delay_score(rows: DataFrame, reference: DataFrame | FrozenReference, minimum: int = MINIMUM_PEERS) -> DataFrame:
    """Product context first, category context as fallback, tail score and severity."""
    ranked = select_peers(rows, reference, CATEGORY_LEVELS, PRODUCT_LEVELS, minimum)
    score, severity = tail_score(F.col(DURATION), F.col("ref_upto"), F.col("ref_n"), F.col("ref_sum_s"))
    return ranked.withColumns({
        "reference_scope": F.coalesce("reference_scope", F.lit("unavailable")), "delay_score": score, "severity": severity,
        "reference_mean_days": F.col("ref_sum_s") / F.col("ref_n") / 86400,
        "tail_resolution": F.when(F.col("ref_n") < 100, "limited_n_below_100").when(F.col("ref_n").isNotNull(), "empirical_discrete_not_probability")
        .otherwise("unavailable")}).withColumns({
        "difference_from_mean_days": F.col(DURATION) / 86400 - F.col("reference_mean_days"),
        "delay_warning": F.when(F.col("delay_score").isNotNull(), F.col("delay_score") > 0)})


def max_stage_score(scored: DataFrame, stage_count: int = 3) -> DataFrame:
    n = F.count("delay_score")
    return scored.groupBy("order_id").agg(
        n.alias("scored_stages"), F.when(n == stage_count, "complete").when(n > 0, "partial").otherwise("none").alias("score_coverage"),
        F.max("delay_score").alias("max_stage_delay_score"),
        F.coalesce(F.max_by("severity", "delay_score"), F.lit("unassessed")).alias("severity"),
        F.when(tristate.count_true(F.col("delay_warning")) > 0, F.lit(True)).when(n == stage_count, F.lit(False)).alias("delay_warning"),
        F.array_sort(F.collect_list(F.when(F.col("delay_warning"), F.col("stage")))).alias("attention_stages"),
        F.array_sort(F.collect_list(F.when(F.col("difference_from_mean_days") < 0, F.col("stage")))).alias("faster_stages"))


def product_stage_profile(reference: DataFrame) -> DataFrame:
    """Unconditioned history per product and stage over attributable orders."""
    used = reference.where("product_attributable")
    base = used.groupBy("product_id", "stage").agg(
        F.count(F.lit(1)).alias("reference_n"), (F.avg(DURATION) / 86400).alias("mean_days"),
        (F.stddev_samp(DURATION) / 86400).alias("sd_days"))
    medians = ordered.quantiles(used, ["product_id", "stage"], DURATION, {"median_days": .5}, scale=86400, width=ordered.UNITS)
    return base.join(medians, ["product_id", "stage"]).withColumn("mean_support", tristate.first_match([
        ("sparse_descriptive_only", F.col("reference_n") < MINIMUM_PEERS)], "descriptive_product_history"))


def matched_comparison(rows: DataFrame, dimension: str, fields: list[str], flag: str, minimum: int = 5) -> DataFrame:
    """Each group of ``dimension`` against all other rows with equal ``fields``, per stage.

    Other = cell total - own count, so no pairs are formed: two aggregates and one join.
    """
    keys = ["stage", *fields]
    own = rows.where(F.col(dimension).isNotNull()).groupBy(*keys, F.col(dimension).alias("group_value")).agg(
        F.count(F.lit(1)).alias("t_n"), tristate.count_true(F.col(flag)).alias("t_s"))
    cell = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), tristate.count_true(F.col(flag)).alias("s"))
    both = own.join(cell, keys).withColumns({"c_n": F.col("n") - F.col("t_n"), "c_s": F.col("s") - F.col("t_s")})
    used = (F.col("t_n") >= minimum) & (F.col("c_n") >= minimum)
    n = F.sum(F.when(used, F.col("t_n")))
    out = both.groupBy("stage", "group_value").agg(
        F.sum("t_n").alias("target_orders"), F.coalesce(n, F.lit(0)).alias("matched_target_orders"),
        F.coalesce(F.sum(F.when(used, F.col("t_s"))), F.lit(0)).alias("matched_target_signals"),
        F.coalesce(F.sum(F.when(used, F.col("c_n"))), F.lit(0)).alias("matched_comparator_orders"),
        (F.sum(F.when(used, F.col("t_s"))) / n).alias("matched_target_rate"),
        (F.sum(F.when(used, F.col("t_n") * F.col("c_s") / F.col("c_n"))) / n).alias("matched_comparator_rate"))
    return out.withColumns({
        "target_match_coverage": F.col("matched_target_orders") / F.col("target_orders"),
        "matched_rate_difference": F.col("matched_target_rate") - F.col("matched_comparator_rate")})


def investigation_gate(groups: DataFrame, min_target: int, min_comparator: int, min_coverage: float, min_signals: int) -> DataFrame:
    """Support ladder and the positive-difference candidate flag; association only."""
    status = tristate.first_match([
        ("no_supported_comparison_cells", F.col("matched_target_orders") == 0),
        ("insufficient_matched_orders", (F.col("matched_target_orders") < min_target) | (F.col("matched_comparator_orders") < min_comparator)),
        ("insufficient_match_coverage", F.col("target_match_coverage") < min_coverage)], "supported_descriptive_comparison")
    return groups.withColumn("comparison_status", status).withColumn("investigation_candidate", tristate.known_true(
        (F.col("comparison_status") == "supported_descriptive_comparison") & (F.col("matched_target_signals") >= min_signals)
        & (F.col("matched_rate_difference") > 0)))


def region_peer_comparison(rows: DataFrame, fields: list[str], region: str, minimum: int) -> DataFrame:
    """Same region vs the other regions in exact strata of ``fields``: weighted control mean per region."""
    own = rows.groupBy(*fields, region).agg(F.count(F.lit(1)).alias("t_n"), F.sum(DURATION).alias("t_sum"))
    cell = rows.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"), F.sum(DURATION).alias("s"))
    both = own.join(cell, fields).withColumns({"c_n": F.col("n") - F.col("t_n"), "c_sum": F.col("s") - F.col("t_sum")})
    used = (F.col("t_n") >= minimum) & (F.col("c_n") >= minimum)
    n = F.sum(F.when(used, F.col("t_n")))
    return both.groupBy(region).agg(
        F.sum("t_n").alias("target_total"), F.coalesce(n, F.lit(0)).alias("target_n"),
        F.coalesce(F.sum(F.when(used, F.col("c_n"))), F.lit(0)).alias("control_n"),
        F.count(F.when(used, 1)).alias("matched_cells"),
        (F.sum(F.when(used, F.col("t_sum"))) / n / 86400).alias("target_mean_days"),
        (F.sum(F.when(used, F.col("t_n") * F.col("c_sum") / F.col("c_n"))) / n / 86400).alias("control_mean_days"),
    ).withColumn("difference_days", F.col("target_mean_days") - F.col("control_mean_days"))


def context_group_stats(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per stage and each single dimension (and overall): one grouping-sets aggregate."""
    count = lambda c: F.count(F.when(c, 1))
    a, w = F.col("assessable"), tristate.known_true(F.col("long_stage_warning"))
    sets = [[F.col("stage")], *[[F.col("stage"), F.col(d)] for d in dimensions]]
    out = rows.groupingSets(sets, F.col("stage"), *[F.col(d) for d in dimensions]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total_orders"), count(a).alias("assessed_orders"),
        count(w).alias("long_stage_orders"), count(F.col("performance_eligible")).alias("comparable_orders"),
        count(F.col("performance_eligible") & (F.col("performance_state") == "late")).alias("late_orders"),
        *[count(F.col("assessment_status") == s).alias(f"{s}_orders")
          for s in ["source_conflict", "endpoint_not_visible", "context_reference_unavailable"]])
    full = (1 << len(dimensions)) - 1
    name = tristate.first_match([("overall", F.col("_g") == full),
                                 *[(d, F.col("_g") == full - (1 << (len(dimensions) - 1 - i))) for i, d in enumerate(dimensions)]])
    value = F.when(F.col("_g") == full, "all")
    for i, d in enumerate(dimensions):
        value = value.when(F.col("_g") == full - (1 << (len(dimensions) - 1 - i)), F.col(d))
    return out.select("stage", name.alias("dimension"), value.alias("group_value"), "total_orders", "assessed_orders",
                      "long_stage_orders", tristate.ratio(F.col("long_stage_orders"), F.col("assessed_orders")).alias("long_stage_rate"),
                      "comparable_orders", "late_orders", tristate.ratio(F.col("late_orders"), F.col("comparable_orders")).alias("late_rate"),
                      "source_conflict_orders", "endpoint_not_visible_orders", "context_reference_unavailable_orders")
