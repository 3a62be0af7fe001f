"""ZIP representatives, order-seller distances, geographic quality screen and context."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import geo, tristate
from ordertide.operators import ordered
from ordertide.session import materialize

DEGREE_CHUNK, KM_CHUNK = 0.001, 0.01
SPREADS = ["spread_p50_km", "spread_p90_km", "spread_max_km"]


def zip_representative(points: DataFrame) -> DataFrame:
    """Per ZIP the observed point nearest to the median (and mean) anchor, and spreads around it.

    points: (record, zip, lat, lng, state). All steps are aggregates or chunked order statistics, so
    a ZIP with any number of points is spread over tasks; the nearest point is a min over structs.
    """
    valid = geo.valid_coordinate(F.col("lat"), F.col("lng"))
    support = points.groupBy("zip").agg(
        F.count(F.lit(1)).alias("coordinate_rows"), F.count(F.when(valid, 1)).alias("valid_rows"),
        F.count(F.when(~valid, 1)).alias("invalid_rows"), F.count_distinct("state").alias("state_count"),
        F.min("state").alias("first_state"))
    unique = points.where(valid).groupBy("zip", "lat", "lng").agg(F.min("record").alias("record"))
    anchors = unique.groupBy("zip").agg(F.avg("lat").alias("mean_lat"), F.avg("lng").alias("mean_lng"),
                                        F.count(F.lit(1)).alias("unique_points"))
    medians = ordered.quantiles(unique, ["zip"], "lat", {"med_lat": .5}, width=DEGREE_CHUNK).join(
        ordered.quantiles(unique, ["zip"], "lng", {"med_lng": .5}, width=DEGREE_CHUNK), "zip")
    with_anchor = unique.join(anchors.join(medians, "zip"), "zip")
    near = lambda p: F.struct(
        geo.haversine_km(F.col("lat"), F.col("lng"), F.col(f"{p}_lat"), F.col(f"{p}_lng")).alias("d"), "lat", "lng", "record")
    chosen = with_anchor.groupBy("zip").agg(F.min(near("med")).alias("r"), F.min(near("mean")).alias("m"),
                                            F.max("unique_points").alias("unique_points"))
    spread = unique.join(chosen.select("zip", "r"), "zip").select(
        "zip", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("r.lat"), F.col("r.lng")).alias("km"))
    spreads = ordered.quantiles(spread, ["zip"], "km", {"spread_p50_km": .5, "spread_p90_km": .9, "spread_max_km": 1.0},
                                width=KM_CHUNK)
    return support.join(chosen, "zip", "left").join(spreads, "zip", "left").select(
        "zip", "coordinate_rows", "valid_rows", "invalid_rows", "state_count", "first_state",
        F.coalesce("unique_points", F.lit(0)).alias("unique_points"),
        F.col("r.lat").alias("latitude"), F.col("r.lng").alias("longitude"), F.col("r.record").alias("representative_record"),
        F.col("r.d").alias("median_anchor_offset_km"), F.col("m.lat").alias("mean_latitude"), F.col("m.lng").alias("mean_longitude"),
        F.col("m.record").alias("mean_record"), *SPREADS,
        geo.haversine_km(F.col("r.lat"), F.col("r.lng"), F.col("m.lat"), F.col("m.lng")).alias("sensitivity_km"))


def seller_customer_distance(pairs: DataFrame, zips: DataFrame) -> DataFrame:
    """Order-seller pairs with distances under both representative policies and the spread envelope."""
    cols = ["latitude", "longitude", "mean_latitude", "mean_longitude", "spread_max_km"]
    out = pairs
    for role in ["customer", "seller"]:
        side = zips.select(F.col("zip").alias(f"{role}_zip"), F.when(F.col("latitude").isNotNull(), "available")
                           .otherwise("no_valid_coordinates").alias(f"{role}_availability"),
                           *[F.col(c).alias(f"{role}_{c}") for c in cols])
        out = out.join(side, f"{role}_zip", "left").withColumn(
            f"{role}_availability", F.coalesce(f"{role}_availability", F.lit("missing_zip")))
    c = lambda role, name: F.col(f"{role}_{name}")
    km = geo.haversine_km(c("seller", "latitude"), c("seller", "longitude"), c("customer", "latitude"), c("customer", "longitude"))
    mean_km = geo.haversine_km(c("seller", "mean_latitude"), c("seller", "mean_longitude"),
                               c("customer", "mean_latitude"), c("customer", "mean_longitude"))
    reason = F.array_join(F.filter(F.array(*[F.when(c(r, "availability") != "available", F.concat(F.lit(f"{r}:"), c(r, "availability")))
                                             for r in ["customer", "seller"]]), lambda x: x.isNotNull()), ";")
    spread = c("customer", "spread_max_km") + c("seller", "spread_max_km")
    return out.withColumns({"distance_km": km, "mean_anchor_distance_km": mean_km}).withColumns({
        "distance_available": F.col("distance_km").isNotNull(), "same_zip": F.col("customer_zip") == F.col("seller_zip"),
        "distance_sensitivity_km": F.abs(F.col("distance_km") - F.col("mean_anchor_distance_km")),
        "envelope_lower_km": F.greatest(F.col("distance_km") - spread, F.when(F.col("distance_km").isNotNull(), 0.0)),
        "envelope_upper_km": F.least(F.col("distance_km") + spread, F.when(F.col("distance_km").isNotNull(), math.pi * geo.RADIUS_KM)),
        "unavailable_reason": F.when(reason == "", "none").otherwise(reason)})


def order_geo_rollup(pairs: DataFrame) -> DataFrame:
    """Order distances, null unless every seller of the order is geocoded."""
    every = F.bool_and(F.col("distance_available"))
    weighted = F.sum(F.col("distance_km") * F.col("item_rows")) / F.sum("item_rows")
    reasons = F.array_sort(F.collect_set(F.when(F.col("unavailable_reason") != "none", F.col("unavailable_reason"))))
    return pairs.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("seller_pairs"), F.count(F.when(F.col("distance_available"), 1)).alias("geocoded_pairs"),
        F.count(F.when(F.col("same_zip"), 1)).alias("same_zip_pairs"), every.alias("all_sellers_geocoded"),
        F.when(every, F.max("distance_km")).alias("distance_max_km"), F.when(every, weighted).alias("distance_weighted_mean_km"),
        F.when(every, F.abs(F.max("distance_km") - F.max("mean_anchor_distance_km"))).alias("distance_max_sensitivity_km"),
        F.array_join(reasons, ";").alias("unavailable_reasons"))


def quality_thresholds(zips: DataFrame, eligible: Column) -> DataFrame:
    """Fit-only dispersion limits expm1(Q75 + 3 IQR) on the log scale: one row, three columns."""
    out = None
    for name in SPREADS:
        logs = zips.where(eligible & F.col(name).isNotNull()).select(F.log1p(name).alias("v"))
        q = ordered.quantiles(logs, [], "v", {"a": .25, "b": .75}, width=0.001)
        limit = q.select(F.expm1(F.col("b") + 3 * (F.col("b") - F.col("a"))).alias(f"limit_{name}"))
        out = limit if out is None else ordered.attach_one_row(out, limit)
    return out


def quality_screen(zips: DataFrame, limits: DataFrame, minimum_points: int) -> DataFrame:
    """Structural checks plus frozen dispersion limits; every failed check is named."""
    joined = ordered.attach_one_row(zips, limits)
    checks = [("coordinates_unavailable", F.col("latitude").isNull()),
              ("insufficient_coordinate_support", F.col("unique_points") < minimum_points),
              ("has_invalid_coordinate_rows", F.col("invalid_rows") > 0),
              ("ambiguous_or_missing_source_state", F.col("state_count") != 1),
              *[(f"high_{n}", tristate.known_true(F.col(n) > F.col(f"limit_{n}"))) for n in SPREADS]]
    return joined.withColumn("reasons", tristate.reasons(checks)).withColumn(
        "zip_quality_eligible", F.size("reasons") == 0)


def pair_quality(pairs: DataFrame, screened: DataFrame) -> DataFrame:
    out = pairs
    for role in ["customer", "seller"]:
        side = screened.select(F.col("zip").alias(f"{role}_zip"), F.col("zip_quality_eligible").alias(f"{role}_ok"))
        out = out.join(side, f"{role}_zip", "left").withColumn(f"{role}_ok", tristate.known_true(F.col(f"{role}_ok")))
    return out.withColumn("pair_quality_eligible", F.col("distance_available") & F.col("customer_ok") & F.col("seller_ok"))


def order_quality(pairs: DataFrame) -> DataFrame:
    every = F.bool_and("pair_quality_eligible")
    return pairs.groupBy("order_id").agg(
        every.alias("all_pairs_quality_eligible"), F.count(F.lit(1)).alias("total_pairs"),
        F.count(F.when(F.col("pair_quality_eligible"), 1)).alias("eligible_pairs"),
        F.when(every, F.max("distance_km")).alias("screened_distance_max_km"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, **chunking) -> DataFrame:
    """Rank correlation with average ranks; null without variation or with fewer than three pairs."""
    # Read by both rankings and by the correlation: one narrow written table.
    pairs = materialize(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y), "ranked-pairs")
    ranked = pairs
    for c in [x, y]:
        r = ordered.ranks(pairs, keys, c, **chunking).select(*keys, c, (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"_r_{c}"))
        ranked = ranked.join(r, [*keys, c])
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paired_orders"),
        F.when((F.count(F.lit(1)) >= 3) & (F.min(x) != F.max(x)) & (F.min(y) != F.max(y)),
               F.corr(f"_r_{x}", f"_r_{y}")).alias("spearman_rho"))
