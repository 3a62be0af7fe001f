"""Joins with a declared cardinality, key and reference audits, reconciliation, set gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import tristate
from ordertide.sources.tables import duplicate_keys


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                 cardinality: str = "many_to_one") -> DataFrame:
    """Equi join that refuses a repeated key on a side declared unique. Strategy is left to AQE."""
    left_side, right_side = cardinality.split("_to_")
    for side, name, df in [(left_side, "left", left), (right_side, "right", right)]:
        if side == "one" and not duplicate_keys(df, on).isEmpty():
            raise ValueError(f"{name} side repeats its key {on} in a {cardinality} join")
    return left.join(right, on, how)


def referential_audit(name: str, child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """One audit row per foreign key. Both sides are counted per key before they meet."""
    children = child.groupBy(F.col(fk).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    parents = parent.groupBy(F.col(pk).alias("k")).agg(F.count(F.lit(1)).alias("p"))
    both = children.where("k IS NOT NULL").join(parents.where("k IS NOT NULL"), "k", "full_outer")
    totals = both.agg(
        F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("c"))), F.lit(0)).alias("unmatched_rows"),
        F.count(F.when(F.col("p").isNull(), 1)).alias("unmatched_keys"),
        F.count(F.when(F.col("c").isNull(), 1)).alias("parent_keys_without_children"),
        F.count(F.when(F.col("c") > 1, 1)).alias("child_keys_with_multiple_rows"),
        (F.coalesce(F.max("p"), F.lit(0)) <= 1).alias("parent_key_is_unique"))
    missing = child.agg(F.count(F.when(F.col(fk).isNull(), 1)).alias("null_rows"))
    return totals.join(F.broadcast(missing), how="cross").select(
        F.lit(name).alias("relation"), "null_rows", "unmatched_rows", "unmatched_keys",
        "parent_keys_without_children", "child_keys_with_multiple_rows", "parent_key_is_unique")


def core_key_gate(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Key defects of a table and whether it may be used as a parent or fact key."""
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).alias("null_key_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_key_excess_rows"),
    ).select(F.lit(name).alias("table_name"), "null_key_rows", "duplicate_key_excess_rows",
             ((F.col("null_key_rows") == 0) & (F.col("duplicate_key_excess_rows") == 0)).alias("passes"))


def require_core_keys(gate: DataFrame) -> None:
    failing = gate.where(~F.col("passes"))
    if not failing.isEmpty():
        raise ValueError(f"core key gate failed: {failing.first().asDict()}")


def in_scope(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def out_of_scope(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer comparison: presence and the list of differing columns, only for differing keys."""
    a = left.select(F.col(key), *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("_l"))
    b = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    both = a.join(b, key, "full_outer")
    state = tristate.first_match([("right_only", F.col("_l").isNull()), ("left_only", F.col("_r").isNull())], "both")
    different = tristate.reasons([(c, ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))) for c in columns])
    return both.select(key, state.alias("presence"), different.alias("differing_columns")).where(
        (F.col("presence") != "both") | (F.size("differing_columns") > 0))


def set_gates(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Equality, subset and disjointness of two id sets from one merge of distinct ids."""
    ids = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(
        b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full_outer")
    return ids.agg(
        F.count(F.when(F.col("in_b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("in_a").isNull(), 1)).alias("only_b"),
        F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("shared"),
    ).select("only_a", "only_b", "shared",
             ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal_sets"),
             (F.col("only_a") == 0).alias("a_within_b"), (F.col("shared") == 0).alias("disjoint"))


def disagreements(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Rows where two known flags differ."""
    return df.where(left != right)


def latest_per_key(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Value at the latest time per key; conflicting values at that time are flagged, not resolved.

    max(struct) style aggregates combine map-side: the latest time, then the spread at that time.
    """
    at_time = df.groupBy(key, time).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                        F.count(F.lit(1)).alias("rows_at_latest"))
    last = at_time.groupBy(key).agg(F.max_by(F.struct("_lo", "_hi", "rows_at_latest"), time).alias("s"),
                                    F.max(time).alias(f"latest_{time}"))
    conflict = F.col("s._lo") != F.col("s._hi")
    return last.select(key, f"latest_{time}", F.col("s.rows_at_latest").alias("rows_at_latest"),
                       F.coalesce(conflict, F.lit(False)).alias("conflicting"),
                       F.when(~F.coalesce(conflict, F.lit(False)), F.col("s._hi")).alias(value))


def entity_links(items: DataFrame, entity: str) -> DataFrame:
    return items.groupBy("order_id", entity).agg(F.count(F.lit(1)).alias("item_rows"))
