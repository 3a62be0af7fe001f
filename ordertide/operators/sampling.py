"""Deterministic sampling and review queues: hash order, strata, round robin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def hash_rank(seed: str, *parts: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256)


def hash_sample(df: DataFrame, seed: str, group: str, key: str, n: int) -> DataFrame:
    """The n lowest hashes of (seed, group, key) per group; top-n is taken per partition before the shuffle."""
    w = W.partitionBy(group).orderBy("_h", key)
    return df.withColumn("_h", hash_rank(seed, group, key)).withColumn("sample_rank", F.row_number().over(w).cast("long")).where(
        F.col("sample_rank") <= n).drop("_h")


def shortfall(df: DataFrame, group: str, n: int) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("available")).withColumns({
        "sampled": F.least(F.col("available"), F.lit(n)), "shortfall": F.greatest(F.lit(n) - F.col("available"), F.lit(0))})


def round_robin(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """One row per group and round by severity: no group contributes round k+1 before all gave round k."""
    w = W.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("round", F.row_number().over(w).cast("long")).where(F.col("round") <= n)
    return ranked.orderBy("round", *order).limit(n)


def stratified_equal_allocation(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """Water-filling allocation over strata with inclusion probability and weight.

    Ranks inside a stratum are by hash; taking the globally first n of (rank, stratum) fills all
    strata equally until one is exhausted.
    """
    w = W.partitionBy(stratum).orderBy("_h", key)
    ranked = df.select(key, stratum).withColumn("_h", hash_rank(seed, key)).withColumn("stratum_rank", F.row_number().over(w).cast("long")).where(
        F.col("stratum_rank") <= n)
    chosen = ranked.orderBy("stratum_rank", stratum).limit(n)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("stratum_size"))
    taken = chosen.groupBy(stratum).agg(F.count(F.lit(1)).alias("allocated"))
    return chosen.drop("_h").join(sizes.join(taken, stratum), stratum).withColumns({
        "inclusion_probability": F.col("allocated") / F.col("stratum_size"), "weight": F.col("stratum_size") / F.col("allocated")})


def nearest_boundary(df: DataFrame, margin: str, key: str, n: int) -> DataFrame:
    """The n smallest absolute margins on each side of the boundary."""
    sided = df.where(F.col(margin).isNotNull()).withColumn("side", F.when(F.col(margin) > 0, "above").otherwise("at_or_below"))
    w = W.partitionBy("side").orderBy(F.abs(F.col(margin)), key)
    return sided.withColumn("margin_rank", F.row_number().over(w).cast("long")).where(F.col("margin_rank") <= n)


def disjoint_groups(df: DataFrame, groups: list[tuple[str, Column]]) -> DataFrame:
    """First eligible group per row by declared priority, so samples never overlap."""
    chain = None
    for name, condition in groups:
        chain = F.when(condition, name) if chain is None else chain.when(condition, name)
    return df.withColumn("sample_group", chain).where("sample_group IS NOT NULL")


__all__ = ["disjoint_groups", "hash_sample", "nearest_boundary", "round_robin", "shortfall", "stratified_equal_allocation"]
