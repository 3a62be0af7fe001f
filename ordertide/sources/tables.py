"""Batch readers and writers: declared schemas, mapped imports, snapshots, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def validate_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Unknown, missing or differently typed columns fail; nullability is not compared."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in expected.fields}
    if have != want:
        missing, extra = sorted(set(want) - set(have)), sorted(set(have) - set(want))
        typed = sorted(n for n in set(want) & set(have) if want[n] != have[n])
        raise ValueError(f"schema differs: missing={missing} extra={extra} type={typed}")
    return df.select(*[f.name for f in expected.fields])


def read_declared(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Fixed schema, no inference and no NA guessing. CSV headers are checked against the schema."""
    if fmt == "parquet":
        return validate_schema(spark.read.parquet(path), schema)
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("nullValue", "").option("emptyValue", "").option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path))


def read_mapped(spark: SparkSession, path: str, columns: dict[str, str | None], source_columns: list[str],
                sep: str = ",") -> DataFrame:
    """Foreign delimited file to canonical fields, all strings; ragged records keep their raw text.

    ``columns`` maps canonical name -> source name (None = absent, read as empty string).
    """
    unknown = sorted({s for s in columns.values() if s} - set(source_columns))
    if unknown:
        raise ValueError(f"mapped columns missing in the source: {unknown}")
    if len(set(source_columns)) != len(source_columns):
        raise ValueError("duplicate header names")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*source_columns, CORRUPT]])
    raw = (spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).option("escape", '"').csv(path))
    return raw.select(
        *[F.coalesce(F.col(s), F.lit("")).alias(c) if s else F.lit("").alias(c) for c, s in columns.items()],
        F.col(CORRUPT).isNotNull().alias("ragged"), F.col(CORRUPT).alias("raw_record"))


def scan_filtered(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is in a key set; a semi join, broadcast only when Spark measures it small."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def table_inventory(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, columns, duplicate excess, key defects and missing cells of one table, long over columns.

    Duplicates are found by grouping on all columns first, so no set of rows sits in one buffer.
    """
    columns = df.columns
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    distinct_rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    per_row = distinct_rows.agg(
        F.sum("_n").alias("rows"), (F.sum("_n") - F.count(F.lit(1))).alias("exact_duplicate_excess_rows"),
        F.coalesce(F.sum(F.when(null_key, F.col("_n"))), F.lit(0)).alias("null_key_rows"),
        *[F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"_m{i}")
          for i, c in enumerate(columns)])
    per_key = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_x")).agg(
        F.coalesce(F.sum("_x"), F.lit(0)).alias("duplicate_key_excess_rows")) if keys else None
    pieces = ", ".join(f"'{c}', _m{i}" for i, c in enumerate(columns))
    joined = per_row.join(F.broadcast(per_key), how="cross") if keys else per_row.withColumn(
        "duplicate_key_excess_rows", F.lit(None).cast("long"))
    return joined.select(
        F.lit(name).alias("table_name"), "rows", F.lit(len(columns)).cast("long").alias("columns"),
        "exact_duplicate_excess_rows",
        (F.col("null_key_rows") if keys else F.lit(None).cast("long")).alias("null_key_rows"),
        "duplicate_key_excess_rows",
        F.expr(f"stack({len(columns)}, {pieces}) AS (column_name, missing_cells)"))


def fingerprint(name: str, df: DataFrame) -> DataFrame:
    """Row count and order-insensitive content hash of a table."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"),
                  F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("hash_sum"))


def write_snapshot(frames: dict[str, DataFrame], path: str) -> DataFrame:
    """Immutable versioned tables plus a manifest; an existing snapshot is never overwritten."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    manifest = None
    for name in frames:
        part = fingerprint(name, spark.read.parquet(f"{path}/{name}")).withColumn(
            "schema_ddl", F.lit(frames[name].schema.json()))
        manifest = part if manifest is None else manifest.unionByName(part)
    manifest.write.mode("errorifexists").parquet(f"{path}/_snapshot_manifest")
    return spark.read.parquet(f"{path}/_snapshot_manifest")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_snapshot(spark: SparkSession, path: str, name: str, schema: T.StructType,
                  keys: list[str] | None = None) -> DataFrame:
    """Reader that applies the recorded schema, reconciles row count and content, and checks the key."""
    df = validate_schema(spark.read.parquet(f"{path}/{name}"), schema)
    recorded = spark.read.parquet(f"{path}/_snapshot_manifest").where(F.col("table_name") == name)
    now = fingerprint(name, df)
    if not recorded.select(*now.columns).exceptAll(now).isEmpty() or recorded.isEmpty():
        raise ValueError(f"snapshot table {name} differs from its manifest")
    if keys and not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"snapshot table {name} repeats its key {keys}")
    return df
