"""S: readers, writers, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.plans.ctes import sql
from ordertide.plans.registry import query
from ordertide.session import new_run_folder
from ordertide.sources import tables

ORDER_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("order_status", T.StringType()),
    T.StructField("purchased_at", T.TimestampNTZType()), T.StructField("delivered_at", T.TimestampNTZType()),
    T.StructField("total_cents", T.LongType())])


@query("s01_read_declared", sql("""
SELECT order_status, count(*) AS orders, count(delivered_at) AS delivered_rows, sum(total_cents)::BIGINT AS total_cents,
 min(purchased_at) AS first_purchase, max(delivered_at) AS last_delivery FROM ord GROUP BY 1"""))
def read_declared(shop):
    path = new_run_folder(shop.spark, "orders-csv")
    shop.orders.select(*ORDER_SCHEMA.names).write.option("header", True).csv(path)
    df = tables.read_declared(shop.spark, path, ORDER_SCHEMA)
    return df.groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"), F.count("delivered_at").alias("delivered_rows"),
        F.sum("total_cents").alias("total_cents"), F.min("purchased_at").alias("first_purchase"),
        F.max("delivered_at").alias("last_delivery"))


@query("s02_read_mapped", sql("""
SELECT order_id::VARCHAR AS order_id, order_status, strftime(purchased_at,'%Y-%m-%d %H:%M:%S') AS purchased_at, '' AS split, false AS ragged FROM ord"""))
def read_mapped(shop):
    path = new_run_folder(shop.spark, "mapped-csv")
    shop.orders.select(F.col("order_id").alias("Pedido"), F.col("order_status").alias("Estado"),
                       F.date_format("purchased_at", "yyyy-MM-dd HH:mm:ss").alias("Compra")).write.option(
        "header", True).option("sep", ";").csv(path)
    return tables.read_mapped(shop.spark, path, {"order_id": "Pedido", "order_status": "Estado", "purchased_at": "Compra",
                                                 "split": None}, ["Pedido", "Estado", "Compra"], sep=";").drop("raw_record")


@query("s03_scan_filtered", sql("""
SELECT l_returnflag, count(*) AS lines, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='F') GROUP BY 1"""))
def scan_filtered(shop):
    keys = shop.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.scan_filtered(shop.table("lineitem"), "l_orderkey", keys).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


SNAPSHOT_SQL = """
SELECT 'orders' AS table_name, count(*) AS rows, sum(o_orderkey)::BIGINT AS key_sum FROM orders
UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT FROM customer"""


def _snapshot(shop):
    path = new_run_folder(shop.spark, "snapshot")
    frames = {"orders": shop.table("orders"), "customer": shop.table("customer")}
    return path, frames, tables.write_snapshot(frames, path)


@query("s04_read_snapshot", SNAPSHOT_SQL)
def read_snapshot(shop):
    path, frames, _ = _snapshot(shop)
    parts = [tables.read_snapshot(shop.spark, path, name, frames[name].schema, [key]).agg(
        F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.sum(key).alias("key_sum"))
        for name, key in [("orders", "o_orderkey"), ("customer", "c_custkey")]]
    return parts[0].unionByName(parts[1])


@query("s05_write_snapshot", """
SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer""")
def write_snapshot(shop):
    _, _, manifest = _snapshot(shop)
    return manifest.select("table_name", "rows")


INVENTORY = [("orders", ["o_orderkey"]), ("customer", ["c_custkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]),
             ("labels", ["doc_id"])]


def _inventory_sql(table, keys, columns):
    null_key = " OR ".join(f"{k} IS NULL" for k in keys)
    head = (f"SELECT '{table}' AS table_name, (SELECT count(*) FROM {table}) AS rows, {len(columns)}::BIGINT AS columns, "
            f"(SELECT count(*) FROM {table})-(SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS exact_duplicate_excess_rows, "
            f"(SELECT count(*) FROM {table} WHERE {null_key}) AS null_key_rows, "
            f"(SELECT count(*) FROM {table})-(SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {table})) AS duplicate_key_excess_rows, ")
    return " UNION ALL ".join(head + f"'{c}' AS column_name, (SELECT count(*) FROM {table} WHERE {c} IS NULL) AS missing_cells"
                              for c in columns)


COLUMNS = {"orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
           "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(),
           "lineitem": ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                        "l_returnflag l_linestatus l_shipdate").split(),
           "labels": "doc_id quality toxic".split()}


@query("s08_table_inventory", " UNION ALL ".join(_inventory_sql(t, k, COLUMNS[t]) for t, k in INVENTORY))
def table_inventory(shop):
    out = None
    for name, keys in INVENTORY:
        part = tables.table_inventory(name, shop.table(name), keys)
        out = part if out is None else out.unionByName(part)
    return out
