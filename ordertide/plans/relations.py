"""J01-J05, J15, J16, U, W02, W03, W07: joins, audits, set gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordertide.operators import cleaning, relations
from ordertide.plans.ctes import sql
from ordertide.plans.registry import query


@query("j01_join_checked", sql("""SELECT customer_state, order_status, count(*) AS orders, sum(total_cents)::BIGINT AS total_cents FROM ord LEFT JOIN cust USING (customer_id) GROUP BY 1,2"""))
def join_checked(shop):
    return relations.join_checked(shop.orders, shop.customers, ["customer_id"]).groupBy("customer_state", "order_status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_cents").alias("total_cents"))


RELATIONS = [("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"),
             ("lineitem.l_partkey", "lineitem", "l_partkey", "part", "p_partkey"),
             ("lineitem.l_suppkey", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
             ("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"),
             ("labels.doc_id", "labels", "doc_id", "documents", "doc_id"),
             ("events.user_id", "events", "user_id", "supplier", "s_suppkey")]


@query("j02_referential_audit", " UNION ALL ".join(f"""SELECT '{n}' AS relation, (SELECT count(*) FROM {c} WHERE {fk} IS NULL) AS null_rows,
 (SELECT count(*) FROM {c} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {p})) AS unmatched_rows,
 (SELECT count(DISTINCT {fk}) FROM {c} WHERE {fk} NOT IN (SELECT {pk} FROM {p})) AS unmatched_keys,
 (SELECT count(DISTINCT {pk}) FROM {p} WHERE {pk} NOT IN (SELECT {fk} FROM {c})) AS parent_keys_without_children,
 (SELECT count(*) FROM (SELECT {fk} FROM {c} GROUP BY 1 HAVING count(*)>1)) AS child_keys_with_multiple_rows,
 (SELECT count(*)=count(DISTINCT {pk}) FROM {p}) AS parent_key_is_unique""" for n, c, fk, p, pk in RELATIONS))
def referential_audit(shop):
    out = None
    for name, child, fk, parent, pk in RELATIONS:
        part = relations.referential_audit(name, shop.table(child), fk, shop.table(parent), pk)
        out = part if out is None else out.unionByName(part)
    return out


GATES = [("orders", ["o_orderkey"]), ("customer", ["c_custkey"]), ("part", ["p_partkey"]), ("lineitem", ["l_orderkey", "l_linenumber"])]


@query("j03_core_key_gate", " UNION ALL ".join(f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM {t} WHERE {' OR '.join(f'{k} IS NULL' for k in ks)}) AS null_key_rows,
 (SELECT count(*) FROM {t})-(SELECT count(*) FROM (SELECT DISTINCT {','.join(ks)} FROM {t})) AS duplicate_key_excess_rows,
 (SELECT count(*) FROM {t})=(SELECT count(*) FROM (SELECT DISTINCT {','.join(ks)} FROM {t})) AS passes""" for t, ks in GATES))
def core_key_gate(shop):
    out = None
    for name, keys in GATES:
        part = relations.core_key_gate(shop.table(name), name, keys)
        out = part if out is None else out.unionByName(part)
    return out


@query("j04_semi_anti_scope", """SELECT 'in_scope' AS scope, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'out_of_scope', count(*), sum(n_chars)::BIGINT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def semi_anti(shop):
    docs, labels = shop.table("documents").select("doc_id", "n_chars"), shop.table("labels")
    parts = [f(docs, labels, "doc_id").agg(F.lit(n).alias("scope"), F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
             for n, f in [("in_scope", relations.in_scope), ("out_of_scope", relations.out_of_scope)]]
    return parts[0].unionByName(parts[1])


@query("j05_full_outer_reconcile", """
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders WHERE o_orderpriority<>'1-URGENT'),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority='2-HIGH' THEN 'X' ELSE o_orderstatus END AS s, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders WHERE o_orderpriority<>'3-MEDIUM')
SELECT coalesce(a.k,b.k) AS k, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS presence,
 concat_ws(',', CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END, CASE WHEN a.v IS DISTINCT FROM b.v THEN 'v' END) AS differing_columns
FROM a FULL OUTER JOIN b ON a.k=b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s<>b.s OR a.v<>b.v""")
def full_outer(shop):
    o = shop.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"),
                                    F.round("o_totalprice").cast("long").alias("v"), "o_orderpriority")
    a = o.where("o_orderpriority <> '1-URGENT'")
    b = o.where("o_orderpriority <> '3-MEDIUM'").withColumn("s", F.when(F.col("o_orderpriority") == "2-HIGH", "X").otherwise(F.col("s")))
    return relations.reconcile(a, b, "k", ["s", "v"]).withColumn("differing_columns", F.array_join("differing_columns", ","))


@query("j15_latest_per_order", sql("""
WITH m AS (SELECT order_id, max(answered_s) AS t FROM rev GROUP BY 1), l AS (SELECT r.order_id, m.t, count(*) AS n, count(DISTINCT score) AS d, max(score) AS s FROM rev r JOIN m ON r.order_id=m.order_id AND r.answered_s=m.t GROUP BY 1,2)
SELECT order_id, t AS latest_answered_s, n AS rows_at_latest, d>1 AS conflicting, CASE WHEN d=1 THEN s END AS score FROM l"""))
def latest(shop):
    return relations.latest_per_key(shop.reviews, "order_id", "answered_s", "score")


@query("j16_entity_links", """SELECT l_orderkey AS order_id, l_suppkey AS seller_id, count(*) AS item_rows FROM lineitem GROUP BY 1,2""")
def entity_links(shop):
    return relations.entity_links(shop.items, "seller_id")


@query("u01_union_evidence", """SELECT 'label' AS kind, doc_id AS id, quality::BIGINT AS score, NULL::VARCHAR AS note FROM labels
UNION ALL SELECT 'document', doc_id, NULL, lang FROM documents""")
def union_evidence(shop):
    a = shop.table("labels").select(F.lit("label").alias("kind"), F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("score"))
    b = shop.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("lang").alias("note"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_set_gates", """WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents WHERE lang='en')
SELECT (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS only_a, (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) AS only_b,
 (SELECT count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM b)) AS shared,
 (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b))+(SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a))=0 AS equal_sets,
 (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b))=0 AS a_within_b, (SELECT count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM b))=0 AS disjoint""")
def set_gates(shop):
    return relations.set_gates(shop.table("labels"), shop.table("documents").where("lang = 'en'"), "doc_id")


@query("u03_symmetric_disagreement", "SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels WHERE quality<>toxic")
def disagreement(shop):
    return relations.disagreements(shop.table("labels").select("doc_id", F.col("quality").cast("long").alias("quality"),
                                                               F.col("toxic").cast("long").alias("toxic")), F.col("quality"), F.col("toxic"))


@query("w02_partition_counts", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS seller_rows FROM lineitem")
def partition_counts(shop):
    df = shop.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return cleaning.group_size(df, ["l_suppkey"], "seller_rows").drop("l_suppkey")


@query("w03_rank_ties", """SELECT l_suppkey, lines, rank() OVER (ORDER BY lines DESC) AS rnk FROM (SELECT l_suppkey, count(*) AS lines FROM lineitem GROUP BY 1)""")
def rank_ties(shop):
    from ordertide.operators import ordered
    per = shop.table("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    return ordered.ranks(per, [], "lines", width=ordered.UNITS, descending=True).select(
        "lines", (F.col("n_before") + 1).alias("rnk")).join(per, "lines").select("l_suppkey", "lines", "rnk")


@query("w04_cumcount_rank", """SELECT o_orderkey, o_orderstatus, month, rn FROM (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate,'%Y-%m') AS month,
 row_number() OVER (PARTITION BY o_orderstatus, strftime(o_orderdate,'%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)""")
def cumcount(shop):
    from ordertide.operators import ordered
    keys = ["o_orderstatus", "month"]
    df = shop.table("orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month"),
                                     F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    # Rows before each price, from chunks of the price axis; the window only orders rows of one price.
    before = ordered.ranks(df, keys, "cents", width=ordered.UNITS, descending=True).select(*keys, "cents", "n_before")
    ties = F.row_number().over(W.partitionBy(*keys, "cents").orderBy("o_orderkey"))
    return df.join(before, [*keys, "cents"]).select("o_orderkey", *keys, (F.col("n_before") + ties).cast("long").alias("rn"))


@query("w07_first_n_per_group", sql("""SELECT usage_group, order_id FROM (SELECT usage_group, order_id, row_number() OVER (PARTITION BY usage_group ORDER BY order_id) AS rn FROM grouped) WHERE rn<=2"""))
def first_n(shop):
    from ordertide.plans.cleaning import scoped
    return cleaning.first_n(scoped(shop), ["usage_group"], [F.col("order_id")], 2).select("usage_group", "order_id")
