"""URL filtering with mined association rules.

A url is a set of tokens: parts of its host, path segments (numbers and long ids as one kind each), its extension and
query keys. Labelled urls become transactions of their tokens and one label item; Spark's FP-growth finds the frequent
combinations, and rules that lead to the bad label with enough confidence and support are kept, without those that a
shorter kept rule implies. Rules are matched through an inverted index: each rule is filed under its rarest token, so
a url meets only the rules filed under one of its own tokens, and is blocked if it holds all tokens of one.

Everything is DataFrame expressions and Spark ML; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.text import table

BAD = "label:bad"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_ROWS = 0.002, 0.8, 5
#: Fixed values of the specification: (verdict, host, path).
LISTED = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
          ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def url_parts(url):
    """Host and path of a url column; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = F.coalesce(at > 0, F.lit(False))
    return (F.when(known, lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise(""),
            F.when(known, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(""))


def listed_rule(host, path):
    """Longest listed rule that fits, as host and path in one string, and its verdict; null where none fits."""
    ordered = sorted(LISTED, key=lambda r: -len(r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def tokens(url, host, path):
    """Distinct tokens of a url: what a rule can be made of."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffix = F.when(F.size(labels) >= 2, F.concat_ws(".", F.slice(labels, -2, 2)))
    segments = F.transform(F.filter(F.split(lower_ascii(path), "/"), lambda x: x != ""), lambda x: F.when(
        x.rlike(r"^\d+"), F.concat(F.lit("path:#"), F.regexp_extract(x, r"(\.[a-z]{1,5})$", 1))).when(
        F.length(x) > 24, F.lit("path:long")).otherwise(F.concat(F.lit("path:"), x)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, r"^([^=]*)", 1)))
    scheme = F.concat(F.lit("scheme:"), F.regexp_extract(lower_ascii(url), r"^([a-z]*)://", 1))
    fragment = F.when(F.instr(url, "#") > 0, F.lit("fragment"))
    words = F.filter(F.split(host, r"[.\-_]+"), lambda x: ~x.rlike(r"^\d*$"))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(
        F.transform(words, lambda x: F.concat(F.lit("host:"), x)), F.array(F.concat(F.lit("site:"), suffix)), segments, keys,
        F.array(scheme, fragment)))))


def mine_rules(transactions: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_rows: int = MIN_ROWS) -> DataFrame:
    """Rules (antecedent, confidence, support, rows) that lead to the bad label.

    ``transactions`` has an ``items`` array of distinct tokens, with the item ``label:bad`` for bad rows. Rules implied
    by a kept rule with a part of their tokens are pruned. Mining is bounded by the support threshold.
    """
    n = transactions.count()
    spark = transactions.sparkSession
    empty = spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    if not n:
        return empty
    least = min(1.0, max(min_support, min_rows / n))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(transactions)
    rules = (model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD))
             .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    # A longer rule is implied by a shorter one with a subset of its tokens: look its subsets without one token up.
    cut = rules.select("antecedent", F.explode("antecedent").alias("without")).select(
        "antecedent", F.array_remove("antecedent", F.col("without")).alias("shorter"))
    implied = cut.join(rules.select(F.col("antecedent").alias("shorter")), "shorter", "left_semi").select("antecedent").distinct()
    return rules.join(implied, "antecedent", "left_anti")


def inverted_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each rule under its rarest token among ``urls`` (items): token, antecedent, confidence."""
    spread = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    used = urls.select(F.explode("items").alias("token")).groupBy("token").count()
    rarest = spread.join(used, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("count", "token")).alias("token"),
                                                                  F.max("confidence").alias("confidence"))
    return rarest.select("token", "antecedent", "confidence")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Confidence and tokens of the best rule that each distinct url (url, items) meets; urls without a match are left out."""
    index = inverted_index(rules, urls)
    met = (urls.select("url", "items", F.explode("items").alias("token")).join(index, "token")
           .where(F.size(F.array_except("antecedent", "items")) == 0))
    return met.groupBy("url").agg(F.max(F.struct("confidence", "antecedent")).alias("best")).select("url", "best.*")


def judge_urls(pages: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """page_id, host, path, rule and verdict of each page, with the mined rule that decided where none is listed.

    ``labels`` (doc_id, quality, toxic) label the pages of the same id: bad if toxic or of quality 0. Null labels, null
    ids and null urls are not learned from. A page without a matching rule is allowed; repeated urls are judged once and
    repeated rows each get the verdict; without labels only the listed rules decide.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    urls = parts.where("url is not null").select("url", "host", "path").distinct()
    urls = urls.select("url", tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"))
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    items = tokens(F.col("url"), F.col("host"), F.col("path"))
    learned = (parts.where("url is not null").join(known, F.col("page_id") == F.col("doc_id")).select(
        F.when(F.col("bad") == 1, F.array_append(items, F.lit(BAD))).otherwise(items).alias("items")))
    blocked = match_rules(urls, mine_rules(learned, **limits))
    name, verdict = listed_rule(F.col("host"), F.col("path"))
    out = parts.join(blocked, "url", "left")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(
        verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.concat_ws(" ", "antecedent").alias("mined_rule"), "confidence")


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
