"""Review wording screen and per-order review evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import tristate
from ordertide.operators.cleaning import fold_accents

# Wording patterns over accent-folded lower-case Portuguese text.
PATTERNS = {
    "delivery_topic": r"\b(?:entreg\w*|receb\w*|cheg\w*|prazo\w*|correios|transportador\w*)\b",
    "delay_wording": r"\b(?:atras\w*|demor\w*)\b",
    "nonreceipt_wording": r"\bnao\s+(?:(?:o|a|os|as|ainda)\s+)?(?:recebi|recebemos|recebeu|chegou|chegaram|foi entregue|foram entregues)\b",
    "on_time_or_early_wording": r"\b(?:antes do prazo|antes da data|dentro do prazo|no prazo|adiantad\w*|antecipad\w*|rapid[oa]s?)\b",
    "negated_delay_wording": r"\b(?:sem\s+(?:atras\w*|demor\w*)|nao\s+(?:houve\s+)?(?:atras\w*|demor\w*))\b",
}


def matches(folded: Column, pattern: str) -> Column:
    """All whole matches of a pattern in already folded text."""
    return F.regexp_extract_all(folded, F.lit(f"({pattern})"), F.lit(1))


def screen_review_text(df: DataFrame, fields: list[str], patterns: dict[str, str] = PATTERNS,
                       mixed: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Adds per kind a match count over all fields, and whether contradicting kinds occur together.

    The folded text is computed once per field and whole texts are searched.
    """
    folded = df.withColumns({f"_f{i}": fold_accents(F.coalesce(F.col(f), F.lit(""))) for i, f in enumerate(fields)})
    counts = {k: reduce(lambda a, b: a + b, [F.size(matches(F.col(f"_f{i}"), p)) for i in range(len(fields))]).cast("long")
              for k, p in patterns.items()}
    out = folded.withColumns(counts).drop(*[f"_f{i}" for i in range(len(fields))])
    first, second = mixed or (["delay_wording", "nonreceipt_wording"], ["on_time_or_early_wording", "negated_delay_wording"])
    hit = lambda names: reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names])
    return out.withColumns({"mixed_wording": hit(first) & hit(second),
                            "wording_status": F.when(hit(list(patterns)), "literal_matches_need_reading")
                            .otherwise("no_listed_phrase_not_a_negative_label")})


def literal_matches(df: DataFrame, key: str, fields: list[str], patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """One row per match: key, field, kind, its number within (field, kind) from 0, and the folded text that matched."""
    def entries(field: str, kind: str) -> Column:
        return F.transform(matches(F.col(f"_f_{field}"), patterns[kind]), lambda m, i: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"),
                                                                                    i.cast("long").alias("match_no"), m.alias("normalized_match")))

    found = F.concat(*[entries(f, k) for f in fields for k in patterns])
    # A null field has no match and must not hide those of the others.
    folded = df.select(key, *[fold_accents(F.coalesce(F.col(f), F.lit(""))).alias(f"_f_{f}") for f in fields])
    return folded.select(key, F.inline(found))


def aggregate_reviews(reviews: DataFrame, kinds: list[str]) -> DataFrame:
    """Per order: usable counts, score range, tri-state wording flags over usable text, status.

    reviews: (order_id, score, dates_valid, has_text, <kind> counts).
    """
    usable_score = F.col("dates_valid") & F.col("score").between(1, 5)
    usable_text = F.col("dates_valid") & F.col("has_text")
    score = F.when(usable_score, F.col("score"))
    n = lambda c: F.count(F.when(c, 1))
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("review_records"), n(usable_score).alias("usable_score_records"),
        n(usable_text).alias("usable_text_records"), n(~F.col("dates_valid")).alias("invalid_date_records"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"),
        F.when(F.count(score) > 0, F.min(score) <= 2).alias("any_low_score"),
        *[F.when(n(usable_text) > 0, n(usable_text & (F.col(k) > 0)) > 0).alias(f"any_{k}") for k in kinds],
        F.when(n(usable_text) > 0, "usable_text").when(n(F.col("has_text")) > 0, "text_with_invalid_or_missing_dates")
        .otherwise("no_written_comment").alias("review_evidence_status"))


def review_comparison(orders: DataFrame, group: str, flags: list[str]) -> DataFrame:
    """Rates by outcome group; each flag has its own known denominator."""
    pieces = ", ".join(f"'{f}', {f}" for f in flags)
    long = orders.select(group, F.expr(f"stack({len(flags)}, {pieces}) AS (flag, value)"))
    return long.groupBy(group, "flag").agg(
        F.count(F.lit(1)).alias("orders"), F.count("value").alias("known_orders"),
        tristate.count_true(F.col("value")).alias("true_orders")).withColumn(
        "rate", tristate.ratio(F.col("true_orders"), F.col("known_orders")))
