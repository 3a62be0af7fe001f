"""Normalisation, exact parsing, duplicates and import validation."""

from __future__ import annotations

import functools
import sys
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.functions import tristate


# --- text -------------------------------------------------------------------------------------

def trimmed(column: Column) -> Column:
    """Trim surrounding whitespace; an empty string is a missing value."""
    return F.nullif(F.regexp_replace(column, r"^\s+|\s+$", ""), F.lit(""))


def canonical_text(name: str, kind: str) -> Column:
    """kind: free (untouched) | id and text (lower) | state (upper)."""
    column = F.col(name)
    if kind == "free":
        return F.nullif(column, F.lit(""))
    clean = trimmed(column)
    return F.upper(clean) if kind == "state" else F.lower(clean)


def normalize_text(df: DataFrame, spec: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Typed text columns and a long (column, operation, affected_cells) change log from one pass."""
    changed = []
    for name, kind in spec.items():
        raw = F.col(name)
        trim = raw if kind == "free" else F.regexp_replace(raw, r"^\s+|\s+$", "")
        clean = F.nullif(trim, F.lit(""))
        changed += [(name, "trim_surrounding_whitespace", ~raw.eqNullSafe(trim)),
                    (name, "empty_string_to_missing", trim == ""),
                    (name, "canonical_case", ~clean.eqNullSafe(canonical_text(name, kind)))]
    counts = df.agg(*[tristate.count_true(c).alias(f"c{i}") for i, (_, _, c) in enumerate(changed)])
    pieces = ", ".join(f"'{n}', '{op}', c{i}" for i, (n, op, _) in enumerate(changed))
    log = counts.select(F.expr(f"stack({len(changed)}, {pieces}) AS (column_name, operation, affected_cells)"))
    return df.withColumns({n: canonical_text(n, k) for n, k in spec.items()}), log


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def nfc(df: DataFrame, column: str) -> DataFrame:
    """Unicode composition in one scan. ASCII text is already composed; only other texts cross to Arrow, the rest as nulls."""
    other = F.when(F.col(column).rlike(r"[^\x00-\x7F]"), F.col(column))
    return df.withColumn(column, F.coalesce(_nfc(other), F.col(column)))


@functools.cache
def _folding() -> tuple[str, str, dict[str, str], str]:
    """Case folding, compatibility decomposition and removal of combining marks as a map of single characters.

    Returns the characters that become one character with what they become, followed by those that
    vanish, the ones that become several, and a pattern of these. Composed Hangul is left out.
    """
    singles, several, gone = {}, {}, []
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char) in ("Cn", "Co", "Cs") or "\uac00" <= char <= "\ud7a3":
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", char.casefold()) if not unicodedata.combining(c))
        if not folded:
            gone.append(char)
        elif len(folded) > 1:
            several[char] = folded
        elif folded != char:
            singles[char] = folded
    runs: list[list[str]] = []
    for char in several:
        if runs and ord(char) == ord(runs[-1][1]) + 1:
            runs[-1][1] = char
        else:
            runs.append([char, char])
    # The look-ahead passes over ASCII without trying the ranges.
    pattern = r"(?=[^\x00-\x7F])([" + "".join(f"{a}-{b}" for a, b in runs) + "])"
    return "".join([*singles, *gone]), "".join(singles.values()), several, pattern


def fold_accents(column: Column) -> Column:
    """Case-folded text without accents, for every script of Unicode, by built-in functions.

    Each character is decomposed and its combining marks go; ligatures and the like become several
    characters. ASCII text only gets lower case. Composed Hangul syllables stay composed.
    """
    before, after, several, pattern = _folding()
    plain = F.translate(column, before, after)
    expansions = F.str_to_map(F.lit("\x01".join(f"{c}\x02{f}" for c, f in several.items())), F.lit("\x01"), F.lit("\x02"))
    present = F.array_distinct(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)))
    whole = F.aggregate(present, plain, lambda text, c: F.replace(text, c, F.element_at(expansions, c)))
    return F.when(column.rlike(r"[^\x00-\x7F]"), whole).otherwise(F.lower(column))


# --- patterns and numbers ----------------------------------------------------------------------

def pad_zip(column: Column) -> Column:
    """One to five digits, zero-padded to five; anything else is null (and a violation)."""
    clean = trimmed(column)
    return F.when(clean.rlike(r"^[0-9]{1,5}$"), F.lpad(clean, 5, "0"))


def violates(column: Column, pattern: str) -> Column:
    """Non-missing value that does not match the full pattern."""
    return column.isNotNull() & ~column.rlike(f"^(?:{pattern})$")


def validate_pattern(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Violation counts per column in one aggregate, long form."""
    counts = df.agg(*[tristate.count_true(violates(F.col(c), p)).alias(f"v{i}")
                      for i, (c, p) in enumerate(patterns.items())])
    pieces = ", ".join(f"'{c}', v{i}" for i, c in enumerate(patterns))
    return counts.select(F.expr(f"stack({len(patterns)}, {pieces}) AS (column_name, violations)"))


def parse_exact(column: Column, fmt: str) -> Column:
    """Timestamp only if formatting it again gives back the identical text."""
    parsed = F.try_to_timestamp(column, F.lit(fmt))
    return F.when(F.date_format(parsed, fmt) == column, parsed.cast("timestamp_ntz"))


def finite_number(column: Column) -> Column:
    """Double value of the text; unparsable and non-finite values are null."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def minor_units(column: Column) -> Column:
    """Exact integer cents; null when more than two decimals carry value."""
    scaled = column.cast("string").try_cast("decimal(38,10)") * 100
    return F.when(scaled == F.floor(scaled), F.floor(scaled).cast("long"))


def inexact_money(column: Column) -> Column:
    return column.isNotNull() & minor_units(column).isNull()


# --- duplicates ----------------------------------------------------------------------------------

def drop_exact_duplicates(df: DataFrame, record: str) -> tuple[DataFrame, DataFrame]:
    """Keep the first record of identical rows and map each removed record to the kept one.

    Grouping is by all columns with a map-side minimum; the lineage is a join back, so one
    heavily repeated row is never sorted in a single task.
    """
    content = [c for c in df.columns if c != record]
    kept = df.groupBy(*content).agg(F.min(record).alias(record), F.count(F.lit(1)).alias("_n"))
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    repeated = kept.where("_n > 1").select(digest.alias("_h"), F.col(record).alias("kept_record"))
    lineage = (df.select(F.col(record), digest.alias("_h")).join(repeated, "_h")
               .where(F.col(record) != F.col("kept_record")).select(record, "kept_record"))
    return kept.select(*df.columns), lineage


def duplicate_groups(df: DataFrame, key: str, raw_key: str | None = None) -> DataFrame:
    """Every repeated id with its record count, kind and conflicting columns; no member is preferred.

    Conflict is min <> max (or mixed nulls), both combinable before the shuffle.
    """
    others = [c for c in df.columns if c not in (key, raw_key)]
    differs = {c: (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))) for c in others}
    grouped = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(
        F.count(F.lit(1)).alias("records"),
        *[F.coalesce(d, F.lit(False)).alias(f"_d{i}") for i, d in enumerate(differs.values())],
        *([(F.min(raw_key) != F.max(raw_key)).alias("raw_id_collision")] if raw_key else []))
    names = F.filter(F.array(*[F.when(F.col(f"_d{i}"), F.lit(c)) for i, c in enumerate(others)]),
                     lambda x: x.isNotNull())
    out = grouped.where("records > 1").withColumn("conflicting", names)
    return out.select(
        key, "records", F.when(F.size("conflicting") > 0, "duplicate_id_conflicting_rows")
        .otherwise("duplicate_id_identical_rows").alias("kind"), "conflicting",
        *(["raw_id_collision"] if raw_key else []))


# --- mapped import -----------------------------------------------------------------------------

ISSUE = "struct<field:string,severity:string,issue_code:string>"


def _issue(field: str, severity: str, code: str, condition: Column) -> Column:
    return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"),
                                      F.lit(code).alias("issue_code")))


def import_validate(df: DataFrame, times: list[str], estimate: str, status_mapping: dict[str, str],
                    primary_category: str, fmt: str) -> DataFrame:
    """One ledger row per source row with typed fields, an issue array and a disposition.

    Input: canonical string columns source_record, order_id, order_status, category, split, cutoff,
    ``times`` and ``estimate``. Nothing is dropped; a row with an error is quarantined whole, and so
    is every member of a repeated id.
    """
    text = ["order_id", "order_status", "category", "split"]
    dates = [*times, estimate, "cutoff"]
    clean = df.select("source_record", *[F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "").alias(c)
                                         for c in [*text, *dates]],
                      *[F.col(c).alias(f"raw_{c}") for c in text])
    groups = duplicate_groups(clean.drop("source_record", *[f"raw_{c}" for c in text[1:]]), "order_id",
                              "raw_order_id").select("order_id", "kind", "raw_id_collision")
    joined = clean.join(groups, "order_id", "left")
    mapped = F.create_map(*[F.lit(x) for pair in status_mapping.items() for x in pair])
    status = F.try_element_at(mapped, F.col("order_status"))
    parsed = {c: parse_exact(F.nullif(F.col(c), F.lit("")), fmt) for c in dates}
    rows = joined.withColumns({f"at_{c}": e for c, e in parsed.items()}).withColumn("mapped_status", status)
    required = ["order_id", "order_status", "category", times[0]]
    bounded = F.col("split").isin("train", "validation")
    errors = [
        *[_issue(c, "error", "missing_required_value", F.col(c) == "") for c in required],
        F.when(F.col("kind").isNotNull(), F.struct(F.lit("order_id").alias("field"), F.lit("error").alias("severity"),
                                                   F.col("kind").alias("issue_code"))),
        _issue("order_id", "error", "normalized_id_collision", tristate.known_true(F.col("raw_id_collision"))),
        _issue("order_status", "error", "unmapped_status",
               (F.col("order_status") != "") & F.col("mapped_status").isNull()),
        *[_issue(c, "error", "invalid_timestamp", (F.col(c) != "") & F.col(f"at_{c}").isNull()) for c in dates],
        _issue("split", "error", "unknown_split",
               (F.col("split") != "") & ~F.col("split").isin("train", "validation", "test")),
        _issue("split", "error", "cutoff_without_split", (F.col("split") == "") & F.col("at_cutoff").isNotNull()),
        _issue("cutoff", "error", "purchase_outside_partition_cutoff",
               bounded & (F.col("at_cutoff") <= F.col(f"at_{times[0]}"))),
    ]
    present = [F.col(f"at_{c}") for c in times]
    missing = reduce(lambda a, b: a + b, [p.isNull().cast("int") for p in present])
    reversed_pair = reduce(lambda a, b: a | b, [tristate.known_true(present[j] < present[i])
                                                for i in range(len(times)) for j in range(i + 1, len(times))])
    delivered = F.coalesce(F.col("mapped_status") == "delivered", F.lit(False))
    complete = delivered & (missing == 0) & ~reversed_pair
    crosses = reduce(lambda a, b: a | b, [tristate.known_true(p >= F.col("at_cutoff")) for p in present])
    notes = [
        _issue("order_status", "warning", "recorded_timeline_reversal", reversed_pair),
        _issue("order_status", "warning", "status_delivery_conflict", delivered != present[-1].isNotNull()),
        _issue("order_status", "warning", "delivered_missing_milestones", delivered & (missing > 0)),
        _issue("order_status", "context", "incomplete_status_context", ~delivered & (missing > 0)),
        *[_issue(f"{a}_to_{b}", "warning", "zero_transition_duration", F.col(f"at_{a}") == F.col(f"at_{b}"))
          for a, b in zip(times, times[1:])],
        _issue("cutoff", "context", "partition_cutoff_required", bounded & F.col("at_cutoff").isNull()),
        _issue("cutoff", "context", "completion_crosses_cutoff", complete & crosses),
    ]
    keep = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    blocking = keep(errors)
    accepted = F.size(blocking) == 0
    ledger = rows.withColumn("_errors", blocking).withColumn("accepted", F.size("_errors") == 0).withColumn(
        "issues", F.when(F.col("accepted"), keep(notes)).otherwise(F.col("_errors")))
    selected = F.col("category") == primary_category
    reason = tristate.first_match([
        ("quarantined", ~F.col("accepted")), ("reserved_test_not_used", F.col("split") == "test"),
        ("chronological_split_required", F.col("split") == ""), ("outside_selected_category", ~selected),
        ("timing_ineligible", ~complete), ("partition_cutoff_required", F.col("at_cutoff").isNull()),
        ("completion_not_before_partition_cutoff", crosses)], "eligible_completed_timing")
    changes = F.filter(F.array(*[F.when(F.coalesce(F.col(f"raw_{c}"), F.lit("")) != F.col(c), F.lit(c)) for c in text]),
                       lambda x: x.isNotNull())
    return ledger.select(
        "source_record", "order_id", F.col("mapped_status").alias("order_status"), "category", "split",
        *[F.col(f"at_{c}").alias(c) for c in dates],
        F.when(F.col("accepted"), "accepted").otherwise("quarantined").alias("disposition"),
        F.array_sort(F.array_distinct(F.transform(F.filter("issues", lambda x: x["severity"] == "error"),
                                                  lambda x: x["issue_code"]))).alias("blocking_codes"),
        "issues", changes.alias("trimmed_fields"), reason.alias("timing_input_reason"))


def import_issue_log(ledger: DataFrame) -> DataFrame:
    return ledger.select("source_record", "order_id", F.explode("issues").alias("i")).select(
        "source_record", "order_id", "i.field", "i.severity", "i.issue_code")


def group_size(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Partition count attached to each row: aggregate and join, so a hot key is not one window task."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group; Spark limits each group per partition before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(
        F.col("_rn") <= n).drop("_rn")
