"""Stage scoring of milestone revisions and the decision journal, shared by stream and batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.functions import tristate
from ordertide.operators import peers
from ordertide.streaming import milestones as m

# The two context availability scenarios.
MODES = ["verified_context_only", "assumed_static_context_at_purchase"]
CONTEXT = ["customer_state", "distance_band", "seller_attribution_scope", "product_id", "single_seller_id", "item_count",
           "product_attributable", "all_pairs_quality_eligible"]


def context_projection(orders: DataFrame) -> DataFrame:
    """Allowlisted static context per order: nothing that an outcome could leak into."""
    return orders.select(F.col("order_id").cast("string").alias("order_id"), *CONTEXT)


def assess(states: DataFrame, key: list[str], prefix: str, reference: DataFrame, context: DataFrame, minimum: int) -> DataFrame:
    """Three stages x two scenarios per state row: status, score, severity, warning."""
    prepared = states.withColumns({k: v for k, v in m.state_columns(prefix).items() if k in ("inversions", "ties")}).withColumn(
        "_purchase", F.col(f"{prefix}t0"))
    rows = m.stage_measurements(prepared, prefix, [*key, "inversions", "ties", "_purchase"]).join(context, "order_id", "left")
    gate = tristate.first_match([
        ("observed_timeline_conflict", F.size("inversions") > 0), ("equal_timestamp_order_unresolved", F.size("ties") > 0),
        ("stage_endpoint_not_observed", F.col("duration_s").isNull()), ("nonpositive_or_unresolved_stage", F.col("duration_s") <= 0),
        ("purchase_not_observed", F.col("_purchase").isNull())])
    gated = rows.withColumn("gate", gate)
    # A score depends on the order's context and the duration: each duration of an order's stage is scored once, in however many states it stands.
    cell = ["order_id", "stage", "duration_s"]
    open_rows = gated.where("gate IS NULL AND all_pairs_quality_eligible AND distance_band IS NOT NULL").select(*cell, *CONTEXT).dropDuplicates(cell)
    named = open_rows.withColumn("_order", F.col("order_id")).withColumn("order_id", F.concat_ws("#", "order_id", F.col("duration_s").cast("string")))
    scored = peers.stage_delay_score(named, reference, minimum).select(
        F.col("_order").alias("order_id"), "stage", "duration_s", "ref_n", "delay_score", "severity", "delay_warning")
    # An order has few scores, so they fit a row and its states, which lie by order, meet them where they are.
    found = ["ref_n", "delay_score", "severity", "delay_warning"]
    scores = scored.groupBy("order_id").agg(F.collect_list(F.struct("stage", "duration_s", *found)).alias("_scores"))
    own = F.get(F.filter("_scores", lambda s: (s["stage"] == F.col("stage")) & (s["duration_s"] == F.col("duration_s"))), F.lit(0))
    met = gated.select(*key, *[c for c in cell if c not in key], "observation_status", "gate", "all_pairs_quality_eligible", "distance_band").join(scores, "order_id", "left").withColumn("_own", own)
    joined = met.select("*", *[F.col(f"_own.{c}").alias(c) for c in found]).drop("_scores", "_own").withColumn("mode", F.explode(F.array(*[F.lit(x) for x in MODES])))
    status = F.coalesce(F.col("gate"), F.when(F.col("mode") == MODES[0], "context_availability_unverified"),
                        F.when(~tristate.known_true(F.col("all_pairs_quality_eligible")) | F.col("distance_band").isNull(), "geographic_quality_not_eligible"),
                        F.when(F.col("delay_score").isNull(), "insufficient_matched_reference"), F.lit("assessed_under_context_assumption"))
    ok = F.col("assessment_status") == "assessed_under_context_assumption"
    return joined.withColumn("assessment_status", status).select(
        *key, "stage", "mode", "duration_s", "observation_status", "assessment_status",
        F.when(ok, F.col("ref_n")).alias("ref_n"), F.when(ok, F.col("delay_score")).alias("delay_score"),
        F.when(ok, F.col("severity")).otherwise("unassessed").alias("severity"), F.when(ok, F.col("delay_warning")).alias("delay_warning"))


RESULT = ["duration_s", "observation_status", "assessment_status", "ref_n", "delay_score", "severity", "delay_warning"]


def decision_journal(revisions: DataFrame, reference: DataFrame, context: DataFrame, minimum: int = peers.MINIMUM_PEERS) -> DataFrame:
    """Changed results per accepted revision with their action.

    A revision carries the milestone set before and after it, so the previous result comes from the same assessment of
    distinct milestone sets: no journal lookup, and a retried batch gives the same rows.
    """
    key = ["order_id", "revision", "event_id", "occurred_at"]
    # An order has at most one revision and one state per milestone: its revisions are dealt once, as one row, and all that follows lies by order.
    state = lambda prefix: F.struct(*[F.col(f"{prefix}{slot}").alias(slot) for slot in m.SLOTS])
    steps = revisions.where("outcome = 'accepted'").groupBy("order_id").agg(F.collect_list(
        F.struct(*key[1:], state("").alias("_now"), F.when(F.col("revision") > 1, state("prev_")).alias("_before"))).alias("_steps"))
    # A state is both the result of one revision and the start of the next: each is assessed once.
    either = F.concat(F.transform("_steps", lambda s: s["_now"]), F.transform("_steps", lambda s: s["_before"]))
    states = steps.select("order_id", F.explode(F.array_distinct(F.array_compact(either))).alias("_state")).select("order_id", "_state", "_state.*")
    results = assess(states, ["order_id", "_state"], "", reference, context, minimum).groupBy("order_id").agg(
        F.collect_list(F.struct("_state", "stage", "mode", F.struct(*RESULT).alias("result"))).alias("_all"))
    now = steps.select("order_id", F.inline("_steps")).join(results, "order_id").select(
        *key, "_before", "_all", F.inline(F.filter("_all", lambda e: e["_state"].eqNullSafe(F.col("_now"))))).drop("_state")
    same = lambda e: e["_state"].eqNullSafe(F.col("_before")) & (e["stage"] == F.col("stage")) & (e["mode"] == F.col("mode"))
    both = now.withColumn("prior", F.get(F.filter("_all", same), F.lit(0))["result"]).select(*key, "stage", "mode", "result", "prior", "result.*")
    changed = both.where(~F.col("result").eqNullSafe(F.col("prior")))
    action = tristate.first_match([
        ("warning_emitted", tristate.known_true(F.col("delay_warning"))), ("completed_stage_scored", F.col("delay_score").isNotNull()),
        ("assessment_withdrawn_after_new_evidence", F.col("prior.delay_score").isNotNull())], "assessment_updated")
    return changed.withColumn("action", action).select(*key, "stage", "mode", "action", *RESULT)


def latest_stage_scores(journal: DataFrame) -> DataFrame:
    return journal.groupBy("order_id", "stage", "mode").agg(F.max_by(F.struct(*RESULT, "revision"), "revision").alias("s")).select(
        "order_id", "stage", "mode", "s.*")


def order_scores(latest: DataFrame) -> DataFrame:
    """Order roll-up per scenario: true if any warned, false only when all three stages are scored."""
    n = F.count("delay_score")
    return latest.groupBy("mode", "order_id").agg(
        n.alias("scored_stages"), F.when(n == 3, "complete").when(n > 0, "partial").otherwise("unavailable").alias("coverage"),
        F.max("delay_score").alias("max_stage_delay_score"),
        F.when(tristate.count_true(F.col("delay_warning")) > 0, F.lit(True)).when(n == 3, F.lit(False)).alias("any_warning"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("delay_score").isNull(), F.col("assessment_status")))), ",").alias("unassessed_reasons"))


def multiset_counts(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """One row: rows on either side, and those of each side beyond their equals on the other (as ``exceptAll`` counts them).

    ``key`` is not null and has few rows on either side: a side is dealt once, a row for each key, and not at all where it lies by the key.
    """
    rest = [c for c in rows.columns if c != key]
    listed = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
    met = listed(rows, "_mine").join(listed(other, "_its"), key, "full").select(*[F.coalesce(c, F.array()).alias(c) for c in ("_mine", "_its")])
    times = lambda c, x: F.size(F.filter(c, lambda y: y.eqNullSafe(x)))

    def beyond(a: str, b: str) -> Column:
        each = F.transform(F.array_distinct(a), lambda x: F.greatest(times(a, x) - times(b, x), F.lit(0)))
        return F.when(F.col(a) == F.col(b), F.lit(0)).otherwise(F.aggregate(each, F.lit(0), lambda x, y: x + y))

    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return met.agg(total(F.size("_mine")).alias("rows"), total(F.size("_its")).alias("other_rows"),
                   total(beyond("_mine", "_its")).alias("only_rows"), total(beyond("_its", "_mine")).alias("only_other"))


def prefix_summary(journal: DataFrame) -> DataFrame:
    return journal.groupBy("mode", "stage", "action", "assessment_status").agg(F.count(F.lit(1)).alias("decisions"), F.count_distinct("order_id").alias("orders"))


def observation_summary(events: DataFrame, states: DataFrame) -> DataFrame:
    """(section, key, value): accepted events by activity; orders by visible events, delivery, completeness, inversions and ties."""
    slots = [F.col(slot).isNotNull() for slot in m.SLOTS]
    visible = sum(slot.cast("int") for slot in slots)
    facts = [(F.lit(True), "orders_by_visible_events", visible.cast("string")), (F.lit(True), "orders", F.lit("observed")),
             (slots[-1], "orders", F.lit("delivery_observed")), (~slots[-1], "orders", F.lit("delivery_not_observed")),
             (visible == len(slots), "orders", F.lit("all_milestones_observed")), (F.size("inversions") > 0, "orders", F.lit("observed_inversions")),
             (F.size("ties") > 0, "orders", F.lit("equal_time_pairs"))]
    rows = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(section).alias("section"), key.alias("key"))) for holds, section, key in facts]))
    of_orders = states.select(F.inline(rows)).groupBy("section", "key").agg(F.count(F.lit(1)).alias("value"))
    return of_orders.unionByName(events.groupBy(F.lit("events_by_activity").alias("section"), F.col("activity").alias("key")).agg(F.count(F.lit(1)).alias("value")))


def scenario_summary(journal: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per scenario: current coverage and warnings, warnings emitted, those emitted before delivery was observed, withdrawals."""
    warned = F.col("delay_score") > 0
    n = tristate.count_true
    current = latest_stage_scores(journal).groupBy("mode", "order_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("delay_score").alias("scored"), n(warned).alias("warned"))
    now = current.groupBy("mode").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("rows").alias("stage_rows"), F.sum("scored").alias("scored_stage_rows"), n(F.col("scored") > 0).alias("orders_with_any_score"),
        n(F.col("scored") == 3).alias("complete_orders"), F.sum("warned").alias("current_warning_stages"), n(F.col("warned") > 0).alias("current_warning_orders"))
    delivered = revisions.where("outcome = 'accepted'").select("order_id", "revision", F.col(m.SLOTS[-1]).isNotNull().alias("delivered"))
    emitted, early = F.col("action") == "warning_emitted", ~F.col("delivered")
    per_order = journal.join(delivered, ["order_id", "revision"]).groupBy("mode", "order_id").agg(
        n(emitted).alias("e"), n(emitted & early).alias("b"), n(F.col("action") == "assessment_withdrawn_after_new_evidence").alias("w"))
    past = per_order.groupBy("mode").agg(F.sum("e").alias("warning_emissions"), F.sum("b").alias("emissions_before_delivery"),
                                         n(F.col("b") > 0).alias("orders_warned_before_delivery"), F.sum("w").alias("assessment_withdrawals"))
    return now.join(past, "mode")


def read_events_stream(spark: SparkSession, path: str, schema: T.StructType = m.EVENT_SCHEMA, fmt: str = "json",
                       files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


class LatestTable:
    """Latest result per (order, stage, scenario), kept across micro-batches without rewriting it in each.

    An epoch's changes are written to a folder of their own and then entered in a ledger; only entered epochs are read, and an
    entered epoch is not applied again, so a retried one changes nothing. Every ``compact_after`` epochs the table is folded
    into a new base, which the ledger names.
    """

    KEY = ("order_id", "stage", "mode")

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, compact_after: int = 16):
        self.spark, self.path, self.schema, self.compact_after = spark, path, schema, compact_after

    def _ledger(self) -> DataFrame:
        """Entered epochs and the base in use since then (-1: none)."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "entered long, base long")
        return self.spark.read.schema("entered long, base long").parquet(f"{self.path}/ledger")

    def epochs(self) -> tuple[list[int], int]:
        """Entered epochs after the base (at most ``compact_after``), and the base."""
        ledger = self._ledger()
        base = ledger.agg(F.max("base")).first()[0]
        base = -1 if base is None else base
        return sorted(r["entered"] for r in ledger.where(F.col("entered") > base).collect()), base

    def read(self) -> DataFrame:
        """The table as of the last entered epoch."""
        epochs, base = self.epochs()
        parts = [f"{self.path}/base/{base}"] * (base >= 0) + [f"{self.path}/changes/{e}" for e in epochs]
        rows = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        rest = [c for c in self.schema.names if c not in self.KEY]
        return rows.groupBy(*self.KEY).agg(F.max_by(F.struct(*rest), "revision").alias("s")).select(*self.KEY, "s.*")

    def apply(self, changes: DataFrame, epoch: int) -> bool:
        """Enter an epoch's changes; False if it was entered before."""
        epochs, base = self.epochs()
        if epoch <= max([base, *epochs]):
            return False
        changes.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/changes/{epoch}")
        entry = base
        if len(epochs) + 1 >= self.compact_after:
            parts = self.read().unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/changes/{epoch}"))
            rest = [c for c in self.schema.names if c not in self.KEY]
            folded = parts.groupBy(*self.KEY).agg(F.max_by(F.struct(*rest), "revision").alias("s")).select(*self.KEY, "s.*")
            folded.write.mode("overwrite").parquet(f"{self.path}/base/{epoch}")
            entry = epoch
        self.spark.createDataFrame([(epoch, entry)], "entered long, base long").coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return True


LATEST_SCHEMA = ("order_id string, stage string, mode string, revision long, duration_s long, observation_status string, assessment_status string, "
                 "ref_n long, delay_score double, severity string, delay_warning boolean")


def latest_table(spark: SparkSession, path: str, compact_after: int = 16) -> LatestTable:
    return LatestTable(spark, f"{path}/latest", T._parse_datatype_string(LATEST_SCHEMA), compact_after)


def write_epoch(batch: DataFrame, epoch: int, path: str, reference=None, context: DataFrame | None = None, minimum: int = peers.MINIMUM_PEERS) -> None:
    """One micro-batch: accepted revisions, late rows and rejects apart, and (with a reference) the journal and the latest table.

    Every part is written to a folder of its epoch with overwrite, so a retried batch leaves what it left before.
    """
    spark = batch.sparkSession
    batch.persist()
    try:
        if not batch.limit(1).count():  # a batch that only moves the watermark
            return
        late = F.col("outcome") == "late"
        for name, kind in (("revisions", F.col("outcome") == "accepted"), ("late", late), ("rejects", (F.col("outcome") != "accepted") & ~late)):
            batch.where(kind).write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}", compression="zstd")
        if reference is not None:
            decision_journal(batch, reference, context, minimum).write.mode("overwrite").parquet(f"{path}/journal/epoch={epoch}", compression="zstd")
            written = spark.read.parquet(f"{path}/journal/epoch={epoch}")
            latest_table(spark, path).apply(latest_stage_scores(written), epoch)
    finally:
        batch.unpersist()


def write_decision_stream(revisions: DataFrame, path: str, checkpoint: str, reference=None, context: DataFrame | None = None,
                          minimum: int = peers.MINIMUM_PEERS):
    """Start the stream over all files present; it ends when they are done and goes on from the checkpoint when started again."""
    return revisions.writeStream.foreachBatch(lambda batch, epoch: write_epoch(batch, epoch, path, reference, context, minimum)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_progress(slices: list[DataFrame], folder: str, start) -> list[list[dict]]:
    """Deliver slices one after another, each to a run of its own that resumes from the checkpoint of the one before.

    ``start`` gives a started query over ``folder``/in. Order comes from the runs, not from file names or times, of which a file source
    only knows the latter. Returns the progress of each run by micro-batch; a run without rows may have none.
    """
    seen = []
    for rows in slices:
        rows.write.mode("append").json(f"{folder}/in", compression="gzip")
        running = start()
        running.awaitTermination()
        if running.exception():
            raise running.exception()
        seen.append(running.recentProgress)
    return seen


def replay(slices: list[DataFrame], folder: str, start) -> list[dict]:
    """The last progress of each run of ``replay_progress``."""
    return [progress[-1] if progress else None for progress in replay_progress(slices, folder, start)]
