"""Milestone event stream: ids, validation, keyed state, late rows.

The state of an order is a pure function of its observed milestone set, so it is derived with
columns; only "which milestones were already seen" lives in the keyed state (at most one entry per
activity and order, filed under a bucket of orders).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ordertide.functions import tristate
from ordertide.sources.star_schema import ACTIVITIES

# Event fields, time format, stages between consecutive milestones.
SCHEMA_VERSION = "milestone_event_v1"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                             ["schema_version", "event_id", "order_id", "activity", "occurred_at"]])
SLOTS = ["t0", "t1", "t2", "t3"]
STAGES = [("approval", 0, 1), ("handling", 1, 2), ("transport", 2, 3)]
#: Groups of orders in the keyed state; fixed for the life of a checkpoint.
BUCKETS = 1024
REVISION_SCHEMA = T.StructType(
    [T.StructField("order_id", T.StringType()), T.StructField("revision", T.LongType()), T.StructField("event_id", T.StringType()),
     T.StructField("activity", T.StringType()), T.StructField("occurred_at", T.StringType()), T.StructField("outcome", T.StringType())]
    + [T.StructField(f"{p}{s}", T.StringType()) for p in ["prev_", ""] for s in SLOTS])


def event_id() -> Column:
    """SHA-256 of the canonical body (fields in alphabetical order); exact for ASCII payloads."""
    return F.sha2(F.to_json(F.struct("activity", "occurred_at", "order_id", "schema_version")), 256)


def make_events(log: DataFrame) -> DataFrame:
    """(order_id, activity, ts) -> allowlisted event rows."""
    body = log.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("order_id").cast("string").alias("order_id"), "activity",
                      F.date_format("ts", TIME_FORMAT).alias("occurred_at"))
    return body.withColumn("event_id", event_id()).select(*EVENT_SCHEMA.names)


def validate_events(events: DataFrame, id_pattern: str, start: str, cutoff: str) -> DataFrame:
    """Stateless checks with the first failing reason; null reason means accepted. Works on streams."""
    at = F.try_to_timestamp("occurred_at", F.lit(TIME_FORMAT))
    exact = F.coalesce(F.date_format(at, TIME_FORMAT) == F.col("occurred_at"), F.lit(False))
    reason = tristate.first_match([
        ("unknown_schema_version", ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))),
        ("invalid_order_id", ~F.coalesce(F.col("order_id").rlike(f"^(?:{id_pattern})$"), F.lit(False))),
        ("unknown_activity", ~F.coalesce(F.col("activity").isin(ACTIVITIES), F.lit(False))),
        ("invalid_timestamp", ~exact), ("event_id_mismatch", ~F.col("event_id").eqNullSafe(event_id())),
        ("before_window", F.col("occurred_at") < start), ("window_closed", F.col("occurred_at") >= cutoff)])
    return events.withColumn("reject_reason", reason)


class MilestoneProcessor(StatefulProcessor):
    """Per bucket of orders: which milestones were seen, until the window closes. Emits one row per event with its outcome.

    A known event is a replay; else, once the watermark has passed the close, it is refused; one behind the watermark is late; another
    event for a milestone already seen is a conflict. Only accepted events change the state. The close is an event-time
    timer: it emits nothing and ends the state. Rows with a reject reason pass through. Orders do not touch each other; a bucket
    only shares the calls to the state store, which cost more than the events of one order. Accepted events are appended.
    """

    def __init__(self, close_ms: int) -> None:
        self._close_ms = close_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getListState("seen", "order_id string, activity string, event_id string, occurred_at string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        watermark = timerValues.getCurrentWatermarkInMs()
        incoming, out, none = {}, [], [None] * 8
        for pdf in rows:  # distinct events only; copies collapse here
            for order, e, a, t, reason, ms in zip(*(pdf[c].tolist() for c in ["order_id", "event_id", "activity", "occurred_at", "reject_reason", "at_ms"]), strict=True):
                if reason is not None:
                    out.append((order, None, e, a, t, reason, *none))
                else:
                    event = (order, t, ACTIVITIES.index(a), e, ms)
                    incoming[event] = incoming.get(event, 0) + 1
        known, new = {}, []
        if incoming:
            for order, activity, e, t in self._seen.get():
                known.setdefault(order, {})[activity] = (e, t)
        had = bool(known)
        for (order, t, rank, e, ms), copies in sorted(incoming.items()):
            activity, seen = ACTIVITIES[rank], known.setdefault(order, {})
            before = [seen[a][1] if a in seen else None for a in ACTIVITIES]
            if activity in seen and seen[activity][0] == e:
                outcome = "replayed"
            elif watermark >= self._close_ms:
                outcome = "refused_after_close"
            elif ms < watermark:
                outcome = "late"
            elif activity in seen:
                outcome = "conflicting_milestone"
            else:
                outcome = "accepted"
                seen[activity] = (e, t)
                new.append((order, activity, e, t))
            after = [seen[a][1] if a in seen else None for a in ACTIVITIES]
            out.append((order, len(seen), e, activity, t, outcome, *before, *after))
            again = "replayed" if outcome == "accepted" else outcome
            out += [(order, len(seen), e, activity, t, again, *after, *after)] * (copies - 1)
        if new:
            self._seen.appendList(new)
            if not had:
                self._handle.registerTimer(self._close_ms)
        yield pd.DataFrame(out, columns=REVISION_SCHEMA.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        self._seen.clear()
        yield pd.DataFrame([], columns=REVISION_SCHEMA.names)

    def close(self) -> None:
        pass


def milestone_revisions_stream(checked: DataFrame, close: str = "9999-12-31 00:00:00", delay: str = "36500 days", buckets: int = BUCKETS) -> DataFrame:
    """Streaming outcomes of events, kept per order in buckets of orders, with or without ``reject_reason`` (see ``validate_events``).

    The watermark follows every readable event time, ``delay`` behind. The operator itself gets plain milliseconds, so Spark drops no
    row before the processor has said what becomes of it. State holds at most one entry per activity and order, and none
    after the close.
    """
    if "reject_reason" not in checked.columns:
        checked = checked.withColumn("reject_reason", F.lit(None).cast("string"))
    at = F.try_to_timestamp("occurred_at", F.lit(TIME_FORMAT))
    timed = checked.withColumn("at", at).withWatermark("at", delay)
    rows = timed.select(F.coalesce("order_id", F.lit("")).alias("order_id"), "event_id", "activity", "occurred_at", "reject_reason",
                        F.unix_millis("at").alias("at_ms")).withColumn("bucket", F.pmod(F.xxhash64("order_id"), F.lit(buckets)))
    close_ms = int(datetime.fromisoformat(close).replace(tzinfo=UTC).timestamp() * 1000)
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=MilestoneProcessor(close_ms), outputStructType=REVISION_SCHEMA, outputMode="Append", timeMode="EventTime")


def milestone_revisions(accepted: DataFrame) -> DataFrame:
    """Batch twin of the stream over events in event-time order: one row per accepted event.

    Copies and conflicts are reduced to the first event per (order, activity) before the shuffle,
    and an order is one row with at most one event per activity, which its revisions are read off.
    """
    first = accepted.groupBy("order_id").agg(*[F.min(F.when(F.col("activity") == a, F.struct("occurred_at", F.lit(rank).alias("rank"), "event_id"))).alias(s)
                                               for rank, (a, s) in enumerate(zip(ACTIVITIES, SLOTS))])
    events = F.array_sort(F.array_compact(F.array(*SLOTS)))
    steps = first.select("order_id", *SLOTS, F.posexplode(events).alias("_at", "_e"))
    place = lambda e: F.struct(F.col(f"{e}.occurred_at"), F.col(f"{e}.rank"))
    seen = lambda s, relation: F.when(relation(place(s), place("_e")), F.col(f"{s}.occurred_at"))
    return steps.select("order_id", (F.col("_at") + 1).cast("long").alias("revision"), "_e.event_id",
                        F.get(F.array(*[F.lit(a) for a in ACTIVITIES]), F.col("_e.rank")).alias("activity"), "_e.occurred_at", F.lit("accepted").alias("outcome"),
                        *[seen(s, lambda a, b: a < b).alias(f"prev_{s}") for s in SLOTS], *[seen(s, lambda a, b: a <= b).alias(s) for s in SLOTS])


def conflicting_milestones(accepted: DataFrame) -> DataFrame:
    """Order milestones reported by more than one event id."""
    return accepted.groupBy("order_id", "activity").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("_a"),
                                                        F.max("event_id").alias("_b")).where("_a <> _b").drop("_a", "_b")


def _pairs(prefix: str, relation) -> Column:
    return tristate.reasons([(f"{ACTIVITIES[i]}>{ACTIVITIES[j]}", tristate.known_true(relation(F.col(prefix + SLOTS[i]), F.col(prefix + SLOTS[j]))))
                             for i in range(4) for j in range(i + 1, 4)])


def state_columns(prefix: str = "") -> dict[str, Column]:
    """Observed facts of a milestone set; text times compare like timestamps."""
    t = [F.col(prefix + s) for s in SLOTS]
    count = reduce(lambda a, b: a + b, [x.isNotNull().cast("long") for x in t])
    highest = tristate.first_match([(ACTIVITIES[i], t[i].isNotNull()) for i in (3, 2, 1, 0)])
    gap = [(ACTIVITIES[i], t[i].isNull() & reduce(lambda a, b: a | b, [x.isNotNull() for x in t[i + 1:]])) for i in range(3)]
    inversions, ties = _pairs(prefix, lambda a, b: a > b), _pairs(prefix, lambda a, b: a == b)
    return {"observed_event_count": count, "highest_milestone": highest, "earlier_not_observed": tristate.reasons(gap),
            "inversions": inversions, "ties": ties,
            "timestamp_quality": tristate.first_match([("observed_timeline_conflict", F.size(inversions) > 0),
                                                       ("equal_timestamp_order_unresolved", F.size(ties) > 0)],
                                                      "no_conflict_in_observed_timestamps"),
            "last_observed_at": F.greatest(*t)}


def latest_states(revisions: DataFrame) -> DataFrame:
    """Latest revision per order with its derived state (batch, or inside foreachBatch)."""
    last = revisions.where("outcome = 'accepted'").groupBy("order_id").agg(F.max_by(F.struct(*SLOTS, "revision"), "revision").alias("s")).select(
        "order_id", "s.*")
    return last.withColumns(state_columns())


def stage_measurements(df: DataFrame, prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """Three stage rows per state with signed seconds and observation status."""
    pieces = ", ".join(f"'{s}', {prefix}{SLOTS[a]}, {prefix}{SLOTS[b]}" for s, a, b in STAGES)
    long = df.select(*(keep or ["order_id"]), F.expr(f"stack(3, {pieces}) AS (stage, start_at, end_at)"))
    sec = lambda c: F.unix_timestamp(F.col(c), TIME_FORMAT)
    a, b = F.col("start_at"), F.col("end_at")
    return long.withColumn("duration_s", sec("end_at") - sec("start_at")).withColumn("observation_status", tristate.first_match([
        ("neither_endpoint_observed", a.isNull() & b.isNull()), ("end_not_observed", b.isNull()), ("start_not_observed", a.isNull()),
        ("negative_recorded_duration", F.col("duration_s") < 0), ("equal_recorded_time_order_unresolved", F.col("duration_s") == 0)],
        "positive_recorded_duration"))


def tumbling_counts(events: DataFrame, time: str, length: str, key: str) -> DataFrame:
    """Event counts per window; the same call serves a watermarked stream and a batch."""
    return events.groupBy(F.window(time, length).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), key, "events")
