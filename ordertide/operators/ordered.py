"""Ordered computations that never put a whole key on one task.

A plain ``Window.partitionBy(key).orderBy(v)`` sorts all rows of a key in one task, and a global
window sorts everything in one. ``running`` first sums rows with equal order value (map-side),
cuts each key into chunks of the order axis, runs the window inside a chunk and adds the totals
of the earlier chunks. A chunk of ``width`` integer units holds at most ``width`` rows per key,
whatever the volume behind it; on real-valued axes chunks are cut further by counts until each
holds a bounded number of values. Quantiles, ranks, ECDFs, as-of counts, ROC curves and
distribution distances are all read off its output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordertide.session import materialize

# Chunk widths: a week of seconds, and 65 536 units for integers such as cents or seconds.
WEEK = 7 * 86400
UNITS = 65536
SPLITS = 64
# Most values of one key in a chunk of a real-valued axis, and the parts a heavier chunk is cut into.
CHUNK_ROWS = 1_000_000
FAN = 64
MAX_CUTS = 12


def value_splits(df: DataFrame, column: str, parts: int = SPLITS) -> list[float]:
    """At most ``parts - 1`` range boundaries of a real-valued column (balance only, never results)."""
    points = df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.5 / parts)
    return sorted({float(p) for p in points})


def _locate(value: Column, points: list[float], low: int = 0) -> Column:
    """Index of the chunk by a balanced CASE tree: log2(parts) comparisons per row."""
    if not points:
        return F.lit(low)
    middle = len(points) // 2
    return F.when(value < F.lit(points[middle]), _locate(value, points[:middle], low)).otherwise(
        _locate(value, points[middle + 1:], low + middle + 1))


def _chunk(order: str, width, splits) -> Column:
    if splits is not None:
        return _locate(F.col(order), splits)
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def bounded_chunks(base: DataFrame, key: list[str], order: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """``base`` with every ``_chunk`` of more than ``rows`` rows of a key cut into ``FAN`` parts of about equal count.

    Heavy chunks are found by a count, cut at their own quantiles and counted again until none is
    left, so a dense spot of the axis costs a few rounds and light data one count. A cut chunk is
    named by its path [chunk, part, part of the part, ...], which sorts like the axis. Values that
    are equal as doubles cannot be told apart and stay together (``MAX_CUTS`` ends the search).
    """
    def heavy(df):
        return df.groupBy(*key, "_chunk").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)

    if heavy(base).isEmpty():
        return base
    value = F.col(order).cast("double")
    base = materialize(base.withColumn("_chunk", F.array(F.col("_chunk").cast("long"))), "chunks")
    for _ in range(MAX_CUTS):
        found = heavy(base)
        if found.isEmpty():
            break
        cuts = base.join(found, [*key, "_chunk"], "left_semi").groupBy(*key, "_chunk").agg(
            F.array_distinct(F.percentile_approx(value, [i / FAN for i in range(1, FAN)], 100 * FAN)).alias("_cuts"))
        part = F.size(F.filter("_cuts", lambda c: c < value)).cast("long")
        base = materialize(base.join(cuts, [*key, "_chunk"], "left").withColumn(
            "_chunk", F.when(F.col("_cuts").isNull(), F.col("_chunk")).otherwise(F.concat("_chunk", F.array(part)))).drop("_cuts"), "chunks")
    return base


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None,
            maxima: dict[str, Column] | None = None, width: float | None = None,
            splits: list[float] | None = None, descending: bool = False, chunk_rows: int = CHUNK_ROWS,
            wanted=None) -> DataFrame:
    """One row per (keys, order value) with, for each measure m: m (own), m_before, m_upto, m_total.

    ``width`` gives fixed chunks of the order axis; otherwise ``splits`` (computed when absent). An integer
    width bounds a chunk by itself; other chunks are cut to at most about ``chunk_rows`` values. ``wanted`` makes of the
    (sum before a chunk, sum up to its end, total of the key) of each measure a condition: rows of other chunks are not read on.
    """
    sums, maxima = sums or {}, maxima or {}
    real = not isinstance(width, int)
    if width is None and splits is None:
        splits = value_splits(df, order)
    base = df.groupBy(*keys, order).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max(c).alias(n) for n, c in maxima.items()],
    ).withColumn("_chunk", _chunk(order, width, splits))
    # A struct is never null itself, so a group with an unknown key keeps its rows in the join below.
    key = ["_key"] if keys else []
    if keys:
        base = base.withColumn("_key", F.struct(*keys))
    # Said here, the filter that the join below implies is on both uses of the sums, so that their shuffle is done once.
    base = base.where(F.col("_chunk").isNotNull())
    if real:
        base = bounded_chunks(base, key, order, chunk_rows)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    earlier = W.partitionBy(*key).orderBy(direction("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*key)
    # One row per (key, chunk): small by construction, so its windows are cheap.
    carry = base.groupBy(*key, "_chunk").agg(
        *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxima],
    ).select(
        *key, "_chunk",
        *[F.sum(n).over(earlier).alias(f"_carry_{n}") for n in sums],
        *[F.max(n).over(earlier).alias(f"_carry_{n}") for n in maxima],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in sums], *[F.col(n).alias(f"_own_{n}") for n in sums],
    )
    if wanted is not None:
        start = {n: F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) for n in sums}
        carry = carry.where(wanted({n: (start[n], start[n] + F.col(f"_own_{n}"), F.col(f"{n}_total")) for n in sums}))
        base = base.join(carry, [*key, "_chunk"])
    inside = W.partitionBy(*key, "_chunk").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, -1)
    rows = base.select(
        "*",
        *[F.sum(n).over(inside).alias(f"_in_{n}") for n in sums],
        *[F.max(n).over(inside).alias(f"_in_{n}") for n in maxima],
    )
    if wanted is None:
        rows = rows.join(carry, [*key, "_chunk"])
    out = [F.col(k) for k in keys] + [F.col(order)]
    for n in sums:
        before = F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) + F.coalesce(F.col(f"_in_{n}"), F.lit(0))
        out += [F.col(n), before.alias(f"{n}_before"),
                (before + F.coalesce(F.col(n), F.lit(0))).alias(f"{n}_upto"), F.col(f"{n}_total")]
    for n in maxima:
        before = F.greatest(F.col(f"_carry_{n}"), F.col(f"_in_{n}"))
        out += [F.col(n), before.alias(f"{n}_before"), F.greatest(before, F.col(n)).alias(f"{n}_upto")]
    return rows.select(*out)


def ranks(df: DataFrame, keys: list[str], value: str, weight: Column | None = None, **chunking) -> DataFrame:
    """Distinct values with the count before, up to and in total: the exact distribution of a group.

    ``weight`` is the number of rows a row stands for.
    """
    return running(df.where(F.col(value).isNotNull()), keys, value, {"n": F.lit(1) if weight is None else weight}, **chunking)


def pick_positions(distribution: DataFrame, keys: list[str], value: str,
                   positions: dict[str, Column]) -> DataFrame:
    """Order statistics: for each name the value at a 0-based position (expression over ``n_total``)."""
    covers = {name: (F.col("n_before") <= p) & (p < F.col("n_upto")) for name, p in positions.items()}
    hit = None
    for condition in covers.values():
        hit = condition if hit is None else hit | condition
    return distribution.where(hit).groupBy(*keys).agg(
        F.max("n_total").alias("n_total"),
        *[F.max(F.when(c, F.col(value))).alias(name) for name, c in covers.items()])


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float],
              scale: float = 1.0, count: str | None = None, **chunking) -> DataFrame:
    """Exact linear-interpolated quantiles per group; results divided by ``scale``.

    Only the chunks that hold a wanted position are sorted; the others are known by their counts.
    """
    positions = {}
    for name, p in probabilities.items():
        at = (F.col("n_total") - 1) * F.lit(float(p))
        positions[f"_lo_{name}"] = F.floor(at)
        positions[f"_hi_{name}"] = F.ceil(at)

    def holds(counts):
        before, upto, total = counts["n"]
        at = [F.floor((total - 1) * F.lit(float(p))) for p in probabilities.values()] + [F.ceil((total - 1) * F.lit(float(p))) for p in probabilities.values()]
        return reduce(lambda a, b: a | b, [(before <= p) & (p < upto) for p in at])

    picked = pick_positions(ranks(df, keys, value, wanted=holds, **chunking), keys, value, positions)
    out = [F.col(k) for k in keys]
    if count:
        out.append(F.col("n_total").alias(count))
    for name, p in probabilities.items():
        at = (F.col("n_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(((low + (high - low) * (at - F.floor(at))) / F.lit(float(scale))).alias(name))
    return picked.select(*out)


def ecdf(queries: DataFrame, reference: DataFrame, keys: list[str], value: str,
         **chunking) -> DataFrame:
    """Right-closed rank of every query value in the reference of its key.

    Adds ``ref_upto`` = count(reference <= value) and ``ref_n``; unknown groups keep nulls.
    """
    both = reference.select(*keys, value, F.lit(1).alias("_ref")).unionByName(
        queries.select(*keys, value, F.lit(0).alias("_ref")))
    table = running(both.where(F.col(value).isNotNull()), keys, value, {"ref": F.col("_ref")}, **chunking)
    looked_up = table.select(*keys, value, F.col("ref_upto"), F.col("ref_total").alias("ref_n"))
    return queries.join(looked_up, [*keys, value], "left")


def strictly_prior(queries: DataFrame, events: DataFrame, keys: list[str], time: str,
                   sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None,
                   width: float = WEEK, windows: dict[str, int] | None = None) -> DataFrame:
    """As-of join: each query row gets the totals of events of its key with event time < query time.

    Equal times are excluded from each other's history. Hot keys are cut along time. ``windows``
    adds, per suffix, the sums over [time - length, time): a chunk is then at least as long as a window and is read with
    the one before it, where both edges are running sums. ``queries`` may be ``events`` itself: its times are then known.
    """
    sums, maxima, windows = sums or {}, maxima or {}, windows or {}
    width = max([width, *windows.values()])
    filled = events.select(*keys, time, *[c.alias(n) for n, c in sums.items()],
                           *[c.alias(n) for n, c in maxima.items()])
    if queries is not events:
        filled = filled.unionByName(queries.select(*keys, time), allowMissingColumns=True)
    if not windows:
        table = running(filled, keys, time, {n: F.col(n) for n in sums}, {n: F.col(n) for n in maxima},
                        width=width)
        before = table.select(*keys, time, *[F.col(f"{n}_before").alias(n) for n in [*sums, *maxima]])
    else:
        before = _before_and_within(filled, keys, time, [*sums], [*maxima], width, windows)
    return queries.join(before, [*keys, time], "left")


def _before_and_within(df: DataFrame, keys: list[str], time: str, sums: list[str], maxima: list[str], width: float, windows: dict[str, int]) -> DataFrame:
    """(keys, time) with every sum and maximum before the time, and every sum within each window before it."""
    base = df.groupBy(*keys, time).agg(*[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxima]).withColumn(
        "_chunk", _chunk(time, width, None)).where(F.col("_chunk").isNotNull()).withColumn("_key", F.struct(*keys))
    earlier = W.partitionBy("_key").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    # Of the chunk itself and the one before, so that the sums over both start after all that is carried.
    carry = base.groupBy("_key", "_chunk").agg(*[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxima])
    carry = carry.select("_key", "_chunk", *[F.sum(n).over(earlier).alias(f"_carry_{n}") for n in sums], *[F.max(n).over(earlier).alias(f"_carry_{n}") for n in maxima])
    twice = base.withColumn("_late", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_chunk", F.col("_chunk") + F.col("_late"))
    own = F.col("_late") == 0
    pair = W.partitionBy("_key", "_chunk").orderBy(time)
    passed = pair.rangeBetween(W.unboundedPreceding, -1)
    total = lambda value, frame: F.coalesce(F.sum(value).over(frame), F.lit(0))
    read = twice.select(
        *keys, time, "_key", "_chunk", "_late", *[total(F.when(own, F.col(n)), passed).alias(f"_in_{n}") for n in sums],
        *[F.max(F.when(own, F.col(n))).over(passed).alias(f"_in_{n}") for n in maxima],
        *[(total(F.col(n), passed) - total(F.col(n), pair.rangeBetween(W.unboundedPreceding, -length - 1))).alias(f"{n}{suffix}")
          for suffix, length in windows.items() for n in sums]).where(own)
    return read.join(carry, ["_key", "_chunk"]).select(
        *keys, time, *[(F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) + F.col(f"_in_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_carry_{n}", f"_in_{n}").alias(n) for n in maxima], *[f"{n}{suffix}" for suffix in windows for n in sums])


def join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two per-group tables in which an unknown key equals an unknown key."""
    if not keys:
        return attach_one_row(left, right)
    tagged = right.withColumn("_group", F.struct(*keys)).drop(*keys)
    return left.withColumn("_group", F.struct(*keys)).join(tagged, "_group", "left").drop("_group")


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of an ungrouped aggregate. Its size is one row, so a broadcast is safe."""
    return df.join(F.broadcast(one_row), how="cross")
