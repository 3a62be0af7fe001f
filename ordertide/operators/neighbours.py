"""Exact k nearest neighbours and local outlier factors against a fit set of any size.

Fit points with equal coordinates are one point with a multiplicity. Points are dealt by ranges of their Z-order and
each run of ``RUN`` consecutive points is halved along its widest axis into compact blocks of at most ``BLOCK``, whose boxes are packed, ``FAN`` at a time, into a tree of tables. Queries
are cut into runs in the same way, and a run descends by equi-joins on the parent: a box that holds more than k points bounds the k-th distance by its
farthest corner, and boxes beyond the smallest such bound are left. The ``FIRST`` blocks with the nearest far corners of each run of a tile then give true bounds of its
runs, which rule out most other blocks before they are read. ``1 << TILE_BITS`` runs meet their blocks in one task, nearest first, and hold no more than the k nearest of
each query. What is known of points (k-distances, densities) travels with their blocks, so that no neighbour leaves its task.
Nothing is sampled, no pair of tables is crossed, and a block that many tiles want is copied to as many tasks as they need.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordertide.session import materialize

BLOCK, RUN, FAN, QUERIES = 128, 1 << 16, 32, 8192
#: Bits of a run's number within its tile, blocks that a run tries for its first bound, blocks of a tile in memory and those compared at once.
TILE_BITS, FIRST, HELD, TOGETHER = 6, 4, 512, 8
BITS = 16
#: Added to every mean reachability, as is usual, so that copies have a finite density.
LEAST_REACH = 1e-10


def _z_order(points: DataFrame, axes: list[str]) -> DataFrame:
    """Interleaved bits of the coordinates on a grid between their extremes; balance only, never results."""
    bounds = points.agg(*[f(a).alias(f"_{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    cells = [F.floor((F.col(a) - F.col(f"_lo_{a}")) / F.greatest(F.col(f"_hi_{a}") - F.col(f"_lo_{a}"), F.lit(1e-300)) * ((1 << BITS) - 1)) for a in axes]
    grid = points.join(F.broadcast(bounds), how="cross").withColumns({f"_q_{a}": c.cast("long") for a, c in zip(axes, cells, strict=True)})  # one row of bounds
    bit = lambda a, b: F.shiftleft(F.shiftright(F.col(f"_q_{a}"), b).bitwiseAND(1), b * len(axes) + axes.index(a))
    z = functools.reduce(lambda x, y: x.bitwiseOR(y), [bit(a, b) for b in range(min(BITS, 63 // len(axes))) for a in axes])
    return grid.select("point", *axes, "copies", z.alias("z"))


def _halves(x: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Rows cut at the median of their widest axis until ``size`` or fewer are together; neighbours come one after another."""
    todo = [rows]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            yield own
            continue
        values = x[:, own]
        widest = values[np.argmax(values.max(axis=1) - values.min(axis=1))]
        own = own[np.argpartition(widest, len(own) // 2)]
        todo += [own[len(own) // 2:], own[:len(own) // 2]]


def _cut(size: int, run: int, axes: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compact blocks of points from each ``run`` of consecutive ones: columns point, copies, axes."""
    part, seq, held = TaskContext.get().partitionId(), 0, []
    while True:
        batch = next(batches, None)
        held += [batch] if batch is not None else []
        if batch is not None and sum(map(len, held)) < run:
            continue
        rows = pa.Table.from_batches(held) if held else None
        for lo in range(0, len(rows) if rows else 0, run):
            own = rows.slice(lo, run)
            x = np.stack([np.asarray(own.column(a), np.float64) for a in axes])
            for at in _halves(x, np.arange(len(own)), size):
                yield _block(part, seq, own.take(pa.array(at)), axes)
                seq += 1
        held = []
        if batch is None:
            return


def _block(part: int, seq: int, rows: pa.Table, axes: list[str]) -> pa.RecordBatch:
    points, copies = (np.asarray(rows.column(c), np.int64) for c in ("point", "copies"))
    x = np.stack([np.asarray(rows.column(a), np.float64) for a in axes])
    return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n": int(copies.sum()), "low": x.min(axis=1).tolist(), "high": x.max(axis=1).tolist(),
                                        "points": points.tobytes(), "copies": copies.tobytes(), "x": x.tobytes()}], _BLOCK)


_BLOCK = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
                    ("points", pa.binary()), ("copies", pa.binary()), ("x", pa.binary())])
_BLOCK_COLUMNS = "part long, seq long, n long, low array<double>, high array<double>, points binary, copies binary, x binary"


class Index:
    """Blocks of fit points, and the boxes of each level above them as one table."""

    def __init__(self, points: DataFrame, axes: list[str]):
        order = ["z", *axes]
        dealt = _z_order(points, axes).repartitionByRange(*order).sortWithinPartitions(*order).select("point", "copies", *axes)
        self.axes = axes
        self.blocks = materialize(dealt.mapInArrow(functools.partial(_cut, BLOCK, RUN, axes), _BLOCK_COLUMNS), "blocks")
        far = self.blocks.agg(F.max("seq"), F.max("part")).first()
        seqs, parts = (far[0] or 0) + 1, (far[1] or 0) + 1
        boxes = self.blocks.select("part", "seq", "n", *[F.col(c)[k].alias(f"{c}{k}") for c in ("low", "high") for k in range(len(axes))])
        part, seq, levels = F.col("part"), F.col("seq"), []
        while True:
            up_part, up_seq = (part, F.floor(seq / FAN)) if seqs > 1 else (F.floor(part / FAN), F.lit(0).cast("long"))
            levels.append(boxes.groupBy(part.alias("part"), seq.alias("seq")).agg(
                F.lit(len(levels)).alias("level"), F.first(up_part).alias("up_part"), F.first(up_seq).alias("up_seq"), F.sum("n").alias("n"),
                *[F.min(f"low{k}").alias(f"low{k}") for k in range(len(axes))], *[F.max(f"high{k}").alias(f"high{k}") for k in range(len(axes))]))
            if seqs == parts == 1:
                break
            part, seq = up_part, up_seq
            seqs, parts = (-(-seqs // FAN), parts) if seqs > 1 else (1, -(-parts // FAN))
        self.top = len(levels) - 1
        self.boxes = materialize(functools.reduce(DataFrame.unionByName, levels), "boxes")


def _near_far(axes: list[str]) -> tuple:
    """Squared distances between the nearest and the farthest points of a run's box and an index box."""
    gap = [F.greatest(F.col(f"low{k}") - F.col(f"_high{k}"), F.col(f"_low{k}") - F.col(f"high{k}"), F.lit(0.0)) for k in range(len(axes))]
    reach = [F.greatest(F.col(f"_high{k}") - F.col(f"low{k}"), F.col(f"high{k}") - F.col(f"_low{k}")) for k in range(len(axes))]
    return sum((g * g for g in gap[1:]), gap[0] * gap[0]), sum((g * g for g in reach[1:]), reach[0] * reach[0])


def _descend(runs: DataFrame, index: Index, wanted: int) -> DataFrame:
    """The blocks in which the ``wanted`` nearest points of a run's queries can lie: run, part, seq, near, far, bound (squared)."""
    axes = index.axes
    sides = [f"_{side}{k}" for k in range(len(axes)) for side in ("low", "high")]
    box = [F.col(side)[k].alias(f"_{side}{k}") for k in range(len(axes)) for side in ("low", "high")]
    found = runs.select("run", *box, F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(float("inf")).alias("bound"))
    near, far = _near_far(axes)
    for level in range(index.top, -1, -1):
        boxes = index.boxes.where(F.col("level") == level)
        if level == index.top:
            met = found.join(boxes.drop("level", "up_part", "up_seq"), ["part", "seq"])
        else:
            boxes = boxes.drop("level").withColumnsRenamed({"part": "_part", "seq": "_seq"})
            met = found.join(boxes, (F.col("part") == F.col("up_part")) & (F.col("seq") == F.col("up_seq"))).drop("part", "seq", "up_part", "up_seq")
            met = met.withColumnsRenamed({"_part": "part", "_seq": "seq"})
        enough = F.min(F.when(F.col("n") >= wanted, far)).over(W.partitionBy("run"))
        met = met.withColumn("near", near).withColumn("far", far).withColumn("bound", F.least("bound", F.coalesce(enough, F.lit(float("inf"))) * (1 + 1e-12)))
        found = met.where("near <= bound").select("run", *sides, "part", "seq", "near", "far", "bound")
        if level:
            found = found.drop("near", "far")
    return found.drop(*sides)


class _Tile:
    """The points that the runs of a tile may be near to, by slot: ids, copies and their known values (rows of ``values``)."""

    def __init__(self, rows: int):
        self.ids, self.copies, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((rows, 0))

    def add(self, blocks: list[_Block]) -> list[int]:
        """The first slot of each block."""
        first = np.cumsum([len(self.ids), *[len(b.points) for b in blocks]])
        self.ids, self.copies = np.concatenate([self.ids, *[b.points for b in blocks]]), np.concatenate([self.copies, *[b.copies for b in blocks]])
        self.values = np.concatenate([self.values, *[b.values for b in blocks]], axis=1)
        return first[:-1].tolist()

    def leave(self, runs: list[_Run]) -> None:
        """Only the points that some query still holds."""
        used, at = np.unique(np.concatenate([r.slot.ravel() for r in runs]), return_inverse=True)
        self.ids, self.copies, self.values = self.ids[used], self.copies[used], self.values[:, used]
        at = np.split(at, np.cumsum([r.slot.size for r in runs])[:-1])
        for run, own in zip(runs, at, strict=True):
            run.slot = own.reshape(run.slot.shape)


class _Block:
    def __init__(self, run: int, points: bytes, copies: bytes, x: bytes, values: bytes | None, dims: int):
        self.run, self.points, self.copies = run, np.frombuffer(points, np.int64), np.frombuffer(copies, np.int64)
        self.x = np.frombuffer(x, np.float64).reshape(dims, -1)
        self.values = np.frombuffer(values or b"", np.float64).reshape(-1, len(self.points))
        self.low, self.high = self.x.min(axis=1), self.x.max(axis=1)


class _Run:
    """Queries that lie together, with the ``wanted`` nearest points met so far of each by (squared distance, point)."""

    def __init__(self, block: _Block, wanted: int):
        self.block, self.x, self.wanted = block, block.x, wanted
        self.squared = np.full((len(block.points), wanted), np.inf)
        self.slot = np.zeros((len(block.points), wanted), np.int64)

    def meet(self, blocks: list[_Block], low: np.ndarray, high: np.ndarray, first: list[int], ids: np.ndarray) -> None:
        """Blocks and their boxes by their distance from the run, a few at a time, until the rest is too far."""
        near = sum(np.maximum(np.maximum(low[:, k] - self.block.high[k], self.block.low[k] - high[:, k]), 0.0) ** 2 for k in range(len(self.x)))
        order = np.argsort(near, kind="stable")
        for at in range(0, len(order), TOGETHER):
            last = self.squared[:, -1]
            own = order[at:at + TOGETHER]
            own = own[near[own] <= last.max()]
            if not len(own):
                return
            apart = sum(np.maximum(np.maximum(low[own, k] - self.x[k][:, None], self.x[k][:, None] - high[own, k]), 0.0) ** 2 for k in range(len(self.x)))
            rows = np.flatnonzero((apart <= last[:, None]).any(axis=1))
            if len(rows):
                slots = np.concatenate([np.arange(first[b], first[b] + len(blocks[b].points)) for b in own])
                self._keep(rows, slots, np.concatenate([blocks[b].x for b in own], axis=1), ids)

    def _keep(self, rows: np.ndarray, slots: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        squared = np.zeros((len(rows), len(slots)))
        for own, other in zip(self.x, x, strict=True):
            squared += (own[rows, None] - other) ** 2
        both = np.concatenate([self.squared[rows], squared], axis=1)
        bound = np.partition(both, self.wanted - 1, axis=1)[:, self.wanted - 1]
        q, at = np.nonzero((both <= bound[:, None]) & np.isfinite(both))
        slot = np.where(at < self.wanted, self.slot[rows][q, np.minimum(at, self.wanted - 1)], slots[np.maximum(at - self.wanted, 0)])
        found = both[q, at]
        order = np.lexsort((ids[slot], found, q))
        q, slot, found = q[order], slot[order], found[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.wanted
        self.squared[rows] = np.inf
        self.squared[rows[q[keep]], rank[keep]], self.slot[rows[q[keep]], rank[keep]] = found[keep], slot[keep]

    def copies(self, tile: _Tile, own: bool) -> np.ndarray:
        """Copies of each point held, nearest first; with ``own`` a query is one of the copies of the point of its id, and not its own neighbour."""
        met = np.isfinite(self.squared)
        copies = np.where(met, tile.copies[self.slot], 0)
        return copies - (met & (tile.ids[self.slot] == self.block.points[:, None])) if own else copies


def _searched(wanted: int, dims: int, values: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Tile, list[_Run]]]:
    """The runs of each tile that has blocks after they met them. Rows (tile, run, block, points, copies, x, known) come by tile, runs of queries before blocks."""
    number, tile, runs, blocks = None, _Tile(values), [], []

    def meet() -> None:
        if len(tile.ids):
            tile.leave(runs)
        first = tile.add(blocks)
        low, high = (np.stack([getattr(b, side) for b in blocks]) for side in ("low", "high"))
        for run in runs:
            run.meet(blocks, low, high, first, tile.ids)
        blocks.clear()

    for batch in batches:
        for row in range(len(batch)):
            own, run, block, *packed = (batch.column(k)[row].as_py() for k in range(7))
            if blocks and (own != number or len(blocks) >= HELD):
                meet()
            if own != number:
                if len(tile.ids):
                    yield tile, runs
                number, tile, runs = own, _Tile(values), []
            if block:
                blocks.append(_Block(run, *packed, dims))
            else:
                runs.append(_Run(_Block(run, *packed, dims), wanted))
    if blocks:
        meet()
    if len(tile.ids):
        yield tile, runs


def _reach(wanted: int, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run the largest squared distance at which one of its queries has met ``wanted`` points."""
    for _, runs in _searched(wanted, dims, 0, batches):
        yield pa.RecordBatch.from_pydict({"run": [r.block.run for r in runs], "reach": [float(r.squared[:, -1].max()) for r in runs]})


def _neighbours(wanted: int, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tile, runs in _searched(wanted, dims, 0, batches):
        for run in runs:
            copies = run.copies(tile, False)
            before = np.cumsum(copies, axis=1) - copies
            q, at = np.nonzero(np.isfinite(run.squared) & (before < wanted))
            yield pa.RecordBatch.from_arrays([pa.array(run.block.points[q]), pa.array(tile.ids[run.slot[q, at]]), pa.array(copies[q, at]), pa.array(np.sqrt(run.squared[q, at])),
                                              pa.array(before[q, at])], names=["query", "point", "copies", "distance", "before"])


def _shares(copies: np.ndarray, k: int) -> np.ndarray:
    """How many of the k nearest copies are copies of each point."""
    return np.clip(k - (np.cumsum(copies, axis=1) - copies), 0, copies)


def _distances(run: _Run) -> np.ndarray:
    return np.sqrt(np.where(np.isfinite(run.squared), run.squared, 0.0))


def _k_distance(run: _Run, tile: _Tile, neighbours: list[int]) -> np.ndarray:
    """Distance of the k-th other fit row of each query, a row for each k; NaN where there are fewer."""
    copies, distance = run.copies(tile, True), _distances(run)
    shares = [_shares(copies, k) for k in neighbours]
    return np.stack([np.where(s.sum(axis=1) == k, np.where(s > 0, distance, 0.0).max(axis=1), np.nan) for k, s in zip(neighbours, shares, strict=True)])


def _density(run: _Run, tile: _Tile, neighbours: list[int], own: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Reachability density of each query, a row for each k, and the shares of its neighbours. The first rows of the tile's values are k-distances."""
    copies, distance, out = run.copies(tile, own), _distances(run), []
    shares = [_shares(copies, k) for k in neighbours]
    for reach, k, share in zip(tile.values, neighbours, shares, strict=False):
        out.append(1 / (np.where(share > 0, share * np.maximum(distance, reach[run.slot]), 0.0).sum(axis=1) / k + LEAST_REACH))
    return np.stack(out), shares


def _with_k_distances(wanted: int, dims: int, neighbours: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of fit points again, with the k-distances of their points."""
    for tile, runs in _searched(wanted, dims, 0, batches):
        yield from (_known(run, _k_distance(run, tile, neighbours)) for run in runs)


def _with_densities(wanted: int, dims: int, neighbours: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of fit points again, with the k-distances and the densities of their points."""
    for tile, runs in _searched(wanted, dims, len(neighbours), batches):
        yield from (_known(run, np.concatenate([run.block.values, _density(run, tile, neighbours, True)[0]])) for run in runs)


def _known(run: _Run, values: np.ndarray) -> pa.RecordBatch:
    b = run.block
    return pa.RecordBatch.from_pydict({"run": [b.run], "points": [b.points.tobytes()], "copies": [b.copies.tobytes()], "x": [b.x.tobytes()], "known": [values.tobytes()]}, _KNOWN)


_KNOWN = pa.schema([("run", pa.int64()), ("points", pa.binary()), ("copies", pa.binary()), ("x", pa.binary()), ("known", pa.binary())])
_KNOWN_COLUMNS = "run long, points binary, copies binary, x binary, known binary"


def _factors(wanted: int, axes: list[str], neighbours: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Axes and a factor for each k of every query."""
    n = len(neighbours)
    for tile, runs in _searched(wanted, len(axes), 2 * n, batches):
        for run in runs:
            density, shares = _density(run, tile, neighbours, False)
            around = [np.where(s > 0, s * d[run.slot], 0.0).sum(axis=1) for s, d in zip(shares, tile.values[n:], strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, run.x), *[pa.array(a / k / d) for a, k, d in zip(around, neighbours, density, strict=True)]],
                                             names=[*axes, *[f"factor{k}" for k in neighbours]])


def _number(seq) -> Column:
    return F.shiftleft("part", 32) + seq


def _met(runs: DataFrame, pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows for ``_searched``: the runs of queries and the ``blocks`` of ``pairs`` (tile, block), dealt by tile."""
    packed, one = ["points", "copies", "x", "known"], F.lit(1).cast("long")
    # Only blocks wanted more than QUERIES times, so at most a row for so many pairs.
    chunks = F.broadcast(pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("long").alias("chunks")).where("chunks > 1"))
    asked = pairs.join(chunks, "block", "left").withColumn("chunk", F.pmod(F.xxhash64("tile"), F.coalesce("chunks", one))).drop("chunks")
    held = blocks.select(F.col("run").alias("block"), *packed).join(chunks, "block", "left").withColumn(
        "chunk", F.explode(F.sequence(one - 1, F.coalesce("chunks", one) - 1)))
    blocks = asked.join(held, ["block", "chunk"]).select("tile", F.col("block").alias("run"), F.lit(True).alias("block"), *packed)
    queries = runs.select("tile", "run", F.lit(False).alias("block"), *packed)
    # A fixed number of tasks: the rows are few and each is long work.
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return queries.unionByName(blocks).repartition(parts, "tile").sortWithinPartitions("tile", "block")


def _tiled(runs: DataFrame) -> DataFrame:
    return runs.withColumn("tile", F.shiftright("run", TILE_BITS))


def _runs(queries: DataFrame, axes: list[str]) -> DataFrame:
    """Queries (query, axes) cut into runs of near ones: a written table."""
    order = ["z", *axes]
    dealt = _z_order(queries.select(F.col("query").alias("point"), *axes, F.lit(1).cast("long").alias("copies")), axes)
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("point", "copies", *axes)
    return _numbered(materialize(dealt.mapInArrow(functools.partial(_cut, BLOCK, RUN, axes), _BLOCK_COLUMNS), "runs"))


def _numbered(blocks: DataFrame) -> DataFrame:
    return _tiled(blocks.withColumn("run", _number(F.col("seq"))).withColumn("known", F.lit(None).cast("binary")))


def _wanted_blocks(runs: DataFrame, index: Index, wanted: int) -> DataFrame:
    """The blocks in which the ``wanted`` nearest points of a tile's queries can lie: tile, block."""
    blocks = _numbered(index.blocks)
    pairs = materialize(_descend(runs, index, wanted).withColumn("block", _number(F.col("seq"))).drop("part", "seq"), "descent")
    closest = pairs.withColumn("_at", F.row_number().over(W.partitionBy("run").orderBy("far", "block"))).where(F.col("_at") <= FIRST)
    tried = _met(runs, _tiled(closest).select("tile", "block").distinct(), blocks)
    reach = tried.mapInArrow(functools.partial(_reach, wanted, len(index.axes)), "run long, reach double")
    needed = pairs.join(materialize(reach, "reach"), "run").where(F.col("near") <= F.least("bound", F.col("reach") * (1 + 1e-12)))
    return materialize(_tiled(needed).select("tile", "block").distinct(), "tile-blocks")


def nearest(queries: DataFrame, index: Index, wanted: int) -> DataFrame:
    """The nearest points of each query until their copies number ``wanted``: query, point, copies, distance, before.

    ``before`` counts the copies of nearer points; equal distances go by point id. ``queries`` has query (unique) and the axes.
    """
    runs = _runs(queries, index.axes)
    found = _met(runs, _wanted_blocks(runs, index, wanted), _numbered(index.blocks))
    return found.mapInArrow(functools.partial(_neighbours, wanted, len(index.axes)), "query long, point long, copies long, distance double, before long")


def local_outlier_factors(fit: DataFrame, rows: DataFrame, axes: list[str], neighbours: list[int], key: str = "order_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Novelty scores of ``rows`` against ``fit``: key, ``keep``, neighbours, score (about 1 inside the fit set's density, larger outside).

    Both have the key (unique over both) and numeric axes. The k-distance and reachability density of fit points leave the point itself
    out; rows to be scored count all fit points. Rows or fit points with an unknown axis are left out. With ``neighbours`` fit
    rows or fewer there is no k-th neighbour and no score.

    No neighbour is written: the blocks of fit points are themselves runs of queries, which are searched twice and carry what is known of
    their points (k-distances, then densities) to the next search.
    """
    known = functools.reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in axes])
    points = materialize(fit.where(known).groupBy(*axes).agg(F.min(key).alias("point"), F.count(F.lit(1)).alias("copies")), "fit-points")
    index = Index(points, axes)
    wanted, dims = max(neighbours) + 1, len(axes)
    blocks = _numbered(index.blocks)
    pairs = _wanted_blocks(blocks, index, wanted)
    reached = functools.partial(_with_k_distances, wanted, dims, neighbours)
    blocks = _tiled(materialize(_met(blocks, pairs, blocks).mapInArrow(reached, _KNOWN_COLUMNS), "k-distances"))
    dense = functools.partial(_with_densities, wanted, dims, neighbours)
    blocks = _tiled(materialize(_met(blocks, pairs, blocks).mapInArrow(dense, _KNOWN_COLUMNS), "densities"))
    asked = rows.where(known).select(key, *keep, *axes)
    runs = _runs(materialize(asked.groupBy(*axes).agg(F.min(key).alias("query")), "scored-points"), axes)
    found = _met(runs, _wanted_blocks(runs, index, wanted), blocks)
    scores = found.mapInArrow(functools.partial(_factors, wanted, axes, neighbours), ", ".join([f"{a} double" for a in axes] + [f"factor{k} double" for k in neighbours]))
    pieces = ", ".join(f"{k}, factor{k}" for k in neighbours)
    return asked.join(scores, axes).select(key, *keep, F.expr(f"stack({len(neighbours)}, {pieces}) AS (neighbours, score)")).where("NOT isnan(score)")
