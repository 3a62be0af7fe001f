"""Near-duplicate vectors by E8 lattice hashing.

A unit vector is projected to sixteen Gaussian directions per table, and each half of the projection is decoded to the
nearest point of the E8 lattice (the nearer of the nearest points of D8 and of D8 shifted by one half). The pair of points
is the vector's cell; a vector is also filed under neighbouring cells, in which one or both halves move to the next nearest
points. Vectors of one label that share a cell of any table are compared by cosine in double precision.

Equal vectors are one vector with a multiplicity. A cell never writes its pairs: a task that holds a cell (or one chunk of
a large cell, or two chunks of it) writes for each of its vectors one link to the first vector of its linked part, so
links stay in proportion to members. Chunks of a large cell are first compared within themselves; two chunks meet only
where a cell still holds several components. Direct links are then counted, not listed, block by block inside each
component, so a link that no table found counts too if both ends are in one component.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.components import connected_components
from ordertide.llm.text import mix, settle, table

COSINE = 0.93
#: Tables, probed cells of each, and the projections' standard deviation for a unit vector: a pair at a cosine of 0.93 shares
#: no cell once in about 2 000, one at 0.97 once in 10**7; two unrelated vectors share one with a chance of 0.002.
TABLES, SCALE = 10, 0.6
HALF = 8
#: Rank of the lattice point (0 nearest) of each half, for each cell that a vector is filed under.
MOVES = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2))
#: Vectors that a task compares with each other at once.
CHUNK = 1024
ROWS = 8_192


def nearest_d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the next nearest point of D8 (integers with an even sum) of each row."""
    point = np.rint(x)
    miss = x - point
    worst, second = np.argsort(-np.abs(miss), axis=1, kind="stable")[:, :2].T
    step = np.where(miss >= 0, 1.0, -1.0)
    row = np.arange(len(x))
    odd = point.sum(axis=1) % 2 != 0
    near, other = point.copy(), point.copy()
    near[row[odd], worst[odd]] += step[row[odd], worst[odd]]
    other[row, second] += step[row, second]
    other[row[~odd], worst[~odd]] += step[row[~odd], worst[~odd]]
    return near, other


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Four close points of E8 of each row, nearest first, doubled to integers: rows x 4 x 8."""
    points = np.stack([*nearest_d8(x), *(p + 0.5 for p in nearest_d8(x - 0.5))], axis=1)
    far = ((points - x[:, None, :]) ** 2).sum(axis=2)
    order = np.argsort(far, axis=1, kind="stable")
    return (np.take_along_axis(points, order[:, :, None], axis=1) * 2).astype(np.int64)


@functools.lru_cache(maxsize=8)
def directions(size: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([size, 8])).normal(size=(size, TABLES * 2 * HALF)) * SCALE


def cells(unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit cell keys of unit vectors: rows x (tables x moves); ``salt`` keeps labels apart."""
    y = unit @ directions(unit.shape[1])
    out = np.empty((len(unit), TABLES, len(MOVES)), np.uint64)
    for t in range(TABLES):
        halves = []
        for h in (0, 1):
            points = nearest_e8(y[:, (2 * t + h) * HALF:(2 * t + h + 1) * HALF])
            key = np.full(points.shape[:2], 2 * t + h + 1, np.uint64)
            for k in range(HALF):
                key = mix(key + points[:, :, k].astype(np.uint64))
            halves.append(key)
        for k, (i, j) in enumerate(MOVES):
            out[:, t, k] = mix(mix(halves[0][:, i] + salt) + halves[1][:, j])
    return out.reshape(len(unit), -1)


def unit_vectors(raw: list[bytes]) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision, scaled first so that no square overflows."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, key of the vector under its label (null if it can't be linked), the vector as doubles."""
    for batch in batches:
        labels, vectors = batch.column(1).to_pylist(), batch.column(2)
        values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64) if len(vectors) else np.zeros(0)
        missing = vectors.values.is_null().to_numpy(zero_copy_only=False) if vectors.values.null_count else np.zeros(len(values), bool)
        bad = np.concatenate([[0], np.cumsum(missing | ~np.isfinite(values))])
        start = np.asarray(vectors.offsets)
        null = vectors.is_null().to_numpy(zero_copy_only=False)
        keys, raw = [], []
        for k in range(len(vectors)):
            lo, hi = int(start[k]), int(start[k + 1])
            x = values[lo:hi] + 0.0  # one zero
            fits = not null[k] and labels[k] is not None and bad[lo] == bad[hi] and x.any()
            raw.append(x.tobytes() if fits else None)
            keys.append(hashlib.blake2b(f"{labels[k]}:".encode() + raw[k], digest_size=16).digest() if fits else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())],
                                         names=["vec_id", "label", "key", "vector"])


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each vector and cell."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            raw, labels = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in labels], np.uint64)
            sizes = np.array([len(x) for x in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                own = np.sort(cells(unit_vectors([raw[k] for k in at]), salts[at] + np.uint64(size)), axis=1)
                new = np.ones(own.shape, bool)
                new[:, 1:] = own[:, 1:] != own[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(own[new].view(np.int64)), batch.column(0).take(pa.array(np.repeat(at, new.sum(axis=1))))],
                                                 names=["cell", "key"])


def first_of_parts(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of flags, the smallest index of its connected part."""
    label = np.arange(len(near))
    while True:
        seen = np.minimum(np.where(near, label[None, :], len(label)).min(axis=1, initial=len(label)), label)
        seen = np.minimum(seen, seen[seen])
        if (seen == label).all():
            return label
        label = seen


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Groups of rows with equal ``names`` from rows that arrive in their order; a group is held whole, no more."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = {f: batch.column(k).to_pylist() for k, f in enumerate(batch.schema.names)}
        keys = list(zip(*(columns[f] for f in names), strict=True))
        cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
        for lo, hi in itertools.pairwise(cuts):
            part = {f: v[lo:hi] for f, v in columns.items()}
            if held and all(held[f][0] == part[f][0] for f in names):
                held = {f: held[f] + part[f] for f in part}
                continue
            if held:
                yield held
            held = part
    if held:
        yield held


def _link(cosine: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each vector of a block to the first vector of its connected part: columns cell, block, label, key, vector.

    Rows come in order of (cell, block, label), so vectors of one label stand together.
    """
    for group in _groups(batches, ("cell", "block")):
        labels = np.unique(np.array(group["label"], object), return_inverse=True)[1]
        a, b = [], []
        if labels.max() > 0:
            unit = unit_vectors(group["vector"])
            near = (unit @ unit.T >= cosine) | (labels[:, None] == labels[None, :])
            first = first_of_parts(near)
            other = np.flatnonzero(labels[first] != labels)
            a, b = [group["key"][k] for k in first[other]], [group["key"][k] for k in other]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _count(cosine: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked rows of each vector inside one block: columns component, block, across, side, key, copies, vector.

    In a block of two chunks (``across``, sides 0 and 1) the vectors of one look at those of the other.
    """
    for group in _groups(batches, ("component", "block")):
        unit, side, copies = unit_vectors(group["vector"]), np.array(group["side"]), np.array(group["copies"], np.int64)
        near = unit @ unit.T >= cosine
        near[np.arange(len(unit)), np.arange(len(unit))] = False
        if group["across"][0]:
            near &= side[:, None] != side[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(group["key"], pa.binary()), pa.array(near @ copies, pa.int64())], names=["key", "links"])


def _blocks(members: DataFrame, group: str, across: bool) -> DataFrame:
    """Members (group, size, key, ...) with the blocks in which they meet others, and their side in it.

    A group is dealt by hash into chunks of about ``CHUNK`` members. Block i * chunks + j holds chunks i and j; without
    ``across`` only the blocks i = j are made.
    """
    met = members.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("long"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64(group, "key"), "chunks"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)) if across else F.col("chunk"))
    return (met.withColumn("block", F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other"))
            .withColumn("across", F.col("chunk") != F.col("other")).withColumn("side", (F.col("chunk") > F.col("other")).cast("int")))


def _links_of(members: DataFrame, vectors: DataFrame, cosine: float, across: bool) -> DataFrame:
    dealt = (_blocks(members, "cell", across).select("cell", "block", "label", "key").join(vectors.select("key", "vector"), "key")
             .select("cell", "block", "label", "key", "vector").repartition("cell", "block").sortWithinPartitions("cell", "block", "label", "key"))
    return dealt.mapInArrow(functools.partial(_link, cosine), "a binary, b binary").distinct()


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding",
                 label_column: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and not null, their vectors are equally long and the cosine reaches
    ``cosine``. Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing and form a
    component of their own. Repeated rows and rows of one id count each as a vector. component_id is the smallest id of the
    component, null ids left out; a null id is kept only where its component has no other. An empty table gives no rows;
    further columns are ignored.
    """
    rows = settle(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"),
                                 F.col(vector_column).cast("array<double>").alias("vector")).mapInArrow(
        _read, "vec_id long, label string, key binary, vector binary"), "vectors")
    known = settle(rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("label").alias("tag"), F.min("vector").alias("vector")), "distinct-vectors")
    filed = settle(known.select("key", "tag", "vector").mapInArrow(_file, "cell long, key binary"), "cells")
    shared = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = settle(filed.join(shared, "cell"), "members")
    links = settle(_links_of(members.withColumn("label", F.col("key")), known, cosine, False), "links")
    labels = connected_components(links)
    # Chunks of large cells meet where a cell still holds more than one component.
    large = members.where(F.col("size") > CHUNK).join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = large.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cell")
    further = settle(_links_of(large.join(mixed, "cell", "left_semi"), known, cosine, True), "links")
    if further.limit(1).count():
        labels = connected_components(links.unionByName(further))
    of_vector = known.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("label", "key"))
    of_vector = settle(of_vector.select("key", "component", "least", "copies", "vector"), "components")
    size = of_vector.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    size = settle(size, "component-sizes")
    dealt = _blocks(of_vector.join(size.where("size > 1").select("component", "size"), "component"), "component", True)
    dealt = (dealt.select("component", "block", "across", "side", "key", "copies", "vector").repartition("component", "block")
             .sortWithinPartitions("component", "block", "side", "key"))
    counted = dealt.mapInArrow(functools.partial(_count, cosine), "key binary, links long").groupBy("key").agg(F.sum("links").alias("links"))
    result = of_vector.select("key", "component", "copies").join(size, "component").join(counted, "key", "left")
    result = settle(result.select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-classes")
    linked = rows.where("key is not null").select("vec_id", "key").join(result, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_lattice_hashing(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
