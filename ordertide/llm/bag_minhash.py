"""Near-duplicate detection with BagMinHash signatures.

A text is the multiset of its five-word shingles (words split at white space; a shorter text is one shingle). Its weights,
the counts, are cut into dyadic ranges of levels: (0, 1], (1, 2], (2, 4], ... Each shingle and range has a Poisson process
whose rate is proportional to the range's width; its points, drawn from hashes in increasing order, fall on random
components of the signature and on random levels, and count if their level is at most the weight. A component keeps its
smallest point. Points beyond a text's largest minimum can change nothing, so every process stops early: a text needs
about as many points as it has shingles plus m ln m, instead of m for each shingle. Components of two texts agree with a
probability equal to their weighted Jaccard similarity.

Signatures are cut into bands. Texts that share a band are candidates: in a band of up to eight texts each with each, in a
larger one each text, over all its bands, with the three that agree with it in most signature components. Candidates are
verified by exact multiset overlap, and components are formed. Then every text outside the largest component of a larger band
is compared with all texts of other components there, in the first band a pair shares; of any two components one is not the
largest, so no link is missed. This second step judges pairs where they meet and returns links only, so that a group of copies
with outliers gives no rows for the pairs below the threshold; where many texts of a band lie just below it, all of their pairs
are still compared. Bands are dealt into chunks by texts and shingles, and each chunk meets each in a block of its own; memory
per task stays bounded. Equal texts are one text throughout; they are written once, in buckets of their id, so that no step
moves the texts themselves but those of its pairs. Later links are contracted to components before these are joined.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.llm.components import connected_components
from ordertide.llm.text import Rolling, Words, blocks, mix, release, settle, table, unit
from ordertide.session import new_run_folder

WORDS_PER_SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5  # a pair at 0.8 misses every band once in 14 000
SMALL, CHUNK = 8, 4096
LONG_WORD = 64
CHUNK_SHINGLES = 512 * CHUNK  # of a chunk whose texts are compared in place
NEAREST = 3  # partners of a text in a large band before components are known
LEAST_AGREEMENT = 0.6  # of a signature's components: five standard deviations below the threshold


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every shingle of a block, in order of text."""
    rolling = Rolling(words.hash)
    hashes = rolling.windows(WORDS_PER_SHINGLE)
    at = np.flatnonzero(words.window_starts(WORDS_PER_SHINGLE))
    text = words.text_of_word()[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < WORDS_PER_SHINGLE))
    if len(short):
        whole = rolling.spans(words.first[short], words.first[short + 1])
        return np.concatenate([text, short]), np.concatenate([hashes[at], whole])
    return text, hashes[at]


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """BagMinHash signature of each text from its distinct shingles and their counts."""
    ranges = int(weight.max(initial=0) - 1).bit_length() + 1 if len(weight) else 0
    parts = []
    for i in range(ranges):
        low, width = (0, 1) if i == 0 else (1 << (i - 1), 1 << (i - 1))
        own = np.flatnonzero(weight > low)
        parts.append((text[own], mix(shingle[own] + np.uint64((i + 1) * 0xD1342543DE82EF95 % (1 << 64))), np.full(len(own), width, np.float64),
                      np.minimum(weight[own] - low, width)))
    least, point = np.full(n_texts * m, np.inf), np.zeros(n_texts * m, np.uint64)
    if not parts:
        return point.reshape(n_texts, m)
    doc, seed, width, within = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.argsort(doc, kind="stable")
    doc, seed, width, within = doc[order], seed[order], width[order], within[order]
    when, limit, turn = np.zeros(len(doc)), np.full(n_texts, np.inf), 0
    while len(doc):
        turn += 1
        x = mix(seed + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        when = when - np.log(unit(x)) / (m * width)
        go = when < limit[doc]
        doc, seed, width, within, when, x = doc[go], seed[go], width[go], within[go], when[go], x[go]
        y = mix(x ^ np.uint64(0x5851F42D4C957F2D))
        counts = unit(mix(y)) * width < within  # the point's level lies within the weight
        slot = (doc * m + (y % np.uint64(m)).astype(np.int64))[counts]
        t, ident = when[counts], x[counts]
        np.minimum.at(least, slot, t)
        first = least[slot] == t
        point[slot[first]] = ident[first]
        if len(doc):
            still = doc[np.concatenate([[True], doc[1:] != doc[:-1]])]
            limit[still] = least.reshape(n_texts, m)[still].max(axis=1)
    return point.reshape(n_texts, m)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = BANDS * ROWS
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch, "text"):
            n = hi - lo
            words = Words(data, offsets)
            for k in np.flatnonzero(words.end - words.start > LONG_WORD):  # sums of bytes can be made to collide on long words
                words.hash[k] = int.from_bytes(hashlib.blake2b(data[words.start[k]:words.end[k]].tobytes(), digest_size=8).digest(), "little")
            text, shingle = shingles(words)
            order = np.lexsort((shingle, text))
            text, shingle = text[order], shingle[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
            at = np.flatnonzero(new)
            weight = np.diff(np.append(at, len(text)))
            sig = signatures(text[at], shingle[at], weight, n, m)
            bands = sig.reshape(n, BANDS, ROWS)
            key = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = mix(key + bands[:, :, r])
            short = (shingle >> np.uint64(32)).astype(np.uint32)
            cut = np.searchsorted(text, np.arange(n + 1))
            worded = words.counts > 0
            ends = np.concatenate([[0], np.cumsum(worded) * BANDS]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[worded].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(np.diff(cut), pa.int32()), keys,
                 pa.array([short[cut[k]:cut[k + 1]].tobytes() for k in range(n)], pa.binary()),
                 pa.array([row.tobytes() for row in sig.astype(np.uint8)], pa.binary())],
                names=["t", "n", "bands", "shingles", "sig"])


def overlap(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two multisets of shingle hashes (sorted, repeated by count)."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.concatenate([x, y])
    values, at = np.unique(both, return_inverse=True)
    p, q = np.bincount(at[:len(x)], minlength=len(values)), np.bincount(at[len(x):], minlength=len(values))
    most = np.maximum(p, q).sum()
    return float(np.minimum(p, q).sum() / most) if most else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([overlap(p, q) for p, q in zip(x, y, strict=True)], pa.float64())],
                                         names=["a", "b", "similarity"])


def judged(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of text ids, and whether their exact multiset similarity reaches the threshold (linked)."""
    left = texts.select(F.col("t").alias("a"), F.col("shingles").alias("sa"))
    right = texts.select(F.col("t").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return met.mapInArrow(_verify, "a binary, b binary, similarity double").select("a", "b", (F.col("similarity") >= similarity).alias("linked"))


def filed(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` as a written table in buckets of ``column``: a join on it moves only the rows of its other side."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_run_folder(spark, name)
    known_as = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(known_as)
    del df
    release()
    return spark.table(known_as)


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further ``links`` (a, b) between different components, which are contracted to their labels first."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left").withColumn(
            f"{end}_label", F.coalesce(f"{end}_label", end))
    contracted = settle(ends.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct(), "contracted")
    merged = connected_components(contracted).select(F.col("node").alias("label"), F.col("label").alias("into"))
    fresh = merged.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("into").alias("label"))
    moved = labels.join(merged, "label", "left").select("node", F.coalesce("into", "label").alias("label"))
    return settle(moved.unionByName(fresh), "labels")


def _by_block(judge, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``judge`` of the rows of whole (band, block)s, which are the first two columns and arrive in order."""
    held: list[tuple] = []
    for batch in batches:
        rows = held + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        last = rows[-1][:2] if rows else None
        cut = next((k for k in range(len(rows) - 1, -1, -1) if rows[k][:2] != last), -1) + 1
        yield judge(rows[:cut])
        held = rows[cut:]
    yield judge(held)


def _groups(rows: list[tuple]) -> Iterator[list[tuple]]:
    start = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k][:2] != rows[start][:2]:
            yield rows[start:k]
            start = k


def _pairs(nearest: int, similarity: float, rows: list[tuple]) -> pa.RecordBatch:
    """Pairs of small bands (agree null, each once), and proposals of large ones: a looks at b and agrees in so many components."""
    small, out = set(), []
    for group in _groups(rows):
        if group[0][5] is None:
            small.update((min(a[3], b[3]), max(a[3], b[3]), None) for i, a in enumerate(group) for b in group[:i]
                         if min(a[4], b[4]) >= similarity * max(a[4], b[4]))
        else:
            out.extend(_nearest(group, nearest, similarity))
    out.extend(sorted(small))
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int32()))], names=["a", "b", "agree"])


def _agreement(own: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Components in which each signature of ``own`` equals each of ``columns`` (one row per component)."""
    agree = np.zeros((len(own), columns.shape[1]), np.uint8)
    for mine, c in zip(own.T, columns, strict=True):
        agree += mine[:, None] == c[None, :]
    return agree


def _nearest(group: list[tuple], nearest: int, similarity: float) -> Iterator[tuple[bytes, bytes, int]]:
    """For each text the ``nearest`` others that agree in most components, at least in ``LEAST_AGREEMENT``, of those that are
    not too short or long. Two chunks of a band (sides 0 and 1) look at each other only."""
    names = [r[3] for r in group]
    n, side = np.array([r[4] for r in group], np.float64), np.array([r[2] for r in group])
    sig = np.stack([np.frombuffer(r[5], np.uint8) for r in group])
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for rows, others in ((first, second), (second, first)) if len(second) else ((first, first),):
        columns = np.ascontiguousarray(sig[others].T)
        for lo in range(0, len(rows) if len(others) else 0, 256):
            own = rows[lo:lo + 256]
            agree = _agreement(sig[own], columns)
            agree[own[:, None] == others[None, :]] = 0
            agree[np.minimum(n[own][:, None], n[others][None, :]) < similarity * np.maximum(n[own][:, None], n[others][None, :])] = 0
            best = np.argpartition(agree, -nearest, axis=1)[:, -nearest:] if nearest < len(others) else np.broadcast_to(np.arange(len(others)), agree.shape)
            k, at = np.nonzero(np.take_along_axis(agree, best, axis=1) >= LEAST_AGREEMENT * BANDS * ROWS)
            for x, y, agreed in zip(own[k].tolist(), others[best[k, at]].tolist(), agree[k, best[k, at]].tolist(), strict=True):
                yield names[x], names[y], agreed


def candidates(members: DataFrame, nearest: int, similarity: float) -> DataFrame:
    """Distinct candidate pairs (a, b) of members (band, size, t, n, sig; sig null in small bands).

    A text's proposals from all blocks of all its large bands are put together, and the ``nearest`` that agree most are tested.
    """
    chunks = F.ceil(F.col("size") / CHUNK).cast("long")
    met = members.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("band", "t"), "chunks"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.withColumn("block", F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")).withColumn("side", (F.col("chunk") > F.col("other")).cast("int"))
    dealt = met.select("band", "block", "side", "t", "n", "sig").repartition("band", "block").sortWithinPartitions("band", "block")
    judge = functools.partial(_by_block, functools.partial(_pairs, nearest, similarity))
    found = dealt.mapInArrow(judge, "a binary, b binary, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))
    turn = F.row_number().over(Window.partitionBy("a").orderBy(F.desc_nulls_last("agree"), "b"))
    chosen = found.withColumn("turn", turn).where((F.col("turn") <= nearest) | F.col("agree").isNull())
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _told_apart(shingles: bytes) -> np.ndarray:
    """A sorted multiset as a set: each value with the number of equal ones before it."""
    x = np.frombuffer(shingles, np.uint32).astype(np.uint64)
    place = np.arange(len(x))
    new = np.append(True, x[1:] != x[:-1])
    return (x << np.uint64(32)) + (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)


def _links(similarity: float, rows: list[tuple]) -> pa.RecordBatch:
    """Links of seekers to texts of other components in their blocks, one per seeker and component."""
    out = [link for group in _groups(rows) for link in _found(group, similarity)]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _found(group: list[tuple], similarity: float) -> Iterator[tuple[bytes, bytes]]:
    """One block (columns band, block, seeks, outside, t, label, n, sig, bands, shingles): each seeker, exactly, with the texts
    that have another label, a like length and signature, and this band as the first they share."""
    seekers, others = [r for r in group if r[2]], [r for r in group if not r[2]]
    if not seekers or not others:
        return
    names = {x: k for k, x in enumerate(sorted({r[5] for r in group}))}
    label, n = np.array([names[r[5]] for r in others]), np.array([r[6] for r in others], np.int64)
    bands = np.array([r[8] for r in others], np.int64)
    columns = np.ascontiguousarray(np.stack([np.frombuffer(r[7], np.uint8) for r in others]).T)
    sets: list[np.ndarray | None] = [None] * len(others)
    for lo in range(0, len(seekers), 256):
        own = seekers[lo:lo + 256]
        agree = _agreement(np.stack([np.frombuffer(r[7], np.uint8) for r in own]), columns)
        for mine, agreed in zip(own, agree, strict=True):
            at = np.flatnonzero((agreed >= LEAST_AGREEMENT * BANDS * ROWS) & (label != names[mine[5]]) & (np.minimum(n, mine[6]) >= similarity * np.maximum(n, mine[6])))
            shared = bands[at] == np.array(mine[8], np.int64)
            at = at[bands[at, shared.argmax(axis=1)] == mine[0]]
            at = np.array([k for k in at.tolist() if not others[k][3] or mine[4] < others[k][4]], np.int64)  # two seekers meet twice
            if not len(at):
                continue
            for k in at.tolist():
                if sets[k] is None:
                    sets[k] = _told_apart(others[k][9])
            wanted, parts = _told_apart(mine[9]), [sets[k] for k in at.tolist()]
            values = np.concatenate(parts)
            hit = wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum([0] + [len(x) for x in parts[:-1]]))
            linked = at[both / (n[at] + mine[6] - both) >= similarity]
            for k in linked[np.unique(label[linked], return_index=True)[1]].tolist():
                yield mine[4], others[k][4]


def remaining_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """All links between components, but one per text and component, of members (band, t, n, label): the texts outside a band's
    largest component are compared with all others of the band."""
    of_label = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    most = F.max(F.struct("k", "n", "label"))
    shares = of_label.groupBy("band").agg(most.alias("most"), F.sum("k").alias("k"), F.sum("n").alias("n")).where("k > most.k")

    def chunks(k, n):
        return F.ceil(F.greatest(k / CHUNK, n / CHUNK_SHINGLES)).cast("long")

    shares = shares.select("band", F.col("most.label").alias("largest"), chunks(F.col("k"), F.col("n")).alias("all_chunks"),
                           chunks(F.col("k") - F.col("most.k"), F.col("n") - F.col("most.n")).alias("seeker_chunks"))
    mixed = members.join(shares, "band").withColumn("outside", F.col("label") != F.col("largest")).drop("largest")
    full = mixed.join(texts.select("t", "sig", "bands", "shingles"), "t")
    dealt = F.xxhash64("band", "t")
    zero = F.lit(0).cast("long")

    def block(i, j, seeks):
        return F.struct((i * F.col("seeker_chunks") + j).alias("block"), F.lit(seeks).alias("seeks"))

    as_other = F.transform(F.sequence(zero, F.col("seeker_chunks") - 1), lambda j: block(F.pmod(dealt, F.col("all_chunks")), j, False))
    as_seeker = F.transform(F.sequence(zero, F.col("all_chunks") - 1), lambda i: block(i, F.pmod(dealt, F.col("seeker_chunks")), True))
    places = F.when(F.col("outside"), F.concat(as_other, as_seeker)).otherwise(as_other)
    met = full.select("band", F.inline(places), "outside", "t", "label", "n", "sig", "bands", "shingles")
    judge = functools.partial(_by_block, functools.partial(_links, similarity))
    return met.repartition("band", "block").sortWithinPartitions("band", "block").mapInArrow(judge, "a binary, b binary")


def has_word() -> Column:
    return F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))


def _text_id() -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Each row's doc_id, key (hash of its text), label (of its class) and class_id, the smallest doc_id of all texts linked with its text.

    Equal texts are in one class; a text without a word (null, empty, white space) is in a class of its own, as is a row
    without a link. Null ids never name a class unless all of its ids are null. Repeated rows are kept. An empty table
    gives no rows; further columns are ignored.
    """
    # The id is the head of the text's SHA-256; texts are signed once and written without their repeats.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), _text_id().alias("t"), has_word().alias("worded"))
    signed = docs.where(has_word()).select(_text_id().alias("t"), "text").mapInArrow(_sign, "t binary, n int, bands array<long>, shingles binary, sig binary")
    texts = filed(signed.dropDuplicates(["t"]), "t", "texts")
    bands = texts.select("t", "n", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = settle(bands.join(shared, "band"), "members")
    large = members.where(F.col("size") > SMALL)
    looking = members.where(F.col("size") <= SMALL).withColumn("sig", F.lit(None).cast("binary")).unionByName(large.join(texts.select("t", "sig"), "t"))
    pairs = settle(candidates(looking, NEAREST, similarity), "pairs")
    labels = connected_components(judged(pairs, texts, similarity).where("linked").select("a", "b"))
    marked = settle(large.join(labels.withColumnRenamed("node", "t"), "t", "left").select("band", "t", "n", F.coalesce("label", "t").alias("label")), "marked")
    links = settle(remaining_links(marked, texts, similarity).distinct(), "links")
    if links.limit(1).count():
        labels = joined_labels(labels, links)
    of_text = rows.join(labels.withColumnRenamed("node", "t"), "t", "left")
    of_text = settle(of_text.select("doc_id", "key", "worded", F.coalesce("label", "t").alias("label")), "classes")
    named = of_text.where("worded").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return of_text.where("worded").join(named, "label").select("doc_id", "key", "label", "class_id").unionByName(
        of_text.where("not worded").select("doc_id", "key", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("class_id")))


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that with the smallest id (then the smallest text hash); columns stay as they are.

    Texts without a word all stay. Of wholly equal rows one stays.
    """
    last = F.lit((1 << 63) - 1)
    classes = near_duplicates(docs, similarity).withColumn("_rank", F.coalesce("doc_id", last))
    first = classes.where("label is not null").groupBy("label").agg(F.min(F.struct("_rank", "key")).alias("first"))
    stay = settle(first.select("first._rank", F.col("first.key").alias("_key")).unionByName(
        classes.where("label is null").select("_rank", F.col("key").alias("_key"))).distinct(), "stay")
    kept = docs.withColumns({"_rank": F.coalesce(F.col("doc_id").cast("long"), last), "_key": F.xxhash64("text")}).join(stay, ["_rank", "_key"], "left_semi")
    turn = F.row_number().over(Window.partitionBy("_rank", "_key").orderBy(F.lit(0)))
    return kept.withColumn("_turn", turn).where((F.col("_turn") == 1) | ~has_word()).select(*docs.columns)


def op2_bag_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
