"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

The index is cut into blocks of documents. A block holds, for each of its terms, the list of its documents in descending
order of impact, and is one row of a written table: documents are never shuffled. A query reads the lists of its terms
from the top, all to the same depth, four times as deep in each round. What was read of a document is the lower bound of
its score; the impacts next in line on the lists in which it was not met make the upper bound. The threshold is the k-th
best lower bound of the block and of the blocks that the task has read before. Reading goes on until each document whose
upper bound reaches the threshold has equal bounds, so membership, ties and scores are final; a block whose first impacts
do not add up to the threshold is not read at all. Each task hands on its k best documents per query, and these are ranked.

Items are read in groups of bounded size, one group at a time: a group's terms are counted over the index, weighted and
broadcast, and the index is searched once.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordertide.llm.text import ALNUM, Words, blocks, buffers, settle, table

TOP = 10
#: Text of one block of the index; item text of one group (its terms are what is broadcast, eight bytes each and their weights).
INDEX_BYTES, GROUP_BYTES = 4 << 20, 8 << 20
#: Depth of the first round, and how much deeper each further one reads.
DEPTH, DEEPER = 256, 4
#: Words of more bytes are hashed by a keyed cryptographic hash instead of a sum.
LONG_WORD = 64


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Terms of a block of texts: lower-cased runs of letters and digits, with 64-bit hashes."""
    words = Words(data, offsets, ALNUM, lower=True)
    for k in np.flatnonzero(words.end - words.start > LONG_WORD):
        term = data[words.start[k]:words.end[k]].tobytes().lower()  # of bytes: A-Z alone
        words.hash[k] = int.from_bytes(hashlib.blake2b(term, digest_size=8).digest(), "little")
    return words


def _count_terms(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch the documents with a term and their terms."""
    for batch in batches:
        docs = terms = 0
        for _, _, data, offsets in blocks(batch, "text", size):
            counts = Words(data, offsets, ALNUM, lower=True).counts
            docs, terms = docs + int((counts > 0).sum()), terms + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])


def norm(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The length norm of documents with ``n`` terms."""
    if len(n) and int(n.max()) * docs >= (1 << 63) // 90:  # beyond 64 bits
        return np.array([10 + 90 * int(x) * docs // terms for x in n], np.int64)
    return 10 + 90 * n * docs // max(terms, 1)


def _index(docs: int, terms: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch, "text", size):
            words = term_hashes(data, offsets)
            order = np.argsort(words.hash, kind="stable")  # by term, then by document
            term, doc = words.hash[order], words.text_of_word()[order]
            first = np.ones(len(term), bool)
            first[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(first)
            tf = np.diff(np.append(at, len(term)))
            term, doc = term[at], doc[at]
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm(words.counts, docs, terms)[doc])
            new = np.ones(len(term), bool)
            new[1:] = term[1:] != term[:-1]
            order = np.lexsort((doc, -impact, np.cumsum(new)))
            starts = np.append(np.flatnonzero(new), len(term)).astype(np.int32)
            ids = batch.column(0).slice(lo, hi - lo)
            row = [np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null().to_numpy(zero_copy_only=False)), term[new], starts,
                   doc[order].astype(np.int32), impact[order].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=[f.split()[0] for f in INDEX.split(", ")])


#: ids and missing ids of the block's documents; its terms and where their lists start; documents and impacts of all lists.
INDEX = "ids binary, missing binary, terms binary, starts binary, docs binary, impacts binary"


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                block_bytes: int = INDEX_BYTES) -> tuple[DataFrame, int]:
    """The index of all rows, a written table, and the number of documents that have a term."""
    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    total = read.mapInArrow(functools.partial(_count_terms, block_bytes), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n, terms = int(total[0] or 0), int(total[1] or 0)
    return settle(read.mapInArrow(functools.partial(_index, n, terms, block_bytes), INDEX), "impact-index"), n


class Queries:
    """One group of items: sorted distinct terms, each item's terms as positions among them, and the terms' weights."""

    def __init__(self, texts: list[str]):
        data, offsets = buffers(pa.array(texts, pa.string()))
        words = term_hashes(data, offsets)
        pairs = np.unique(np.stack([words.text_of_word().astype(np.uint64), words.hash]), axis=1)
        self.terms, self.position = np.unique(pairs[1], return_inverse=True)
        self.first = np.searchsorted(pairs[0], np.arange(len(texts) + 1).astype(np.uint64))
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, counts: dict[int, int], docs: int) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * counts.get(k, 0) + 1))) for k in range(len(self.terms))], np.int64)


def _lists(terms: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) place of each wanted term's list in a block; equal where the block lacks it."""
    if not len(terms):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    there = terms[at] == wanted
    return np.where(there, starts[at], 0).astype(np.int64), np.where(there, starts[at + 1], 0).astype(np.int64)


def _count_documents(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each of the group's terms (by position), summed up over the task's blocks."""
    wanted = held.value
    counts = np.zeros(len(wanted), np.int64)
    for batch in batches:
        for terms, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lo, hi = _lists(np.frombuffer(terms, np.uint64), np.frombuffer(starts, np.int32), wanted)
            counts += hi - lo
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["term", "docs"])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [lo, hi), and which range each is of."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def resolve(lo: np.ndarray, hi: np.ndarray, weights: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, k: int,
            held: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Documents of one block that can be among the k best, with their scores, by rounds of sequential reads.

    List i is at [lo[i], hi[i]) and counts weights[i] times its impacts, which descend. ``held`` are scores found before.
    """
    lower, seen = np.zeros(n_docs, np.int64), np.zeros((len(lo), n_docs), bool)
    read = lo
    while True:
        to = np.minimum(hi, lo + depth)
        place, which = _ranges(read, to)
        np.add.at(lower, docs[place], weights[which] * impacts[place].astype(np.int64))
        seen[which, docs[place]] = True
        read, depth = to, depth * DEEPER
        ahead = np.where(read < hi, weights * impacts[np.minimum(read, len(impacts) - 1)].astype(np.int64), 0)
        upper = lower + (ahead.sum() - ahead @ seen)
        best = np.concatenate([held, lower])
        threshold = np.partition(best, len(best) - k)[len(best) - k] if len(best) > k else 0
        can = (upper >= max(threshold, 1))
        if (lower[can] == upper[can]).all():
            at = np.flatnonzero(can)
            return at, lower[at]


def _search(held, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best documents of each query among all blocks of the task: query, doc_id, score."""
    queries: Queries = held.value
    n = len(queries.first) - 1
    best: list[list[tuple[int, bool, int]]] = [[] for _ in range(n)]  # (-score, id missing, id), in order
    scores = [np.zeros(0, np.int64)] * n
    for batch in batches:
        for packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, missing, terms, starts, docs, impacts = (np.frombuffer(x, kind) for x, kind in zip(
                packed, (np.int64, bool, np.uint64, np.int32, np.int32, np.int32), strict=True))
            if not len(terms):
                continue
            lo, hi = _lists(terms, starts, queries.terms)
            top = np.where(hi > lo, queries.weights * impacts[np.minimum(lo, len(impacts) - 1)].astype(np.int64), 0)
            for q in range(n):
                own = queries.position[queries.first[q]:queries.first[q + 1]]
                least = -best[q][-1][0] if len(best[q]) == k else 1
                if top[own].sum() < least:
                    continue
                own = own[top[own] > 0]
                at, found = resolve(lo[own], hi[own], queries.weights[own], docs, impacts, len(ids), k, scores[q])
                best[q] = sorted([*best[q], *zip((-found).tolist(), missing[at].tolist(), ids[at].tolist(), strict=True)])[:k]
                scores[q] = np.array([-x[0] for x in best[q]], np.int64)
    rows = [(q, None if x[1] else x[2], -x[0]) for q in range(n) for x in best[q]]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                      pa.array([r[2] for r in rows], pa.int64())], names=["query", "doc_id", "score"])


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = TOP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score; highest score first, equal ones by ascending doc_id.

    ``items`` has item_id and text. Equal rows are one item; rows that share an id but not their text are ranked each on its
    own. Null, empty and term-less texts find nothing, on either side. Documents without an id rank behind equal scores that
    have one; repeated documents are ranked each. Empty tables give no rows; further columns are ignored.
    """
    spark, kind = items.sparkSession, items.schema["item_id"].dataType
    asked = settle(items.select("item_id", F.col("text").cast("string").alias("text")).where("text <> ''").distinct(), "items")
    size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups, found = math.ceil(size / group_bytes), None
    for group in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == group).collect()
        queries = Queries([r["text"] for r in rows])
        if not len(queries.terms):
            continue
        wanted = spark.sparkContext.broadcast(queries.terms)
        counted = (index.select("terms", "starts").mapInArrow(functools.partial(_count_documents, wanted), "term long, docs long")
                   .groupBy("term").agg(F.sum("docs").alias("docs")))
        queries.weigh({r["term"]: r["docs"] for r in counted.collect()}, n_docs)
        held = spark.sparkContext.broadcast(queries)
        best = index.mapInArrow(functools.partial(_search, held, k), "query long, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], "query long, item_id " + kind.simpleString())
        part = settle(best.join(names, "query").select("item_id", "rank", "doc_id", "score"), "ranked")
        found = part if found is None else found.unionByName(part)
        for shared in (wanted, held):
            shared.destroy()
    return found if found is not None else spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    index, n_docs = build_index(table(spark, sf_dir, "documents"))
    return search(index, n_docs, table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"

ORACLE = rf"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL),
     docs AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
     total AS (SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS l FROM docs),
     norms AS (SELECT doc_id, 100 - 90 + ((90 * n * c) // l) AS m FROM docs, total),
     weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
     asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} FROM benchmark)),
     scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
                FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""
