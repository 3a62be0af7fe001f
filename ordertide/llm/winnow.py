"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters and digits. Every window of ten benchmark words is looked for in the documents: of
each run of six 5-word hashes the smallest is a fingerprint (so any ten shared words share at least one), fingerprints of
documents are joined with those of the benchmark, and each hit is extended to the windows around it. An item of fewer
than ten words is one window of its own length and is fingerprinted by its whole.

The benchmark is read in groups of bounded size (at most ``group_words`` words): one group's fingerprints and windows are
broadcast, the documents pass by them without a shuffle, and where a further group follows the marked documents are
written and the broadcast is released. So executors hold one group however large the benchmark is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.session import materialize
from ordertide.llm.text import ALNUM, Rolling, Words, blocks, buffers, covered, sliding_min

WINDOW, GRAM = 10, 5
GROUP_WORDS = 4_000_000


class Fingerprints:
    """Fingerprints and windows of one group of benchmark items, as sorted arrays."""

    def __init__(self, ids: list[str | None], texts: list[str]):
        data, offsets = buffers(pa.array(texts, pa.string()))
        words = Words(data, offsets, ALNUM, lower=True)
        rolling = Rolling(words.hash)
        self.ids = ids
        self.lengths = sorted({int(c) for c in np.minimum(words.counts, WINDOW) if c})
        self.prints, self.windows, self.items = {}, {}, {}
        for n in self.lengths:
            hashes = rolling.windows(n)
            rows = words.text_of_word()[:len(hashes)]
            ok = words.window_starts(n)
            ok &= (words.counts >= WINDOW if n == WINDOW else words.counts == n)[rows]
            pairs = np.unique(np.stack([hashes[ok], rows[ok].astype(np.uint64)]), axis=1)
            self.windows[n], self.items[n] = pairs[0], pairs[1].astype(np.int64)
            self.prints[n] = np.unique(selected(words, rolling, n, ok)[1])


def selected(words: Words, rolling: Rolling, n: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of all windows of ``n`` words that ``ok`` allows."""
    if n < WINDOW:
        hashes = rolling.windows(n)
        at = np.flatnonzero(ok)
        return at, hashes[at]
    grams = rolling.windows(GRAM)
    width = WINDOW - GRAM + 1
    lowest = np.where(ok, sliding_min(grams, width), np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), lowest, np.zeros(width - 1, np.uint64)])
    highest = ~sliding_min(~padded, width)  # the largest minimum of the windows around a gram
    at = np.flatnonzero(highest[:len(grams)] == grams)
    return at, grams[at]


def member(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def hits(prints: Fingerprints, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hit words of a block, and the (text, item) pairs of occurring windows as two columns."""
    rolling, n_words = Rolling(words.hash), len(words.start)
    hit, pairs = np.zeros(n_words, bool), []
    text = words.text_of_word()
    for n in prints.lengths:
        ok = words.window_starts(n)
        if not len(ok):
            continue
        at, found = selected(words, rolling, n, ok)
        at = at[member(prints.prints[n], found)]
        if not len(at):
            continue
        if n == WINDOW:  # extend: every window that holds the fingerprint
            at = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
            at = at[(at >= 0) & (at < len(ok))]
            at = at[ok[at]]
        hashes = rolling.spans(at, at + n)
        known = member(prints.windows[n], hashes)
        at, hashes = at[known], hashes[known]
        hit |= covered(n_words, at, n)
        lo = np.searchsorted(prints.windows[n], hashes)
        hi = np.searchsorted(prints.windows[n], hashes, "right")
        which = np.repeat(np.arange(len(at)), hi - lo)
        item = prints.items[n][np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]]
        pairs.append(np.stack([text[at[which]], item]))
    return hit, np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)


def _scan(prints, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = prints.value
    for batch in batches:
        col = batch.schema.get_field_index
        for lo, hi, data, offsets in blocks(batch, "text"):
            words = Words(data, offsets, ALNUM, lower=True)
            hit, (doc, item) = hits(held, words)
            rows = batch.slice(lo, hi - lo)
            before_hit, before_items = rows.column(col("_hit")).to_pylist(), rows.column(col("_items")).to_pylist()
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            marks, items = [], []
            for i in range(hi - lo):
                flags = hit[words.first[i]:words.first[i + 1]]
                old = before_hit[i]
                if old:
                    flags = flags | np.unpackbits(np.frombuffer(old, np.uint8), count=len(flags)).astype(bool)
                marks.append(np.packbits(flags).tobytes() if flags.any() else b"")
                own = [held.ids[k] for k in item[cut[i]:cut[i + 1]] if held.ids[k] is not None]
                items.append((before_items[i] or []) + own)
            out = {name: rows.column(k) for k, name in enumerate(rows.schema.names)}
            out |= {"_words": pa.array(words.counts, pa.int64()), "_hit": pa.array(marks, pa.binary()),
                    "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([out[name] for name in rows.schema.names], names=rows.schema.names)


def benchmark_groups(benchmark: DataFrame, group_words: int = GROUP_WORDS) -> Iterator[Fingerprints]:
    """Items one partition at a time, cut into groups of at most ``group_words`` words (about their bytes / 2)."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if not row[1]:
            continue
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) // 2
        if size >= group_words:
            yield Fingerprints(ids, texts)
            ids, texts, size = [], [], 0
    if texts:
        yield Fingerprints(ids, texts)


def _pass(docs: DataFrame, held) -> DataFrame:
    return docs.mapInArrow(lambda batches: _scan(held, batches), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def mark_benchmark_words(docs: DataFrame, benchmark: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``docs`` plus _words (number of words), _hit (bit per word, packed; empty if none) and _items (ids found).

    Null and empty texts have no words and no hits; repeated rows and ids are marked each; columns of ``docs`` are kept
    (its own columns named _words, _hit or _items are replaced). Items without a word are left out. The words of an item
    without an id are hit like others, but it has no place in _items. An item id that occurs twice counts as one item.
    """
    out = (docs.withColumn("_words", F.lit(0).cast("long")).withColumn("_hit", F.lit(b"").cast("binary"))
           .withColumn("_items", F.lit(None).cast("array<string>")))
    spark, held = docs.sparkSession, None
    for prints in benchmark_groups(benchmark, group_words):
        if held is not None:
            out = materialize(out, "marked-documents")
            held.unpersist()
        held = spark.sparkContext.broadcast(prints)
        out = _pass(out, held)
    if held is None:  # no item: count the words all the same
        out = _pass(out, spark.sparkContext.broadcast(Fingerprints([], [])))
    return out.withColumn("_items", F.array_sort(F.array_distinct(F.coalesce("_items", F.array().cast("array<string>")))))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: its words, its words inside benchmark windows, and the items that occur in it."""
    marked = mark_benchmark_words(docs.select("doc_id", "text"), benchmark)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    kept = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "_words", "_hit", "_items")
    return kept.mapInArrow(_digest, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words, marks, items = batch.columns
        hit = [int(np.bitwise_count(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in marks.to_pylist()]
        lists = [sorted(x or []) for x in items.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [ids, words, pa.array(hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64()),
             pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]), pa.array([h > 0 for h in hit])],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
