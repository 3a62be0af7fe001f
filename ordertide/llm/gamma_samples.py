"""Document fingerprints by consistent weighted sampling with gamma variates.

A text is a weighted set: its lower-cased words with their counts. For each sample j and term k the gamma variates r, c
and the uniform b are drawn from a hash of (k, j) alone; with weight w, t = floor(ln w / r + b), ln y = r (t - b) and
ln a = ln c - ln y - r. The term with the smallest ln a is the sample, together with its t. Two texts agree in a sample
with a probability equal to their generalised Jaccard similarity, sum of min over sum of max of the weights.

Variates do not depend on the document, so each block draws them once per distinct term; the minimum over a document's
terms is then one segmented reduction. A sample is kept as 16 bits of a hash of ln a (which fixes term and t), so
different samples agree by chance once in 65 536.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.text import Words, buffers, mix, table

SAMPLES = 64
CHUNK_ROWS = 5_000  # documents of one stretch of ids, streamed through one task
MAX_CHUNKS = 1_000  # beyond that stretches get longer; they are sorted by Spark and streamed, so memory stays the same
BATCH_BYTES = 3 << 20


def fingerprints(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples per text; a text without words has the fixed row of zeros."""
    data, offsets = buffers(pa.array(texts, pa.string()))
    words = Words(data, offsets, lower=True)
    out = np.zeros((len(texts), samples), np.uint16)
    if not len(words.hash):
        return out
    vocabulary, term = np.unique(words.hash, return_inverse=True)
    pair, count = np.unique(words.text_of_word() * np.int64(len(vocabulary)) + term, return_counts=True)
    text, term = pair // len(vocabulary), pair % len(vocabulary)
    kinds, kind = np.unique(term + np.int64(len(vocabulary)) * count, return_inverse=True)
    row_of, first = np.unique(text, return_index=True)
    width = 8  # samples drawn together: bounds the table of variates
    for j in range(0, samples, width):
        seeds_for = slice(j, j + width)
        table_ = _drawn(vocabulary[kinds % len(vocabulary)], kinds // len(vocabulary), samples, seeds_for)
        least = np.minimum.reduceat(table_[kind], first, axis=0)
        bits = (mix(least.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        out[row_of, seeds_for] = np.maximum(bits, 1)
    return out


def _drawn(terms, weights, samples, part) -> np.ndarray:
    """ln a of each (term hash, weight), for some of the samples; terms with weight 1 have t = 0."""
    seeds = mix(np.arange(1, samples + 1, dtype=np.uint64))[part]
    first = mix(terms[:, None] + seeds[None, :])
    second = (first ^ (first >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    second ^= second >> np.uint64(29)

    def uniform(x, shift, bits):
        return ((x >> np.uint64(shift)).astype(np.uint32) & np.uint32((1 << bits) - 1)).astype(np.float32) * np.float32(2.0**-bits) \
            + np.float32(2.0 ** -(bits + 1))

    r = -np.log(uniform(first, 40, 24) * uniform(second, 40, 24))
    log_c = np.log(-np.log(np.minimum(uniform(first, 16, 24) * uniform(second, 16, 24), np.float32(1 - 2.0**-24))))
    b = uniform(first, 0, 16)
    out = log_c - r * (1 - b)
    more = np.flatnonzero(weights > 1)
    if len(more):
        out[more] -= r[more] * np.floor(np.log(weights[more].astype(np.float32))[:, None] / r[more] + b[more])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    q = len(text) // 4
    return text[:len(text) - q] + following[:q] if q else text


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive in order of (chunk, doc_id); the last row of a chunk is a copy of the next chunk's first."""
    held: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held += [(chunk, extra, doc_id, text or "") for chunk, extra, doc_id, text in rows]
        size, cut = 0, 0
        for i, row in enumerate(held):
            size += len(row[3])
            if size >= BATCH_BYTES and i:
                yield from _emit(held[cut:i + 1])
                cut, size = i, 0
        held = held[cut:]
    if len(held) > 1:
        yield from _emit(held)


def _emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """All rows but the last, each next to its successor."""
    own = [k for k in range(len(rows) - 1) if not rows[k][1]]
    if not own:
        return
    texts = [r[3] for r in rows]
    changed = [edited(texts[k], texts[k + 1]) for k in own]
    both = fingerprints(texts + changed)  # together: the vocabulary's variates are drawn once
    prints, other = both[:len(texts)], both[len(texts):]
    here = np.array(own)
    yield pa.RecordBatch.from_arrays([
        pa.array([rows[k][2] for k in own], pa.int64()),
        pa.array([len(texts[k]) for k in own], pa.int64()),
        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]),
        pa.array([prints[k].tobytes().hex() for k in own]), pa.array([x.tobytes().hex() for x in other]),
        pa.array(likeness(prints[here], other)), pa.array(likeness(prints[here], prints[here + 1]))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprint_with_next(docs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Fingerprints of each text, of the text edited with its successor's head, and the likeness to both.

    Documents are cut into stretches of about ``chunk_rows`` ids at approximate quantiles. Each stretch gets one extra
    row, the first of the next stretch (the last one gets the first of all), so that it can be streamed by itself in
    order of doc_id: one shuffle of the texts, no window over all rows. Null ids come first, ties are ordered by text.
    Null and empty texts have the fingerprint of zeros and are wholly alike; an empty table gives no rows. A single
    document is its own successor.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = d.select("doc_id").agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if not rows[0]:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    n = min(MAX_CHUNKS, max(1, rows[0] // chunk_rows))
    at = sorted({int(x) for x in d.where("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], min(0.01, 0.2 / n))}) \
        if n > 1 and rows[1] else []
    chunk = F.size(F.filter(F.array(*[F.lit(x) for x in at]), lambda x: x <= F.col("doc_id"))) if at else F.lit(0)
    cut = d.withColumn("chunk", F.when(F.col("doc_id").isNull(), 0).otherwise(chunk).cast("long"))
    # A stretch's head: its rows with the smallest id, of which the smallest text is taken.
    # At most MAX_CHUNKS ids reach the driver; the heads' texts are then read by a filter, without a join of all texts.
    least = {r[0]: r[1] for r in cut.where("doc_id is not null").groupBy("chunk").agg(F.min("doc_id").alias("doc_id")).collect()}
    if rows[1] < rows[0]:
        least[0] = None
    is_head = F.col("doc_id").isin([x for x in least.values() if x is not None])
    if None in least.values():
        is_head = F.coalesce(is_head, F.lit(False)) | F.col("doc_id").isNull()
        is_head &= F.col("doc_id").isNull() | (F.col("chunk") > 0)
    head_texts = cut.where(is_head).groupBy("chunk", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    order = list(least)
    before = {c: p for p, c in zip([sorted(order)[-1], *sorted(order)[:-1]], sorted(order), strict=True)}
    steps = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    extra = head_texts.select(steps[F.col("chunk")].alias("chunk"), F.lit(True).alias("extra"), "doc_id", "text")
    both = cut.select("chunk", F.lit(False).alias("extra"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(extra)
    dealt = both.repartition(max(n, 1), "chunk").sortWithinPartitions("chunk", "extra", "doc_id", "text")
    return dealt.mapInArrow(_stretch, SCHEMA)


def op9_gamma_samples(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))
