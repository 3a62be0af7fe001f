"""Repeated windows of a corpus: the shared frame of the two substring operators.

A window is ``length`` consecutive symbols (bytes, or words) of one text. Every window owns an anchor, the smallest hash
of the ``gram`` symbols in it; neighbouring windows with the same anchor position form a run. Equal windows have equal
anchors, so all copies of a window meet in the bucket of their anchor:

1. Each block of texts sends, per bucket, its runs as packed arrays: anchor hash, hash of the run's span, text, start,
   number of windows. A bucket drops anchors that occur once and settles runs whose whole span recurs.
2. Where one anchor has different spans, one copy of each span is cut from its text and sent to the anchor's shard, where
   the operator's own index (suffix order or suffix automaton) finds the windows that spans share.
3. The found stretches return to their texts by document.

A passage found in a third of all texts is one entry per text and bucket; buckets grow in number with the corpus, get a
row per block and so stay even. Nothing is sampled, capped or sent to the driver but two counts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.text import CODES, Rolling, Words, blocks, mix, settle, sliding_min

BUCKET_BYTES = 8 << 20  # bytes of text per bucket, about
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Frame:
    """How an operator sees texts: ``units`` is 'bytes' or 'words'; ``earlier`` if only texts with a smaller id count."""

    length: int
    gram: int
    units: str
    earlier: bool
    #: (spans, group of each, rank of each, weight of each) -> flags of each span's windows
    resolve: Callable

    def symbols(self, data: np.ndarray, offsets: np.ndarray):
        """Codes of a block's symbols and the first symbol of each text."""
        if self.units == "bytes":
            return CODES[data], offsets
        words = Words(data, offsets)
        return words.hash, words.first

    def packed(self, data: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return data if self.units == "bytes" else codes

    @property
    def dtype(self):
        return np.uint8 if self.units == "bytes" else np.uint64


RUN = np.dtype([("anchor", "<u4"), ("high", "<u4"), ("low", "<u2"), ("text", "<u2"), ("start", "<u4"), ("n", "u1")])
REP = np.dtype([("group", "<u8"), ("start", "<u4"), ("n", "u1"), ("weight", "<u4")])
DOC = np.dtype([("rank", "<i8"), ("key", "<i8")])
SPAN = np.dtype([("group", "<u8"), ("text", "<u4"), ("start", "<u4"), ("n", "u1"), ("weight", "<u4")])
STRETCH = np.dtype([("start", "<u4"), ("size", "<u4")])


def by_field(rows: np.ndarray) -> bytes:
    """Packed rows field by field, numbers byte by byte: equal high bytes lie together and shrink in the shuffle."""
    return b"".join(np.ascontiguousarray(rows[name]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for name in rows.dtype.names)


def from_fields(packed: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = len(packed) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for name in dtype.names:
        size = dtype[name].itemsize
        own = np.frombuffer(packed, np.uint8, n * size, at).reshape(size, n)
        out[name] = np.ascontiguousarray(own.T).view(dtype[name]).ravel()
        at += n * size
    return out


def doc_rows(rank: np.ndarray, key: np.ndarray) -> np.ndarray:
    out = np.empty(len(rank), DOC)
    out["rank"], out["key"] = rank, key
    return out


def runs_of(frame: Frame, codes: np.ndarray, first: np.ndarray):
    """Anchor hash, span hash, first window and number of windows of every run of a block."""
    width = frame.length - frame.gram + 1
    n = len(codes) - frame.length + 1
    if n <= 0:
        return None
    counts = np.diff(first)
    valid = np.zeros(len(codes) + 1, np.int32)
    long_ = np.flatnonzero(counts >= frame.length)
    if not len(long_):
        return None
    valid[first[long_]] += 1
    np.add.at(valid, first[long_] + counts[long_] - frame.length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:n]) > 0)
    rolling = Rolling(codes)
    grams = rolling.windows(frame.gram)
    # Half of the hash, then the place counted backwards: of equal hashes the rightmost wins, so equal windows of one
    # text never share an anchor's place.
    half = np.uint64(32)
    places = np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams >> half << half) | places, width)[at]
    owner = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    start, size = at[head], np.diff(np.append(head, len(at)))
    span = mix(rolling.spans(start, start + size - 1 + frame.length) + size.astype(np.uint64) * np.uint64(64)
               + (owner[head] - start).astype(np.uint64))
    return mix(grams[owner[head]]), span, start, size


def _send_runs(frame: Frame, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for lo, hi, data, offsets in blocks(batch, "text"):
            codes, first = frame.symbols(data, offsets)
            runs = runs_of(frame, codes, first)
            if runs is None:
                continue
            anchor, span, start, size = runs
            text = np.searchsorted(first, start, "right") - 1
            bucket = ((anchor & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            row = np.empty(len(order), RUN)
            row["anchor"], row["high"], row["low"] = (anchor >> np.uint64(32))[order], (span >> np.uint64(32))[order], (span >> np.uint64(16))[order] & np.uint64(0xFFFF)
            row["start"], row["n"] = (start - first[text])[order], size[order]
            text = text[order]
            used, cut = np.unique(bucket[order], return_index=True)
            cut = np.append(cut, len(order))
            docs, packed = [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own, place = np.unique(text[a:b], return_inverse=True)
                row["text"][a:b] = place
                docs.append(by_field(doc_rows(rank[lo + own], key[lo + own])))
                packed.append(by_field(row[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(docs, pa.binary()), pa.array(packed, pa.binary())],
                                             names=["bucket", "docs", "runs"])


def _by_text(texts: np.ndarray, docs: np.ndarray, rows: np.ndarray):
    """Rows packed per text: (rank, key, bytes) columns."""
    order = np.argsort(texts, kind="stable")
    texts, rows = texts[order], rows[order]
    own, cut = np.unique(texts, return_index=True)
    cut = np.append(cut, len(texts))
    return docs[own, 0], docs[own, 1], [rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


FOUND = "rank long, key long, kind int, packed binary"


def _found(parts) -> pa.Table:
    ranks, keys, kinds, packed = [], [], [], []
    for kind, (rank, key, rows) in parts:
        ranks.append(rank), keys.append(key), packed.extend(rows)
        kinds.append(np.full(len(rows), kind, np.int32))
    return pa.table({"rank": np.concatenate(ranks), "key": np.concatenate(keys), "kind": np.concatenate(kinds), "packed": pa.array(packed, pa.binary())})


def _settle(frame: Frame, table: pa.Table) -> pa.Table:
    """One bucket: stretches of runs that recur whole (kind 0), and copies of spans that differ under one anchor (kind 1)."""
    bucket = table.column("bucket")[0].as_py()
    docs, runs, shift = [], [], 0
    for d, r in zip(table.column("docs").to_pylist(), table.column("runs").to_pylist(), strict=True):
        own = from_fields(r, RUN)
        docs.append(from_fields(d, DOC).view(np.int64).reshape(-1, 2))
        runs.append((own, own["text"].astype(np.int64) + shift))
        shift += len(docs[-1])
    docs, text = np.concatenate(docs), np.concatenate([t for _, t in runs])
    run = np.concatenate([r for r, _ in runs])
    span = (run["high"].astype(np.uint64) << np.uint64(16)) | run["low"]
    order = np.lexsort((span, run["anchor"]))
    run, text, span = run[order], text[order], span[order]
    rank = docs[text, 0]
    new_anchor, new_span = np.ones(len(run), bool), np.ones(len(run), bool)
    new_anchor[1:] = run["anchor"][1:] != run["anchor"][:-1]
    new_span[1:] = new_anchor[1:] | (span[1:] != span[:-1])
    head = np.flatnonzero(new_span)
    of_span = np.cumsum(new_span) - 1
    count = np.diff(np.append(head, len(run)))
    least = np.minimum.reduceat(rank, head)
    anchor_of = (np.cumsum(new_anchor) - 1)[head]  # anchor of each span
    heads = np.flatnonzero(new_anchor[head])
    kinds = np.diff(np.append(heads, len(head)))  # spans per anchor
    if frame.earlier:
        settled = rank > least[of_span]
        low, high = np.minimum.reduceat(least, heads), np.maximum.reduceat(least, heads)
        open_ = (low < high)[anchor_of]
        send = open_[of_span] & ~settled
        weight = np.ones(len(run), np.int64)
    else:
        settled = count[of_span] > 1
        open_ = (kinds > 1)[anchor_of]
        # An anchor whose spans all recur is settled; otherwise one copy of each span is compared.
        single = np.add.reduceat((count == 1).astype(np.int64), heads) > 0
        send = open_[of_span] & single[anchor_of][of_span] & new_span
        weight = count[of_span]
    parts = []
    if settled.any():
        out = np.empty(int(settled.sum()), STRETCH)
        out["start"], out["size"] = run["start"][settled], run["n"][settled].astype(np.int64) + frame.length - 1
        parts.append((0, _by_text(text[settled], docs, out)))
    if send.any():
        out = np.empty(int(send.sum()), REP)
        out["group"] = (run["anchor"][send].astype(np.uint64) << np.uint64(32)) | np.uint64(bucket)
        out["start"], out["n"], out["weight"] = run["start"][send], run["n"][send], weight[send]
        parts.append((1, _by_text(text[send], docs, out)))
    return _found(parts) if parts else pa.table({"rank": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "packed": pa.array([], pa.binary())})


def _cut_spans(frame: Frame, shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of the wanted spans, packed per shard: rows (rank, key, text, wanted) in, (shard, docs, spans, content) out."""
    for batch in batches:
        rank, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        wanted = batch.column(batch.schema.get_field_index("wanted"))
        for lo, hi, data, offsets in blocks(batch, "text"):
            codes, first = frame.symbols(data, offsets)
            content = frame.packed(data, codes)
            lists = [np.frombuffer(b"".join(x or []), REP) for x in wanted.slice(lo, hi - lo).to_pylist()]
            text = np.repeat(np.arange(hi - lo), [len(x) for x in lists])
            rep = np.concatenate(lists)
            if not len(rep):
                continue
            shard = (mix(rep["group"]) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            rep, text, shard = rep[order], text[order], shard[order]
            row = np.empty(len(rep), SPAN)
            for name in ("group", "start", "n", "weight"):
                row[name] = rep[name]
            at = first[text] + rep["start"]
            size = rep["n"].astype(np.int64) + frame.length - 1
            flat = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
            flat, ends = content[flat], np.append(0, np.cumsum(size))
            used, cut = np.unique(shard, return_index=True)
            cut = np.append(cut, len(shard))
            docs, spans, contents = [], [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own, place = np.unique(text[a:b], return_inverse=True)
                row["text"][a:b] = place
                docs.append(np.stack([rank[lo + own], key[lo + own]], axis=1).astype(np.int64).tobytes())
                spans.append(row[a:b].tobytes())
                contents.append(flat[ends[a]:ends[b]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(x, pa.binary()) for x in (docs, spans, contents))],
                                             names=["shard", "docs", "spans", "content"])


def _resolve(frame: Frame, table: pa.Table) -> pa.Table:
    docs, spans, texts, contents, shift = [], [], [], [], 0
    for d, s, c in zip(*(table.column(x).to_pylist() for x in ("docs", "spans", "content")), strict=True):
        docs.append(np.frombuffer(d, np.int64).reshape(-1, 2))
        spans.append(np.frombuffer(s, SPAN))
        texts.append(spans[-1]["text"].astype(np.int64) + shift)
        contents.append(np.frombuffer(c, frame.dtype))
        shift += len(docs[-1])
    docs, span, text, content = np.concatenate(docs), np.concatenate(spans), np.concatenate(texts), np.concatenate(contents)
    flags = frame.resolve(frame, content, span, docs[text, 0])  # one flag per window, in order of the spans
    sizes = span["n"].astype(np.int64)
    of = np.repeat(np.arange(len(span)), sizes)
    window = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hit = np.flatnonzero(flags)
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])
    head = np.flatnonzero(new)
    out = np.empty(len(head), STRETCH)
    out["start"] = span["start"][of[hit[head]]] + window[hit[head]]
    out["size"] = np.diff(np.append(head, len(hit))) + frame.length - 1
    return _found([(0, _by_text(text[of[hit[head]]], docs, out))])


def keyed(docs: DataFrame) -> DataFrame:
    """rank (the id; null is the largest), key (hash of the text), doc_id and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("rank"), F.xxhash64("text").alias("key"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")


def repeated_stretches(docs: DataFrame, frame: Frame) -> DataFrame:
    """(rank, key, stretches): packed starts and sizes, in symbols, of what repeats in the text of that id and key."""
    def settle_runs(table: pa.Table) -> pa.Table:
        return _settle(frame, table)

    def resolve(table: pa.Table) -> pa.Table:
        return _resolve(frame, table)

    rows = keyed(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(size // BUCKET_BYTES))
    found = settle(rows.select("rank", "key", "text").mapInArrow(functools.partial(_send_runs, frame, buckets), "bucket int, docs binary, runs binary")
                   .groupBy("bucket").applyInArrow(settle_runs, FOUND), "settled")
    wanted = found.where("kind = 1").groupBy("rank", "key").agg(F.collect_list("packed").alias("wanted"))
    # Rows that repeat send their spans twice; those occur more than once anyway.
    resolved = settle(rows.select("rank", "key", "text").join(wanted, ["rank", "key"]).mapInArrow(
        functools.partial(_cut_spans, frame, buckets), "shard int, docs binary, spans binary, content binary")
        .groupBy("shard").applyInArrow(resolve, FOUND), "resolved")
    stretches = found.where("kind = 0").select("rank", "key", "packed").unionByName(resolved.select("rank", "key", "packed"))
    return stretches.groupBy("rank", "key").agg(F.collect_list("packed").alias("stretches"))


def with_stretches(docs: DataFrame, frame: Frame) -> DataFrame:
    return keyed(docs).join(repeated_stretches(docs, frame), ["rank", "key"], "left").select("doc_id", "text", "stretches")


def removed_flags(n: int, lists: list[bytes] | None) -> np.ndarray:
    """Flags of a text's symbols that lie in its stretches."""
    if not lists:
        return np.zeros(n, bool)
    rows = np.frombuffer(b"".join(lists), STRETCH)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, rows["start"], 1)
    np.add.at(change, rows["start"].astype(np.int64) + rows["size"], -1)
    return np.cumsum(change[:-1]) > 0
