"""Removal of byte strings that an earlier document has, with prefix-free parsing.

Rolling hashes of 24 bytes trigger at the local minima of each text; the runs between triggers are the phrases. Each
phrase is taken with the bytes that its windows reach into the following phrases, so the set of phrases is prefix-free
with respect to the triggers. The dictionary holds each distinct phrase of a trigger once, the parse lists in which
documents it occurs, the smallest id first. Phrases that recur are settled from the parse alone. Where phrases of one
trigger differ, the suffixes of the dictionary phrases are sorted byte by byte to the depth of a window (the suffix
array of the dictionary), and combined with the parse: each class of equal suffixes gets the smallest id of the phrases
it occurs in. Together this is the order of all corpus suffixes that share a trigger, without building it for text that
occurs once. The comparison in the dictionary is on the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ordertide.llm.repeats import Frame, removed_flags, with_stretches
from ordertide.llm.text import blocks, table

LENGTH, TRIGGER = 50, 24


def suffix_classes(frame: Frame, content: np.ndarray, span: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Flags of the dictionary's windows that occur in a phrase of a smaller rank."""
    sizes = span["n"].astype(np.int64)
    lengths = sizes + frame.length - 1
    begin = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(span)), sizes)
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(of))
    eight = np.zeros(len(content), np.uint64)  # the eight bytes from each place, as a number that sorts like them
    padded = np.concatenate([content, np.zeros(8, np.uint8)])
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k:k + len(content)]
    depths = [*range(0, frame.length - 8, 8), frame.length - 8]
    keys = [eight[at + d] for d in depths]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        sorted_ = key[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    head = np.flatnonzero(new)
    own = rank[of][order]
    first = np.minimum.reduceat(own, head)
    flags = np.zeros(len(order), bool)
    flags[order] = own > first[np.cumsum(new) - 1]
    return flags


FRAME = Frame(LENGTH, TRIGGER, "bytes", True, suffix_classes)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2).to_pylist()
        for lo, hi, data, offsets in blocks(batch, "text"):
            size, removed, spans, digest = np.diff(offsets), [], [], []
            for k in range(hi - lo):
                own = data[offsets[k]:offsets[k + 1]]
                if lists[lo + k]:
                    gone = removed_flags(len(own), lists[lo + k])
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    own = own[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                digest.append(hashlib.sha256(own.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.int64()), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_earlier_strings(docs: DataFrame) -> DataFrame:
    """Per document the bytes removed because a 50-byte string over them starts in a document with a smaller id.

    Null texts count as empty. Equal ids never remove from each other, whatever their texts; a null id counts as larger
    than all others, so such a row loses what any document with an id has. Repeated rows get equal results; an empty
    table gives none.
    """
    return with_stretches(docs, FRAME).mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_earlier_strings(table(spark, sf_dir, "documents"))
