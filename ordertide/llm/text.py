"""Texts as byte arrays: blocks, words, hashes of words and of windows. Shared by the operators of this package.

All hashes are 64-bit sums of random byte codes times powers of an odd base, modulo 2**64, read off prefix sums, so a
window of any length costs two lookups. They depend on content only and are equal on every executor.
"""

from __future__ import annotations

import functools
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.session import materialize, prepare

#: Bytes of text handled at once inside a task; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Fixed values of the specification: characters that separate words.
SPACES = b" \t\n\x0b\x0c\r"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """A written table, after which the shuffle files behind it are released (pass the plan in, keep no other reference)."""
    out = materialize(df, name, compression)
    del df
    release()
    return out


def release() -> None:
    """Let Spark clean up the shuffle files of plans that nothing refers to."""
    gc.collect()
    SparkSession.active()._jvm.System.gc()


def split_remainder(doc_id, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from scrambled integers."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << int(n).bit_length())
    if size > 1 << 23:  # rare long texts: not worth keeping
        forward, back = _powers.__wrapped__(size)
    else:
        forward, back = _powers(size)
    return forward[:n], back[:n]


def byte_codes(lower: bool) -> np.ndarray:
    """A random code for each byte; with ``lower``, A-Z have the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


CODES, LOWER_CODES = byte_codes(False), byte_codes(True)
#: Bytes inside a word: everything but white space; letters, digits and all bytes of non-ASCII characters.
NOT_SPACE = np.array([b not in SPACES for b in range(256)])
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK_BYTES, rows: int = 60_000):
    """Slices of a batch with about ``size`` bytes of text: (first row, one past the last row, bytes, offsets)."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n, first + rows)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


class Rolling:
    """Window hashes over a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        self.forward, self.back = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.forward[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Hash of each window of ``length`` codes; windows may cross texts, the caller masks those."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n] + np.uint64(length))


class Words:
    """Words of a block: start, end (bytes), hash, and ``first``, the index of each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = False):
        flag = inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros_like(flag), np.zeros_like(flag)
        before[1:], after[:-1] = flag[:-1], flag[1:]
        before[edge[:-1]] = False
        after[edge[1:]] = False
        self.start = np.flatnonzero(flag & ~before)
        self.end = np.flatnonzero(flag & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.hash = Rolling((LOWER_CODES if lower else CODES)[data]).spans(self.start, self.end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def window_starts(self, length: int) -> np.ndarray:
        """Flags for each window start (of len(words) - length + 1) that stays inside one text."""
        n = len(self.start) - length + 1
        if n <= 0:
            return np.zeros(0, bool)
        last = np.repeat(self.first[1:], self.counts)[:n]
        return np.arange(n) + length <= last


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def covered(n: int, start: np.ndarray, length) -> np.ndarray:
    """Flags of 0..n-1 that lie in any [start, start + length)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, np.minimum(start + length, n), -1)
    return np.cumsum(change[:-1]) > 0


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
