"""Language identification with interpolated Kneser-Ney character models.

Texts become sequences of lower-cased letters with one separator between words. Each language has counts of character
n-grams up to ``ORDER``; lower orders use continuation counts (the number of distinct preceding characters), every order
is interpolated with the next lower one by absolute discounting, and the lowest with a uniform distribution. The
probabilities of all n-grams seen in any language are worked out once and stored in one hash array per order, sorted by
hash, with a column per language; backoff weights of contexts are stored the same way. A text is given to the language
with the lowest cross-entropy per character.

Rejection is calibrated: for each language a threshold is set above the cross-entropies of held-back training texts
(their ``REJECT_QUANTILE`` plus ``REJECT_MARGIN`` nats, and more for short texts); a text above the threshold of its best language is rejected, as
is a text without letters.

Training is bounded: about ``TRAIN_ROWS`` rows per label, drawn by a hash of the id. Counting runs in Spark; only the
count tables of that bounded sample reach the driver. Prediction is one map over the documents, without a shuffle.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.text import BLOCK_BYTES, buffers, mix, split_remainder, table

ORDER = 4
TRAIN_ROWS = 600  # rows per label, about
DISCOUNT = 0.75
CALIBRATION_SHARE = 5  # one training row of so many is held back for the thresholds
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 0.5
SHORT_SLACK = 6.0  # over the root of the number of symbols: the entropy of a short text varies more
CONFIDENCE = 12.0  # posterior sharpness per nat of cross-entropy
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Lower-case code point of each letter, 0 for everything else."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x30000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
        elif unicodedata.category(ch) in ("Mn", "Mc") and cp >= 0x300:
            out[cp] = cp
    return out


def has_letter(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(symbols != 0)])
    return total[first[1:]] > total[first[:-1]]


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single separators of all texts of a block, each text led by a separator; starts of the texts."""
    lead = np.zeros(len(data), bool)
    lead[:] = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    sym = letter_table()[points]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    inner = at[(at > 0) & (at < len(sym))]
    keep[inner] = sym[inner] != 0  # a leading separator is added below
    if len(sym) and sym[0] == 0:
        keep[0] = False
    kept = np.concatenate([[0], np.cumsum(keep)])[at]
    first = kept + np.arange(len(kept))
    out = np.insert(sym[keep], kept[:-1], 0) if len(kept) > 1 else sym[keep]
    return out, first


def grams(sym: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order: the hash of the n symbols that end at each position, 0 where the text is younger than that."""
    age = np.arange(len(sym)) - np.repeat(first[:-1], np.diff(first))
    code = mix(sym.astype(np.uint64) + np.uint64(1))
    out, h = [code], code
    for n in range(2, order + 1):
        back = np.zeros_like(code)
        back[1:] = h[:-1]
        h = mix(back * np.uint64(0x9E3779B97F4A7C15) + code)
        h[age < n - 1] = 0
        out.append(h)
    return out


class HashArray:
    """Sorted 64-bit keys with rows of float32 values, found through an index of their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.bits = max(1, int(len(keys)).bit_length() + 2)
        tops = (self.keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.index = np.searchsorted(tops, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.probes = int(np.diff(self.index).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is missing."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        top = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.index[top], self.index[top + 1]
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        for _ in range(self.probes):
            same = self.keys[at] == wanted[open_]
            out[open_[same]] = at[same]
            go = ~same & (at + 1 < end)
            if not go.any():
                break
            open_, at, end = open_[go], at[go] + 1, end[go]
        return out


class CharacterModels:
    """Interpolated Kneser-Ney probabilities of all languages."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], order: int = ORDER):
        """``counts`` per order n: hash of the n-gram, of its context (first n-1), of its suffix (last n-1), and a count per language."""
        self.languages, self.order = languages, order
        n_lang = len(languages)
        top = []
        for n in range(order):
            keys, context, suffix, c = counts[n]
            if n + 1 < order:  # continuation counts: distinct symbols seen before the n-gram
                _, _, above, above_c = counts[n + 1]
                c = np.zeros((len(keys), n_lang))
                at = np.searchsorted(keys, above)
                ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == above)
                np.add.at(c, at[ok], above_c[ok] > 0)
                # n-grams that only begin texts have no predecessor; they count once
                c = np.where((c == 0) & (counts[n][3] > 0), 1, c)
            top.append((keys, context, suffix, c.astype(np.float64)))
        vocabulary = max(1, len(top[0][0]))
        self.uniform = np.full(n_lang, np.log(1.0 / (vocabulary + 1)), np.float32)
        self.tables, self.backoff, lower = [], [], None
        for n in range(order):
            keys, context, suffix, c = top[n]
            groups, group = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(groups), n_lang)), np.zeros((len(groups), n_lang))
            np.add.at(total, group, c)
            np.add.at(kinds, group, c > 0)
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            if n == 0:
                below = np.broadcast_to(np.exp(self.uniform), (len(keys), n_lang))
            else:  # probability of the suffix one order lower
                at = lower.find(suffix)
                below = np.exp(lower.values[np.maximum(at, 0)])
            p = np.maximum(c - DISCOUNT, 0) / np.maximum(total[group], 1) + weight[group] * below
            lower = HashArray(keys, np.log(np.maximum(p, 1e-12)))
            self.tables.append(lower)
            self.backoff.append(HashArray(groups, np.log(np.maximum(weight, 1e-12))))
        self.thresholds = np.full(n_lang, np.inf)

    def log_likelihood(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of ln P of each text under each language, and its number of symbols."""
        hashes = grams(sym, first, self.order)
        n_lang = len(self.languages)
        out = np.zeros((len(sym), n_lang), np.float32)
        age = np.arange(len(sym)) - np.repeat(first[:-1], np.diff(first))
        open_ = np.arange(len(sym))
        for n in range(self.order, 0, -1):
            if not len(open_):
                break
            deep = age[open_] >= n - 1
            at = np.full(len(open_), -1, np.int64)
            at[deep] = self.tables[n - 1].find(hashes[n - 1][open_[deep]])
            hit = at >= 0
            out[open_[hit]] += self.tables[n - 1].values[at[hit]]
            miss, deep = open_[~hit], deep[~hit]
            if n > 1 and len(miss):  # the context's backoff weight, if the context is known
                here = miss[deep]
                ctx = self.backoff[n - 1].find(hashes[n - 2][here - 1])
                known = ctx >= 0
                out[here[known]] += self.backoff[n - 1].values[ctx[known]]
            elif n == 1 and len(miss):
                out[miss] += self.uniform + self.backoff[0].values[0] if len(self.backoff[0].values) else self.uniform
            open_ = miss
        length = np.diff(first)
        sums = np.zeros((len(length), n_lang))
        full = np.flatnonzero(length > 0)
        if len(full):
            sums[full] = np.add.reduceat(out, first[:-1][full], axis=0, dtype=np.float64)
        return sums, length

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1 without letters), confidence, cross-entropy and rejection of each text."""
        sym, first = symbols_of(data, offsets)
        lettered = has_letter(sym, first)
        sums, length = self.log_likelihood(sym, first)
        entropy = -sums / np.maximum(length, 1)[:, None]
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        odds = np.exp(-CONFIDENCE * (entropy - low[:, None]))
        score = np.where(lettered, 1.0 / odds.sum(axis=1), 0.0)
        return np.where(lettered, best, -1), score, low, ~lettered | (low > self.thresholds[best] + SHORT_SLACK / np.sqrt(np.maximum(length, 1)))


GRAM_SCHEMA = "n int, gram long, context long, suffix long, language int, c long"


def _count(languages: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = {x: k for k, x in enumerate(languages)}
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for language, k in index.items():
            rows = [i for i, x in enumerate(labels) if x == language]
            if not rows:
                continue
            sym, first = symbols_of(*buffers(batch.column(0).take(pa.array(rows))))
            age = np.arange(len(sym)) - np.repeat(first[:-1], np.diff(first))
            hashes = grams(sym, first, ORDER)
            for n in range(1, ORDER + 1):
                at = np.flatnonzero(age >= n - 1)
                keys, one, c = np.unique(hashes[n - 1][at], return_index=True, return_counts=True)
                where = at[one]
                context = hashes[n - 2][where - 1] if n > 1 else np.zeros(len(where), np.uint64)
                suffix = hashes[n - 2][where] if n > 1 else np.zeros(len(where), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), n, np.int32)), *(pa.array(x.astype(np.uint64).view(np.int64)) for x in (keys, context, suffix)),
                     pa.array(np.full(len(keys), k, np.int32)), pa.array(c.astype(np.int64))],
                    names=["n", "gram", "context", "suffix", "language", "c"])


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> CharacterModels | None:
    """Models from rows (doc_id, text, lang). Uses about ``rows`` rows per label, drawn by a hash of id and text.

    Only rows with a letter teach, and only they make a label a candidate: nothing is learned of a label without them.
    Equal rows come or stay away together.
    """
    usable = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    scale = 1 << 20
    limits = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(scale, scale * rows / sizes[name])))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(scale))
    sample = (usable.where(draw < limits[F.col("lang")]).withColumn("_hold", F.pmod(F.xxhash64(F.lit("calibration"), "doc_id", "text"), F.lit(CALIBRATION_SHARE)) == 0))
    counted = (sample.where(~F.col("_hold")).select("text", "lang").mapInArrow(functools.partial(_count, languages), GRAM_SCHEMA)
               .groupBy("n", "gram", "context", "suffix", "language").agg(F.sum("c").alias("c")))
    got = counted.toArrow()  # bounded by the sample
    column = {name: got.column(name).to_numpy() for name in got.schema.names}
    counts = []
    for n in range(1, ORDER + 1):
        own = np.flatnonzero(column["n"] == n)
        keys, one, at = np.unique(column["gram"][own].view(np.uint64), return_index=True, return_inverse=True)
        c = np.zeros((len(keys), len(languages)))
        np.add.at(c, (at, column["language"][own]), column["c"][own])
        counts.append((keys, column["context"][own][one].view(np.uint64), column["suffix"][own][one].view(np.uint64), c))
    if not len(counts[0][0]):
        return None
    models = CharacterModels(languages, counts)
    held = sample.where("_hold").select("text", "lang").toArrow().combine_chunks()
    if held.num_rows:
        best, _, entropy, _ = models.judge(*buffers(held.column("text")))
        labels = np.array([languages.index(x) for x in held.column("lang").to_pylist()])
        for k in range(len(languages)):
            own = entropy[(labels == k) & (best == k)]
            if len(own):
                models.thresholds[k] = np.quantile(own, REJECT_QUANTILE) + REJECT_MARGIN
    return models


def _predict(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from ordertide.llm.text import blocks

    models = held.value
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch, "text", BLOCK_BYTES // 2):
            part = batch.slice(lo, hi - lo)
            if models is None:
                best, score, entropy, rejected = np.full(hi - lo, -1), np.zeros(hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)
                names = []
            else:
                best, score, entropy, rejected = models.judge(data, offsets)
                names = models.languages
            predicted = pa.array([names[k] if k >= 0 else UNKNOWN for k in best], pa.string())
            added = {"_lang": predicted, "_score": pa.array(score), "_entropy": pa.array(entropy), "_rejected": pa.array(rejected)}
            yield pa.RecordBatch.from_arrays([*part.columns, *added.values()], names=[*part.schema.names, *added])


def identify(docs: DataFrame, models: CharacterModels | None) -> DataFrame:
    """``docs`` plus _lang, _score (0 to 1), _entropy (nats per symbol) and _rejected.

    Only ``text`` is looked at. A null text, or one without a letter, is ``und`` with score 0 and is rejected; without any
    training row everything is. Ties go to the first label in order. Columns of those four names are replaced.
    """
    from pyspark.sql import types as T

    clean = docs.drop("_lang", "_score", "_entropy", "_rejected")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in clean.schema]).add("_lang", "string").add("_score", "double") \
        .add("_entropy", "double").add("_rejected", "boolean")
    held = docs.sparkSession.sparkContext.broadcast(models)
    return clean.mapInArrow(functools.partial(_predict, held), schema)


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = split_remainder(F.col("doc_id"), 5) == 0
    models = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), models).select(
        "doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
        F.col("_entropy").alias("cross_entropy"), F.col("_rejected").alias("rejected"))
