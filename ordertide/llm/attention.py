"""Language-model scoring: a causal self-attention model in numpy, beside a unigram baseline over the whole corpus.

Model. Words are split into subword ids of a public byte-level tokenizer. One attention layer predicts the class of the
next subword from the ids before it (class = cluster of subwords with similar successors); the subword within its class
follows the training counts. Texts are cut into blocks of 16 positions; each block attends to itself and the block before
it under a causal mask, so windows overlap and each subword is scored once, many blocks in one batched product.

Fit. All of it comes from all training rows. Tasks count subwords, then neighbours of the ``KNOWN`` most frequent ones, and
Spark adds the counts up; classes are clustered from one short sketch per known subword. The network learns in rounds:
each task takes its training texts of the round in batches, starting from the last round's state, and the tasks' states are
averaged, weighted by what they learned from. Every training text is in one round; a corpus too small for ``STEPS``
batches is learned in several passes. What reaches the driver is bounded by the vocabulary and the size of the network.
The split of rows over tasks enters the averages, so another layout of the same rows gives a slightly different score.

Baseline. Counts of all lower-cased words and text ends of the training rows, over the whole corpus. Every block of texts
sends its distinct words with their counts, packed per bucket of the word's hash; a bucket adds the counts up and returns
them to the blocks, which hold the words of their documents as packed entries. So a frequent word meets in one place once
per block, not once per document, and the counts never leave the executors.
"""

from __future__ import annotations

import base64
import functools
import itertools
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.repeats import BUCKET_BYTES, keyed
from ordertide.llm.text import Words, blocks, buffers, mix, settle, split_remainder, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed pattern of the tokenizer's vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPAN, WIDTH, CLASSES, KNOWN = 16, 16, 40, 2048  # positions of a block, model width, classes, subwords with a class by clustering
STEPS, RATE = 600, 0.01
RUN, RUNS = 16, 16  # a batch: so many neighbouring blocks from so many places
ROUNDS = (1, 3, 7, 16)  # sixteenths of the training texts learned from after each round
SKETCH, PARTS = 24, 8  # numbers kept of a subword's neighbours; pieces in which states are averaged
LONG_WORD = 64  # longer words are encoded in pieces
END_WORD = np.uint64(0x51ED270B0A1F39C1)


class Tokenizer:
    """Subword ids of words; travels as the vocabulary file's content."""

    def __init__(self, path: str = TOKENIZER):
        self.content = Path(path).read_bytes()
        self._own = None

    def __getstate__(self):
        return {"content": self.content, "_own": None}

    @property
    def size(self) -> int:
        return self.own.max_token_value + 1

    @property
    def own(self):
        if self._own is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.content.splitlines()) if a}
            self._own = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            heads = np.zeros(max(ranks.values()) + 1, bool)
            heads[[v for k, v in ranks.items() if k[:1] == b" "]] = True
            self._heads = heads
        return self._own

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each led by a space, and where each word's ids start."""
        plain = [w if len(w) <= LONG_WORD else b"" for w in words]
        ids = np.array(self.own.encode_ordinary((b"".join(b" " + w for w in plain if w)).decode("utf-8", "replace")), np.int32)
        starts = np.flatnonzero(self._heads[ids]) if len(ids) else np.zeros(0, np.int64)
        n_plain = sum(1 for w in plain if w)
        if len(starts) == n_plain and n_plain == len(words):
            return ids, np.append(starts, len(ids))
        out = []  # long words, or white space of other kinds inside a word: one by one
        for w in words:
            text = w.decode("utf-8", "replace")
            parts = [text] if len(w) <= LONG_WORD else [text[k:k + LONG_WORD // 4] for k in range(0, len(text), LONG_WORD // 4)]
            out.append([i for k, p in enumerate(parts) for i in self.own.encode_ordinary(" " + p if k == 0 else p)])
        return np.array([i for x in out for i in x], np.int32), np.append(0, np.cumsum([len(x) for x in out]))

    def texts(self, words: Words, raw: bytes, kinds: np.ndarray, one: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts, each ended by one id past the vocabulary, and where the texts start. ``raw`` has the
        block's bytes; ``kinds``, ``one`` and ``at`` are the distinct word hashes, a place of each, and each word's kind."""
        return laid_end_to_end(*self.of_kinds(words, raw, one), at, words.counts, self.size)

    def of_kinds(self, words: Words, raw: bytes, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's distinct words, and how many each has."""
        ids, cut = self.words([raw[a:b] for a, b in zip(words.start[one].tolist(), words.end[one].tolist(), strict=True)])
        return ids, np.diff(cut)


def laid_end_to_end(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with ``counts`` words of the kinds ``at``, each text ended by ``end``, and where the texts start."""
    size = sizes[at] if len(at) else np.zeros(0, np.int64)
    ends = np.append(0, np.cumsum(size))
    first = ends[np.append(0, np.cumsum(counts))] + np.arange(len(counts) + 1)  # one end per text
    out = np.full(first[-1], end, np.int32)
    if len(at):
        source = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], size) + np.arange(ends[-1])
        out[np.arange(ends[-1]) + np.repeat(np.repeat(np.arange(len(counts)), counts), size)] = ids[source]
    return out, first


_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def lowered(data: np.ndarray, offsets: np.ndarray):
    """Words of a block in lower case, its bytes, and its distinct words (hashes, places, kind of each word)."""
    words = Words(data, offsets, lower=True)
    return words, _TO_LOWER[data].tobytes(), *np.unique(words.hash, return_index=True, return_inverse=True)


ONES = np.ones(max(CLASSES, 2 * SPAN), np.float32)
MASK = np.where(np.arange(2 * SPAN)[None, :] <= np.arange(SPAN)[:, None] + SPAN, 0, -1e9).astype(np.float32)


class AttentionModel:
    """Fitted parameters, the class of each subword, and ln P(subword | class)."""

    def __init__(self, count: np.ndarray, seed: int = 7):
        """``count``: of each subword and of the end, in all training rows."""
        self.rng = np.random.default_rng(seed)
        self.count, self.end = count, len(count) - 1
        self.top = np.argsort(-count, kind="stable")[:min(KNOWN, len(count))]
        n = self.n_known = len(self.top)
        self.slot = np.full(len(count) + 1, n, np.int32)  # input slots: known subwords, others, and the begin
        self.slot[self.top] = np.arange(n)
        self.slot[-1] = n + 1
        self.lines = self.rng.normal(size=(n + 1, SKETCH)).astype(np.float32)

    def pairs(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Cell of each neighbouring pair in the flat table of known subwords (others: the last row) by the ones before."""
        slots = self.slot[:-1][ids].astype(np.int64)
        inner = np.ones(len(ids), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        return slots[at] * (self.n_known + 1) + slots[at - 1]

    def sketch(self, before: np.ndarray) -> np.ndarray:
        """Short form of what comes before a subword: similar ones are near each other."""
        return np.sqrt(before / max(before.sum(), 1)).astype(np.float32) @ self.lines

    def classify(self, sketch: np.ndarray) -> None:
        """Classes from the sketches of the known subwords (the last: others), and a network at its start."""
        rng, seen = self.rng, np.bincount(self.slot[:-1], weights=self.count, minlength=self.n_known + 1) + 1
        centre = sketch[rng.choice(len(sketch), CLASSES - 1, p=seen / seen.sum())]
        for _ in range(12):
            group = ((sketch[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            for g in range(CLASSES - 1):
                if (group == g).any():
                    centre[g] = sketch[group == g].mean(axis=0)
        self.klass = np.append(group[:-1], CLASSES - 1)[self.slot[:-1]].astype(np.int32)
        weight = self.count + 0.1
        self.inside = np.log(weight / np.bincount(self.klass, weights=weight, minlength=CLASSES)[self.klass]).astype(np.float32)
        p = {"E": rng.normal(0, 0.3, (self.n_known + 2, WIDTH)), "P": rng.normal(0, 0.1, (2 * SPAN, WIDTH)), "U": rng.normal(0, 0.3, (WIDTH, CLASSES)),
             "b": np.zeros(CLASSES), "QKV": rng.normal(0, WIDTH**-0.5, (WIDTH, 3 * WIDTH))}
        self.shapes = {k: v.shape for k, v in p.items()}
        size = sum(v.size for v in p.values())
        self.state = np.concatenate([*(v.ravel() for v in p.values()), np.zeros(2 * size)]).astype(np.float32)  # parameters and their two moments

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters in a flat array."""
        out, at = {}, 0
        for name, shape in self.shapes.items():
            out[name] = flat[at:at + int(np.prod(shape))].reshape(shape)
            at += out[name].size
        return out

    def laid_out(self, ids: np.ndarray, first: np.ndarray):
        """Blocks of all texts: input slots, whether there is a block before, targets (-1: padding), and each id's place."""
        length = np.diff(first)
        n_blocks = -(-length // SPAN)
        start = np.cumsum(n_blocks) - n_blocks
        place = np.repeat(start * SPAN - first[:-1], length) + np.arange(len(ids))
        target = np.full(int(n_blocks.sum()) * SPAN, -1, np.int32)
        target[place] = ids
        source = np.full(len(target), self.slot[-1], np.int32)
        source[place[1:]] = self.slot[ids[:-1]]
        source[start[n_blocks > 0] * SPAN] = self.slot[-1]  # texts begin with the begin
        cur = source.reshape(-1, SPAN)
        has_prev = np.ones(len(cur), bool)
        has_prev[start[n_blocks > 0]] = False
        return cur, has_prev, target.reshape(-1, SPAN), place

    def prepare(self) -> None:
        """Queries, keys, values and direct class scores of each slot and place, so that scoring only looks them up."""
        self.p = p = self.views(self.state)
        self.of_slot, self.of_place = (np.ascontiguousarray(np.concatenate([p[k] @ p["QKV"], p[k]], axis=1)) for k in "EP")

    def log_prob(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """ln P of each text."""
        cur, has_prev, target, place = self.laid_out(ids, first)
        p, w, n = self.p, WIDTH, len(cur)
        got = np.zeros(n * SPAN, np.float32)
        wanted = np.maximum(target.ravel(), 0)
        klass, inside = self.klass[wanted], self.inside[wanted]
        carry = np.zeros((SPAN, 2 * w), np.float32)  # keys and values of the last block before the chunk, without its place
        for k in range(0, n, 256):
            part = slice(k, min(n, k + 256))
            now = self.of_slot.take(cur[part].ravel(), axis=0).reshape(-1, SPAN, 4 * w)
            here = now + self.of_place[SPAN:]
            m = len(here)
            kv = np.empty((m, 2 * SPAN, 2 * w), np.float32)
            kv[0, :SPAN], kv[1:, :SPAN], kv[:, SPAN:] = carry, now[:-1, :, w:3 * w], here[:, :, w:3 * w]
            kv[:, :SPAN] += self.of_place[:SPAN, w:3 * w]
            carry = now[-1, :, w:3 * w].copy()
            s = here[:, :, :w] @ kv[:, :, :w].transpose(0, 2, 1)
            s += MASK
            s[np.flatnonzero(~has_prev[part]), :, :SPAN] = -1e9
            np.minimum(s, 60, out=s)  # scores are small; this only keeps exp finite
            np.exp(s, out=s)
            o = s @ kv[:, :, w:]
            o /= (s @ ONES[:2 * SPAN])[:, :, None]
            o += here[:, :, 3 * w:]
            z = o.reshape(m * SPAN, w) @ p["U"]
            z += p["b"]
            flat = slice(k * SPAN, (k + m) * SPAN)
            right = z.ravel().take(np.arange(0, m * SPAN * CLASSES, CLASSES) + klass[flat])
            np.minimum(z, 80, out=z)
            np.exp(z, out=z)
            got[flat] = right - np.log(z @ ONES[:CLASSES]) + inside[flat]
        flat = got[place].astype(np.float64)
        total = np.append(0, np.cumsum(flat))
        return total[first[1:]] - total[first[:-1]]

    def learn(self, flat: np.ndarray, texts: Iterator[tuple[np.ndarray, np.ndarray]], step: int, progress) -> tuple[int, int]:
        """Learn from texts (ids and starts) in place; returns the blocks and steps taken. ``step`` were taken before;
        ``progress`` tells from the blocks taken what part of the whole fit is done."""
        n = len(flat) // 3
        p, mean, square = self.views(flat[:n]), flat[n:2 * n], flat[2 * n:]
        grad, change, seen, before = np.empty(n, np.float32), np.empty(n, np.float32), 0, step
        rng = np.random.default_rng(step)
        for ids, first in texts:
            cur, has_prev, target, _ = self.laid_out(ids, first)
            runs = -(-len(cur) // RUN)
            padded = np.full((runs * RUN + 1, SPAN), self.slot[-1], np.intp)
            padded[1:len(cur) + 1] = cur
            more = runs * RUN - len(cur)
            target = np.concatenate([target, np.full((more, SPAN), -1, np.int32)]).reshape(runs, RUN * SPAN)
            has_prev = np.append(has_prev, np.zeros(more, bool)).reshape(runs, RUN)
            order = rng.permutation(runs)
            for k in range(0, runs, RUNS):
                at = order[k:k + RUNS]
                self.gradient(p, self.views(grad), padded[at[:, None] * RUN + np.arange(RUN + 1)], has_prev[at].ravel(), target[at].ravel())
                step += 1
                seen += len(at) * RUN
                rate = RATE * min(1.0, step / 20) * (1 - 0.9 * min(1.0, progress(seen)))
                mean += 0.1 * (grad - mean)
                np.square(grad, out=grad)
                square += 0.01 * (grad - square)
                np.sqrt(square, out=change)
                change *= (1 - 0.99**step) ** -0.5
                change += 1e-8
                np.divide(mean, change, out=change)
                change *= rate / (1 - 0.9**step)
                flat[:n] -= change
            seen -= more
        return seen, step - before

    def gradient(self, p: dict, out: dict, slots: np.ndarray, has_prev: np.ndarray, target: np.ndarray) -> None:
        """Gradient of the mean class loss of runs of blocks. ``slots``: (runs, blocks + 1, SPAN), a run's first block is
        only looked back at; ``target``: subword of each position of the others, -1 for none."""
        w, places, qkv = WIDTH, p["P"], p["QKV"]
        runs, n = len(slots), len(has_prev)
        x = p["E"].take(slots.ravel(), axis=0)
        base = (x @ qkv).reshape(runs, -1, SPAN, 3 * w)
        of_place = places @ qkv
        q = (base[:, 1:, :, :w] + of_place[SPAN:, :w]).reshape(n, SPAN, w)
        kv = np.empty((runs, n // runs, 2 * SPAN, 2 * w), x.dtype)
        np.add(base[:, :-1, :, w:], of_place[:SPAN, w:], out=kv[:, :, :SPAN])
        np.add(base[:, 1:, :, w:], of_place[SPAN:, w:], out=kv[:, :, SPAN:])
        k, v = (y.reshape(n, 2 * SPAN, w) for y in (kv[..., :w], kv[..., w:]))
        a = q @ k.transpose(0, 2, 1)
        a += MASK
        a[np.flatnonzero(~has_prev), :, :SPAN] = -1e9
        np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a *= (1 / (a @ ONES[:2 * SPAN]))[:, :, None]
        o = a @ v
        h = (o.reshape(runs, -1, SPAN, w) + x.reshape(runs, -1, SPAN, w)[:, 1:] + places[SPAN:]).reshape(-1, w)
        z = h @ p["U"]
        z += p["b"]
        np.minimum(z, 80, out=z)
        np.exp(z, out=z)
        known = target >= 0
        z *= (known / max(1, np.count_nonzero(known)) / (z @ ONES[:CLASSES]).astype(np.float64)).astype(np.float32)[:, None]
        at = np.flatnonzero(known)
        z.ravel()[at * CLASSES + self.klass[target[at]]] -= np.float32(1 / max(1, len(at)))
        out["U"][:], out["b"][:] = h.T @ z, np.ones(len(z), np.float32) @ z
        dh = (z @ p["U"].T).reshape(n, SPAN, w)
        da = dh @ v.transpose(0, 2, 1)
        da -= ((dh * o) @ ONES[:w])[:, :, None]
        da *= a
        dk, dv = (y.reshape(runs, -1, 2 * SPAN, w) for y in (da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh))
        dbase, by_place, ones = np.zeros_like(base), np.zeros((2 * SPAN, 3 * w), x.dtype), np.ones(n, x.dtype)
        for at, own in ((0, (da @ k).reshape(runs, -1, SPAN, w)), (w, dk[:, :, SPAN:]), (2 * w, dv[:, :, SPAN:])):
            dbase[:, 1:, :, at:at + w] = own
        for at, own in ((w, dk), (2 * w, dv)):
            dbase[:, :-1, :, at:at + w] += own[:, :, :SPAN]
            by_place[:, at:at + w] = (ones @ own.reshape(n, -1)).reshape(2 * SPAN, w)
        by_place[SPAN:, :w] = (ones @ dbase[:, 1:, :, :w].reshape(n, -1)).reshape(SPAN, w)
        dbase = dbase.reshape(-1, 3 * w)
        out["QKV"][:] = x.T @ dbase + places.T @ by_place
        out["P"][:] = by_place @ qkv.T
        out["P"][SPAN:] += (ones @ dh.reshape(n, -1)).reshape(SPAN, -1)
        dx = dbase @ qkv.T
        dx.reshape(runs, -1, SPAN, w)[:, 1:] += dh.reshape(runs, -1, SPAN, w)
        cells = (slots.reshape(-1, 1) * w + np.arange(w)).ravel()
        out["E"][:] = np.bincount(cells, weights=dx.ravel(), minlength=p["E"].size).reshape(p["E"].shape)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, behind that width; equal bytes lie together and shrink in the table."""
    top = int(numbers.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 31 else 8
    return bytes([width]) + numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    width = packed[0]
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64 if width == 8 else np.int32)


def _kinds(batch: pa.RecordBatch, train: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block: subwords of its distinct words, how many each has, the kind of each word, words of each text; of the
    training texts only if ``train``."""
    for docs, *packed in zip(*(batch.column(c).to_pylist() for c in ("docs", "ids", "sizes", "kinds")), strict=True):
        docs = np.frombuffer(docs, np.int64).reshape(-1, 5)
        ids, sizes, at = map(_unpacked, packed)
        counts = docs[:, 2] - 1
        if train:
            at, counts = at[np.repeat(docs[:, 4] > 0, counts)], counts[docs[:, 4] > 0]
        yield ids, sizes, at, counts


def _texts(batch: pa.RecordBatch, end: int, train: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and starts of each block's texts, of the training ones only if ``train``."""
    for x in _kinds(batch, train):
        yield laid_end_to_end(*x, end)


def _count_subwords(end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the count of each subword in training texts; under -1 the blocks of positions."""
    count = np.zeros(end + 2, np.int64)
    for batch in batches:
        for ids, sizes, at, counts in _kinds(batch, True):
            words = np.bincount(at, minlength=len(sizes))
            count[:-2] += np.bincount(ids, weights=np.repeat(words, sizes), minlength=end).astype(np.int64)
            count[-2] += len(counts)
            length = np.diff(np.append(0, np.cumsum(sizes[at]))[np.append(0, np.cumsum(counts))]) + 1
            count[-1] += (-(-length // SPAN)).sum()
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(at > end, -1, at), pa.int32()), pa.array(count[at])], names=["subword", "n"])


def _count_pairs(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and known subword: the known subwords before it and how often."""
    model = held.value
    side = model.n_known + 1
    pairs, cells, held_back = np.zeros(side * side, np.int64), [], 0
    for cell in itertools.chain((model.pairs(*x) for batch in batches for x in _texts(batch, model.end, True)), [None]):
        if cell is not None:
            cells.append(cell)
            held_back += len(cell)
        if held_back > side * side or cell is None and cells:  # the whole table is walked for each count
            pairs += np.bincount(np.concatenate(cells), minlength=side * side)
            cells, held_back = [], 0
    at = np.flatnonzero(pairs)
    slot, cut = np.unique(at // side, return_index=True)
    packed = [[_packed(x) for x in np.split(y, cut[1:])] if len(at) else [] for y in (at % side, pairs[at])]
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["slot", "other", "n"])


def _learn(held, passes: int, step: int, done: float, share: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the network's state after learning from the task's texts, in parts, and the blocks learned from.
    ``done``: part of the whole fit done before, ``share``: the part a block stands for."""
    model = held.value
    state = model.state.copy()
    texts = (x for batch in batches for x in _texts(batch, model.end, True) if len(x[0]))
    if passes > 1:  # only where all training texts are few
        texts = itertools.chain.from_iterable(itertools.repeat(list(texts), passes))
    seen, steps = model.learn(state, texts, step, lambda seen: done + seen * share)
    if seen:
        parts = [x.tobytes() for x in np.array_split(state, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array([steps] * PARTS, pa.int64()),
                                          pa.array(parts, pa.binary())], names=["part", "seen", "steps", "state"])


def _average(table_: pa.Table) -> pa.Table:
    """One part of the states of all tasks: their mean weighted by blocks, added in an order of content."""
    rows = sorted(zip(*(table_.column(c).to_pylist() for c in ("seen", "steps", "state")), strict=True))
    total = sum(r[0] for r in rows)
    state = sum(np.frombuffer(r[2], np.float32) * (r[0] / total) for r in rows)
    return pa.table({"part": table_.column("part").slice(0, 1), "seen": pa.array([total], pa.int64()), "steps": pa.array([max(r[1] for r in rows)], pa.int64()),
                     "state": pa.array([state.astype(np.float32).tobytes()], pa.binary())})


def fit(texts: DataFrame, end: int) -> AttentionModel:
    """The model from all training texts among the packed blocks ``texts`` (docs, ids, sizes, kinds)."""
    context = texts.sparkSession.sparkContext
    count = np.zeros(end + 2, np.int64)
    counted = texts.mapInArrow(functools.partial(_count_subwords, end), "subword int, n long").groupBy("subword").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most the vocabulary
        count[r.subword] = r.n
    model, blocks_ = AttentionModel(count[:-1]), int(count[-1])
    held = context.broadcast(model)

    def sketch(table_: pa.Table) -> pa.Table:
        before = np.zeros(held.value.n_known + 1)
        for other, n in zip(table_.column("other").to_pylist(), table_.column("n").to_pylist(), strict=True):
            before[_unpacked(other)] += _unpacked(n)
        return pa.table({"slot": table_.column("slot").slice(0, 1), "sketch": pa.array([held.value.sketch(before).tobytes()], pa.binary())})

    near = np.zeros((model.n_known + 1, SKETCH), np.float32)
    found = texts.mapInArrow(functools.partial(_count_pairs, held), "slot int, other binary, n binary").groupBy("slot").applyInArrow(sketch, "slot int, sketch binary")
    for r in found.collect():  # at most a short row per known subword
        near[r.slot] = np.frombuffer(r.sketch, np.float32)
    model.classify(near)
    least = STEPS * RUN * RUNS
    passes, tasks = max(1, -(-least // max(1, blocks_))), max(1, blocks_ // least)
    turn = F.pmod(F.xxhash64("docs"), F.lit(16))
    schema, step, seen = "part int, seen long, steps long, state binary", 0, 0
    for low, high in itertools.pairwise((0, *ROUNDS)) if tasks > 1 else [(0, 16)]:
        own = texts.where((turn >= low) & (turn < high)).coalesce(tasks)
        # coalesce never makes more tasks than there are
        share = own.rdd.getNumPartitions() / max(1, blocks_ * (passes if tasks == 1 else 1))
        learned = own.mapInArrow(functools.partial(_learn, context.broadcast(model), passes, step, seen / max(1, blocks_), share), schema)
        rows = sorted(learned.groupBy("part").applyInArrow(_average, schema).collect())
        if rows:
            model.state = np.concatenate([np.frombuffer(r.state, np.float32) for r in rows])
            step, seen = step + rows[0].steps, seen + rows[0].seen
    model.prepare()
    return model


SENT = np.dtype([("hash", "<u8"), ("train", "<u4")])
SENT_SCHEMA = "block binary, bucket int, terms binary, docs binary, pairs binary, doc_ids array<bigint>, ids binary, sizes binary, kinds binary"
COUNTS = "block binary, bucket int, counts binary, total long, kinds long"
SHARES = "rank long, key long, tokens long, known long, logs double"


def _send_words(held, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of texts: a row for each bucket with the words that fall there, and one (bucket null) with its documents
    and their subwords: those of the distinct words, and the kind of each word."""
    tokenizer = held.value
    for batch in batches:
        rank, key, train = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        for lo, hi, data, offsets in blocks(batch, "text"):
            words, raw, kinds, one, at = lowered(data, offsets)
            used, terms, docs, pairs = _block_words(buckets, words, kinds, at, rank[lo:hi], key[lo:hi], train[lo:hi])
            often = np.argsort(-np.bincount(at, minlength=len(kinds)), kind="stable")  # small numbers for frequent words
            place = np.empty_like(often)
            place[often] = np.arange(len(often))
            ids, sizes = tokenizer.of_kinds(words, raw, one[often])
            n = len(used)
            last = {"docs": docs, "pairs": pairs, "doc_ids": batch.column(3).slice(lo, hi - lo).to_pylist(), "ids": _packed(ids), "sizes": _packed(sizes), "kinds": _packed(place[at])}
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().bytes] * (n + 1), pa.binary()), pa.array([*used.tolist(), None], pa.int32()), pa.array([*terms, None], pa.binary()),
                 *(pa.array([None] * n + [x], pa.list_(pa.int64()) if k == "doc_ids" else pa.binary()) for k, x in last.items())],
                names=["block", "bucket", "terms", *last])


def _score(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = held.value
    for batch in batches:
        for k, (ids, first) in enumerate(_texts(batch, model.end, False)):
            docs = np.frombuffer(batch.column(0)[k].as_py(), np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(docs[:, 0]), pa.array(docs[:, 1]), pa.array(batch.column(4)[k].as_py(), pa.int64()),
                                              pa.array(model.log_prob(ids, first) / np.log(10)), pa.array(np.diff(first), pa.int64())],
                                             names=["rank", "key", "doc_id", "score", "n_subwords"])


def _block_words(buckets, words, kinds, at, rank, key, train):
    """Buckets in use, each one's words; rank, key, tokens, entries and use of the documents; and their entries: each word as
    its distance from the last one (words in order of bucket) and its count (over 255 spread over several entries)."""
    n = len(rank)
    terms = np.append(kinds, END_WORD)
    term = np.concatenate([at, np.full(n, len(terms) - 1)])
    text = np.concatenate([words.text_of_word(), np.arange(n)])
    bucket = (mix(terms) % np.uint64(buckets)).astype(np.int32)
    by_bucket = np.argsort(bucket, kind="stable")
    place = np.empty(len(terms), np.int64)
    place[by_bucket] = np.arange(len(terms))
    pair, tf = np.unique(text * np.int64(len(terms)) + place[term], return_counts=True)
    sent = np.empty(len(terms), SENT)
    sent["hash"] = terms[by_bucket]
    sent["train"] = np.bincount(pair % len(terms), weights=tf * train[pair // len(terms)], minlength=len(terms))
    if tf.max(initial=0) > 255:
        pieces = -(-tf // 255)
        left = np.repeat(tf, pieces) - 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        pair, tf = np.repeat(pair, pieces), np.minimum(left, 255)
    own, of = pair % len(terms), pair // len(terms)
    gap = np.diff(own, prepend=0)
    head = np.append(True, of[1:] != of[:-1])
    gap[head] = own[head]
    docs = np.stack([rank, key, words.counts + 1, np.bincount(of, minlength=n), train], axis=1).astype(np.int64)
    used, cut = np.unique(bucket[by_bucket], return_index=True)
    packed = gap.astype(np.uint16 if len(terms) < 1 << 16 else np.uint32).tobytes() + tf.astype(np.uint8).tobytes()
    return used, [x.tobytes() for x in np.split(sent, cut[1:])], docs.tobytes(), packed


def _count_words(table_: pa.Table) -> pa.Table:
    """One bucket: each block gets the corpus counts of the words it sent; one row (block null) has the bucket's totals."""
    sent = [np.frombuffer(x, SENT) for x in table_.column("terms").to_pylist()]
    kinds, at = np.unique(np.concatenate([x["hash"] for x in sent]), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([x["train"] for x in sent]), minlength=len(kinds)).astype(np.int64)
    back = np.split(count[at], np.cumsum([len(x) for x in sent])[:-1])
    none = pa.nulls(len(sent), pa.int64())
    return pa.concat_tables([
        pa.table({"block": table_.column("block"), "bucket": table_.column("bucket"), "counts": pa.array([x.tobytes() for x in back], pa.binary()), "total": none, "kinds": none}),
        pa.table({"block": pa.nulls(1, pa.binary()), "bucket": pa.nulls(1, pa.int32()), "counts": pa.nulls(1, pa.binary()),
                  "total": pa.array([int(count.sum())], pa.int64()), "kinds": pa.array([int((count > 0).sum())], pa.int64())})])


def _block_shares(table_: pa.Table) -> pa.Table:
    """One block: tokens, known tokens and the sum of log10(count + 1) of each of its documents."""
    rows = list(zip(*(table_.column(x).to_pylist() for x in ("bucket", "counts", "docs", "pairs")), strict=True))
    count = np.concatenate([np.frombuffer(r[1], np.int64) for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])])
    _, _, docs, packed = next(r for r in rows if r[0] is None)
    docs = np.frombuffer(docs, np.int64).reshape(-1, 5)
    entries, n = docs[:, 3], int(docs[:, 3].sum())
    gap = np.frombuffer(packed, np.uint16 if len(count) < 1 << 16 else np.uint32, n).astype(np.int64)
    tf = np.frombuffer(packed, np.uint8, n, offset=len(packed) - n).astype(np.float64)
    sums = np.append(0, np.cumsum(gap))
    term = sums[1:] - np.repeat(sums[np.cumsum(entries) - entries], entries)
    of = np.repeat(np.arange(len(docs)), entries)
    known, logs = (np.bincount(of, weights=tf * x[term], minlength=len(docs)) for x in (count > 0, np.log10(count + 1)))
    return pa.table({"rank": docs[:, 0], "key": docs[:, 1], "tokens": docs[:, 2], "known": known.astype(np.int64), "logs": logs})


def score_texts(docs: DataFrame, held_out, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """Model score and unigram baseline (log10) of each text; ``held_out`` is the column of rows not to learn from.

    A null or empty text has no words and one end. Repeated rows count each in the counts and get equal scores. Null ids
    are ids like others. Without training rows all counts are zero and the model stays at its start; an empty table gives
    no rows.
    """
    keys = keyed(docs)
    flagged = keys.withColumn("held_out", held_out)
    size = keys.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(size // (2 * BUCKET_BYTES)))

    def count_words(table_: pa.Table) -> pa.Table:
        return _count_words(table_)

    def block_shares(table_: pa.Table) -> pa.Table:
        return _block_shares(table_)

    tokenizer = Tokenizer(tokenizer_path)
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)
    sent = settle(flagged.select("rank", "key", (~F.col("held_out")).cast("int").alias("train"), "doc_id", "text").mapInArrow(
        functools.partial(_send_words, held, buckets), SENT_SCHEMA), "words", "zstd")
    counts = settle(sent.where("bucket is not null").select("block", "bucket", "terms").groupBy("bucket").applyInArrow(count_words, COUNTS), "counts")
    total, kinds = counts.where("block is null").agg(F.sum("total"), F.sum("kinds")).first()
    total, kinds = total or 0, kinds or 0
    of_blocks = sent.where("bucket is null").select("block", "bucket", "docs", "pairs").unionByName(
        counts.where("block is not null").select("block", "bucket", "counts"), allowMissingColumns=True)
    shares = settle(of_blocks.groupBy("block").applyInArrow(block_shares, SHARES), "shares")
    base = shares.groupBy("rank", "key").agg(*[F.first(c).alias(c) for c in ("tokens", "known", "logs")])  # rows that repeat have equal shares
    texts = sent.where("bucket is null").select("docs", "ids", "sizes", "kinds", "doc_ids")
    model = docs.sparkSession.sparkContext.broadcast(fit(texts.drop("doc_ids"), tokenizer.size))
    scored = texts.mapInArrow(functools.partial(_score, model), "rank long, key long, doc_id long, score double, n_subwords long")
    each = float(np.log10(total + kinds + 1))
    return scored.join(base, ["rank", "key"]).select(
        "doc_id", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("tokens") * F.lit(each)).alias("base_score"),
        "score", "n_subwords")


def op4_attention(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = split_remainder(F.col("doc_id"), 7) == 2
    return score_texts(docs, held_out).withColumn("held_out", held_out)
