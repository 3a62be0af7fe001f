"""Ranked search: every score recomputed by plain counting, and the cases of its docstring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ordertide.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for (doc, bag), length in zip(bags, lengths, strict=True):
            m = 10 + (90 * length * n) // total if total else 10
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in set(terms(text)) if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, block_bytes=ranked_search.INDEX_BYTES, **more):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    index, n = ranked_search.build_index(frame, block_bytes=block_bytes)
    assert block_bytes > 5_000 or index.count() > 6
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = ranked_search.search(index, n, asked, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["Été", "ÜBER", "日本", "x1"]
    weight = [1 / (k + 1) for k in range(len(words))]
    return [(k, " ".join(rng.choices(words, weight, k=rng.randint(0, 40)))) for k in range(n)]


@pytest.mark.parametrize("vocabulary", [8, 300])
def test_equals_counting(spark, vocabulary):
    docs, items = corpus(1, 400, vocabulary), corpus(2, 12, vocabulary)
    got = result(spark, docs, items, block_bytes=2_000, group_bytes=500)  # many blocks, several groups
    assert got == brute(docs, items) and got


def test_rounds_end_with_final_scores():
    rng = np.random.default_rng(3)
    for trial in range(200):
        n, lists = 60, int(rng.integers(1, 6))
        docs, impacts, cut = [], [], [0]
        for _ in range(lists):
            own = rng.permutation(n)[:rng.integers(0, n)]
            value = np.sort(rng.integers(1, 6, len(own)))[::-1]
            docs, impacts, cut = [*docs, *own], [*impacts, *value], [*cut, cut[-1] + len(own)]
        if not docs:
            continue
        docs, impacts, weights = np.array(docs), np.array(impacts, np.int32), rng.integers(1, 4, lists)
        whole = np.zeros(n, np.int64)
        for i in range(lists):
            np.add.at(whole, docs[cut[i]:cut[i + 1]], weights[i] * impacts[cut[i]:cut[i + 1]])
        at, score = ranked_search.resolve(np.array(cut[:-1]), np.array(cut[1:]), weights, docs, impacts, n, 10, np.zeros(0, np.int64), depth=1)
        assert (whole[at] == score).all()
        best = sorted((-s, d) for d, s in enumerate(whole) if s > 0)[:10]
        assert sorted((-s, d) for d, s in zip(at.tolist(), score.tolist(), strict=True))[:10] == best


def test_defined_cases(spark):
    long = "tail " * 30_000 + "needle"
    docs = [(3, "Alpha beta"), (1, "alpha BETA"), (1, "alpha BETA"), (None, "alpha beta"), (2, None), (4, ""), (5, "?! ..."), (6, long),
            (7, "a" * 1024), (8, "a" * 1023 + "b"), (9, "ÉTÉ été")]
    items = [(1, "beta"), (1, "beta"), (2, None), (3, ""), (4, "..."), (5, "needle"), (6, "A" * 1024), (None, "alpha unknown"), (7, "été"), (1, "alpha needle")]
    got = result(spark, docs, items)
    assert got == brute(docs, [i for i in items if i[1]])
    assert [r[2] for r in got if r[0] is None] == [1, 1, 3, None] and [r[2] for r in got if r[0] == 6] == [7]
    assert [r[2] for r in got if r[0] == 7] == [9]  # only A-Z are lower-cased
    assert result(spark, [], items) == [] and result(spark, docs, []) == []


def test_a_term_of_every_document_counts_nothing(spark):
    docs = [(k, "same words here") for k in range(700)]
    assert result(spark, docs, [(1, "same")]) == brute(docs, [(1, "same")]) == []
