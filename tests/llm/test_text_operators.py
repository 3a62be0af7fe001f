"""Operators on training text: edge cases with defined results, and brute force on small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ordertide.llm import (attention, automaton_dedup, bag_minhash, gamma_samples, language, mixing, suffix_dedup, surrogates,
                           url_rules, winnow)

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, rank long, key long, label string, _lang string, "
          "bucket int, t string, stretches string")  # the last ones clash with names used inside


def rows_of(texts):
    return [(i, t, lang, "src0", None if t is None else len(t), 1, 2, "x", "y", 3, "z", "w") for i, t, lang in texts]


LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(30_000))
EDGE = [(1, None, "en"), (2, "", "en"), (3, "  \n\t", "de"), (4, LONG, "en"), (4, LONG, "en"), (None, "Some words of a text without an id", None),
        (5, "one", "en"), (6, "...!!!", "fr"), (7, LONG, "en"), (8, "a" * 300, "en"), (8, "other text of the same id", "fr"),
        (9, "\U0001F600 é ü ñ " * 40, "es"), (10, "the same words " * 60, "en")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(rows_of(EDGE), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def documents_df(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_suffix_dedup(spark, edge, empty, documents_df, documents):
    got = suffix_dedup.remove_earlier_strings(edge).collect()
    assert len(got) == len(EDGE)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.n_removed == 0 for r in by[4]) and by[7][0].n_removed == len(LONG) and by[7][0].n_spans == 1
    assert by[1][0].n_bytes == 0 and by[1][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert suffix_dedup.remove_earlier_strings(empty).count() == 0
    want, first = {}, {}
    for r in sorted(documents, key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k:k + 50], r["doc_id"]) < r["doc_id"]:
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        want[r["doc_id"]] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    have = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_earlier_strings(documents_df).collect()}
    assert have == want


def words_removed(rows):
    count, words = collections.Counter(), []
    for r in rows:
        w = WORD.findall((r or "").encode())
        words.append(w)
        count.update(tuple(w[k:k + 35]) for k in range(len(w) - 34))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k:k + 35])] > 1:
                gone[k:k + 35] = [True] * 35
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone, strict=True) if not y)).hexdigest()))
    return out


def test_automaton_dedup(edge, empty, documents_df, documents):
    assert automaton_dedup.remove_repeated_windows(empty).count() == 0
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in automaton_dedup.remove_repeated_windows(edge).collect())
    assert got == sorted(words_removed([t for _, t, _ in EDGE]))  # with repeats inside one text
    have = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in automaton_dedup.remove_repeated_windows(documents_df).collect()}
    assert have == dict(zip([r["doc_id"] for r in documents], words_removed([r["text"] for r in documents]), strict=True))


def test_suffix_automaton_counts():
    automaton = automaton_dedup.SuffixAutomaton()
    for text in ("abcabx", "bcab"):
        automaton.add(list(text), 1)
    automaton.finish()
    assert list(automaton.repeated(list("abcabx"), 3)) == [False, True, True, False]


@pytest.mark.parametrize("group_words", [10, 4_000_000])
def test_winnowing(spark, edge, empty, documents_df, documents, group_words):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist() + [{"item_id": 900, "text": "One"}, {"item_id": 901, "text": None}, {"item_id": 902, "text": "a text without"}]
    benchmark = spark.createDataFrame([(r["item_id"], r["text"]) for r in items], "item_id long, text string")
    assert winnow.contamination(empty, benchmark).count() == 0
    assert winnow.contamination(edge, benchmark.limit(0)).where("contaminated").count() == 0
    windows = {}
    for r in items:
        w = ALNUM.findall((r["text"] or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(r["item_id"]))

    def wanted(text):
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit[k:k + n], found = [True] * n, found | windows[tuple(w[k:k + n])]
        return len(w), sum(hit), sorted(found)

    for df, texts in ((edge, [t for _, t, _ in EDGE]), (documents_df, [r["text"] for r in documents])):
        marked = winnow.mark_benchmark_words(df, benchmark, group_words)
        assert marked.columns[:len(df.columns)] == df.columns
        got = sorted((r._words, sum(x.bit_count() for x in r._hit), sorted(r._items)) for r in marked.collect())
        assert got == sorted(wanted(t) for t in texts)


def test_items_without_an_id_hit_but_are_not_listed(spark):
    words = [f"w{k}" for k in range(40)]
    benchmark = spark.createDataFrame([(None, " ".join(words[:12])), (7, " ".join(words[20:31])), (None, None), (None, "solo")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[:13])), (2, " ".join(words)), (3, "a solo b"), (4, "clean")], "doc_id long, text string")
    for group_words in [1, 4_000_000]:
        got = {r.doc_id: (sum(x.bit_count() for x in r._hit), r._items) for r in winnow.mark_benchmark_words(docs, benchmark, group_words).collect()}
        assert got == {1: (12, []), 2: (23, ["7"]), 3: (1, []), 4: (0, [])}


def test_near_duplicates(spark, edge, empty, documents_df, documents):
    assert bag_minhash.near_duplicates(empty).count() == 0
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1) for r in bag_minhash.near_duplicates(edge).collect())
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (-1, -1), (5, 5), (6, 6), (7, 4), (8, 8), (8, 8), (9, 9), (10, 10)])
    kept = bag_minhash.keep_one_of_each(edge)
    assert kept.columns == edge.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 8, 8, 9, 10]
    sets = []
    for r in documents:
        w = WORD.findall((r["text"] or "").encode())
        sets.append(collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] \
                    and (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total():
                parent[find(i)] = find(j)
    least = {}
    for k, r in enumerate(documents):
        least[find(k)] = min(least.get(find(k), 1 << 60), r["doc_id"])
    have = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(documents_df).collect()}
    assert have == {r["doc_id"]: least[find(k)] for k, r in enumerate(documents)}


def test_large_band_of_near_copies(spark):
    base = [f"w{k}" for k in range(200)]
    texts = [(k, " ".join([f"x{k}" if k and j == (k * 7) % 200 else w for j, w in enumerate(base)]), "en") for k in range(60)]
    got = bag_minhash.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert {r.class_id for r in got} == {0}


@pytest.mark.parametrize("chunk", [4096, 60])
def test_large_bands_around_the_threshold(spark, monkeypatch, chunk):
    """Few pairs at 0.80 among many at 0.78: a rejected partner must not hide the next one."""
    monkeypatch.setattr(bag_minhash, "CHUNK", chunk)
    draw = random.Random(5)
    places = [draw.sample(range(4, 1000), 14) for _ in range(160)]  # words of its own that end up to 70 of 1000 shingles
    texts = [(k, " ".join(f"x{k}-{j}" if j in own else f"w{j}" for j in range(1004)), "en") for k, own in enumerate(places)]
    killed = [{j - d for j in own for d in range(5)} for own in places]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            ended = len(killed[i] | killed[j])
            if 1000 - ended >= 0.8 * (1000 + ended):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert got == dict(enumerate(label)) and 3 < len(texts) - len(set(label)) < 30


@pytest.mark.parametrize("chunk", [4096, 50])
def test_outliers_of_a_large_group_give_no_row_per_pair(spark, monkeypatch, chunk):
    """Copies of one text and outliers just below the threshold of all of them: links are exact, the pairs written few."""
    rows_of_pairs = []

    def settled(df, name, settle=bag_minhash.settle):
        out = settle(df, name)
        if name == "pairs":
            rows_of_pairs.append(out.count())
        return out

    monkeypatch.setattr(bag_minhash, "settle", settled)
    monkeypatch.setattr(bag_minhash, "CHUNK", chunk)
    draw = random.Random(11)
    texts = [(k, " ".join(f"x{k}" if k and j == 3 * k else w for j, w in enumerate(f"w{j}" for j in range(404))), "en") for k in range(120)]
    for k in range(120, 140):  # 10 to 12 words of their own end 50 to 60 of 400 shingles: 0.74 to 0.78 of the copies
        own = set(draw.sample(range(4, 400, 5), 10 + k % 3))
        texts.append((k, " ".join(f"x{k}-{j}" if j in own else f"w{j}" for j in range(404)), "en"))
    sets = [collections.Counter(zip(*(t.split()[k:] for k in range(5)))) for _, t, _ in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total():
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert got == dict(enumerate(label)) and 5 < len(set(label))
    assert sum(rows_of_pairs) <= 5 * len(texts)  # three of each text in large bands, and those of small bands


def test_bag_minhash_estimates_weighted_jaccard():
    import numpy as np

    hashes = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.ones(300, np.int64), np.full(300, 3, np.int64)
    text = np.repeat([0, 1], 300)
    sig = bag_minhash.signatures(text, np.concatenate([hashes[:300], hashes[100:]]), np.concatenate([a, b]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 200 / (100 + 900)) < 0.03


def test_language(spark, edge, empty, documents_df):
    models = language.fit(documents_df.where("doc_id % 5 <> 0"))
    got = {(r.doc_id, r.text): r for r in language.identify(edge, models).collect()}
    assert len(got) == len({(i, t) for i, t, _ in EDGE})
    for key in ((1, None), (2, ""), (3, "  \n\t"), (6, "...!!!")):
        assert (got[key]._lang, got[key]._score, got[key]._rejected) == ("und", 0.0, True)
    held = language.identify(documents_df.where("doc_id % 5 = 0"), models)
    assert held.where("_lang = lang").count() >= 0.95 * held.count()
    assert language.identify(empty, models).count() == 0
    assert language.fit(empty) is None and {r._lang for r in language.identify(edge, None).collect()} == {"und"}


def test_labels_without_a_letter_are_no_candidates(spark):
    rows = [(k, f"the quick brown fox number {k} jumps over the lazy dog", "en") for k in range(40)] + [(None, None, "zz")] * 40 + [(99, "", "yy"), (98, "12 34 !!", "xx")]
    models = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.languages == ["en"]
    texts = spark.createDataFrame([(1, "Привет мир"), (2, "the lazy fox"), (3, "12")], "doc_id long, text string")
    assert {r._lang for r in language.identify(texts, models).collect()} <= {"en", "und"}
    assert language.fit(spark.createDataFrame(rows[40:], "doc_id long, text string, lang string")) is None


def test_kneser_ney_is_a_distribution(documents_df):
    import numpy as np

    models = language.fit(documents_df)
    table = models.tables[0]  # order 1: all known symbols and the rest sum to one
    total = np.exp(table.values).sum(axis=0) + np.exp(models.uniform) * np.exp(models.backoff[0].values[0])
    assert np.allclose(total, 1, atol=0.02)


def test_scores(spark, edge, empty):
    held_out = F.coalesce(F.col("doc_id") == 5, F.lit(False))
    got = attention.score_texts(edge, held_out).collect()
    assert len(got) == len(EDGE) and attention.score_texts(empty, held_out).count() == 0
    tokens = [[*WORD.findall((t or "").translate(LOWER).encode()), None] for _, t, _ in EDGE]
    count = collections.Counter(x for (i, _, _), ts in zip(EDGE, tokens, strict=True) if i != 5 for x in ts)
    n, v = sum(count.values()), len(count)
    want = sorted((len(ts), sum(count[x] > 0 for x in ts), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ts), 4)) for ts in tokens)
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_scores_learn_from_every_training_text(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("the of and to in is that for it was on are".split()) for _ in range(20))) for k in range(1500)]
    held_out = F.col("doc_id") == 1499
    for k in (10, 700, 1400):  # any one text that knows the words of the held-out one makes it likelier
        scores = []
        for more in ("", " zygote quartz" * 200):
            texts = [(i, "zygote quartz zygote quartz" if i == 1499 else t + more * (i == k)) for i, t in rows]
            scores.append(attention.score_texts(spark.createDataFrame(texts, "doc_id long, text string").coalesce(2), held_out).where(held_out).first().score)
        assert scores[1] > scores[0] + 3, (k, scores)


def fitted_attention(spark, documents_df, monkeypatch, steps):
    import numpy as np

    monkeypatch.setattr(attention, "STEPS", steps)
    kept = []
    own = attention.fit
    monkeypatch.setattr(attention, "fit", lambda *a: kept.append(own(*a)) or kept[0])
    scored = attention.score_texts(documents_df.repartition(5, "doc_id"), F.col("doc_id") % 3 == 0)
    tokenizer = attention.Tokenizer()
    return kept[0], scored, lambda text: [*(int(i) for w in WORD.findall(text.translate(LOWER).encode()) for i in tokenizer.words([w])[0]), tokenizer.size], np


def test_attention_counts_all_training_texts(spark, documents_df, documents, monkeypatch):
    model, scored, ids_of, np = fitted_attention(spark, documents_df, monkeypatch, 4)  # few steps: several tasks and rounds
    texts = [ids_of(r["text"] or "") for r in documents if r["doc_id"] % 3]
    count = collections.Counter(i for t in texts for i in t)
    assert {i: int(n) for i, n in enumerate(model.count) if n} == count
    total = np.bincount(model.klass, weights=model.count + 0.1, minlength=attention.CLASSES)
    assert np.allclose(np.exp(model.inside), (model.count + 0.1) / total[model.klass], rtol=1e-4)
    # scores of short texts, position by position
    got = {r.doc_id: r.score for r in scored.collect()}
    p, w, span, begin = {k: v.astype(float) for k, v in model.p.items()}, attention.WIDTH, attention.SPAN, model.slot[-1]
    for r in sorted(documents, key=lambda r: len(r["text"] or ""))[:5]:
        ids = ids_of(r["text"] or "")
        slots = [begin, *(model.slot[i] for i in ids[:-1])]
        sum_ = 0.0
        for at, target in enumerate(ids):
            block = at // span
            seen = range(max(0, (block - 1) * span), at + 1)
            x = np.array([p["E"][slots[j]] + p["P"][j - (block - 1) * span] for j in seen])
            q, k, v = (x @ p["QKV"][:, c * w:(c + 1) * w] for c in range(3))
            a = np.exp(k @ q[-1])
            z = (x[-1] + a @ v / a.sum()) @ p["U"] + p["b"]
            sum_ += z[model.klass[target]] - np.log(np.exp(z).sum()) + model.inside[target]
        assert got[r["doc_id"]] == pytest.approx(sum_ / math.log(10), rel=1e-4)


def test_attention_gradient(spark, documents_df, monkeypatch):
    model, _, _, np = fitted_attention(spark, documents_df, monkeypatch, 40)
    rng = np.random.default_rng(5)
    p = {k: v.astype(float) for k, v in model.p.items()}
    slots, has_prev = rng.integers(0, model.n_known, (3, 5, attention.SPAN)), rng.random(12) > 0.3
    target = np.where(rng.random(12 * attention.SPAN) > 0.2, rng.integers(0, model.end, 12 * attention.SPAN), -1)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    model.gradient(p, grad, slots, has_prev, target)

    def loss():
        w, out = attention.WIDTH, []
        for n, (run, block) in enumerate((r, b) for r in range(3) for b in range(1, 5)):
            x = np.concatenate([p["E"][slots[run, block - 1]], p["E"][slots[run, block]]]) + p["P"]
            q, k, v = (x @ p["QKV"][:, c * w:(c + 1) * w] for c in range(3))
            for j in range(attention.SPAN):
                seen = slice(0 if has_prev[n] else attention.SPAN, attention.SPAN + j + 1)
                a = np.exp(k[seen] @ q[attention.SPAN + j])
                z = (x[attention.SPAN + j] + a @ v[seen] / a.sum()) @ p["U"] + p["b"]
                t = target[n * attention.SPAN + j]
                if t >= 0:
                    out.append(np.log(np.exp(z).sum()) - z[model.klass[t]])
        return np.mean(out)

    for name, v in p.items():
        for at in ([(slots[0, 0, 3], 1), (slots[1, 2, 5], 7)] if name == "E" else [tuple(rng.integers(0, d) for d in v.shape) for _ in range(4)]):
            here, step = v[at], 1e-5
            sides = []
            for v[at] in (here + step, here - step):
                sides.append(loss())
            v[at] = here
            assert grad[name][at] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=1e-4, abs=1e-7)


def test_fingerprints(spark, edge, empty, documents_df, documents):
    assert gamma_samples.fingerprint_with_next(empty).count() == 0
    assert gamma_samples.fingerprint_with_next(edge, 3).count() == len(EDGE)
    texts = [r["text"] or "" for r in sorted(documents, key=lambda r: r["doc_id"])]
    for chunk in (7, 5000):
        got = sorted(gamma_samples.fingerprint_with_next(documents_df, chunk).collect(), key=lambda r: r.doc_id)
        for k, r in enumerate(got):
            follow = texts[(k + 1) % len(texts)]
            q = len(texts[k]) // 4
            changed = texts[k][:len(texts[k]) - q] + follow[:q]
            assert (r.n_chars, r.edited_sha256) == (len(texts[k]), hashlib.sha256(changed.encode()).hexdigest())
            a, b = (collections.Counter(WORD.findall(x.translate(LOWER).encode())) for x in (texts[k], changed))
            exact = (a & b).total() / max(1, (a | b).total())
            assert abs(r.near_edited - exact) < 0.3
    same = collections.defaultdict(set)
    for r, t in zip(got, texts, strict=True):
        same[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_url_rules(spark):
    bad = [(k, f"http://a{k}.spam-farm.example.net/x/{k}") for k in range(20)]
    good = [(100 + k, f"http://a{k}.fine.example.net/x/{k}") for k in range(40)]
    listed = [(200, "http://W.Example.ORG/es/1"), (201, "http://example.org/en/12?q"), (202, "http://b.org/x"), (203, "https://c.com/de/9#t"), (204, None),
              (205, "no scheme"), (None, "http://q.spam-farm.example.net/y"), (206, "http://d.com/fr/1"), (200, "http://W.Example.ORG/es/1")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in bad + good + listed], "page_id long, url string, items string")
    labels = spark.createDataFrame([(k, 1, 1) for k, _ in bad] + [(k, 1, 0) for k, _ in good] + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, labels).collect()}
    assert got[3] == ("a3.spam-farm.example.net", "/x/3", None, "block") and got[103][3] == "allow" and got[None][3] == "block"
    assert got[200] == ("w.example.org", "/es/1", "example.org/es/", "block") and got[201][2:] == ("example.org/en/1", "block")
    assert got[202][2:] == ("org/", "allow") and got[203][2:] == ("com/de/", "block") and got[206][2:] == ("com/fr/", "allow")
    assert got[204] == ("", "", None, "allow") == got[205]
    assert url_rules.judge_urls(pages, labels.limit(0)).count() == len(bad + good + listed) and url_rules.judge_urls(pages.limit(0), labels).count() == 0


def test_surrogates(spark, edge, empty):
    text = 'Mail a.b@x.org or A.B@X.org, +1 (017) 555-7713, 4111 1111 1111 1111, 10.20.30.40, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962". Mrs. Anna Smith.'
    rows = [(1, text, "en"), (2, "again a.b@x.org and 4111111111111111", "en"), (3, "clean text, version 4.0 of 2020", "en"), (4, None, "en")]
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    got = {r.doc_id: r for r in surrogates.replace_entities(docs).collect()}
    assert dict(got[1]._entities) == {"email": 2, "phone": 1, "card": 1, "ip": 1, "secret": 1, "name": 1}
    for old in ("a.b@x.org", "555-7713", "4111 1111", "10.20.30.40", "04dbebab", "Anna Smith"):
        assert old not in got[1].text
    mail = re.search(r"\S+@\S+", got[1].text).group()
    assert mail in got[2].text and len(got[1].text) >= len(text) - 8  # the same entity, the same surrogate
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[1].text).group().replace(" ", "")
    assert card in got[2].text and surrogates.luhn([int(x) for x in card[:-1]]) == int(card[-1])
    assert got[3].text == rows[2][1] and got[4].text is None
    assert surrogates.replace_entities(empty).count() == 0
    assert sorted(x or "" for (x,) in surrogates.replace_entities(edge).select("text").collect()) == sorted(t or "" for _, t, _ in EDGE)


def test_entities_are_found_as_in_the_whole_text():
    from ordertide.llm.text import buffers

    forms = ["(Mr. John Smith", '"Mrs. Anna Smith"', "«Señora Ana Pérez-Gil", "x,Herr Max Muster", "—Госпожа Анна Иванова", "Mr John", "Mr.  John Smith", "Mrs.\nAnna Smith",
             "password=correcthorse", "api_key=abcdEFGHijkl", 'token = "abcdefgh"', 'x Token = "abcdefghij', "SECRET=abcdefgh.", "paſſword=abcdefghij", 'token =\n"abcdefgh"',
             "abcdef" * 6, "(" + "ABCDEF" * 6 + ")", "AKIA" + "ABCDEFGH" * 2, "ghp_" + "abcDEF" * 6, "sk-" + "abcDEF" * 4, "a" * 40,
             "٠١٢-٣٤-٥٦٧٨", "+٤٩ ١٧٠ ١٢٣٤٥٦٧", "१२३४ १२३४ १२३४ १२३४", "\U0001D7CE" * 14, "(०१२) ३४५-६७८९", "a@b.org", "+1 (017) 555-7713", "10.20.30.40",
             "DE44 ABCD EFGH.", "DE44ABCD EFGHIJKL XYZ", "(GB82 WEST ABCD EFGH IJKL MNOP QRST UVWX YZ", "XX٤٤ ABCD EFGH AB", "ABCD EFGH", "plain words only"]
    texts = [f"{before}{form}{behind}" for form in forms for before in ("", "some words ", "é\t", "4 Mr ") for behind in ("", " and more words", "\nNext Line", ", x")]
    texts += [" ".join(random.Random(k).choices(forms, k=6)) for k in range(300)] + ["", " ", "Mr"]
    got = surrogates.replace_block(*buffers(pa.array(texts)), "key")
    for k, text in enumerate(texts):
        new, found = surrogates.replace(text, "key")
        assert got.get(k, (text, {})) == (new, found)


def test_names_of_every_script_have_surrogates_of_their_own(spark):
    lasts = ["محمود", "כהן", "山田", "김철수", "Čapek", "Łoś", "Őry", "Li", "Smith", "Καρράς", "Ωμέγά"]
    firsts = [f"{a}{b}" for a in "ABCDEFGH" for b in "abcdef"] + ["محمد", "太郎", "Čeněk", "Anna", "Mary", "James", "Paul", "Анна", "Иван"]
    names = [(title, first, last) for first in firsts for last in lasts for title in ("Mr", "Mrs")]
    docs = spark.createDataFrame(rows_of([(k, " ".join((t + ".", f, n)), "en") for k, (t, f, n) in enumerate(names)]), SCHEMA)
    got = {r.doc_id: r.text.split(" ") for r in surrogates.replace_entities(docs).collect()}
    pairs = {}
    for k, (title, first, last) in enumerate(names):
        new_title, new_first, new_last = got[k]
        assert new_title == title + "." and new_first != first and new_last != last
        for a, b in zip(last, new_last, strict=True):
            assert unicodedata.category(a) == unicodedata.category(b) and unicodedata.name(a).split()[0] == unicodedata.name(b).split()[0]
        pairs.setdefault((new_first, new_last), set()).add((first, last))
    assert len(pairs) == len(firsts) * len(lasts) and all(len(x) == 1 for x in pairs.values())
    assert surrogates.other_first_name("Anna", "key") in surrogates.NAMES["f", "latin"]
    every = {first: surrogates.other_first_name(first, "key") for first in [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]}
    assert len(set(every.values())) == len(every)


def test_permutation_is_one_to_one():
    seen = {surrogates.same_format(f"{k:03d}", "key", "t") for k in range(1000)}
    assert len(seen) == 1000 and all(len(x) == 3 for x in seen)


def test_mixing(edge, empty, documents_df):
    assert mixing.mix_sources(empty).count() == 0
    assert {r._tokens for r in mixing.mix_sources(edge).where("text is null").collect()} <= {0}
    targets = mixing.Targets(source={"src0": 0.5}, language={"en": 0.5}, topic={}, share=0.4)
    cells = {("src0", "en", "*"): 700.0, ("src0", "*", "*"): 100.0, ("*", "en", "*"): 100.0, ("*", "*", "*"): 100.0}
    raked = mixing.rake(cells, targets)
    assert abs(sum(v for k, v in raked.items() if k[0] == "src0") - 0.5) < 1e-9 and abs(sum(v for k, v in raked.items() if k[1] == "en") - 0.5) < 1e-3
    rates = mixing.keep_rates(cells, targets)
    assert all(0 <= r <= 1 for r in rates.values()) and abs(sum(cells[k] * rates[k] for k in cells) - 400) < 1e-6
    kept = mixing.mix_sources(documents_df)
    assert kept.count() == mixing.mix_sources(documents_df).count() and 0 < kept.count() < documents_df.count()


def test_pipeline(spark, edge, documents_df):
    docs = documents_df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and ids
        docs = out
    assert corpus_pipeline.run(spark, SF).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edge, SF).count()
        stage(spark, edge.limit(0), SF).count()


def test_texts_as_arrow_slices():
    from ordertide.llm.text import Words, buffers

    column = pa.array(["skip", None, "two words", "é"])[1:]
    data, offsets = buffers(column)
    words = Words(data, offsets)
    assert words.counts.tolist() == [0, 2, 1] and offsets.tolist() == [0, 0, 9, 11]


def test_texts_that_polynomial_hashes_confuse_stay_apart(spark):
    """A Thue-Morse word and its complement: equal under any sum of powers of an odd base modulo 2**64."""
    from ordertide.llm import bag_minhash

    word = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    got = {r["doc_id"]: r["class_id"] for r in bag_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[3] == 1 and got[2] == 2
