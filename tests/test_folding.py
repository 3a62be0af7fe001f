"""Accent folding over all letters, the literal matches read off it, and count-bounded chunks of real axes."""

import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from ordertide.operators import ordered, reviews
from ordertide.operators.cleaning import fold_accents


def folded(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def test_every_assigned_character_folds_by_the_rule(spark):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")
             and not "가" <= chr(c) <= "힣"]
    texts = ["x".join(chars[i:i + 40]) for i in range(0, len(chars), 40)] + chars[:9000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold_accents(F.col("t")).alias("f")).collect()
    assert len(rows) == len(texts) and all(r.f == folded(r.t) for r in rows)


def test_folding_edge_cases(spark):
    texts = ["", None, "ÀÉ straße", "ẹ́lève ﬁn ﬁn", "İstanbul ΣΊΣΥΦΟΣ", "𝔄 ℡ ½", "한국 é", "ёЙ" * 5000]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fold_accents(F.col("t")).alias("f")).collect()]
    want = [None if t is None else "한국 e" if t == "한국 é" else folded(t) for t in texts]
    assert got == want


def test_literal_matches_equal_a_regular_expression_search(spark):
    rows = [(1, "Não recebi", "O prazo passou, NÃO CHEGOU e está atrasado"), (2, None, "chegou antes do prazo, rápido"), (3, "", None), (1, "Não recebi", "sem atraso")]
    df = spark.createDataFrame(rows, "id long, title string, message string")
    got = sorted(tuple(r) for r in reviews.literal_matches(df, "id", ["title", "message"]).collect())
    want = sorted((i, name, kind, n, m.group()) for i, *texts in rows for name, text in zip(["title", "message"], texts)
                  for kind, p in reviews.PATTERNS.items() for n, m in enumerate(re.finditer(p, folded(text or ""))))
    assert got == want and len(got) > 8
    screened = {(r.id, r.message): r for r in reviews.screen_review_text(df, ["title", "message"]).collect()}
    assert screened[(3, None)].wording_status == "no_listed_phrase_not_a_negative_label" and not screened[(1, "sem atraso")].delivery_topic == 0


def test_heavy_chunks_of_a_real_axis_are_cut_until_light(spark):
    rng = random.Random(5)
    hot = [10.0 ** rng.uniform(-12, 0) for _ in range(3000)] + [0.5 + rng.random() * 1e-9 for _ in range(2000)]
    rows = [("hot", x, rng.randint(0, 9)) for x in hot] + [(k, rng.random(), 1) for k in "abc" for _ in range(50)] + [(None, rng.random(), 2) for _ in range(700)]
    rows += rows[:400]
    df = spark.createDataFrame(rows, "k string, x double, v long")
    base = df.groupBy("k", "x").agg(F.sum("v").alias("v")).withColumn("_key", F.struct("k")).withColumn("_chunk", F.floor("x").cast("long"))
    cut = ordered.bounded_chunks(base, ["_key"], "x", rows=60)
    sizes = cut.groupBy("_key", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 60 and cut.count() == base.count()
    for descending in [False, True]:
        got = {(r.k, r.x): (r.s_before, r.s_upto, r.s_total) for r in ordered.running(
            df, ["k"], "x", {"s": F.col("v")}, width=1.0, descending=descending, chunk_rows=60).collect()}
        for k in ["hot", "a", None]:
            own = sorted(((x, v) for kk, x, v in rows if kk == k), reverse=descending)
            total, before, at = sum(v for _, v in own), 0, 0
            while at < len(own):
                end = at
                while end < len(own) and own[end][0] == own[at][0]:
                    end += 1
                own_sum = sum(v for _, v in own[at:end])
                assert got[(k, own[at][0])] == (before, before + own_sum, total)
                before, at = before + own_sum, end


def test_light_chunks_stay_as_they_are(spark):
    base = spark.createDataFrame([(0.1, 0), (0.2, 0), (5.0, 5)], "x double, _chunk long")
    assert ordered.bounded_chunks(base, [], "x", rows=2) is base
    assert ordered.bounded_chunks(base.where("x > 9"), [], "x", rows=2).count() == 0
