"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell of (source, language, topic). The targets are declared marginal shares; values without a
share of their own form one group per dimension that gets what is left, so the number of cells is bounded by the
declaration, not by the data. The cells' token weights are raked to the three marginals in turn, a fixed number of
rounds. A document is then kept with probability min(1, rate * target / present of its cell), where the common rate
is set by bisection so that the expected number of tokens meets the wanted share of the corpus; the draw compares a
hash of the id and text with that probability, so it is the same in every run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.text import table
from ordertide.session import materialize

REST = "*"


@dataclass(frozen=True)
class Targets:
    """Declared shares per dimension (the group ``*`` gets the remainder) and the wanted share of all tokens."""

    source: dict = field(default_factory=lambda: {"src0": 0.15, "src1": 0.08, "src2": 0.08})
    language: dict = field(default_factory=lambda: {"en": 0.5, "de": 0.18, "fr": 0.16, "es": 0.14})
    topic: dict = field(default_factory=lambda: {"prose": 0.7, "table": 0.12, "noise": 0.06})
    share: float = 0.5
    rounds: int = 30
    seed: str = "mixture-1"


DIMENSIONS = ("source", "language", "topic")


def group_of(col, shares: dict):
    return F.when(col.isin(list(shares)), col).otherwise(F.lit(REST))


def topic_of(text):
    """Kind of text by its characters: noise (many symbols), table (many bars), prose, or short."""
    chars = F.greatest(F.length(text), F.lit(1))
    symbols = F.regexp_count(text, F.lit(r"[#$%&*@<>{}\[\]=]"))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (F.when(F.length(text) < 200, "short").when(symbols / chars > 0.05, "noise").when(bars / chars > 0.01, "table")
            .otherwise("prose"))


def token_count(text):
    """White-space separated words."""
    return F.size(F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")).cast("long")


def rake(cells: dict[tuple, float], targets: Targets) -> dict[tuple, float]:
    """Token weights of the present cells, raked to the target shares; groups without tokens keep no share."""
    keys = sorted(cells)
    weight = np.array([float(cells[k]) for k in keys])
    total = weight.sum()
    if total <= 0:
        return {k: 0.0 for k in keys}
    weight = weight / total
    wanted = []
    for d, name in enumerate(DIMENSIONS):
        shares = dict(getattr(targets, name))
        shares[REST] = max(0.0, 1.0 - sum(shares.values()))
        groups = sorted({k[d] for k in keys})
        present = sum(shares.get(g, 0.0) for g in groups) or 1.0
        index = np.array([groups.index(k[d]) for k in keys])
        wanted.append((index, np.array([shares.get(g, 0.0) / present for g in groups])))
    for _ in range(targets.rounds):
        for index, share in wanted:
            have = np.bincount(index, weights=weight, minlength=len(share))
            weight = weight * np.divide(share, have, out=np.zeros_like(share), where=have > 0)[index]
    return dict(zip(keys, weight, strict=True))


def keep_rates(cells: dict[tuple, float], targets: Targets) -> dict[tuple, float]:
    """Probability of each cell's documents, clipped at 1, with the common rate that meets the wanted tokens."""
    raked, total = rake(cells, targets), float(sum(cells.values()))
    ratio = {k: raked[k] * total / cells[k] if cells[k] else 0.0 for k in cells}
    low, high = 0.0, max([1.0 / r for r in ratio.values() if r > 0], default=1.0)
    for _ in range(100):
        rate = (low + high) / 2
        got = sum(cells[k] * min(1.0, rate * ratio[k]) for k in cells)
        low, high = (rate, high) if got < targets.share * total else (low, rate)
    return {k: min(1.0, high * ratio[k]) for k in cells}


def draw(seed: str):
    """Uniform number in [0, 1) from 32 bits of an MD5 of seed, id and text."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_cells(docs: DataFrame, targets: Targets) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({
        "_source": group_of(F.col("source"), targets.source), "_language": group_of(F.col("lang"), targets.language),
        "_topic": group_of(topic_of(text), targets.topic), "_tokens": token_count(text)})


def mix_sources(docs: DataFrame, targets: Targets | None = None, columns: list[str] | None = None) -> DataFrame:
    """The kept documents of ``docs`` with _tokens, _rate (probability) and _weight (its inverse, to estimate totals).

    ``columns`` are the columns of ``docs`` wanted back (all by default). Without the text among them, what was measured
    is a small written table and the texts are read once; else they are read for the cells and again for the draw.

    Null source or language count as the remaining group. Null and empty texts have no tokens: their cell's rate decides,
    and a cell without tokens is never kept. Repeated rows are drawn alike. An empty table stays empty. Declared groups
    that do not occur leave their share to the others in proportion. Own columns named like the added ones are replaced.
    """
    targets = targets or Targets()
    wanted = docs.columns if columns is None else columns
    added = ["_source", "_language", "_topic", "_tokens", "_draw"]
    cells_df = with_cells(docs, targets).withColumn("_draw", draw(targets.seed)).select(*[c for c in wanted if c not in added], *added)
    if "text" not in wanted:
        cells_df = materialize(cells_df, "measured")
    keys = ["_source", "_language", "_topic"]
    cells = {tuple(r[k] for k in keys): float(r["n"]) for r in cells_df.groupBy(*keys).agg(F.sum("_tokens").alias("n")).collect()}
    rates = keep_rates(cells, targets)
    joint = F.concat_ws("\x1f", *keys)
    entries = [x for k, v in sorted(rates.items()) for x in (F.lit("\x1f".join(k)), F.lit(float(v)))]
    rate = F.create_map(*entries)[joint] if entries else F.lit(None).cast("double")
    kept = cells_df.withColumn("_rate", F.coalesce(rate, F.lit(0.0))).where(F.col("_draw") < F.col("_rate"))
    return kept.withColumn("_weight", 1 / F.col("_rate")).drop(*keys, "_draw")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    kept = mix_sources(table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"])
    return kept.select("doc_id", "source", "lang", F.col("_tokens").alias("n_tokens"),
                       F.round("_rate", 9).alias("rate"), F.round("_weight", 6).alias("weight"))


def _oracle(t: Targets) -> str:
    """The same raking, unrolled: one common table expression per step, on the cells only."""
    def grp(col, shares):
        return f"CASE WHEN {col} IN ({', '.join(repr(x) for x in shares)}) THEN {col} ELSE '{REST}' END"

    def sym(chars):
        return f"(length(t) - length(translate(t, '{chars}', '')))"

    topic = (f"CASE WHEN length(t) < 200 THEN 'short' WHEN {sym('#$%&*@<>{}[]=')} / greatest(length(t), 1) > 0.05 THEN 'noise' "
             f"WHEN {sym('|')} / greatest(length(t), 1) > 0.01 THEN 'table' ELSE 'prose' END")
    ctes = [f"d AS (SELECT doc_id, text, source, lang, coalesce(text, '') AS t FROM documents)",
            f"k AS (SELECT doc_id, text, source, lang, {grp('source', t.source)} AS g0, {grp('lang', t.language)} AS g1, "
            f"{grp('(' + topic + ')', t.topic)} AS g2, len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS tokens FROM d)",
            "c AS (SELECT g0, g1, g2, sum(tokens)::DOUBLE AS n FROM k GROUP BY ALL)",
            "w0 AS (SELECT g0, g1, g2, n, n / sum(n) OVER () AS w FROM c)"]
    for d, name in enumerate(DIMENSIONS):
        shares = dict(getattr(t, name))
        shares[REST] = max(0.0, 1.0 - sum(shares.values()))
        rows = ", ".join(f"('{g}', {s!r}::DOUBLE)" for g, s in shares.items())
        ctes.append(f"s{d} AS (SELECT g, s / sum(s) OVER () AS s FROM (VALUES {rows}) v(g, s) WHERE g IN (SELECT g{d} FROM c))")
    step = 0
    for _ in range(t.rounds):
        for d in range(3):
            ctes.append(f"w{step + 1} AS MATERIALIZED (SELECT g0, g1, g2, n, w * s / nullif(sum(w) OVER (PARTITION BY g{d}), 0) AS w "
                        f"FROM w{step} JOIN s{d} ON g = g{d})")
            step += 1
    ctes.append(f"r AS (SELECT g0, g1, g2, n, CASE WHEN n > 0 THEN w * (sum(n) OVER ()) / n ELSE 0 END AS q FROM w{step})")
    ctes.append("b(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, (SELECT max(1 / q) FROM r WHERE q > 0) UNION ALL SELECT i + 1, "
                f"CASE WHEN (SELECT sum(n * least(1, (lo + hi) / 2 * q)) FROM r) < {t.share!r} * (SELECT sum(n) FROM r) THEN (lo + hi) / 2 ELSE lo END, "
                f"CASE WHEN (SELECT sum(n * least(1, (lo + hi) / 2 * q)) FROM r) < {t.share!r} * (SELECT sum(n) FROM r) THEN hi ELSE (lo + hi) / 2 END "
                "FROM b WHERE i < 100)")
    ctes.append("f AS (SELECT g0, g1, g2, least(1.0, (SELECT hi FROM b WHERE i = 100) * q) AS rate FROM r)")
    u = f"('0x' || substr(md5('{t.seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || t2), 1, 8))::UBIGINT::DOUBLE / 4294967296.0"
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT doc_id, source, lang, tokens::BIGINT AS n_tokens, round(rate, 9) AS rate, round(1 / rate, 6) AS weight "
            f"FROM (SELECT *, coalesce(text, '') AS t2 FROM k) JOIN f USING (g0, g1, g2) WHERE {u} < rate")


ORACLE = _oracle(Targets())
