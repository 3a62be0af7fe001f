"""Conversation repair: exhaustive search on short symbol sequences, brute force on rows, cut conversations, defined cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from ordertide.llm import repair

SYMBOLS = "suaoSUAOx"


def exhaustive(symbols, max_inserts):
    """Least (cost, audit) over all edit sequences, by the specification's pattern alone."""
    best = None

    def extend(k, roles, cost, audit, left):
        nonlocal best
        if k == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if left:
            for role in "ua":
                extend(k, roles + role, cost + 2, audit + "I", left - 1)
        if k < len(symbols):
            c, late = symbols[k].lower(), symbols[k].isupper()
            extend(k + 1, roles, cost + 3, audit + "D", left)
            if c != "x":
                extend(k + 1, roles + c, cost + late, audit + "K", left)
                for role in "ua":
                    extend(k + 1, roles + role, cost + 2 + late, audit + "R", left)

    extend(0, "", 0, "", max_inserts)
    return best


def straight(symbols):
    """Least (cost, audit) by plain strings, state by state."""
    follow = (2, 2, 3, 2)

    def better(d, k, v):
        d[k] = min(d.get(k, v), v)

    def inserted(d):
        for _ in range(3):
            for s, (cost, audit) in list(d.items()):
                better(d, follow[s], (cost + 2, audit + "I"))
        return d

    now = {0: (0, "")}
    for c in symbols:
        then, late = {}, int(c.isupper())
        for s, (cost, audit) in inserted(now).items():
            better(then, s, (cost + 3, audit + "D"))
            if c != "x":
                better(then, follow[s], (cost + 2 + late, audit + "R"))
                if c.lower() == "s" and s == 0 or c.lower() == "u" and follow[s] == 2 or c.lower() == "a" and s == 2:
                    better(then, {"s": 1, "u": 2, "a": 3}[c.lower()], (cost + late, audit + "K"))
        now = then
    return min(v for s, v in inserted(now).items() if s in (0, 3))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute(rows):
    everything, out = damage(rows), []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in everything if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        turns = {r[1] for r in own if r[1] is not None}
        seen, symbols, faults = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] = faults.get(fault, 0) + 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = straight(symbols)
        lines, left = [], iter(own)
        for letter in audit:
            wanted = "assistant" if lines and lines[-1][0] == "u" else "user"
            if letter == "I":
                lines.append(f"{wanted}:")
                continue
            _, _, role, text = next(left)
            if letter != "D":
                lines.append(f"{role if letter == 'K' else wanted}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=str)


def result(spark, rows, partitions=3):
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, symbol string, n int")
    got = repair.repair(frame.repartition(partitions))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_plain_strings_equal_exhaustive_search():
    for n in range(4):
        for symbols in itertools.product("sua" if n == 3 else SYMBOLS, repeat=n):
            assert straight("".join(symbols)) == exhaustive("".join(symbols), 3)


def test_grammar_and_pieces_equal_plain_strings():
    rng = random.Random(5)
    grammar = repair.Grammar()
    for _ in range(60):  # rules over rules
        known = [c for c in grammar.matrices]
        grammar.add("".join(rng.choices(known[-12:], k=2)))
    for _ in range(400):
        symbols = "".join(rng.choices(SYMBOLS, k=rng.randint(0, 60)))
        cost, audit, kept = grammar.solve(symbols)
        assert (cost, audit) == straight(symbols)
        assert kept.count("I") == audit.count("I") and len(kept) == len(audit) - symbols.count("x")
        cuts = sorted(rng.choices(range(len(symbols) + 1), k=3))
        pieces = []
        for lo, hi in itertools.pairwise([0, *cuts, len(symbols)]):
            entries = [e for line in grammar.matrix(symbols[lo:hi]) for e in line]
            audits = [repair.flat(e[1]) if e else None for e in entries]
            pieces.append({"costs": [e and e[0] for e in entries], "audits": audits, "first": "u", "last": "a", "illegal": 0,
                           "edits": [a if a is None else repair.edits(symbols[lo:hi], a) for a in audits]})
        made = repair.join_pieces(pieces)
        assert min((made["costs"][s] + repair.CLOSE[s][0][0], made["audits"][s] + repair.CLOSE[s][0][1][2]) for s in range(4) if made["costs"][s] is not None) == (cost, audit)


def test_ropes_compare_like_strings():
    rng = random.Random(6)

    def rope(text):
        if len(text) < 2 or rng.random() < 0.2:
            return repair.leaf(text)
        k = rng.randint(1, len(text) - 1)
        return repair.concat(rope(text[:k]), rope(text[k:]))

    for _ in range(500):
        a, b = ("".join(rng.choices("DK", k=rng.randint(0, 9))) for _ in range(2))
        assert repair.before(rope(a), rope(b)) == (a < b) and repair.flat(rope(a)) == a


def talk(seed, conversations, turns):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), "system" if turn == 0 and rng.random() < 0.3 else role,
                         rng.choice(["Yes.", "No!", "half a", " ", "Why?\n", "so ", f"text {rng.randint(0, 99)}."])))
    return rows


def test_equals_brute_force(spark):
    rows = talk(1, 150, 9)
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("chunk", [4, 1024])
def test_conversations_cut_by_ranges_and_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "FAN", 3)
    rows = talk(2, 3, 200) + [(0, k, ("user", "assistant")[k % 2], f"more {k}.") for k in range(300, 500)] + [(9, 1, "user", "Same.")] * 40
    joined = []
    monkeypatch.setattr(repair, "_joined", lambda pieces, level, fan, made=repair._joined: joined.append(level) or made(pieces, level, fan))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # eight ranges
    try:
        assert result(spark, rows, 8) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert "part" in joined and ("seq" in joined) == (chunk == 4)


def test_defined_cases(spark):
    long = "word " * 200_000
    rows = [(None, 1, "user", "A."), (None, None, "assistant", "B."), (1, None, None, None), (1, 2, "", "x."), (1, 3, "tool", "y."), (1, 3, "tool", "y."),
            (2, 5, "user", long), (2, 9, "assistant", long + "."), (3, None, "user", "Q?"), (3, None, "user", "Q?"), (3, 4, "user", "Q?"),
            (4, 1, "system", "S."), (5, 1, "assistant", "late."), (6, 7, "user", "\t\n"), (7, -3, "user", "Hm."), (7, 2, "assistant", "Hm.")]
    dropped = next(k for k in range(100, 999) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows.append((dropped, 1, "user", "gone."))
    got = result(spark, rows)
    assert got == brute(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert result(spark, []) == []
