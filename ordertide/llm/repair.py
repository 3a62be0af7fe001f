"""Conversation repair by a dynamic programme over a Re-Pair grammar.

Every row of a conversation becomes one symbol: its role's initial class, whether it is truncated, or that it must go. Edits
move between four states (nothing yet, system, user, assistant came last), so a symbol is a 4 x 4 min-plus matrix whose
entries are a cost and the least audit text at that cost. Two audits of equal cost between the same states never are prefixes
of each other (the rows fix all letters but the inserts, and inserts that return to a state only cost), so the least audit of
a product comes from the least audits of its factors, and matrices may be multiplied in any order.

Rows are dealt by ranges of (conversation, turn, role, hash of text), so one huge conversation spreads over many tasks; each
task cuts its stretch into chunks of symbols. Re-Pair runs over the distinct chunks of all conversations: in each round the
executors count neighbouring symbols, the commonest pairs that don't compete become rules, and each rule's matrix, its audits
held as ropes over its two parts, is made once from theirs and shared by all conversations. The number of rules bounds what
is broadcast; symbols that no rule covers count by themselves, so it changes the work, not the result. Conversations cut by a
range are put together by multiplying the matrices of their chunks, a bounded number at a time.

Texts travel once, to the task that writes the repaired text's SHA-256 row by row, which has to follow one conversation in
order but holds one row at a time.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.text import settle, table

#: Symbols of a chunk; chunks that one task multiplies; rules of the grammar, and rounds and candidates of its making.
CHUNK, FAN, RULES, ROUNDS, CANDIDATES = 1024, 256, 256, 12, 64
#: Conversations whose solution a task remembers by their symbols.
REMEMBERED = 1 << 16

# Fixed values of the specification.
DAMAGES = 20
DROP, EMPTY, UNSTOP, REPEAT, SET_USER = range(5)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE, STOPS = r"\x20\x09-\x0D", ".!?"

#: States by what came last, the state after the next user or assistant row, and those that may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
MUST_GO = "x"
FIRST_RULE = 0xE000  # rules are characters of the private area

Rope = tuple  # (length, fingerprint, text or None, left, right)
Entry = tuple  # (cost, rope)
_MODULUS, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6


def leaf(text: str) -> Rope:
    fingerprint = 0
    for c in text:
        fingerprint = (fingerprint * _BASE + ord(c)) % _MODULUS
    return len(text), fingerprint, text, None, None


def concat(a: Rope, b: Rope) -> Rope:
    if not a[0] or not b[0]:
        return a if a[0] else b
    return a[0] + b[0], (a[1] * pow(_BASE, b[0], _MODULUS) + b[1]) % _MODULUS, None, a, b


def flat(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        length, _, text, left, right = todo.pop()
        if text is not None:
            out.append(text)
        elif length:
            todo += [right, left]
    return "".join(out)


def before(a: Rope, b: Rope) -> bool:
    """Whether a's text is less than b's; equal parts are skipped by their fingerprints."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p[:2] == q[:2]:
            continue
        if p[2] is None and (p[0] >= q[0] or q[2] is not None):
            x += [p[4], p[3]]
            y.append(q)
        elif q[2] is None:
            y += [q[4], q[3]]
            x.append(p)
        else:
            n = min(p[0], q[0])
            if p[2][:n] != q[2][:n]:
                return p[2][:n] < q[2][:n]
            x += [leaf(p[2][n:])] if p[0] > n else []
            y += [leaf(q[2][n:])] if q[0] > n else []
    return bool(y) and not x


def least(a: Entry | None, b: Entry | None) -> Entry | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def product(rows: list[list[Entry | None]], by: list[list[Entry | None]]) -> list[list[Entry | None]]:
    """Min-plus product; audits are joined, and the least of equal cost stays."""
    out = []
    for row in rows:
        made: list[Entry | None] = [None] * len(by[0])
        for middle, a in enumerate(row):
            for to, b in enumerate(by[middle]) if a else ():
                if b and (made[to] is None or a[0] + b[0] <= made[to][0]):
                    made[to] = least(made[to], (a[0] + b[0], concat(a[1], b[1])))
        out.append(made)
    return out


def symbol_matrix(symbol: str) -> list[list[Entry | None]]:
    """The edits of one row, each after as many inserts as it may need."""
    out: list[list[Entry | None]] = [[None] * 4 for _ in range(4)]
    late = TRUNCATED if symbol.isupper() else 0
    for start in range(4):
        state, cost, inserts = start, 0, ""
        for _ in range(3):
            steps = [(state, DELETE, "D")]
            if symbol != MUST_GO:
                steps.append((NEXT[state], REROLE + late, "R"))
                kept = {"s": SYSTEM if state == NOTHING else None, "u": USER if NEXT[state] == USER else None,
                        "a": ASSISTANT if NEXT[state] == ASSISTANT else None}.get(symbol.lower())
                steps += [(kept, late, "K")] if kept is not None else []
            for to, price, letter in steps:
                out[start][to] = least(out[start][to], (cost + price, leaf(inserts + letter)))
            state, cost, inserts = NEXT[state], cost + INSERT, inserts + "I"
    return out


#: Inserts after the last row, into an accepted end.
CLOSE = [[(0, leaf(""))], [(2 * INSERT, leaf("II"))], [(INSERT, leaf("I"))], [(0, leaf(""))]]


class Grammar:
    """Re-Pair rules in the order in which they were made, and the matrix of each symbol and rule."""

    def __init__(self):
        self.rules: list[str] = []
        self.matrices = {c: symbol_matrix(c) for c in "suaoSUAO" + MUST_GO}

    def add(self, pair: str) -> None:
        self.matrices[chr(FIRST_RULE + len(self.rules))] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        self.rules.append(pair)

    def encode(self, symbols: str) -> str:
        for k, pair in enumerate(self.rules):
            symbols = symbols.replace(pair, chr(FIRST_RULE + k))
        return symbols

    def matrix(self, symbols: str, starts: tuple[int, ...] = (NOTHING, SYSTEM, USER, ASSISTANT)) -> list[list[Entry | None]]:
        """The matrix of a sequence, or its rows for some states before it."""
        rows: list[list[Entry | None]] = [[(0, leaf("")) if k == s else None for k in range(4)] for s in starts]
        for c in self.encode(symbols):
            rows = product(rows, self.matrices[c])
        return rows

    def solve(self, symbols: str) -> tuple[int, str, str]:
        """Cost, audit and edits of a whole conversation."""
        cost, audit = product(self.matrix(symbols, (NOTHING,)), CLOSE)[0][0]
        return cost, flat(audit), edits(symbols, flat(audit))


def edits(symbols: str, audit: str) -> str:
    """The audit without the letters of rows that must go."""
    letters = np.frombuffer(audit.encode(), np.uint8)
    stay = letters == ord("I")
    stay[~stay] = np.frombuffer(symbols.encode(), np.uint8) != ord(MUST_GO)
    return letters[stay].tobytes().decode()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, copies (0: dropped), hash of the text, blank and truncated."""
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("damage", F.crc32(key.cast("binary")) % DAMAGES)
    rows = rows.withColumn("role", F.when(F.col("damage") == SET_USER, "user").otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(F.col("damage") == EMPTY, "").when(F.col("damage") == UNSTOP, F.translate("text", STOPS, "")).otherwise(F.col("text")))
    copies = F.when(F.col("damage") == DROP, 0).when(F.col("damage") == REPEAT, 2).otherwise(1)
    return rows.select("conv_id", "turn", "role", "text", copies.cast("long").alias("copies"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"),
                       (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[{STOPS}][{SPACE}]*\z")).alias("unended"))


def _seen_first(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` plus fresh: no earlier turn of the conversation has the role and text. ``repeated``: those of several turns."""
    other = repeated.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("hash").alias("_hash"), "early", "unnumbered")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("hash") == F.col("_hash"))
    first = F.when(F.col("unnumbered"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("early"))
    return rows.join(other, same, "left").withColumn("fresh", ~F.col("blank") & F.coalesce(first, F.lit(True))).drop(*other.columns)


def _chunks(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of symbols of a stretch of rows in order: columns conv_id, symbol, initial, n (rows; all but the first must go).

    A chunk is marked whole if its conversation surely lies inside the stretch and has no other chunk.
    """
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    conv, symbols, initials, seq, opening = None, "", "", 0, True
    started = False

    def cut(whole: bool) -> None:
        nonlocal symbols, initials, seq
        if symbols:
            legal = sum(initials.count(p) for p in ("su", "ua", "au"))
            out.append((conv, part, seq, symbols, initials[0], initials[-1], len(initials) - 1 - legal, whole))
        symbols, initials, seq = "", "", seq + 1

    def emptied() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist([dict(zip(CHUNKS.names, r, strict=True)) for r in out], CHUNKS)
        out.clear()
        return made

    for batch in batches:
        ids, heads, classes = (batch.column(k).to_pylist() for k in range(3))
        for k, n in enumerate(batch.column(3).to_pylist()):
            if started and ids[k] != conv:
                cut(seq == 0 and not opening)
                seq, opening = 0, False
            conv, started = ids[k], True
            symbols += heads[k] + MUST_GO * (n - 1)
            initials += classes[k] * n
            while len(symbols) > size:
                rest, symbols, later, initials = symbols[size:], symbols[:size], initials[size:], initials[:size]
                cut(False)
                symbols, initials = rest, later
        yield emptied()
    cut(False)
    yield emptied()


CHUNKS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("symbols", pa.string()), ("first", pa.string()),
                    ("last", pa.string()), ("illegal", pa.int64()), ("whole", pa.bool_())])
_CHUNK_COLUMNS = "conv_id long, part long, seq long, symbols string, first string, last string, illegal long, whole boolean"


def _count_pairs(grammar: Grammar, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            coded = grammar.encode(symbols)
            for pair in zip(coded, coded[1:]):
                counts[pair] += n
    yield pa.RecordBatch.from_arrays([pa.array([a + b for a, b in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["pair", "n"])


def compress(chunks: DataFrame) -> Grammar:
    """Re-Pair over all chunks, with rules for several pairs a round: pairs of which none ends as another begins."""
    sequences = settle(chunks.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "sequences")
    grammar = Grammar()
    for _ in range(ROUNDS):
        counted = sequences.mapInArrow(functools.partial(_count_pairs, grammar), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        common = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(CANDIDATES).collect()
        starts, ends = set(), set()
        for a, b in (row["pair"] for row in common):
            if a in ends or b in starts or a == b and (a in starts or b in ends) or len(grammar.rules) == RULES:
                continue
            starts.add(a)
            ends.add(b)
            grammar.add(a + b)
        if not starts:
            break
    return grammar


def _solve(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solutions of whole conversations: columns conv_id, symbols, illegal."""
    solve = functools.lru_cache(REMEMBERED)(held.value.solve)
    for batch in batches:
        found = [solve(s) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(
            (pa.int64(), pa.string(), pa.string())))], names=["conv_id", "illegal", "cost", "audit", "edits"])


PIECES = pa.schema([*(CHUNKS.field(f) for f in ("conv_id", "part", "seq", "first", "last", "illegal")),
                    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("edits", pa.list_(pa.string()))])
_PIECE_COLUMNS = "conv_id long, part long, seq long, first string, last string, illegal long, costs array<long>, audits array<string>, edits array<string>"


def _measure(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole matrix of each chunk of a cut conversation, state by state: cost (null: no way), audit, edits."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            entries = [e for line in held.value.matrix(row["symbols"]) for e in line]
            audits = [flat(e[1]) if e else None for e in entries]
            rows.append({f: row[f] for f in PIECES.names[:6]} | {"costs": [e and e[0] for e in entries], "audits": audits,
                                                                 "edits": [a if a is None else edits(row["symbols"], a) for a in audits]})
        yield pa.RecordBatch.from_pylist(rows, PIECES)


def join_pieces(pieces: list[dict]) -> dict:
    """Neighbouring pieces of a conversation as one."""
    made = dict(pieces[0])
    for piece in pieces[1:]:
        costs: list[int | None] = [None] * 16
        audits, kept = [None] * 16, [None] * 16
        for a in range(4):
            for to in range(4):
                ways = [(made["costs"][4 * a + m] + piece["costs"][4 * m + to], made["audits"][4 * a + m] + piece["audits"][4 * m + to], m)
                        for m in range(4) if made["costs"][4 * a + m] is not None and piece["costs"][4 * m + to] is not None]
                if ways:
                    costs[4 * a + to], audits[4 * a + to], m = min(ways)
                    kept[4 * a + to] = made["edits"][4 * a + m] + piece["edits"][4 * m + to]
        border = made["last"] + piece["first"] not in ("su", "ua", "au")
        made |= {"costs": costs, "audits": audits, "edits": kept, "last": piece["last"], "illegal": made["illegal"] + piece["illegal"] + border}
    return made


def _joined(pieces: DataFrame, level: str, fan: int) -> DataFrame:
    """Pieces with up to ``fan`` neighbours in the order of ``level`` (seq inside a part, or part) put together."""

    def join(group):  # without type hints, which Spark can't resolve for nested functions
        row = join_pieces(sorted(group.select(PIECES.names).to_pylist(), key=lambda r: r[level]))
        row[level] //= fan
        return pa.Table.from_pylist([row], PIECES)

    keys = ["conv_id", "part"] if level == "seq" else ["conv_id"]
    return settle(pieces.withColumn("up", F.floor(F.col(level) / fan)).groupBy(*keys, "up").applyInArrow(join, _PIECE_COLUMNS), "pieces")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            ways = [(row["costs"][s] + CLOSE[s][0][0], row["audits"][s] + CLOSE[s][0][1][2], row["edits"][s] + CLOSE[s][0][1][2])
                    for s in range(4) if row["costs"][s] is not None]
            cost, audit, kept = min(ways)
            rows.append((row["conv_id"], row["illegal"], cost, audit, kept))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k > 2 else pa.int64()) for k in range(5)],
                                         names=["conv_id", "illegal", "cost", "audit", "edits"])


_SOLUTION = "conv_id long, illegal long, cost long, audit string, edits string"


def solutions(ordered: DataFrame) -> DataFrame:
    """Cost, audit, edits and illegal neighbours of each conversation; ``ordered``: conv_id, turn, role, hash, symbol, initial, n."""
    runs = ordered.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    runs = runs.withColumn("n", F.least(F.lit(CHUNK).cast("long"), F.col("n") - F.col("piece") * CHUNK))
    runs = runs.withColumn("symbol", F.when(F.col("piece") == 0, F.col("symbol")).otherwise(MUST_GO))
    order = ["conv_id", "turn", "role", "hash", "piece"]
    dealt = runs.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "symbol", "initial", "n")
    chunks = settle(dealt.mapInArrow(functools.partial(_chunks, CHUNK), _CHUNK_COLUMNS), "chunks")
    held = ordered.sparkSession.sparkContext.broadcast(compress(chunks))
    whole = chunks.where("whole").select("conv_id", "symbols", "illegal").mapInArrow(functools.partial(_solve, held), _SOLUTION)
    pieces = settle(chunks.where("not whole").mapInArrow(functools.partial(_measure, held), _PIECE_COLUMNS), "pieces")
    far = pieces.agg(F.max("seq"), F.max("part")).first()
    for level, highest in (("seq", far[0] or 0), ("part", far[1] or 0)):
        while highest:
            pieces, highest = _joined(pieces, level, FAN), highest // FAN
    return settle(whole.unionByName(pieces.mapInArrow(_close, _SOLUTION)), "solutions")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation from its solution (solved) followed by its rows in order."""
    solution, done, sha, lines, state, at, last = None, [], None, 0, NOTHING, 0, None

    def say(role: str, text: str) -> None:
        nonlocal lines, state
        sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
        lines, state = lines + 1, {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)

    def inserts() -> None:
        nonlocal at
        while solution["edits"][at:at + 1] == "I":
            say(("user", "assistant")[NEXT[state] == ASSISTANT], "")
            at += 1

    def finish() -> None:
        if solution:
            inserts()
            done.append({f: solution[f] for f in ("conv_id", "illegal", "cost", "audit")} | {"repaired_sha256": sha.hexdigest()})

    for batch in batches:
        for row in batch.to_pylist():
            if row["solved"]:
                finish()
                solution, sha, lines, state, at, last = row, hashlib.sha256(), 0, NOTHING, 0, None
            elif last != (row["turn"], row["role"], row["hash"]):  # a copy goes with the rows that must go
                last = row["turn"], row["role"], row["hash"]
                inserts()
                edit, at = solution["edits"][at], at + 1
                if edit != "D":
                    say(row["role"] if edit == "K" else ("user", "assistant")[NEXT[state] == ASSISTANT], row["text"])
        yield pa.RecordBatch.from_pylist(done, _DIGESTS)
        done.clear()
    finish()
    yield pa.RecordBatch.from_pylist(done, _DIGESTS)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` (conv_id, turn, role, text) with the faults and the cheapest repair after damage.

    Null ids are one conversation; null turns come first and count in no gap; a null role or text is one space, so such a
    role is kept by no edit and such a text is blank. Rows of one turn are ordered by role, then by the MD5 of their text; equal
    rows are copies, of which all but the first are duplicates. An empty role is like an unknown one. A conversation
    without a row after damage has zeros, an empty audit and the hash of the empty text. An empty table gives no rows;
    further columns are ignored.
    """
    rows = damaged(conversations)
    turns = settle(rows.groupBy("conv_id", "turn", "role", "hash", "blank", "unended").agg(F.sum("copies").alias("n")), "turns")
    repeated = (turns.where("n > 0 and not blank").groupBy("conv_id", "role", "hash")
                .agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("early"), F.max(F.col("turn").isNull()).alias("unnumbered")).where("turns > 1"))
    repeated = settle(repeated, "repeated")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(~F.col("fresh"), MUST_GO).when(F.col("unended"), F.upper("initial")).otherwise(F.col("initial"))
    marked = settle(_seen_first(turns.withColumn("initial", initial), repeated).withColumn("symbol", symbol), "marked")
    there, fresh = F.col("n") > 0, F.col("fresh") & (F.col("n") > 0)
    counted = marked.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(there, F.col("turn"))) - F.min(F.when(there, F.col("turn"))) + 1 - F.count_distinct(F.when(there, F.col("turn"))), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - fresh.cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((fresh & F.col("unended")).cast("long")).alias("truncated"))
    solved = solutions(marked.where(there).select("conv_id", "turn", "role", "hash", "symbol", "initial", "n"))
    texts = _seen_first(rows.where("copies > 0 and not blank"), repeated).where("fresh").select("conv_id", "turn", "role", "hash", "text")
    none = F.lit(None)
    joined = (solved.withColumn("solved", F.lit(True)).withColumns({"turn": none.cast("long"), "role": none.cast("string"), "hash": none.cast("binary"),
                                                                     "text": none.cast("string")})
              .unionByName(texts.withColumn("solved", F.lit(False)).withColumns({f: none.cast(kind) for kind, f in (
                  ("long", "illegal"), ("long", "cost"), ("string", "audit"), ("string", "edits"))})))
    dealt = joined.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("solved"), "turn", "role", "hash")
    digests = dealt.mapInArrow(_digest, "_conv long, illegal long, cost long, audit string, repaired_sha256 string")
    found = counted.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero, empty = F.lit(0).cast("long"), F.lit("")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", zero).alias("illegal"), F.coalesce("cost", zero).alias("cost"),
                        F.coalesce("audit", empty).alias("audit"), F.coalesce("repaired_sha256", F.sha2(empty.cast("binary"), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
