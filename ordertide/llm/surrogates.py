"""Personal data replaced by surrogates of the same type and format.

Detected entities: e-mail addresses, IPv4 addresses, card and account numbers, phone and social security numbers, IBANs,
secrets (keys and tokens; not one letter over and over), and names that follow a title. A surrogate is a keyed permutation
of the strings of the same format: digits stay digits, letters stay letters of their script and case, all other characters
stay in place. Because it is a permutation, different entities never share a surrogate and the same entity has the same one
in every document, with no table of entities at all. Further rules per type: cards keep whether their Luhn check holds,
IPv4 octets stay valid, a phone keeps its country code, an e-mail keeps its top-level domain, and spelling variants of one
entity (case of an e-mail, separators of a number) keep their variant around the same surrogate.

A first name of the lists below becomes another one of its list, so of the same gender and script; any other is permuted
letter by letter, passing over the listed names. A last name is permuted in a way that depends on the first name. So the
pair, whatever its script, is permuted as a whole, and different names have different surrogates with nothing to check.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.llm.text import Words, blocks, table

KEY = "surrogate-key-1"
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ",
             "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
             "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
HEX = {case: {ch: (case, k) for k, ch in enumerate(case)} for case in ("0123456789abcdef", "0123456789ABCDEF")}
NAMES = {("m", "latin"): "James Robert David Peter Martin Paul Thomas Lukas Jonas Felix Pierre Louis Hugo Carlos Miguel Javier".split(),
         ("f", "latin"): "Mary Anna Laura Julia Emma Clara Sophie Claire Marie Elena Lucia Carmen Sofia Nina Helen Alice".split(),
         ("m", "cyrillic"): "Иван Пётр Сергей Алексей Николай Дмитрий Андрей Михаил".split(),
         ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана".split()}
TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин",
          "Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "Doña", "Госпожа"]

PATTERN = re.compile(r"""
    (?P<email>[^\W_][\w.+%\-]*@(?:[^\W_](?:[\w\-]*[^\W_])?\.)+[^\W\d_]{2,})
  | (?P<secret>(?<![0-9A-Za-z])(?:(?!(?P<same>[A-Fa-f])(?P=same)*(?![0-9A-Za-z]))(?:[0-9a-f]{32,}|[0-9A-F]{32,})|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|sk-[0-9A-Za-z]{20,})(?![0-9A-Za-z])
     |(?i:(?<=token\ =\ ")|(?<=token=)|(?<=password=)|(?<=secret=)|(?<=api_key=))[0-9A-Za-z_\-+/]{8,})
  | (?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:\ ?[0-9A-Z]{4}){2,7}(?:\ ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))
  | (?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d))
  | (?P<phone>(?<![\w+])\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,5}(?!\d)|(?<![\w+])\(\d{3}\)\ ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-]))
  | (?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))
  | (?P<card>(?<![\w\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\w\-]))
  | (?P<name>(?<!\w)(?P<title>Mrs?|Ms|Miss|Herr|Frau|Monsieur|Madame|Señora?|Sra?|Don|Doña|Господин|Госпожа)\.?\ (?P<first>[^\W\d_]\w+)\ (?P<last>[^\W\d_]\w+(?:-[^\W\d_]\w+)?))
""", re.X)
TYPES = ("email", "secret", "iban", "ip", "phone", "ssn", "card", "name")


def _noise(key: str, tweak: str, turn: int, part, n: int) -> bytes:
    seed = f"{key}|{tweak}|{turn}|{part}".encode("utf-8", "surrogatepass")
    return hashlib.shake_256(seed).digest(2 * n)


def permute(values: list[int], radix: list[int], key: str, tweak: str, rounds: int = 6) -> list[int]:
    """Keyed permutation of sequences with the given radix at each place: halves are shifted by a hash of each other."""
    if not values:
        return values
    if len(values) == 1:
        noise = _noise(key, tweak, 0, radix, 1)
        return [(values[0] + int.from_bytes(noise, "big")) % radix[0]]
    half = len(values) // 2
    out = list(values)
    for turn in range(rounds):
        lo, hi = (0, half) if turn % 2 == 0 else (half, len(out))
        other = out[half:] if turn % 2 == 0 else out[:half]
        noise = _noise(key, tweak, turn, other, hi - lo)
        for k in range(lo, hi):
            out[k] = (out[k] + int.from_bytes(noise[2 * (k - lo):2 * (k - lo) + 2], "big")) % radix[k]
    return out


@functools.lru_cache(maxsize=1)
def _more_alphabets() -> dict[str, tuple[str, int]]:
    """Alphabet and place of all further letters and digits: those of one script, kind (case) and range of code points."""
    groups: dict[tuple, list[str]] = {}
    known = set("".join(ALPHABETS))
    for point in range(128, 0x110000):
        ch = chr(point)
        if not ch.isalnum() or ch in known:
            continue
        script, kind = unicodedata.name(ch, "?").split(" ")[0], unicodedata.category(ch)
        paired = kind in ("Ll", "Lu") and ch.lower().upper() == ch.upper() and ch.upper().lower() == ch.lower() and ch in (ch.lower(), ch.upper())
        wide = script == "CJK" and 0x4E00 <= point <= 0x9FFF or script == "HANGUL" and 0xAC00 <= point <= 0xD7A3
        groups.setdefault((script, kind, paired, "wide" if wide else point >> 8), []).append(ch)
    for small in [g for g, members in groups.items() if len(members) < 8]:  # rare letters share the alphabet of their kind
        groups.setdefault(("", *small[1:3], ""), []).extend(groups.pop(small))
    return {ch: (alphabet, k) for alphabet in map("".join, groups.values()) for k, ch in enumerate(alphabet)}


class Places(dict):
    """(alphabet, place) of every letter and digit; those outside ``ALPHABETS`` are looked up when first met."""

    def __contains__(self, ch) -> bool:
        return super().__contains__(ch) or ch > "\x7f" and ch.isalnum()

    def __missing__(self, ch):
        self[ch] = _more_alphabets()[ch]
        return self[ch]


PLACE = Places({ch: (alphabet, k) for alphabet in ALPHABETS for k, ch in enumerate(alphabet)})


def same_format(text: str, key: str, tweak: str, places: dict = PLACE) -> str:
    """A permutation of the texts of one format; never the text itself where the format has over one text."""
    at = [k for k, ch in enumerate(text) if ch in places]
    if not at:
        return text
    alphabets = [places[text[k]][0] for k in at]
    values, radix = [places[text[k]][1] for k in at], [len(a) for a in alphabets]
    shape = f"{tweak}|{''.join(str(len(a)) + a[0] for a in alphabets)}|{''.join(ch for ch in text if ch not in places)}"
    new = permute(values, radix, key, shape)
    out = list(text)
    for k, v, alphabet in zip(at, new, alphabets, strict=True):
        out[k] = alphabet[v]
    return "".join(out)


LISTED = {name: names for names in NAMES.values() for name in names}


def other_first_name(first: str, key: str) -> str:
    """A permutation of all first names that keeps the lists of names to themselves."""
    names = LISTED.get(first)
    if names:
        shift = 1 + int.from_bytes(_noise(key, "first", 0, names, 1), "big") % (len(names) - 1)
        return names[(names.index(first) + shift) % len(names)]
    new = same_format(first, key, "first")
    while new in LISTED:  # ends: the permutation leads back to ``first``, which is not listed
        new = same_format(new, key, "first")
    return new


def luhn(digits: list[int]) -> int:
    """Check digit of the digits before it."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = d * 2 if k % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def _digits_into(layout: str, digits: list[int]) -> str:
    new = iter(digits)
    return "".join(str(next(new)) if ch.isdigit() else ch for ch in layout)


def _recase(like: str, text: str) -> str:
    return "".join(b.upper() if a.isupper() else b for a, b in zip(like, text, strict=True)) if len(like) == len(text) else text


def surrogate(kind: str, text: str, key: str = KEY) -> str:
    if kind == "email":
        low = text.lower()
        local, _, domain = low.partition("@")
        body, _, top = domain.rpartition(".")
        new = f"{same_format(local, key, 'email|' + domain)}@{same_format(body, key, 'domain|' + top)}.{top}"
        return _recase(text, new)
    if kind == "ip":
        number = [int(x) for x in text.split(".")]
        return ".".join(map(str, permute(number, [256] * 4, key, "ip")))
    if kind == "card":
        digits = [int(ch) for ch in text if ch.isdecimal()]
        offset = (digits[-1] - luhn(digits[:-1])) % 10
        new = permute(digits[:-1], [10] * (len(digits) - 1), key, f"card|{len(digits)}|{offset}")
        return _digits_into(text, [*new, (luhn(new) + offset) % 10])
    if kind in ("phone", "ssn"):
        code = re.match(r"\+\d{1,3}(?=[ .\-(])", text)
        head = code.group() if code else ""
        digits = [int(ch) for ch in text[len(head):] if ch.isdecimal()]
        return head + _digits_into(text[len(head):], permute(digits, [10] * len(digits), key, f"{kind}|{head}|{len(digits)}"))
    if kind == "iban":
        plain = text.replace(" ", "")
        new = iter(plain[:2] + same_format(plain[2:], key, "iban|" + plain[:2]))
        return "".join(ch if ch == " " else next(new) for ch in text)
    if kind == "secret":
        for case in HEX:
            if all(ch in case for ch in text):
                return same_format(text, key, "secret", HEX[case])
        return same_format(text, key, "secret")
    match = PATTERN.fullmatch(text)
    first, last = match["first"], match["last"]
    return f"{text[:match.start('first')]}{other_first_name(first, key)} {same_format(last, key, f'last|{first}')}"


def entities(text: str, start: int = 0) -> Iterator[tuple[str, str, int, int]]:
    for m in PATTERN.finditer(text, start):
        kind = next(k for k in TYPES if m[k] is not None)
        yield kind, m.group(), m.start(), m.end()


def replace(text: str, key: str = KEY, start: int = 0) -> tuple[str, dict[str, int]]:
    """The text from ``start`` on with surrogates, and the number of entities of each type."""
    out, at, found = [], start, {}
    for kind, old, begin, end in entities(text, start):
        out += [text[at:begin], surrogate(kind, old, key)]
        at, found[kind] = end, found.get(kind, 0) + 1
    return "".join([*out, text[at:]]), found


_MARKS = np.array([48 <= b <= 57 or b in b"@=" for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_ALNUM = _MARKS & (np.arange(256) < 58) | np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_TITLES = [np.frombuffer(t.encode(), np.uint8) for t in TITLES]
_ENDS = np.zeros(1 << 16, bool)
_ENDS[[int(t[-2]) << 8 | int(t[-1]) for t in _TITLES]] = True
CONTEXT = 16  # bytes before a stretch that its patterns may look back to
LONG_SECRET, IBAN_GROUPS = 20, 8  # letters of the shortest secret without a keyword; most words behind the first of an IBAN


@functools.lru_cache(maxsize=1)
def _decimal() -> np.ndarray:
    return np.array([chr(c).isdecimal() for c in range(0x110000)])


def foreign_digits(data: np.ndarray) -> np.ndarray:
    """Places of the first bytes of decimal digits beyond ASCII."""
    found = []
    for size, low, high in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
        at = np.flatnonzero((data >= low) & (data <= high))
        at = at[at + size <= len(data)]
        point = data[at].astype(np.int64) & (0xFF >> (size + 1))
        for k in range(1, size):
            point = point << 6 | data[at + k] & 0x3F
        found.append(at[_decimal()[np.minimum(point, 0x10FFFF)]])
    return np.concatenate(found)


def _ends_in_title(data: np.ndarray, words: Words) -> np.ndarray:
    """Flags of the words that end in a title, with or without a dot, whatever precedes it."""
    end = words.end - (data[words.end - 1] == 46)
    size = end - words.start
    own = np.flatnonzero(size >= 2)
    own = own[_ENDS[data[end[own] - 2].astype(np.int64) << 8 | data[end[own] - 1]]]
    out = np.zeros(len(end), bool)
    for title in _TITLES:
        at = own[size[own] >= len(title)]
        for k in range(len(title)):
            at = at[data[end[at] - len(title) + k] == title[k]]
        out[at] = True
    return out


def stretches(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first byte, last byte) of the runs of words that can hold an entity, a superset of what ``PATTERN`` matches:
    words that end in a title with the two words behind them; words with a decimal digit of any script, an at sign or an
    equals sign, quoted words behind one; long runs of letters and digits; and the words behind the first of an IBAN."""
    words = Words(data, offsets)
    if not len(words.start):
        return []
    titles = _ends_in_title(data, words)
    flag = titles.copy()
    flag[1:] |= titles[:-1]
    flag[2:] |= titles[:-2]
    mark = _MARKS[data]
    marks = np.concatenate([[0], np.cumsum(mark, dtype=np.int32)])
    flag |= marks[words.end] > marks[words.start]
    foreign = foreign_digits(data)
    alone = (words.end - words.start == 1) & (data[words.start] == 61)
    flag[1:] |= alone[:-1] & (data[words.start[1:]] == 34)
    inside = np.concatenate([[0], np.cumsum(_ALNUM[data], dtype=np.int32)])
    runs = np.flatnonzero(inside[LONG_SECRET:] - inside[:-LONG_SECRET] == LONG_SECRET)
    flag[np.searchsorted(words.start, np.concatenate([foreign, runs]), "right") - 1] = True
    upper, mark[foreign] = _UPPER[data], True
    head = np.zeros(len(flag), bool)
    head[np.searchsorted(words.start, np.flatnonzero(upper[:-2] & upper[1:-1] & mark[2:]), "right") - 1] = True
    for k in range(1, IBAN_GROUPS + 1):
        flag[k:] |= head[:-k]
    at = np.flatnonzero(flag)
    if not len(at):
        return []
    text = np.searchsorted(words.first, at, "right") - 1
    joined = np.zeros(len(at), bool)
    joined[1:] = (at[1:] == at[:-1] + 1) & (text[1:] == text[:-1]) & (words.start[at[1:]] == words.end[at[:-1]] + 1)
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], len(at)) - 1
    return list(zip(text[first].tolist(), words.start[at[first]].tolist(), words.end[at[last]].tolist(), strict=True))


def _with_context(data: np.ndarray, begin: int, low: int, high: int) -> tuple[str, int]:
    """The stretch low..high with some text before it, and where the stretch starts in it."""
    before = data[max(begin, low - CONTEXT):low].tobytes().decode("utf-8", "ignore")
    return before + data[low:high].tobytes().decode("utf-8", "surrogatepass"), len(before)


def replace_block(data: np.ndarray, offsets: np.ndarray, key: str) -> dict[int, tuple[str, dict[str, int]]]:
    """New text and entity counts of the texts of a block that hold an entity."""
    pieces: dict[int, list] = {}
    for row, low, high in stretches(data, offsets):
        text, start = _with_context(data, offsets[row], low, high)
        new, found = replace(text, key, start)
        if found:
            pieces.setdefault(row, []).append((low, high, new, found))
    out = {}
    for row, changed in pieces.items():
        at, parts, total = offsets[row], [], {}
        for low, high, new, found in changed:
            parts += [data[at:low].tobytes().decode("utf-8", "surrogatepass"), new]
            at = high
            total = {k: total.get(k, 0) + found.get(k, 0) for k in {**total, **found}}
        parts.append(data[at:offsets[row + 1]].tobytes().decode("utf-8", "surrogatepass"))
        out[row] = "".join(parts), total
    return out


def _apply(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index("text")
        for lo, hi, data, offsets in blocks(batch, "text"):
            part = batch.slice(lo, hi - lo)
            changed = replace_block(data, offsets, key)
            texts = part.column(k)
            if changed:
                values = texts.to_pylist()
                for row, (new, _) in changed.items():
                    values[row] = new
                texts = pa.array(values, pa.string())
            counts = [list(changed[row][1].items()) if row in changed else [] for row in range(hi - lo)]
            columns = [texts if j == k else c for j, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.map_(pa.string(), pa.int32()))], names=[*batch.schema.names, "_entities"])


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text`` and _entities, the number of entities per type.

    A null text stays null; a text without entities stays as it is, and so do all other columns (one named _entities is
    replaced). Repeated rows get equal results. One map over the documents, without a shuffle.
    """
    clean = docs.drop("_entities")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in clean.schema]).add("_entities", T.MapType(T.StringType(), T.IntegerType()))
    return clean.mapInArrow(functools.partial(_apply, key), schema)


def op5_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = replace_entities(docs)
    counts = [F.coalesce(F.col("_entities")[kind], F.lit(0)).alias(f"n_{kind}") for kind in TYPES]
    return out.select("doc_id", "text", F.aggregate(F.map_values("_entities"), F.lit(0), lambda a, x: a + x).alias("n_entities"), *counts)
