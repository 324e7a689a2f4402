"""Surrogates for personal data.

Entities are found by pattern: e-mail addresses, telephone numbers, IPv4 addresses, card
numbers, secrets (tokens, keys, passwords) and names (a given name of the lists below, or a title, before a capitalised word).
Each is replaced by another of its kind. A surrogate is the image of the
entity under a permutation, made from the caller's secret key, of all strings of the entity's format:
equal entities get equal surrogates in all texts (coreference), and different ones different
surrogates, without any table of what has been given out. The permutation is a Feistel
network turned into a single cycle, so that nothing is its own surrogate, and it is walked on
until the result keeps what the kind demands: check digit of a card, the range of an address (private,
loopback, multicast and so on), and for names no string that is on the lists. Given names move along a keyed
cycle of the names of the same gender and script; family names keep script, letter case,
the places of vowels, accents, hyphens and apostrophes. Letters of no alphabet below change with those beside them in Unicode of the same case.
An initial between the names may stand and stays. A name that is found once is replaced wherever the text has it as a word,
also as a part of one with a hyphen, but not a family name that the text also has in lower case.

The surrogates of a text are checked: should two formats of one kind ever meet in one surrogate,
the later entity by order walks on until it is alone, and keeps that throughout the text. As all is one permutation, a
surrogate can be a string that stands for something else in the corpus; that one has then another surrogate.
Who has the key can undo the replacement, so it must be kept secret.

Letter case does not tell e-mail addresses or names apart, nor does punctuation tell
telephone numbers apart, and it is kept. Null text stays null and
empty text empty; texts without entities come back unchanged, and long ones are searched whole. Rows stay as they are in
number, order and all other columns, whatever their names, except n_chars, which follows the text; an empty
table gives no rows, and repeated rows get equal texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import columns_of, unused

# Given names by gender and script, and titles by gender.
NAMES = {
    ("f", "latin"): "Alice Amelia Ana Andrea Anna Barbara Carla Carmen Caroline Charlotte Chloe Clara Elena Elizabeth Emily Emma Eva Fatima Grace Hannah Helen Ingrid Isabel Jennifer Jessica Julia Karen Katharina Laura Linda Lucia Maria Marie Marta Martha Mary Mia Monika Nina Olivia Patricia Petra Rachel Rosa Ruth Sabine Sarah Sofia Sophie Susan Teresa Ursula Chloé Inés Lucía María Sofía Zoë".split(),
    ("m", "latin"): "Adam Alexander Andreas Antonio Ben Carlos Charles Christian Daniel David Diego Edward Felix Fernando Francisco Frank George Hans Henry Jack Jacques James Jan Javier Jean John Jorge Joseph Juan Karl Klaus Louis Luis Manuel Marco Mark Martin Matthew Michael Miguel Noah Oliver Pablo Paul Pedro Peter Pierre Richard Robert Samuel Stefan Thomas William Wolfgang André François Jesús José Łukasz Sébastien Özgür".split(),
    ("f", "cyrillic"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f", "Dr": "", "Prof": ""}
# Letters that stand for each other in family names, and in other words.
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "äëïöü", "áéíóúý", "àèìòù", "âêîôû", "ãõ", "åæø", "çñ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"]

# Ranges of addresses that are not public (this network, private, shared, loopback, link-local, documentation, tests, multicast, reserved).
RANGES = [((a << 24) + (b << 16) + (c << 8), 1 << 32 - bits) for a, b, c, bits in [(0, 0, 0, 8), (10, 0, 0, 8), (100, 64, 0, 10), (127, 0, 0, 8), (169, 254, 0, 16), (172, 16, 0, 12), (192, 0, 0, 24), (192, 0, 2, 24), (192, 168, 0, 16), (198, 18, 0, 15), (198, 51, 100, 24), (203, 0, 113, 24), (224, 0, 0, 4), (240, 0, 0, 4)]]

FINDERS = [
    ("email", re.compile(r"[A-Za-z0-9_.+-]*[A-Za-z0-9_+-]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")),
    ("secret", re.compile(r"(?i:token|secret|api_?key|password|passwd)\s*[=:]\s*[\"']?([A-Za-z0-9_+/-]{8,})")),
    ("secret", re.compile(r"\b(?:AKIA|ASIA)([A-Z0-9]{12,20})\b")),
    ("secret", re.compile(r"\b(?:sk-|ghp_|AIza)([A-Za-z0-9_-]{20,})")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)")),
    ("phone", re.compile(r"(?<![\w(.-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?!\d)")),
    ("card", re.compile(r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{4}(?![\w-]|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
]
#: Capital letters, from the alphabets that have them.
UPPER = "[" + "".join(c for c in map(chr, range(0x590)) if c.isupper()) + "]"
LETTER = r"[^\W\d_]"
NAME = f"{UPPER}(?:{LETTER}+(?:['’-]{UPPER}{LETTER}+)*|['’]{UPPER}{LETTER}+)"
CAPITAL = re.compile(rf"\b({NAME})(?=\.? (?:{UPPER}\.? )?({NAME})\b(?: ({NAME})\b)?)")
WORD = re.compile(rf"(?<![\w@.-]){LETTER}+(?:['’-]{LETTER}+)*(?![\w@])")
PART = re.compile(f"{LETTER}+")
GIVEN = {n.lower(): (g, s) for (g, s), names in NAMES.items() for n in names}


def _round(key: bytes, tag: str, i: int, value: int, bits: int) -> int:
    size = (bits + 7) // 8
    out = hashlib.blake2b(f"{tag}|{i}|{value}".encode(), key=key, digest_size=min(64, size)).digest()
    while len(out) < size:
        out += hashlib.blake2b(out, key=key).digest()
    return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)


def _feistel(key: bytes, tag: str, x: int, half: int, back: bool) -> int:
    a, b = x >> half, x & ((1 << half) - 1)
    for i in range(7, -1, -1) if back else range(8):
        if back:
            a, b = b ^ _round(key, tag, i, a, half), a
        else:
            a, b = b, a ^ _round(key, tag, i, b, half)
    return a << half | b


def _within(key: bytes, tag: str, x: int, n: int, back: bool) -> int:
    """A permutation of range(n): the network over the next power of four, walked until it is back below n."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    x = _feistel(key, tag, x, half, back)
    while x >= n:
        x = _feistel(key, tag, x, half, back)
    return x


def cycled(key: bytes, tag: str, x: int, n: int) -> int:
    """The next of x on a cycle of all of range(n)."""
    return _within(key, tag, (_within(key, tag, x, n, True) + 1) % n, n, False)


@lru_cache(maxsize=None)
def _beside(c: str) -> str:
    """The lower-case letters of a block of 64 that are in none of ALPHABETS and have one capital, if ``c`` is one of them."""
    block = ord(c) // 64 * 64
    found = "".join(x for x in map(chr, range(block, block + 64)) if x.isalpha() and len(x.upper()) == 1 and x.upper() != x and x.upper().lower() == x and not any(x in a for a in ALPHABETS))
    return found if c in found else c


def _alphabets(text: str, hexadecimal: bool) -> list[str]:
    """For every character what may take its place; one that is only itself stays."""
    out = []
    for c in text:
        if c.isdigit() and c.isascii():
            out.append("0123456789")
        elif hexadecimal and c in "abcdef":
            out.append("abcdef")
        elif hexadecimal and c in "ABCDEF":
            out.append("ABCDEF")
        else:
            low = c.lower()
            own = next((a for a in ALPHABETS if low in a), None) or (_beside(low) if len(low) == 1 and low.isalpha() and not low.isascii() else c)
            out.append(c if len(own) < 2 else own.upper() if c.isupper() else own)
    return out


def permuted(key: bytes, tag: str, text: str, keep: Callable[[str], bool], hexadecimal: bool = False) -> str:
    """The surrogate of a string among those of its format that ``keep`` accepts; the string itself must be one."""
    alphabets = _alphabets(text, hexadecimal)
    x, n = 0, 1
    for c, a in zip(text, alphabets):
        x, n = x * len(a) + (a.index(c) if len(a) > 1 else 0), n * len(a)
    if n < 2:
        return text
    tag += "|" + "|".join(alphabets)
    while True:
        x = cycled(key, tag, x, n)
        y, out = x, []
        for a in reversed(alphabets):
            y, i = divmod(y, len(a))
            out.append(a[i])
        made = "".join(reversed(out))
        if keep(made):
            return made


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _shaped(original: str, plain: str) -> str:
    """``plain`` has as many letters and digits as the original; the case and all else come from there."""
    it = iter(plain)
    return "".join((lambda n: n.upper() if c.isupper() else n)(next(it)) if c.isalnum() else c for c in original)


def _range_of(x: int) -> tuple[int, int]:
    """First address and size of the special range that an address is in; size 0 for public ones."""
    return next(((low, size) for low, size in RANGES if low <= x < low + size), (0, 0))


@lru_cache(maxsize=50_000)
def surrogate(key: bytes, kind: str, text: str) -> str:
    """The surrogate of one entity; a function of the key, the kind and the entity alone."""
    any_ = lambda s: True
    if kind == "email":
        local, _, domain = text.partition("@")
        name, dot, top = domain.lower().rpartition(".")
        plain = local.lower()
        made = permuted(key, "email", plain + "@" + name, any_)
        made = f"{made}{dot}{top}"
        return "".join(m.upper() if c.isupper() else m for c, m in zip(text, made))
    if kind == "ip":
        x = 0
        for octet in text.split("."):
            x = x * 256 + int(octet)
        low, size = _range_of(x)
        if size:
            x = low + cycled(key, f"ip|{low}", x - low, size)
        else:
            x = cycled(key, "ip", x, 1 << 32)
            while _range_of(x)[1]:
                x = cycled(key, "ip", x, 1 << 32)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind in ("card", "phone", "ssn"):
        digits = "".join(c for c in text if c.isdigit())
        fixed = 1 if kind == "card" else len(re.match(r"\+?(\d{1,3}(?=\D)|\d)?", text)[1] or "") if text.startswith("+") else 0
        head, rest = digits[:fixed], digits[fixed:]
        good = luhn(digits) if kind == "card" else None
        return _shaped(text, head + permuted(key, f"{kind}|{head}", rest, (lambda s: luhn(head + s) == good) if kind == "card" else any_))
    if kind == "family":
        plain = "".join(c.lower() if len(c.lower()) == 1 else c for c in text if c.isalnum())
        return _shaped(text, permuted(key, "family", plain, lambda s: s not in GIVEN))
    if kind == "given":
        names = sorted(NAMES[GIVEN[text.lower()]], key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
        made = names[(names.index(text.lower().capitalize()) + 1) % len(names)]
        return made.upper() if text.isupper() else made
    hexadecimal = bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", text))
    return permuted(key, "hex" if hexadecimal else "secret", text, lambda s: bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", s)) == hexadecimal, hexadecimal)


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is found, in text order; of overlapping ones the first by the list of finders."""
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        at = bisect_right(found, (start, end, kind))
        if not (at and found[at - 1][1] > start) and not (at < len(found) and found[at][0] < end):
            insort(found, (start, end, kind))

    if DIGIT_OR_SIGN.search(text):
        for kind, finder in FINDERS:
            for m in finder.finditer(text):
                add(*m.span(1 if finder.groups else 0), kind)
    def name(m: re.Match, group: int, kind: str) -> None:
        """A given name's parts are names each; a family name is one with its hyphens."""
        if kind == "family":
            add(*m.span(group), kind)
        else:
            for part in PART.finditer(text, *m.span(group)):
                add(*part.span(), "given" if part[0].lower() in GIVEN else "family")

    is_given = lambda word: word.partition("-")[0].lower() in GIVEN
    taken = 0
    for m in CAPITAL.finditer(text):
        first, second = m[1], m[2]
        if m.start() < taken:
            continue
        if first in TITLES:
            if is_given(second) and m[3]:
                name(m, 2, "given")
                name(m, 3, "family")
                taken = m.end(3)
            else:
                name(m, 2, "given" if is_given(second) else "family")
                taken = m.end(2)
        elif is_given(first):
            name(m, 1, "given")
            name(m, 2, "given" if is_given(second) else "family")
            # A second given name may have the family name after it.
            taken = m.start(2) if is_given(second) else m.end(2)
    people = {text[s:e]: kind for s, e, kind in found if kind in ("given", "family")}
    if people:
        # A name that is known by now is one wherever it stands as a word, but a family name that is a common word too.
        again, common, lowered = [], set(), {p.lower() for p, kind in people.items() if kind == "family"}
        for m in WORD.finditer(text):
            for part in [m] if m[0] in people else PART.finditer(text, *m.span()):
                if part[0] in people:
                    again.append(part.span())
                elif part[0] in lowered:
                    common.add(part[0])
        places = sorted((s, e) for s, e, _ in found)
        for start, end in again:
            kind = people[text[start:end]]
            at = bisect_right(places, (start, len(text) + 1))
            if not (kind == "family" and text[start:end].lower() in common) and not (at and places[at - 1][1] > start) and not (at < len(places) and places[at][0] < end):
                found.append((start, end, kind))
    return sorted(found)


DIGIT_OR_SIGN = re.compile(r"[@\d]|(?i:token|secret|api_?key|passw)\s*[=:]|sk-|ghp_|AIza|AKIA|ASIA")


def same(kind: str, text: str) -> str:
    """What tells entities of a kind apart."""
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    return text.lower() if kind in ("email", "given", "family") else text


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, kind, surrogate) by places in the text as it was."""
    found = entities(text)
    if not found:
        return text, []
    steps: dict[tuple[str, str], int] = {}
    used: set[tuple[str, str]] = set()
    for kind, of, one in sorted({(kind, same(kind, text[s:e]), text[s:e]) for s, e, kind in found}):
        if (kind, of) not in steps:
            n, new = 1, surrogate(key, kind, one)
            while (kind, same(kind, new)) in used:
                n, new = n + 1, surrogate(key, kind, new)
            steps[kind, of] = n
            used.add((kind, same(kind, new)))
    out, made, at = [], [], 0
    for s, e, kind in found:
        new = text[s:e]
        for _ in range(steps[kind, same(kind, new)]):
            new = surrogate(key, kind, new)
        out += [text[at:s], new]
        made.append((s, e, kind, new))
        at = e
    return "".join([*out, text[at:]]), made


def pseudonymised(text: Column, key: bytes) -> Column:
    """A struct of the new text and the entities (start, end, kind, surrogate), null for null."""

    @F.pandas_udf("text string, entities array<struct<start:int,end:int,kind:string,surrogate:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [(None, None) if t is None else replaced(t, key) for t in texts]
            yield pd.DataFrame({"text": pd.Series([t for t, _ in out], dtype=object), "entities": [None if f is None else [dict(zip(("start", "end", "kind", "surrogate"), x)) for x in f] for _, f in out]})

    return run(text.cast("string"))


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities, entities of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pseudonymised(F.col("text"), key).alias("p"))
    return rows.select("doc_id", F.col("p.text").alias("text"), F.when(F.col("p.entities").isNull(), 0).otherwise(F.size("p.entities")).cast("long").alias("n_entities"), F.col("p.entities").alias("entities"))


def remove_personal_data(docs: DataFrame, key: bytes) -> DataFrame:
    """All rows and columns of ``docs``, the texts with surrogates and n_chars to match."""
    p = unused("p", docs)
    made = docs.withColumn(p, pseudonymised(F.col("text"), key))
    text = F.col(f"{p}.text")
    new = {"text": text, "n_chars": F.when(text.isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return made.select(*[new[c].alias(c) if c in new else own for c, own in zip(docs.columns, columns_of(docs))])
