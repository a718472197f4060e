"""PII: surrogates for detected entities, alike in type, gender, script and format.

Each kind of entity is a set of values of one format (the same letters' classes, digits and punctuation in the same
places), numbered by mixed radix. A keyed permutation of that set, s = P(P'(x) + step), maps an entity to its surrogate;
P is a Feistel network over the numbers, walked on until it stays within the set, and step has no divisor in common with the set's
size, so s is one cycle. As it is a permutation without fixed points, equal entities have equal surrogates in every document and task (coreference), different ones have different
surrogates (no collisions), and none is its own; nothing has to be gathered, so one pass over the texts does, without a
shuffle. Replacements of a document are checked all the same: should one equal its entity, or two entities of a kind meet
in one surrogate, other keys are tried in turn. collisions() looks for such meetings over a whole table.

Checksums are kept (Luhn, IBAN's mod 97). Given names map within lists of their gender and script; other names map to
words with letters of the same script, case and kind (vowel or not), whose ending stays where it tells a gender, and never
into the lists. A name that is found with a title or a listed given name is replaced wherever its words occur in the
document, also alone. Domains of example.com and its like keep that ending; others keep their last label.

Defined cases: a null text stays null with no entities; an empty text has none; repeated rows are treated alike; an empty
table gives an empty result; whole texts are searched. replace() keeps all other columns, whatever their names are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import release

KEY = b"surrogate-key-1"
ROUNDS = 6

# ---------------------------------------------------------------- keyed permutations


def _round(key: bytes, label: bytes, r: int, x: int, bits: int) -> int:
    size = (bits + 7) // 8
    out, n = b"", 0
    while len(out) < size:
        out += hashlib.blake2b(x.to_bytes(size + 1, "big") + bytes([r, n & 255]) + label, key=key, digest_size=min(64, size)).digest()
        n += 1
    return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)


def _feistel(x: int, half: int, key: bytes, label: bytes, back: bool) -> int:
    mask = (1 << half) - 1
    a, b = x >> half, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        a, b = (b ^ _round(key, label, r, a, half), a) if back else (b, a ^ _round(key, label, r, b, half))
    return a << half | b


def permute(x: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of 0..size-1 in one cycle, so without fixed points (if size is over 1)."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    tag = f"{label}|{size}".encode()

    def walk(v: int, back: bool) -> int:
        v = _feistel(v, half, key, tag, back)
        while v >= size:
            v = _feistel(v, half, key, tag, back)
        return v

    step = 1 + int.from_bytes(hashlib.blake2b(tag, key=key, digest_size=8).digest(), "big") % (size - 1)
    while math.gcd(step, size) > 1:  # one cycle through all numbers: a walk that starts in a subset meets all of it before it comes back
        step = step % (size - 1) + 1
    return walk((walk(x, True) + step) % size, False)


def permute_places(values: list[int], sizes: list[int], key: bytes, label: str) -> list[int]:
    """The permutation of mixed-radix numbers."""
    x, total = 0, 1
    for v, n in zip(values, sizes):
        x, total = x * n + v, total * n
    x = permute(x, total, key, label)
    out = []
    for n in reversed(sizes):
        x, v = divmod(x, n)
        out.append(v)
    return out[::-1]


#: Letters by script, case and kind: a letter is replaced by one of its own class.
CLASSES = [
    "0123456789",
    "aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ",
    "áàâäãåéèêëíìîïóòôöõúùûü", "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜ",
    "аеёиоуыэюя", "АЕЁИОУЫЭЮЯ", "бвгджзйклмнпрстфхцчшщ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "ΑΕΗΙΟΥΩ", "βγδζθκλμνξπρστφχψ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
PLACE = {c: (k, i) for k, cs in enumerate(CLASSES) for i, c in enumerate(cs)}


def shape(text: str, key: bytes, label: str, alphabet: str | None = None) -> str:
    """A text of the same format: each character of a class (or of alphabet) becomes one of that class, others stay."""
    where = PLACE if alphabet is None else {c: (0, i) for i, c in enumerate(alphabet)}
    classes = CLASSES if alphabet is None else [alphabet]
    at = [(i, *where[c]) for i, c in enumerate(text) if c in where]
    fixed = "".join(f"<{where[c][0]}>" if c in where else c for c in text)
    new = permute_places([i for _, _, i in at], [len(classes[k]) for _, k, _ in at], key, f"{label}|{fixed}")
    out = list(text)
    for (i, k, _), v in zip(at, new):
        out[i] = classes[k][v]
    return "".join(out)


# ---------------------------------------------------------------- entities

# Given names by script and gender.
NAMES = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sophie Clara Elena Lucia Marta Alice Camille Helena Ingrid Petra Carmen Isabel Louise Judith Nora Paula Rosa Silvia Teresa".split(),
    ("latin", "m"): "James Thomas Daniel Martin Peter Paul Lukas Felix Jonas Hugo Antoine Pierre Carlos Javier Miguel Pablo Stefan Walter Oskar Victor David Simon George Henry".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел".split(),
}
LISTED = {n: k for k, names in NAMES.items() for n in names}
# Titles that tell a gender, and those that tell none.
TITLES = {"Mr": "m", "Mr.": "m", "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Dr": "", "Dr.": "", "Prof.": ""}
# Domains that are reserved for examples.
RESERVED = ("example.com", "example.net", "example.org")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _refill(pattern: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


def email(m: re.Match, key: bytes) -> str:
    local, _, domain = m[0].rpartition("@")
    kept = next((x for x in RESERVED if domain.lower() == x or domain.lower().endswith("." + x)), None)
    tail = domain[len(domain) - len(kept) :] if kept else domain[domain.rindex(".") + 1 :]
    head = domain[: len(domain) - len(tail)]
    # hosts are mapped alike wherever they occur; pairs of permutations are a permutation of the pairs
    return shape(local, key, "mail") + "@" + (shape(head, key, "host") if head else "") + tail


def card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) < 2:
        return None
    new = digits[0] + shape(digits[1:-1], key, f"card{digits[0]}")
    return _refill(m[0], new + next(c for c in "0123456789" if luhn(new + c)))


def phone(m: re.Match, key: bytes) -> str | None:
    country, rest = re.match(r"(\+\d{1,3}(?=\D)|)(.*)", m[0], re.S).groups()
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 14:
        return None
    label, places = f"phone{country}|{re.sub(r'[0-9]', '0', rest)}", [int(c) for c in digits]
    if len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789":  # area and exchange begin with 2 to 9
        low = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]
        new = permute_places([v - w for v, w in zip(places, low)], [10 - w for w in low], key, label + "|area")
        places = [v + w for v, w in zip(new, low)]
    else:
        tail = permute_places(places, [10] * len(places), key, label)
        while len(digits) == 10 and tail[0] >= 2 and tail[3] >= 2:  # stays outside of the other set
            tail = permute_places(tail, [10] * len(places), key, label)
        places = tail
    return country + _refill(rest, "".join(map(str, places)))


def address(m: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if any(x > 255 for x in parts) or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    widths = [len(x) for x in m[0].split(".")]
    low = [0 if w == 1 else 10 if w == 2 else 100 for w in widths]
    sizes = [10 if w == 1 else 90 if w == 2 else 156 for w in widths]
    new = permute_places([v - x for v, x in zip(parts, low)], sizes, key, f"ip{widths}")
    return ".".join(str(v + x) for v, x in zip(new, low))


def social(m: re.Match, key: bytes) -> str:
    return shape(m[0], key, "ssn")


def iban(m: re.Match, key: bytes) -> str | None:
    raw = m[0].replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(raw) <= 34 or number(raw[4:] + raw[:4]) % 97 != 1:
        return None
    body = shape(raw[4:], key, "iban" + raw[:2])
    new, left = raw[:2] + f"{98 - number(body + raw[:2] + '00') % 97:02d}" + body, None
    left = iter(new)
    return "".join(" " if c == " " else next(left) for c in m[0])


def access_key(m: re.Match, key: bytes) -> str:
    return m[0][:4] + shape(m[0][4:], key, "access", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


HEX = re.compile("[0-9a-f]+")


def secret(m: re.Match, key: bytes) -> str:
    value = m["value"]
    if HEX.fullmatch(value):
        new = shape(value, key, "hex", "0123456789abcdef")
    else:
        new = shape(value, key, "secret")
        while HEX.fullmatch(new):  # a walk as in name_word: these images stay outside of the other set
            new = shape(new, key, "secret")
    at = m.start("value") - m.start()
    return m[0][:at] + new + m[0][at + len(value) :]


# Endings of names that tell a gender, longest first.
ENDING = re.compile("(?:ская|ский|цкая|цкий|ова|ева|ина|ов|ев|ин|[aeioаяйеи])$")


def split_name(word: str) -> tuple[str, str]:
    """A name's stem and its ending that tells a gender (nothing, if the stem would be a single letter)."""
    m = ENDING.search(word)
    return (word[: m.start()], m[0]) if m and m.start() > 1 else (word, "")


def name_word(word: str, key: bytes) -> str:
    """A listed name becomes one of its list; another one a word that is not listed and splits into a stem of the same shape and the same ending.

    These words are a subset of the stems of that shape, and the word itself is one of them. The permutation of the shape is one cycle, so walking on
    to the next word of the subset is a cycle through the subset: it ends, different names stay different, and only a name that is alone in
    its subset (no letter of it has a class) stays itself.
    """
    if word in LISTED:
        names = NAMES[LISTED[word]]
        return names[permute(names.index(word), len(names), key, "given" + "".join(LISTED[word]))]
    stem, ending = split_name(word)
    while True:
        stem = shape(stem, key, "name" + ending)
        if split_name(stem + ending) == (stem, ending) and stem + ending not in LISTED:
            return stem + ending


def person(m: re.Match, key: bytes) -> str:
    return (m["title"] or "") + "".join(name_word(w, key) if i % 2 == 0 else w for i, w in enumerate(re.split(r"([ ]+)", m["names"])))


_W = r"[A-ZÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜА-ЯΑ-Ω][^\W\d_]+"
#: Kinds in the order in which they are looked for: pattern, surrogate, and a test that spares most texts the search.
KINDS: list[tuple[str, re.Pattern, Callable, Callable[[str], bool]]] = [
    ("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])"), email, lambda t: "@" in t),
    ("access_key", re.compile(r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"), access_key, lambda t: "KIA" in t or "SIA" in t),
    ("secret", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?[ \t]*[=:][ \t]*(?P<q>[\"']?)(?P<value>[A-Za-z0-9_+/.-]{6,})(?P=q)"), secret, lambda t: "=" in t or ":" in t),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), iban, lambda t: True),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"), card, lambda t: True),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), address, lambda t: "." in t),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), social, lambda t: "-" in t),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w-])"), phone, lambda t: "-" in t or "+" in t or "." in t),
    ("person", re.compile(rf"\b(?:(?P<title>(?:{'|'.join(re.escape(x) for x in sorted(TITLES, key=len, reverse=True))}) +)(?P<names>{_W}(?: {_W}){{0,2}}))"), person, lambda t: any(x in t for x in TITLES)),
    ("person", re.compile(rf"\b(?P<title>)(?P<names>(?:{'|'.join(LISTED)}) {_W})\b"), person, lambda t: any(x in t for x in LISTED)),
]
NEED_DIGIT = {"iban", "card", "ip", "ssn", "phone", "access_key"}
_DIGIT = re.compile("[0-9]")


def find(text: str, key: bytes = KEY, tries: int = 8) -> list[tuple[str, int, int, str]]:
    """Entities (kind, start, end, surrogate) in order of place; of overlapping ones the kind that comes first in KINDS."""
    found: list[tuple[str, int, int, str]] = []
    digit = bool(_DIGIT.search(text))
    for kind, pattern, surrogate, may in KINDS:
        if (kind in NEED_DIGIT and not digit) or not may(text):
            continue
        for m in pattern.finditer(text):
            if any(m.start() < e and s < m.end() for _, s, e, _ in found):
                continue
            new = surrogate(m, key)
            if new is not None:
                found.append((kind, m.start(), m.end(), new))
    words: dict[str, str] = {}
    for kind, s, e, new in found:
        if kind == "person":
            old_words, new_words = (re.findall(r"[^\W\d_]+", x) for x in (text[s:e], new))
            words.update((w, n) for w, n in zip(old_words, new_words) if w != n and len(w) > 2)
    if words:  # mentions of the same people by one name only
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})\b", text):
            if not any(m.start() < e and s < m.end() for _, s, e, _ in found):
                found.append(("person", m.start(), m.end(), words[m[0]]))
    found.sort(key=lambda x: x[1])
    return found if distinct(text, found) else again(text, key, tries) if tries else found


def distinct(text: str, found: list[tuple[str, int, int, str]]) -> bool:
    """Whether no entity is its own surrogate and no two of a kind share one."""
    met: dict[tuple[str, str], str] = {}
    same = lambda s, e, new: new == text[s:e] and any(c in PLACE for c in text[s:e])
    return not any(same(s, e, new) or met.setdefault((kind, new), text[s:e]) != text[s:e] for kind, s, e, new in found)


def again(text: str, key: bytes, tries: int) -> list[tuple[str, int, int, str]]:
    """The entities of a document whose surrogates met, under the next key."""
    return find(text, hashlib.blake2b(key, digest_size=16).digest(), tries - 1)


def rewritten(text: str | None, key: bytes = KEY) -> tuple[str | None, list[dict]]:
    if not text:
        return text, []
    out, at, size, spans = [], 0, 0, []
    for kind, s, e, new in find(text, key):
        out += [text[at:s], new]
        size += s - at
        spans.append({"kind": kind, "start": s, "end": e, "new_start": size, "new_end": size + len(new)})
        size, at = size + len(new), e
    return ("".join(out) + text[at:], spans) if spans else (text, [])


SPANS = "array<struct<kind: string, start: int, end: int, new_start: int, new_end: int>>"
#: Characters of text that are rewritten at once.
SLICE = 1 << 19


def replace(docs: DataFrame, key: bytes = KEY, column: str = "text", spans: str | None = "entities") -> DataFrame:
    """docs with surrogates in the text column; `spans` names a column of the entities' places (in the place of one of that name), or None for none."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != spans])
    at = rows.columns.index(column)
    schema = StructType([StructField(f.name, StringType()) if f.name == column else StructField(f.name, f.dataType) for f in rows.schema])
    if spans:
        schema = schema.add(spans, StructType.fromDDL(f"e {SPANS}")["e"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity = pa.list_(pa.struct([("kind", pa.string()), *[(x, pa.int32()) for x in ("start", "end", "new_start", "new_end")]]))
        for batch in batches:
            begin, held, n = 0, 0, batch.column(at)
            sizes = pc.fill_null(pc.binary_length(n), 0).to_pylist()
            for i, size in enumerate(sizes):
                held += size
                if held < SLICE and i + 1 < len(sizes):
                    continue
                part, held = batch.slice(begin, i + 1 - begin), 0
                done = [rewritten(t, key) for t in part.column(at).to_pylist()]
                columns = [pa.array([t for t, _ in done], pa.string()) if k == at else c for k, c in enumerate(part.columns)]
                if spans:
                    columns.append(pa.array([s for _, s in done], entity))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                begin = i + 1
        release()

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], *([spans] if spans and spans not in docs.columns else []))


def collisions(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Surrogates that stand for several entities of a kind, over a whole table: there should be none."""

    def entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(kind, t[s:e], new) for t in pdf["text"] if t for kind, s, e, new in find(t, key)]
            yield pd.DataFrame(rows, columns=["kind", "entity", "surrogate"])

    pairs = docs.select("text").mapInPandas(entities, "kind string, entity string, surrogate string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).filter("entities > 1")
