"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

A surrogate is a keyed permutation of the values that share the entity's format: the letters
of a name change within vowels and consonants of their script, digits of a number within the
digits their place allows, given names within the list of their gender and script. So the same
value gets the same surrogate in every document and notation (coreference), two values never
share one (distinctness), and no table of values has to be kept or joined, however large the
corpus is. The permutation is one cycle, so no value stands for itself either.

Collision checks: inside the permutation a value that falls outside the format's valid set (a
listed name where a free one is wanted, an address of another network) is walked on until it is inside,
which keeps it one-to-one. Addresses of a special network (private, loopback, documentation, ...) stay
within it and public ones stay public with their first octet. Two values of a document that should share a surrogate nevertheless
are marked ``clash`` and never stop a job; ``collisions`` checks the same over a whole corpus.

Names are looked for behind a form of address only; a name without one stays.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import over_rows

ROUNDS = 8

# Letters that may stand for each other, small form.
ALPHABETS = {
    "vowel": "aeiouy",
    "consonant": "bcdfghjklmnpqrstvwxz",
    "accented": "àáâãäåèéêëìíîïòóôõöùúûü",
    "cyrillic vowel": "аеёиоуыэюя",
    "cyrillic consonant": "бвгджзйклмнпрстфхцчшщ",
    "greek vowel": "αεηιουω",
    "greek consonant": "βγδζθκλμνξπρστφχψ",
}
# All other letters of a script that have both cases: Latin, Greek, Cyrillic and Armenian, by range.
_LISTED = set("".join(ALPHABETS.values()))
MORE = {
    name: "".join(c for c in map(chr, range(*codes)) if c not in _LISTED and c.islower() and len(c.upper()) == 1 and c.upper().lower() == c)
    for name, codes in {"more latin": (0xDF, 0x250), "more greek": (0x370, 0x400), "more cyrillic": (0x430, 0x530), "more armenian": (0x561, 0x587)}.items()
}
CAPITALS = "".join(c for c in map(chr, range(0x41, 0x590)) if c.isupper())
DIGITS = "0123456789"
LATIN = "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"

# Given names by script and gender.
GIVEN = {
    ("latin", "female"): "anna clara elena emma ines julia laura lucia maria nora paula sofia".split(),
    ("latin", "male"): "adam david felix hugo john karl leon mark paul peter simon thomas".split(),
    ("cyrillic", "female"): "анна вера дарья елена ирина мария нина ольга софия татьяна".split(),
    ("cyrillic", "male"): "антон борис иван игорь максим олег павел пётр сергей юрий".split(),
}
_LISTS = {n: (k, i) for k, names in GIVEN.items() for i, n in enumerate(names)}

# Forms of address that announce a name.
TITLES = "Mr Mrs Ms Miss Dr Herr Frau Mme Monsieur Madame Señor Señora Господин Госпожа".split()

_NAME = rf"[{CAPITALS}][^\W\d_]+"
_HOST = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"
# Each starts with a character or set, so that a search skips quickly to where one can begin; what
# may not stand before it is looked at after its first character. Earlier ones win overlaps.
PATTERNS = [
    ("email", re.compile(rf"[A-Za-z0-9](?<![A-Za-z0-9._%+-].)(?:[A-Za-z0-9._%+-]{{0,62}}[A-Za-z0-9])?@{_HOST}")),
    ("aws_key", re.compile(r"A(?<![A-Za-z0-9].)[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?:token|passw(?:or)?d|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_-]{8,256})", re.I)),
    ("iban", re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"[0-9](?<![\w.].)[0-9]{0,2}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")),
    ("card", re.compile(r"[0-9](?<![0-9].)[0-9]{12,18}(?![0-9])")),
    ("card", re.compile(r"[0-9](?<![0-9-].)(?:[0-9]{3} [0-9]{4} [0-9]{4} |[0-9]{3}-[0-9]{4}-[0-9]{4}-)[0-9]{4}(?![0-9-])")),
    ("card", re.compile(r"[0-9](?<![0-9-].)(?:[0-9]{3} [0-9]{6} |[0-9]{3}-[0-9]{6}-)[0-9]{5}(?![0-9-])")),
    ("ssn", re.compile(r"[0-9](?<![\w-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"\+(?<![\w+].)[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![\w-])")),
    ("phone", re.compile(r"\((?<![\w(].)[0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"[0-9](?<![\w.+-].)[0-9]{2}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])")),
    ("name", re.compile(rf"(?:{'|'.join(TITLES)})\b\.? ({_NAME}(?: {_NAME})?)")),
]
_DIGIT = re.compile("[0-9]")


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what looks like an entity, in order and without overlaps."""
    digit, found = _DIGIT.search(text), []
    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        if kind == "secret" and "=" not in text and ":" not in text:
            continue
        if kind in ("iban", "ip", "card", "ssn", "phone") and not digit:
            continue
        found += [(kind, *m.span(pattern.groups)) for m in pattern.finditer(text)]
    if len(found) < 2:
        return found
    rank, out = {k: i for i, (k, _) in enumerate(PATTERNS)}, []
    taken: list[tuple[int, int]] = []
    for e in sorted(found, key=lambda e: (rank[e[0]], e[1])):
        at = bisect.bisect(taken, (e[1], e[2]))
        if (at == 0 or taken[at - 1][1] <= e[1]) and (at == len(taken) or taken[at][0] >= e[2]):
            taken.insert(at, (e[1], e[2]))
            out.append(e)
    return sorted(out, key=lambda e: e[1])


class Permutation:
    """Keyed permutations of 0..n-1 for any n, each a single cycle."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, value: int, top: int) -> int:
        text = f"{len(self.key)}|".encode() + self.key + f"|{tweak}|{i}|{value}|{top}".encode()
        return int.from_bytes(hashlib.shake_256(text).digest(top.bit_length() // 8 + 9), "big") % top

    def _shuffle(self, tweak: str, x: int, n: int, back: bool) -> int:
        """A balanced Feistel network over the least square that holds n, walked until below n."""
        side = math.isqrt(n - 1) + 1
        rounds = range(ROUNDS)
        while True:
            left, right = divmod(x, side)
            for i in reversed(rounds) if back else rounds:
                if back:
                    left, right = (right - self._round(tweak, i, left, side)) % side, left
                else:
                    left, right = right, (left + self._round(tweak, i, right, side)) % side
            x = left * side + right
            if x < n:
                return x

    def step(self, tweak: str, x: int, n: int) -> int:
        """The value after x in a keyed cycle through all n values."""
        if n < 2:
            return x
        return self._shuffle(tweak, (self._shuffle(tweak, x, n, True) + 1) % n, n, False)


# Networks whose addresses stand for something special; none lies in another.
SPECIAL = [
    (int(n.network_address), 32 - n.prefixlen)
    for n in map(
        ipaddress.ip_network,
        """0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24
        192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4""".split(),
    )
]


def network(address: int) -> tuple[int, int] | None:
    """The special network an address lies in: its first address and its host bits."""
    return next(((first, bits) for first, bits in SPECIAL if address >> bits == first >> bits), None)


def alphabet(letter: str) -> str | None:
    """The letters that may stand for a small letter; letters without case move within 64 code points."""
    found = next((a for a in (*ALPHABETS.values(), *MORE.values()) if letter in a), None)
    if found or letter.lower() != letter.upper():
        return found
    low = ord(letter) & ~63
    return "".join(c for c in map(chr, range(low, low + 64)) if c.isalpha() and c.lower() == c.upper())


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Surrogates:
    def __init__(self, key: bytes):
        self.permutation = Permutation(key)
        self.known = lru_cache(maxsize=100_000)(self._value)

    def _letters(self, kind: str, value: str, classes: list[str | None], allowed: Callable[[str], bool] | None = None) -> str:
        """Permute the characters whose class (an alphabet) is given, in one number of mixed base."""
        x, n = 0, 1
        for c, alphabet in zip(value, classes):
            if alphabet is not None:
                x, n = x * len(alphabet) + alphabet.index(c), n * len(alphabet)
        tweak = f"{kind}|" + "|".join("=" + c if a is None else a for c, a in zip(value, classes))
        while True:
            x = self.permutation.step(tweak, x, n)
            rest, out = x, []
            for c, alphabet in zip(reversed(value), reversed(classes)):
                if alphabet is None:
                    out.append(c)
                else:
                    rest, place = divmod(rest, len(alphabet))
                    out.append(alphabet[place])
            text = "".join(reversed(out))
            if allowed is None or allowed(text):
                return text

    @staticmethod
    def _any_case(value: str) -> tuple[str, list[bool]]:
        small = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        return small, [a != b for a, b in zip(value, small)]

    @staticmethod
    def _cased(value: str, capitals: list[bool]) -> str:
        return "".join(c.upper() if up and len(c.upper()) == 1 else c for c, up in zip(value, capitals))

    def _word(self, small: str) -> str:
        """One part of a name: list names stay in their list, others keep their last letter, which marks gender."""
        if small in _LISTS:
            group, i = _LISTS[small]
            return GIVEN[group][self.permutation.step("|".join(group), i, len(GIVEN[group]))]
        classes = [alphabet(c) for c in small]
        if len(small) > 2:
            classes[-1] = None
        return self._letters("name", small, classes, lambda t: t not in _LISTS)

    def _value(self, kind: str, value: str) -> str:
        """The surrogate of a canonical value."""
        if kind == "name":
            return self._word(value)
        if kind == "email":
            local, _, host = value.partition("@")
            labels = host.split(".")
            parts = [
                self._letters("mail", p, [DIGITS if c.isdigit() else LATIN if c in LATIN else None for c in p])
                for p in (local, *labels[:-1])
            ]
            return parts[0] + "@" + ".".join([*parts[1:], labels[-1]])
        if kind == "ip":
            address = int(ipaddress.IPv4Address(value))
            own = network(address)
            first, bits = own or (address >> 24 << 24, 24)
            x = address - first
            while True:  # a public address must not become a special one
                x = self.permutation.step(f"ip|{first}|{bits}", x, 1 << bits)
                if network(first + x) == own:
                    return str(ipaddress.IPv4Address(first + x))
        if kind == "card":
            body = self._letters("card", value[:-1], [None, *[DIGITS] * (len(value) - 2)])
            return body + str(_luhn(body))
        if kind == "iban":
            classes = [DIGITS if c.isdigit() else LATIN.upper() for c in value[4:]]
            body = self._letters("iban" + value[:2], value[4:], classes)
            return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
        if kind == "phone":
            first = [DIGITS[2:] if value[0] in DIGITS[2:] else None]
            return self._letters("phone", value, [*first, *[DIGITS] * (len(value) - 1)])
        if kind == "secret" and set(value) <= set(HEX):
            return self._letters("secret", value, [HEX] * len(value))
        start = 4 if kind == "aws_key" else 0
        classes = [DIGITS if c.isdigit() else LATIN if c in LATIN else LATIN.upper() if c.isascii() and c.isalpha() else None for c in value]
        return self._letters(kind, value, [None] * start + classes[start:])

    def replace(self, kind: str, found: str) -> list[tuple[str, str]] | None:
        """[(canonical value, surrogate in the format found)]; None if it only looks like an entity."""
        if kind in ("card", "phone", "ssn", "iban"):
            plain = re.sub(r"[^0-9A-Z]", "", found)
            kept = 0
            if kind == "card" and (not 13 <= len(plain) <= 19 or str(_luhn(plain[:-1])) != plain[-1] or len(set(plain)) < 2):
                return None
            if kind == "iban" and (not 15 <= len(plain) <= 34 or not 2 <= int(plain[2:4]) <= 98 or _mod97(plain) != 1):
                return None
            if kind == "phone":
                kept = max(0, len(plain) - 10)  # the country's digits
            new = iter(plain[:kept] + self.known(kind, plain[kept:]))
            return [(plain[kept:], "".join(next(new) if c.isdigit() or kind == "iban" and c.isalpha() else c for c in found))]
        if kind in ("email", "name"):
            out = []
            for part in found.split(" "):
                small, capitals = self._any_case(part)
                new = self.known(kind, small)
                if len(new) != len(small):  # a listed name of another length: same case pattern at its start
                    capitals = [True] * len(new) if all(capitals) else [capitals[0]] + [False] * (len(new) - 1)
                out.append((small, self._cased(new, capitals)))
            return out
        if kind == "ip":
            octets = found.split(".")
            if max(map(int, octets)) > 255:
                return None
            value = ".".join(str(int(o)) for o in octets)  # 10.0.0.01 is 10.0.0.1
            new = self.known(kind, value).split(".")
            return [(value, ".".join(n.zfill(len(o)) if o[0] == "0" else n for n, o in zip(new, octets)))]
        return [(found, self.known(kind, found))]

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, int, int, str, str]]]:
        """The text with surrogates, and (kind, start, end in the new text, canonical value, surrogate) of each entity."""
        new, found, _ = self.checked(text)
        return new, found

    def checked(self, text: str) -> tuple[str, list[tuple[str, int, int, str, str]], list[bool]]:
        """As ``rewrite``, and whether each entity's surrogate stands for another value of the text too."""
        out, kept, at, size, taken, marks = [], [], 0, 0, {}, []
        for kind, low, high in entities(text):
            parts = self.replace(kind, text[low:high])
            if parts is None:
                continue
            new = " ".join(p[1] for p in parts)
            for value, surrogate in parts:
                taken.setdefault((kind, comparable(kind, surrogate)), set()).add(value)
            marks.append([(kind, comparable(kind, surrogate)) for _, surrogate in parts])
            out += [text[at:low], new]
            size += low - at
            kept.append((kind, size, size + len(new), " ".join(p[0] for p in parts), new))
            size += len(new)
            at = high
        clash = [any(len(taken[m]) > 1 for m in mark) for mark in marks]
        return ("".join([*out, text[at:]]) if kept else text), kept, clash


def comparable(kind: str, surrogate: str) -> str:
    """A surrogate without the notation it is written in."""
    if kind in ("card", "phone", "ssn", "iban"):
        return re.sub(r"[^0-9A-Z]", "", surrogate)[-10 if kind == "phone" else 0 :]
    if kind == "ip":
        return ".".join(str(int(o)) for o in surrogate.split("."))
    return surrogate.lower() if kind in ("email", "name") else surrogate


ENTITIES = "array<struct<kind:string,start:int,end:int,surrogate:string,clash:boolean>>"
_ENTITY = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()), ("clash", pa.bool_())]))


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities, entities): one row per row of ``docs``, entities placed in the new text.

    Null texts stay null with no entities, empty and clean texts stay as they are. Repeated rows
    and equal values get equal surrogates everywhere. Extra columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _maker(key)
        rows = [(None, [], []) if t is None else made.checked(t) for t in batch.column(1).to_pylist()]
        found = [[{"kind": k, "start": a, "end": b, "surrogate": s, "clash": c} for (k, a, b, _, s), c in zip(r[1], r[2])] for r in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array(found, _ENTITY)],
            ["doc_id", "text", "n_entities", "entities"],
        )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(over_rows(work), f"doc_id long, text string, n_entities int, entities {ENTITIES}")


def rewritten(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with surrogates in its text and, where it has one, a new length; all columns stay.

    Null texts stay null with a null length, empty and clean ones as they are; an empty table stays empty.
    """
    at, fields = docs.columns.index(text_col), docs.columns
    length = fields.index(length_col) if length_col in fields else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _maker(key)
        texts = [t if t is None else made.rewrite(t)[0] for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, columns[at].type)
        if length is not None:
            old = columns[length]
            columns[length] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(old.type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(over_rows(work), docs.schema)


@lru_cache(maxsize=4)
def _maker(key: bytes) -> Surrogates:
    return Surrogates(key)


def entity_table(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, value, surrogate): the distinct entities of a whole corpus, values as keyed digests."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _maker(key)
        rows = {
            (k, hmac.new(key, v.encode(), hashlib.sha256).hexdigest(), comparable(k, s))
            for t in batch.column(0).to_pylist()
            if t
            for k, _, _, v, s in made.rewrite(t)[1]
        }
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "value", "surrogate"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(over_rows(work), "kind string, value string, surrogate string").distinct()


def collisions(entities: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one value; none are expected."""
    return entities.groupBy("kind", "surrogate").agg(F.countDistinct("value").alias("values")).where("values > 1")
