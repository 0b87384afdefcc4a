"""Personal data and secrets replaced by keyed surrogates of the same type, script, gender and format.

A surrogate is drawn by a keyed permutation of all values of the same format: digits stay digits, letters stay letters of
their script and case, separators, country codes, card brands, key prefixes and top-level domains stay, check sums hold
where they held.  A permutation without fixed points keeps distinct entities distinct, never returns the original, and
gives all mentions of an entity one surrogate, in all documents and without a table.  Listed given names are exchanged
within the list of their script and gender, wherever in a name they stand; others become names of their gender, if a title tells it.  Later bare mentions of a
part of a person's name in the same text are replaced like that part.  A job over all entities of the corpus then checks that no two share a surrogate and
draws again for those that do.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Batches, bounded_batches, documents, slices

ROUNDS = 8
CHUNK = 48  # characters permuted together
MOST_REDRAWN = 10_000  # entities that may need another draw; by construction none do

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Letters that are exchanged for each other, by script.
LETTERS = (LOWER, "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
#: In names vowels stay vowels and consonants consonants.
SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
          "àáâãäåæèéêëìíîïòóôõöøùúûü", "çðñýþ", "άέήίόύώ")
GIVEN = {
    ("latin", "m"): "james robert michael william david richard thomas charles daniel matthew anthony steven andrew kevin brian george".split(),
    ("latin", "f"): "patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy margaret sandra ashley emily michelle laura".split(),
    ("cyrillic", "m"): "иван алексей дмитрий сергей андрей михаил николай павел".split(),
    ("cyrillic", "f"): "анна мария елена ольга наталья ирина татьяна светлана".split(),
    ("greek", "m"): "γιώργος δημήτρης κώστας νίκος".split(),
    ("greek", "f"): "μαρία ελένη κατερίνα σοφία".split(),
}
TITLES = {
    "m": "Mr Mister Herr Monsieur Señor Sr Signor Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Signora Госпожа Κυρία".split(),
    "": "Dr Prof Doctor Professor".split(),
}
#: What a given name of a script and gender ends with, and what is appended to one that doesn't, or that has it already.
#: No listed name ends with what is appended.
ENDINGS = {
    ("latin", "m"): ("bcdfgklmnoprstvxz", "or"), ("latin", "f"): ("a", "ina"), ("cyrillic", "m"): ("бвгджзйклмнпрстфхцчшщ", "ор"),
    ("cyrillic", "f"): ("ая", "лла"), ("greek", "m"): ("ς", "άδης"), ("greek", "f"): ("αη", "ινα"),
}
#: Words that are not taken for a name when they stand alone, though a name before seemed to go on with one.
NO_NAMES = frozenset("""A An And As At But By For From He Her His I If In Is It Its My No Not Of On Or Our She So That The Their Then There
    These They This Those To Was We What When Where Which Who Why With You Your И В На Но Он Она Они Это Я Мы Вы Как Что Ο Η Το Και Οι Τα""".split())
GENDER = {t: g for g, titles in TITLES.items() for t in titles}
KNOWN = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}

_NAME = r"[A-ZÀ-ÖØ-ÞΑ-ΩΆ-ΏА-Я][a-zß-öø-ÿά-ώа-я]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {  # in order of precedence; the group `v` is what is replaced
    "email": r"(?<![\w.%+-])(?P<v>[\w%+-]+(?:\.[\w%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w-])",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))\s*[=:]\s*[\"']?(?P<v>(?=[^\s\"']*\d)[A-Za-z0-9+/_=-]{8,})",
    "key": r"\b(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})\b",
    "iban": r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ip": rf"(?<![\w.])(?P<v>{_OCTET}(?:\.{_OCTET}){{3}})(?![\w]|\.\d)",
    "card": r"(?<![\w+-])(?P<v>\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}|3[47]\d{2}([ -]?)\d{6}\3\d{5})(?![\w-])",
    "phone": r"(?<![\w+])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "ssn": r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])",
    "person": rf"\b(?:(?:{'|'.join(GENDER)})\.?\s+(?P<v>{_NAME}(?: {_NAME}){{0,2}})|(?P<w>(?:{'|'.join(n.capitalize() for n in KNOWN)}) {_NAME}))",
}
_COMPILED = {kind: re.compile(p) for kind, p in PATTERNS.items()}
_SIGNS = re.compile(r"[0-9@=:]")
_NUMBERS = re.compile(r"\d")
_WORDS = re.compile(r"[^\W\d_]+")
_CALLED = frozenset(GENDER) | {n.capitalize() for n in KNOWN}


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities as (start, end, kind, gender), in order and apart; earlier kinds take precedence."""
    found: list[tuple[int, int, str, str]] = []
    signs = _SIGNS.search(text) is not None
    people = not _CALLED.isdisjoint(_WORDS.findall(text))
    digits = signs and _NUMBERS.search(text) is not None
    for kind, pattern in _COMPILED.items():
        if kind == "person" and not people or kind != "person" and not signs or kind == "email" and "@" not in text or kind in ("iban", "ip", "card", "phone", "ssn") and not digits:
            continue
        for m in pattern.finditer(text):
            group = "w" if kind == "person" and m["v"] is None else "v"
            gender = ""
            if kind == "person":
                gender = KNOWN[m["w"].split(" ")[0].lower()][1] if group == "w" else GENDER[re.split(r"[.\s]", m[0])[0]]
            found.append((*m.span(group), kind, gender))
    kept: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    for start, end, kind, gender in found:  # in order of precedence
        if all(end <= a or start >= b for a, b in taken):
            kept.append((start, end, kind, gender))
            taken.append((start, end))
    return _mentions(text, sorted(kept)) if people else sorted(kept)


def _mentions(text: str, kept: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """With later bare mentions of the parts of persons.  Genders of given names that stand alone end with a +."""
    first = next((k[0] for k in kept if k[2] == "person"), None)
    if first is None:
        return kept
    parts: dict[str, str] = {}  # gender of what is known so far; given names by their own
    out: list[tuple[int, int, str, str]] = []
    at = 0
    for m in _WORDS.finditer(text, first):
        while at < len(kept) and kept[at][0] <= m.start():
            start, end, kind, gender = kept[at]
            if kind == "person":
                names = text[start:end].split(" ")
                if len(names) == 1 and parts.get(names[0], "").endswith("+"):
                    gender = parts[names[0]]  # the same person with a title
                for i, name in enumerate(names):
                    parts.setdefault(name, gender.rstrip("+") + "+" if i < len(names) - 1 else gender)
            out.append((start, end, kind, gender))
            at += 1
        if m[0] in parts and m[0] not in NO_NAMES and m.start() >= out[-1][1] and (at == len(kept) or m.end() <= kept[at][0]):
            before, after = text[m.start() - 1:m.start()], text[m.end():m.end() + 1]
            if not (before.isdigit() or after.isdigit() or "_" in (before, after)):
                out.append((*m.span(), "person", parts[m[0]]))
    return kept[:next(i for i, k in enumerate(kept) if k[2] == "person")] + [o for o in out if o[0] >= first] + kept[at:]


def entity(kind: str, value: str) -> str:
    """What mentions of one entity have in common: case where it doesn't matter, separators where they don't."""
    return value.lower() if kind in ("email", "person") else value


class Keyed:
    """Surrogates under one key.  `again`: (kind, entity) → number of a further draw."""

    def __init__(self, key: bytes, again: dict[tuple[str, str], int] | None = None) -> None:
        self.key, self.again = blake2b(key).digest(), again or {}
        self.surrogate = lru_cache(maxsize=50_000)(self._surrogate)

    def _mix(self, tweak: bytes, turn: int, value: int, bits: int) -> int:
        data = blake2b(turn.to_bytes(1, "big") + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big") + b"|" + tweak, key=self.key, digest_size=64).digest()
        return int.from_bytes(data, "big") & ((1 << bits) - 1)

    def _shuffle(self, x: int, size: int, tweak: bytes, back: bool) -> int:
        """A keyed permutation of range(size), or its inverse: Feistel rounds, walked until inside."""
        bits = max(2, (size - 1).bit_length())
        low = bits // 2
        turns = range(ROUNDS)[::-1] if back else range(ROUNDS)
        while True:
            a, b = x >> low, x & ((1 << low) - 1)
            for turn in turns:
                if turn % 2:
                    b ^= self._mix(tweak, turn, a, low)
                else:
                    a ^= self._mix(tweak, turn, b, bits - low)
            x = a << low | b
            if x < size:
                return x

    def _next(self, x: int, size: int, tweak: bytes) -> int:
        """One step along a keyed cycle through all of range(size): a permutation without fixed points."""
        if size < 2:
            return x
        return self._shuffle((self._shuffle(x, size, tweak, False) + 1) % size, size, tweak, True)

    def exchange(self, value: str, alphabets: list[str], tweak: str, valid: Callable[[str], bool] | None = None) -> str:
        """Exchanges every character with one of its alphabet; characters without an alphabet stay.

        With `valid`, walks on until valid(result) is as valid(value): still one to one.  Long values go in chunks.
        """
        places = [i for i, a in enumerate(alphabets) if len(a) > 1 and value[i] in a]
        out = list(value)
        while True:
            for at in range(0, len(places), CHUNK):
                chunk = places[at:at + CHUNK]
                size, number = 1, 0
                for i in chunk:
                    number = number * len(alphabets[i]) + alphabets[i].index(out[i])
                    size *= len(alphabets[i])
                number = self._next(number, size, f"{tweak}|{at}|{len(places)}".encode())
                for i in reversed(chunk):
                    number, digit = divmod(number, len(alphabets[i]))
                    out[i] = alphabets[i][digit]
            if valid is None or valid("".join(out)) == valid(value):
                return "".join(out)

    def _surrogate(self, kind: str, value: str, gender: str) -> str:
        """Of an entity; see entity()."""
        draw = self.again.get((kind, value), 0)
        tweak = f"{kind}|{draw}" if draw else kind
        if kind == "email":
            top = value.rindex(".")
            return self.exchange(value, [_letters(c) if i < top else "" for i, c in enumerate(value)], tweak)
        if kind == "ip":
            return self._ip(value, tweak)
        if kind == "card":
            brand = 2 if sum(c.isdigit() for c in value) == 15 else 1
            return self.exchange(value, ["" if i < brand or not c.isdigit() else DIGITS for i, c in enumerate(value)], tweak, _luhn)
        if kind in ("phone", "ssn"):
            start = re.match(r"\+\d{1,3}(?=\D)|\+\d|", value).end()
            return self.exchange(value, [_leading(value, i) if i >= start else "" for i in range(len(value))], tweak)
        if kind == "iban":
            return self.exchange(value, ["" if i < 2 else _letters(c) for i, c in enumerate(value)], tweak, _mod97)
        if kind == "key":
            start = re.match(r"AKIA|ASIA|gh._|sk-", value).end()
            return self.exchange(value, ["" if i < start else _letters(c) for i, c in enumerate(value)], tweak)
        if kind == "person":
            return self._person(value, gender, tweak)
        hexadecimal = re.fullmatch(r"[0-9a-f]+", value) is not None
        return self.exchange(value, ["0123456789abcdef" if hexadecimal else _letters(c) for c in value], tweak + "x" * hexadecimal,
                             (lambda v: re.fullmatch(r"[0-9a-f]+", v) is not None) if not hexadecimal else None)

    def _ip(self, value: str, tweak: str) -> str:
        """Octets keep their number of digits."""
        ranges = [{1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(o)] for o in value.split(".")]
        size, number = 1, 0
        for octet, (low, many) in zip(value.split("."), ranges, strict=True):
            size, number = size * many, number * many + int(octet) - low
        number, out = self._next(number, size, f"{tweak}|{size}|{ranges}".encode()), []
        for low, many in reversed(ranges):
            number, digit = divmod(number, many)
            out.append(str(low + digit))
        return ".".join(reversed(out))

    def _person(self, value: str, gender: str, tweak: str) -> str:
        """Listed given names within their list, also alone or last; other given names by gender, the rest by sound, outside of all lists."""
        parts, out = value.split(" "), []
        for i, part in enumerate(parts):
            script, of = KNOWN.get(part, ("", ""))
            if of:
                names = GIVEN[script, of]
                out.append(names[self._next(names.index(part), len(names), f"{tweak}|{script}|{of}".encode())])
            elif gender and (i < len(parts) - 1 or gender.endswith("+")):
                out.append(self._gendered(part, gender[0], tweak))
            else:
                out.append(self._by_sound(part, tweak))
        return " ".join(out)

    def _gendered(self, part: str, gender: str, tweak: str) -> str:
        """Of a given name that isn't listed: one with an ending of its gender.  One to one.

        Names with such an ending keep it, others get one; the latter end with a syllable that the former don't end with.
        """
        script = "greek" if "ͱ" <= part[0] <= "Ͽ" else "cyrillic" if "Ѐ" <= part[0] <= "ӿ" else "latin"
        ends, more = ENDINGS[script, gender]
        own = part[-1] in ends and not part.endswith(more)
        tweak = f"{tweak}|{gender}|{own}"
        keep = 1 if own else len(more) if part.endswith(more) else 0  # a first letter is always exchanged
        stem = self.exchange(part, [next((s for s in SOUNDS if c in s), "") if j < max(1, len(part) - keep) else "" for j, c in enumerate(part)], tweak,
                             lambda v: v in KNOWN or own and v.endswith(more) or not own and v[-1] in ends and not v.endswith(more))
        return stem if own else stem + more

    def _by_sound(self, part: str, tweak: str) -> str:
        """Of a name that isn't listed: another one, in as many steps as there are listed names, and one, at most."""
        last = len(part) - 1  # an ending in a vowel often tells the gender
        sounds = [next((s for s in SOUNDS if c in s), "") if j < last or c not in "aаeα" else "" for j, c in enumerate(part)]
        return self.exchange(part, sounds, tweak, lambda v: v in KNOWN)

    def mention(self, kind: str, value: str, gender: str) -> str:
        """Surrogate of a mention, in its case."""
        got = self.surrogate(kind, entity(kind, value), gender)
        return "".join(g.upper() if v.isupper() else g for g, v in zip(got, value, strict=True)) if kind == "email" else _cased(got, value) if kind == "person" else got

    def replace(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and its entities as (kind, entity, surrogate)."""
        out, at, seen = [], 0, []
        for start, end, kind, gender in find(text):
            value = text[start:end]
            out += [text[at:start], self.mention(kind, value, gender)]
            seen.append((kind, entity(kind, value), self.surrogate(kind, entity(kind, value), gender)))
            at = end
        return ("".join([*out, text[at:]]) if seen else text), seen


def _letters(c: str) -> str:
    if c in DIGITS:
        return DIGITS
    return next((a if c in a else a.upper() for a in LETTERS if c in a or c in a.upper()), "")


def _leading(value: str, i: int) -> str:
    """Digits; the first of a group of three or more stays within 0-1 or 2-9."""
    if value[i] not in DIGITS:
        return ""
    first = (i == 0 or value[i - 1] not in DIGITS) and value[i:i + 3].isdigit() and len(value[i:i + 3]) == 3
    return DIGITS if not first else "01" if value[i] in "01" else "23456789"


def _luhn(value: str) -> bool:
    digits = [int(c) for c in reversed(value) if c in DIGITS]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _mod97(value: str) -> bool:
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _cased(surrogate: str, value: str) -> str:
    return " ".join(s.upper() if len(v) > 1 and v.isupper() else s.capitalize() if v[0].isupper() else s
                    for s, v in zip(surrogate.split(" "), value.split(" "), strict=True))


ENTITIES = "kind string, entity string, surrogate string"


def entities(docs: DataFrame, key: bytes, again: dict[tuple[str, str], int] | None = None, text_col: str = "text") -> DataFrame:
    """The distinct entities of all documents and their surrogates; each task drops its own repeats first."""

    def run(batches: Batches) -> Batches:
        keyed = Keyed(key, again)
        for batch in slices(batches):
            rows = sorted({e for t in batch.column(0).to_pylist() if t for e in keyed.replace(t)[1]})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "entity", "surrogate"])

    return bounded_batches(docs).select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENTITIES).distinct()


def redrawn(docs: DataFrame, key: bytes, text_col: str = "text", most: int = MOST_REDRAWN) -> dict[tuple[str, str], int]:
    """Entities that share a surrogate with a smaller one, with the draw that parts them; empty as a rule."""
    again: dict[tuple[str, str], int] = {}
    for draw in range(1, 9):
        groups = entities(docs, key, again, text_col).groupBy("kind", "surrogate").agg(F.min("entity").alias("first"), F.count("*").alias("n")).where("n > 1")
        if groups.isEmpty():
            return again
        shared = entities(docs, key, again, text_col).join(groups, ["kind", "surrogate"]).where("entity <> first").select("kind", "entity").limit(most + 1).collect()
        again |= {(r.kind, r.entity): draw for r in shared}
        if len(again) > most:
            raise RuntimeError("too many entities share surrogates")
    raise RuntimeError("surrogates could not be parted")


def surrogate_texts(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_entities and kinds (with repeats, in order) of every row; nothing is shuffled but distinct entities.

    Null texts stay null, empty ones empty; texts without entities come back as they are.
    """
    again = redrawn(docs, key, text_col)

    def run(batches: Batches) -> Batches:
        keyed = Keyed(key, again)
        for batch in slices(batches):
            rows = [keyed.replace(t) if t else (t, []) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[1]) for r in rows], pa.int64()),
                                              pa.array([[e[0] for e in r[1]] for r in rows], pa.list_(pa.string()))], ["doc_id", "text", "n_entities", "kinds"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_entities long, kinds array<string>")


def private_documents(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The documents with surrogates in their text, all other columns as they were."""
    again, at = redrawn(docs, key, text_col), docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        keyed = Keyed(key, again)
        for batch in slices(batches):
            texts = pa.array([keyed.replace(t)[0] if t else t for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return bounded_batches(docs).mapInArrow(run, docs.schema)
