"""Personal data replaced by keyed surrogates of the same type and format.

Detected entities (e-mail addresses, card numbers, IBANs, IP addresses, phone
numbers, social security numbers, person names) are replaced by values that a
secret key derives from them:

* Letters and digits change within their class (digit, vowel or consonant, in
  each case of the Latin, Cyrillic and Greek scripts) by a keyed Feistel
  network over the mixed radix number they spell. For a given pattern this is
  a bijection, so different entities stay different, and it depends on the
  canonical entity alone, so the same entity gets the same surrogate in every
  text, whatever its separators or case.
* Card numbers keep a valid Luhn digit, IBANs valid check digits, IP addresses
  valid octets, e-mail addresses their top-level domain; the mail domain is a
  surrogate of its own, shared by all addresses in it.
* A given name becomes another of its list, which is of one gender and one
  script, by a keyed permutation of the list; family names are spelled anew.
  A title stays and so states the gender of a name that no list has.
* No entity is its own surrogate: spelling is a permutation with one single
  cycle, the keyed bijection's conjugate of adding one.
* The words of names found by a title or a list are names in the rest of the
  same text too ('Mr John Smith ... Smith left').

A check over the table of distinct entities verifies that no two entities of a
kind share a surrogate; if any did, all of that kind would be keyed again.

Nulls and edges: a null text is empty; overlapping finds keep the kind listed
first; rows that repeat are replaced alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tasks import id_and_text, map_columns
from cairn.plans.durable import materialize

#: Character classes, within which characters are replaced.
CLASSES = [
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "àâäáéèêëíìîïóòôöúùûü", "ÀÂÄÁÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ",
]

#: Given names by gender and script.
GIVEN = {
    "female latin": "Alice Anna Camille Carmen Charlotte Claire Clara Elena Emma Eva Grace Hannah Helen Ingrid Isabel Jane Julia Karin Laura Lucy Maria Marie Martha Nina Olivia Paula Rosa Ruth Sarah Sofia",
    "male latin": "Adam Albert Andreas Carlos Charles Daniel David Diego Emil Felix Frank George Hans Henry Hugo Jack James Jean Johann John Jonas Juan Karl Louis Lukas Martin Oscar Paul Peter Thomas",
    "female cyrillic": "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Полина Татьяна",
    "male cyrillic": "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей",
    "female greek": "Αθηνα Ελενη Ιωαννα Κατερινα Μαρια Σοφια",
    "male greek": "Αλεξης Γιωργος Δημητρης Κωστας Νικος Πετρος",
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora Господин Госпожа Доктор Профессор Κύριος Κυρία Κυριος Κυρια".split()

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-.")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*")
TOP = re.compile(r"\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DIGIT_RUN = re.compile(r"(?<![\d.-])\d(?:[\x20-]?\d){12,}+")
GROUP = re.compile(r"[^\x20]+")
IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
PHONE = re.compile(
    r"(?<![\w+])\+[1-9](?:\)?[\x20.-]?\(?\d){6,14}(?!\w)"
    r"|(?<![\w+(])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?|\d{2,4}[\x20.-])\d{3,4}[\x20.-]\d{3,4}(?!\w)"
    r"|(?<![\w+(])\(\d{2,4}\)[\x20.-]?\d{6,8}(?!\w)"
)
TITLED = re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.?\x20)+(?=[^\W\d_])")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*+")
LETTERS = re.compile(r"[^\W\d_]+")
NEXT_WORD = re.compile(rf"\x20({WORD.pattern})")
CAPITALISED = re.compile(rf"(?<![^\W\d_])(?=[^\W\d_a-z]){WORD.pattern}")
DIGITS = re.compile(r"\d")
#: Each digit's double, with its digits added.
DOUBLED = str.maketrans("0123456789", "0246813579")
KINDS = ["email", "iban", "card", "ip", "ssn", "phone", "name"]

_PLACE = {c: (k, i) for k, chars in enumerate(CLASSES) for i, c in enumerate(chars)}
_GIVEN = {name.lower(): (name, kind) for kind, names in GIVEN.items() for name in names.split()}


def luhn(digits: str) -> bool:
    doubled = digits[-2::-2].translate(DOUBLED)
    return (sum(map(int, digits[::-2])) + sum(map(int, doubled))) % 10 == 0


def iban_remainder(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


class Surrogates:
    """Keyed bijections; ``attempt`` by kind changes all of that kind's surrogates."""

    def __init__(self, key: bytes, attempt: dict[str, int] | None = None):
        self.key, self.attempt = key, attempt or {}
        self.spell = lru_cache(1 << 16)(self._spell)

    def _number(self, kind: str, *parts) -> int:
        data = "\x1f".join([kind, str(self.attempt.get(kind.split(":")[0], 0)), *map(str, parts)])
        return int.from_bytes(hmac.new(self.key, data.encode(), hashlib.sha256).digest(), "big")

    def permute(self, kind: str, radices: tuple[int, ...], values: list[int]) -> list[int]:
        """A keyed permutation of the mixed radix numbers, in one cycle: back through a keyed bijection, one further, and forth again.

        The bijection has alternating halves, each shifted by a keyed function of the other.
        """
        half = len(radices) // 2
        sides = []
        for r, v in ((radices[:half], values[:half]), (radices[half:], values[half:])):
            number, size = 0, 1
            for base, digit in zip(r, v, strict=True):
                number, size = number * base + digit, size * base
            sides.append([number, size])
        for step in reversed(range(8)):
            one, other = sides[step % 2], sides[1 - step % 2]
            one[0] = (one[0] - self._number(kind, radices, step, other[0])) % one[1]
        sides[1][0] += 1
        if sides[1][0] == sides[1][1]:
            sides[0][0], sides[1][0] = (sides[0][0] + 1) % sides[0][1], 0
        for step in range(8):
            one, other = sides[step % 2], sides[1 - step % 2]
            one[0] = (one[0] + self._number(kind, radices, step, other[0])) % one[1]
        out = []
        for r, (number, _) in ((radices[half:], sides[1]), (radices[:half], sides[0])):
            for base in reversed(r):
                number, digit = divmod(number, base)
                out.append(digit)
        return out[::-1]

    def _spell(self, kind: str, value: str) -> str:
        """Characters of a class by others of it; all others stay."""
        at = [(k, _PLACE[c]) for k, c in enumerate(value) if c in _PLACE]
        new = self.permute(kind, tuple(len(CLASSES[c]) for _, (c, _) in at), [i for _, (_, i) in at])
        out = list(value)
        for (k, (c, _)), i in zip(at, new, strict=True):
            out[k] = CLASSES[c][i]
        return "".join(out)

    def recased(self, kind: str, value: str) -> str:
        """By the lower-case form, which is the entity; capitals come back where they were."""
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        return "".join(n.upper() if c != x else n for c, x, n in zip(value, low, self.spell(kind, low), strict=True))

    def given(self, name: str) -> str:
        """Another name of the list, in capitals or small letters where ``name`` is."""
        listed, kind = _GIVEN[name.lower()]
        order = sorted(GIVEN[kind].split(), key=lambda n: self._number("name:given", n))
        new = order[(order.index(listed) + 1) % len(order)]
        return new.upper() if name.isupper() else new.lower() if name.islower() else new

    def family(self, name: str) -> str:
        """Spelled anew, again while that gives a listed given name: a bijection of the other words."""
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in name)
        new = self.spell("name:family", low)
        while new in _GIVEN and new != low:
            new = self.spell("name:family", new)
        return "".join(n.upper() if c != x else n for c, x, n in zip(name, low, new, strict=True))

    def of(self, kind: str, value: str) -> str:
        if kind == "email":
            local, _, domain = value.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.recased('email:local', local)}@{self.recased('email:domain', host)}.{top}"
        if kind == "iban":
            code = value.replace(" ", "")
            new = code[:2] + "00" + self.spell("iban", code[4:])
            return self._laid(value, f"{new[:2]}{98 - iban_remainder(new):02d}{new[4:]}")
        if kind == "card":
            digits = "".join(DIGITS.findall(value))
            body = digits[0] + self.spell("card", digits[1:-1])
            check = next(str(d) for d in range(10) if luhn(body + str(d)))
            return self._laid(value, body + check)
        if kind == "ip":
            octets = [int(x) for x in value.split(".")]
            return ".".join(map(str, self.permute("ip", (256,) * 4, octets)))
        if kind in ("ssn", "phone"):
            digits = "".join(DIGITS.findall(value))
            return self._laid(value, self.spell(kind, digits))
        return WORD.sub(lambda m: m[0] if m[0] in TITLES else self.given(m[0]) if m[0].lower() in _GIVEN else self.family(m[0]), value)

    @staticmethod
    def _laid(value: str, code: str) -> str:
        """``code`` in the places of the letters and digits of ``value``."""
        rest = iter(code)
        return "".join(next(rest) if c.isalnum() else c for c in value)


def canonical(kind: str, value: str) -> str:
    """What makes two finds the same entity."""
    if kind in ("card", "ssn", "phone"):
        return "".join(DIGITS.findall(value))
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return value.lower() if kind == "email" else " ".join(w.lower() for w in WORD.findall(value) if w not in TITLES)


def email_spans(text: str) -> list[tuple[int, int]]:
    """Addresses from each @ outwards: every character is looked at once, however long the runs."""
    out, upto = [], 0
    for m in DOMAIN.finditer(text):
        a = m.start()
        while a > upto and text[a - 1] in LOCAL:
            a -= 1
        dots = text.rfind("..", a, m.start())
        a = dots + 2 if dots >= 0 else a
        while a < m.start() and text[a] == ".":
            a += 1
        upto = m.start() + 1
        if a == m.start() or text[m.start() - 1] == ".":
            continue
        # the domain ends behind the last label that may be a top-level domain
        end = m.end()
        while (dot := text.rfind(".", m.start(), end)) >= 0 and not (top := TOP.match(text, dot, end)):
            end = dot
        if dot >= 0:
            out.append((a, top.end()))
            upto = top.end()
    return out


def card_spans(text: str) -> list[tuple[int, int]]:
    """Of each run of digits, the stretches of whole groups with 13 to 19 digits and a valid check digit; at each start the longest."""
    out = []
    for run in DIGIT_RUN.finditer(text):
        groups = [(m.start() + run.start(), m.end() + run.start(), m[0].replace("-", "")) for m in GROUP.finditer(run[0])]
        digits = "".join(g[2] for g in groups)
        at = [0, *accumulate(len(g[2]) for g in groups)]
        # running check sums with the digits at odd and at even places doubled
        pairs = list(zip(map(int, digits), map(int, digits.translate(DOUBLED)), strict=True))
        sums = [[0, *accumulate(x[(k + odd) % 2] for k, x in enumerate(pairs))] for odd in (0, 1)]
        k = 0
        while k < len(groups):
            valid = None
            for j in range(k + 1, bisect_right(at, at[k] + 19)):
                check = sums[(at[j] - 1) % 2]
                if at[j] - at[k] >= 13 and (check[at[j]] - check[at[k]]) % 10 == 0:
                    valid = j
            if valid is not None:
                out.append((groups[k][0], groups[valid - 1][1]))
            k = k + 1 if valid is None else valid
    return out


@lru_cache(1 << 10)
def _any_of(names: frozenset[str]) -> re.Pattern:
    return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(sorted(names))})(?![^\W\d_])", re.IGNORECASE)


def name_spans(text: str) -> list[tuple[int, int]]:
    """Names behind a title, and listed given names in any case.

    A capitalised word after the first is part of the name; a third one and
    more only after given names ('Anna Maria Schmidt'). Hyphens and apostrophes
    between letters belong to a word. The words of all names so found, where
    they stand alone in the text with their capital, are names as well.
    """
    starts = []  # (start, where the first name word starts)
    if any(t in text for t in TITLES):
        starts += [(m.start(), m.end()) for m in TITLED.finditer(text)]
    listed = _GIVEN.keys() & set(LETTERS.findall(text.lower()))
    if listed:
        starts += [(m.start(), m.start()) for m in _any_of(frozenset(listed)).finditer(text) if m[0].lower() in _GIVEN]
    out, upto = [], 0
    for a, first in sorted(starts):
        word = WORD.match(text, first)
        if first < upto or word[0] in TITLES or not (a == first or word[0][0].isupper()):
            continue
        a, b, n, last = max(a, upto), word.end(), 1, word[0]
        while (n < 2 or last.lower() in _GIVEN) and (m := NEXT_WORD.match(text, b)) and m[1][0].isupper() and m[1] not in TITLES:
            b, n, last = m.end(), n + 1, m[1]
        out.append((a, b))
        upto = b
    words = {w for a, b in out for w in WORD.findall(text[a:b]) if len(w) > 1 and w[0].isupper() and w not in TITLES}
    if not words:
        return out
    again, spans, last = [], iter([*out, (len(text) + 1, len(text) + 1)]), (0, 0)
    for m in CAPITALISED.finditer(text):
        while last[1] <= m.start():
            last = next(spans)
        if m[0] in words and m.end() <= last[0]:
            if again and text[again[-1][1] : m.start()] == " ":
                again[-1] = (again[-1][0], m.end())
            else:
                again.append(m.span())
    return sorted(out + again)


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, not overlapping."""
    found: list[tuple[int, int, str]] = []

    def take(kind: str, spans) -> None:
        earlier = found.copy()
        for a, b in spans:
            k = bisect_left(earlier, (b,))  # those before k start before b, and the last of them ends last
            if not k or earlier[k - 1][1] <= a:
                found.append((a, b, kind))
        found.sort()

    if "@" in text:
        take("email", email_spans(text))
    if DIGITS.search(text):
        take("iban", [m.span() for m in IBAN.finditer(text) if iban_remainder(m[0].replace(" ", "")) == 1])
        take("card", card_spans(text))
        take("ip", [m.span() for m in IP.finditer(text) if all(int(x) < 256 for x in m[0].split("."))])
        take("ssn", [m.span() for m in SSN.finditer(text)])
        take("phone", [m.span() for m in PHONE.finditer(text)])
    take("name", name_spans(text))
    return found


MADE = "entities array<struct<kind:string,start:int,end:int,entity:string,surrogate:string>>, masked string"


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", attempt: dict[str, int] | None = None) -> DataFrame:
    """(id, entities, masked): each row's finds with their surrogates, and its text with these in place."""

    def run(batch: pa.RecordBatch) -> dict:
        keyed = Surrogates(key, attempt)
        out = {"entities": [], "masked": []}
        for text in batch.column("text").to_pylist():
            entities, parts, at = [], [], 0
            for a, b, kind in find_entities(text):
                new = keyed.of(kind, text[a:b])
                entities.append({"kind": kind, "start": a, "end": b, "entity": canonical(kind, text[a:b]), "surrogate": new})
                parts += [text[at:a], new]
                at = b
            out["entities"].append(entities)
            out["masked"].append("".join([*parts, text[at:]]))
        return out

    return map_columns(id_and_text(docs, id_col, text_col), ["id"], MADE, run).withColumnRenamed("id", id_col)


def collisions(found: DataFrame) -> DataFrame:
    """(kind, surrogate, n): canonical surrogates that ``n`` > 1 different entities share."""
    e = found.where(F.size("entities") > 0).select(F.explode("entities").alias("e"))
    digits = F.regexp_replace(F.lower("e.surrogate"), r"[\s().+-]", "")
    words = F.regexp_extract_all(F.lower("e.surrogate"), F.lit(r"(\p{L}+(?:['’-]\p{L}+)*)"))
    own = F.size(F.split("e.entity", " "))  # the words behind the title
    name = F.array_join(F.slice(words, F.greatest(F.size(words) - own + 1, F.lit(1)), own), " ")
    shown = F.when(F.col("e.kind").isin("card", "ssn", "phone", "iban"), digits).when(F.col("e.kind") == "name", name).otherwise(F.lower("e.surrogate"))
    pairs = e.select(F.col("e.kind").alias("kind"), F.col("e.entity").alias("entity"), shown.alias("surrogate"))
    return pairs.distinct().groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def surrogate_digests(docs: DataFrame, key: bytes | None = None, id_col: str = "doc_id", text_col: str = "text", attempts: int = 4) -> DataFrame:
    """One row per input row: id, n_entities, spans (kind:start:end:surrogate), masked_sha256; checked for collisions.

    Without a key the run draws one of its own, so that its surrogates can't be undone or linked to another run's.
    """
    key = key or os.urandom(32)
    attempt: dict[str, int] = {}
    for _ in range(attempts):
        made = replace_entities(docs, key, id_col, text_col, attempt).withColumn("masked_sha256", F.sha2("masked", 256)).drop("masked")
        made = materialize(made, "entities")
        clash = [r["kind"] for r in collisions(made).select("kind").distinct().collect()]  # one of KINDS each
        if not clash:
            shown = F.transform(
                "entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"), e["surrogate"])
            )
            return made.select(id_col, F.size("entities").cast("long").alias("n_entities"), F.array_join(shown, ",").alias("spans"), "masked_sha256")
        for kind in clash:
            attempt[kind] = attempt.get(kind, 0) + 1
    raise RuntimeError(f"surrogates of {clash} still collide")
