"""Surrogates for personal data: keyed, of the same type and format, distinct where the originals are.

Entities: e-mail addresses, telephone, card and social security numbers, IPv4 addresses, secrets (access keys, assigned
passwords and tokens) and persons' names after a form of address or with a known given name. A surrogate is the image of
the entity under a keyed permutation of the canonical values of its type: a Feistel network over its letters, another
over its digits. The canonical value leaves out how the entity is written: the separators and the country code of an
American number, the blanks of a card, the case of an address or a name. The surrogate is then written in the format that
was found, so "+1 (988) 555-2485" and "988-555-2485" stay one number. A permutation can't send two entities to one
surrogate, on any partition or executor, so coreference and distinctness need no exchange between rows. Values that a
type excludes are walked past along the permutation, which stays one: reserved address ranges, area codes, and names that
the lists of given names hold. Cards are numbers of a known issuer with a right check digit, and stay that.

Names are replaced part by part, so "Ms Lopez" and "Maria Lopez" keep their common surname. Listed given names change
places within their gender and script; other parts keep the pattern of vowels and consonants, the script, the case and
the last letter, which carries the gender in many languages. ``collisions`` compares canonical values: it finds two
entities with one surrogate, an entity with two, and surrogates that are other entities; ``anonymise_checked`` raises for
the first two over the whole table.

Defined results: a null text stays null, an empty one empty, neither has entities; a text of any length is searched whole,
in one task, and an entity is never longer than a line's run of its characters; repeated rows get equal results; a null
doc_id stays null; an empty table gives no rows; further columns are kept, whatever they hold: where one has the name of
the list of entities, that list's name gets underscores until it is free. Entities never overlap: of two that do, the
first to start wins, then the earlier type in the list above, then the longer one.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..deploy import ship
from .common import free_name, lean, slices, written

EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
NUMBER = re.compile(r"[+(]?\d[\d .()\-]*\d")
# No letter, digit or underscore before the entity, no letter or digit after it; whatever else the run of numbers holds.
BEFORE, AFTER = r"(?<!\w)", r"(?![^\W_])"
PHONE = re.compile(rf"{BEFORE}(?:\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}|\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}}){AFTER}")
CARD = re.compile(rf"{BEFORE}(?:\d{{13,19}}|\d{{4}}([ -])\d{{4}}\1\d{{4}}\1\d{{1,7}}|\d{{4}}([ -])\d{{6}}\2\d{{5}}){AFTER}")
SSN = re.compile(rf"{BEFORE}\d{{3}}-\d{{2}}-\d{{4}}{AFTER}")
IPV4 = re.compile(rf"{BEFORE}(?<!\d\.)(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){{3}}{AFTER}(?!\.\d)")
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")
ASSIGNED = re.compile(r"""(?i)(?<![a-z])(?:pass(?:word|wd)|pwd|secret|token|api[_-]?key)["']?\s*[=:]\s*["']?([^\s"']{5,}[^\s"'.,;:!?)\]])""")
# Forms of address (they stay in the text, and say what gender they say) and given names by script and gender.
ADDRESS = "Mr Mister Sir Herr Monsieur Señor Mrs Ms Miss Madam Frau Madame Mme Señora Dr Prof Professor Doctor Господин Госпожа Κύριος Κυρία".split()
GIVEN = {
    ("latin", "f"): "Alice Anna Camille Carmen Charlotte Claire Clara Elena Emily Emma Grace Hannah Heidi Isabel Julia Laura Lucia Maria Sofia Sophie".split(),
    ("latin", "m"): "Andreas Antonio Carlos Charles David Diego Felix Hans Henri Jack James John Jonas Luis Lukas Marc Michael Paul Peter Thomas".split(),
    ("cyrillic", "f"): "Алина Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Ольга".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Максим Николай Павел Сергей".split(),
}
ALPHABETS = {"latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "cyrillic": ("аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"), "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
SCRIPTS = {"cyrillic": re.compile("[Ѐ-ӿ]"), "greek": re.compile("[Ͱ-Ͽ]")}
# issuers' first digits and lengths of card numbers, and the two-digit country codes (1 and 7 have one digit, others three).
ISSUERS = re.compile(r"4\d{12}(?:\d{3}){0,2}|(?:5[1-5]|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d+|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11,16}|35(?:2[89]|[3-8]\d)\d{12,15}|6\d{15,18}")
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
LISTED = {name: (script, gender, i) for (script, gender), names in GIVEN.items() for i, name in enumerate(names)}
LOWER_HEX, UPPER_HEX, LETTERS = "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz"
_PART = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я][^\W\d_]*(?:[-'’](?!s\b)[^\W\d_]+)*"
NAME = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(ADDRESS)})\.?[ \t]+(?P<named>{_PART}(?:[ \t]+{_PART}){{0,2}})|(?P<given>{'|'.join(LISTED)})[ \t]+(?P<family>{_PART}))(?!\w)")


class Cipher:
    """Keyed permutations of {0, ..., size - 1}, and of strings by their format."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, size: int, step: int, x: int) -> int:
        data = f"{tweak}\0{size}\0{step}\0{x}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16 + size.bit_length() // 8).digest(), "big")

    def number(self, x: int, size: int, tweak: str, rounds: int = 8) -> int:
        """An unbalanced Feistel network over a pair of residues, walked until the value is below size."""
        if size < 2:
            return x
        a = 1
        while a * a < size:
            a += 1 if size < 1 << 20 else max(1, (1 << (size.bit_length() + 1) // 2) - a)
        b = -(-size // a)
        while True:
            high, low = divmod(x, b)
            for step in range(rounds):
                if step % 2:
                    low = (low + self._round(tweak, size, step, high)) % b
                else:
                    high = (high + self._round(tweak, size, step, low)) % a
            x = high * b + low
            if x < size:
                return x

    def letters(self, text: str, alphabets: list[str], tweak: str) -> str:
        """Replaces each character by one of its alphabet; the alphabets of all places are part of the tweak."""
        x, size = 0, 1
        for c, alphabet in zip(text, alphabets, strict=True):
            x, size = x * len(alphabet) + alphabet.index(c), size * len(alphabet)
        x, out = self.number(x, size, tweak), []
        for alphabet in reversed(alphabets):
            x, i = divmod(x, len(alphabet))
            out.append(alphabet[i])
        return "".join(reversed(out))

    def shaped(self, text: str, kind: str) -> str:
        """Digits stay digits, letters letters of their case, hexadecimal text hexadecimal; the rest stays."""
        plain = "".join(c for c in text if c.isascii() and c.isalnum())
        for name, alphabet in (("hex", LOWER_HEX), ("HEX", UPPER_HEX)):
            if len(plain) >= 8 and not plain.isdigit() and not set(plain) - set(alphabet):
                return self._fill(text, lambda c, a=alphabet: a, f"{kind}:{name}", lambda out: out.isdigit())
        hexes = (set(LOWER_HEX), set(UPPER_HEX))
        choose = lambda c: "0123456789" if c.isdigit() else LETTERS if c.islower() else LETTERS.upper()
        return self._fill(text, choose, kind, lambda out: len(out) >= 8 and not out.isdigit() and any(not set(out) - h for h in hexes))

    def _fill(self, text: str, choose: Callable[[str], str], kind: str, excluded: Callable[[str], bool]) -> str:
        places = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
        sets = [choose(text[i]) for i in places]
        kept = list(text)
        for i in places:
            kept[i] = "0" if kept[i].isdigit() else "A" if kept[i].isupper() else "a"
        tweak, out = f"{kind}\0{''.join(kept) if not kind.lower().endswith(':hex') else len(places)}", "".join(text[i] for i in places)
        out = self.letters(out, sets, tweak)
        while excluded(out):
            out = self.letters(out, sets, tweak)
        result = list(text)
        for i, c in zip(places, out, strict=True):
            result[i] = c
        return "".join(result)


def _listed(name: str) -> str | None:
    """The given name of the lists that this is, as it stands there or in capitals."""
    return name if name in LISTED else name.capitalize() if name.isupper() and name.capitalize() in LISTED else None


def _put_digits(text: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """What the digits' weighted sum lacks to a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def is_card(text: str) -> bool:
    """Whether an issuer's range and the check digit fit; other long numbers are left alone."""
    digits = "".join(c for c in text if c.isdigit())
    return luhn(digits) == 0 and ISSUERS.fullmatch(digits) is not None


def dialled(text: str) -> tuple[str, str]:
    """The country code and the other digits; American where no code is written."""
    digits = "".join(c for c in text if c.isdigit())
    if not text.startswith("+"):
        return "1", digits
    n = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3
    return digits[:n], digits[n:]


def canonical(kind: str, text: str) -> str:
    """What is one and the same entity, however it is written."""
    if kind == "phone":
        return "+{} {}".format(*dialled(text))
    if kind in ("card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    return " ".join(text.lower().split()) if kind in ("email", "person") else text


class Surrogates:
    """The surrogate of each entity, by its type."""

    def __init__(self, key: bytes) -> None:
        self.cipher = Cipher(key)
        self.of = functools.lru_cache(1 << 16)(self._of)

    def _of(self, kind: str, text: str) -> str:
        return getattr(self, f"_{kind}")(text)

    def _email(self, text: str) -> str:
        local, _, domain = text.lower().partition("@")
        labels, _, top = domain.rpartition(".")
        # The domain's surrogate doesn't depend on the mailbox: colleagues stay colleagues.
        made = f"{self.cipher.shaped(local, 'mailbox')}@{self.cipher.shaped(labels, 'domain')}.{top}"
        return made if text == text.lower() else made.upper() if text == text.upper() else "".join(m.upper() if c.isupper() else m for c, m in zip(text, made, strict=True))

    def _phone(self, text: str) -> str:
        country, rest = dialled(text)
        american = country == "1" and len(rest) == 10
        usual = american and rest[0] >= "2" and rest[3] >= "2"
        while True:
            rest = self.cipher.letters(rest, ["0123456789"] * len(rest), f"phone\0{country}")
            if not american or usual == (rest[0] >= "2" and rest[3] >= "2"):
                return _put_digits(text, (country if text.startswith("+") else "") + rest)

    def _card(self, text: str) -> str:
        digits = "".join(c for c in text if c.isdigit())
        keep = {"4": 1, "5": 2}.get(digits[0], 4)  # as many as tell the issuer
        first, middle, check = digits[:keep], digits[keep:-1], digits[-1]
        fault = (int(check) - luhn(digits[:-1] + "0")) % 10
        middle = self.cipher.letters(middle, ["0123456789"] * len(middle), f"card\0{first}\0{fault}")
        return _put_digits(text, f"{first}{middle}{(luhn(first + middle + '0') + fault) % 10}")

    def _ssn(self, text: str) -> str:
        usual = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        digits = text.replace("-", "")
        kind = usual(digits)
        while True:
            digits = self.cipher.letters(digits, ["0123456789"] * 9, "ssn")
            if usual(digits) == kind:
                return _put_digits(text, digits)

    def _ip(self, text: str) -> str:
        parts = [int(x) for x in text.split(".")]
        fixed = 1 if parts[0] in (0, 10, 127) or parts[0] >= 224 else 2 if parts[0] == 172 and 16 <= parts[1] < 32 or parts[:2] in ([192, 168], [169, 254], [100, 64]) else 0
        if fixed:
            head, size = parts[:fixed], 256 ** (4 - fixed)
            x = self.cipher.number(int.from_bytes(bytes(parts[fixed:]), "big"), size, f"ip\0{head}")
            return ".".join(map(str, [*head, *x.to_bytes(4 - fixed, "big")]))
        x = int.from_bytes(bytes(parts), "big")
        while True:
            x = self.cipher.number(x, 1 << 32, "ip")
            p = list(x.to_bytes(4, "big"))
            if not (p[0] in (0, 10, 127) or p[0] >= 224 or p[0] == 172 and 16 <= p[1] < 32 or p[:2] in ([192, 168], [169, 254], [100, 64])):
                return ".".join(map(str, p))

    def _key(self, text: str) -> str:
        return text[:4] + self.cipher.shaped(text[4:], f"key\0{text[:4]}")

    def _secret(self, text: str) -> str:
        return self.cipher.shaped(text, "secret")

    def _given(self, text: str) -> str:
        if text in LISTED:
            script, gender, _ = LISTED[text]
            # One keyed circle through the list: no name is its own surrogate.
            order = sorted(GIVEN[script, gender], key=lambda n: self.cipher._round(f"given\0{n}", 2, 0, 0))
            return order[(order.index(text) + 1) % len(order)]
        return self._family(text)

    def _family(self, text: str) -> str:
        """Vowels stay vowels and consonants consonants; the last letter, accents and marks stay as they are.

        Listed given names that are surnames change places among themselves, as no other surname becomes one of them.
        """
        if listed := _listed(text):
            made = self._given(listed)
            return made if text == listed else made.upper()
        script = next((name for name, letters in SCRIPTS.items() if letters.search(text)), "latin")
        vowels, consonants = ALPHABETS[script]
        places = [i for i, c in enumerate(text) if c.lower() in vowels + consonants]
        places = places[:-1] if len(places) > 3 and places[-1] == len(text) - 1 else places
        if not places:
            return text
        sets = [vowels if text[i].lower() in vowels else consonants for i in places]
        hole = "".join("\0" if i in places else c for i, c in enumerate(text.lower()))
        out, name = "".join(text[i].lower() for i in places), text
        while True:
            out = self.cipher.letters(out, sets, f"name\0{hole}\0{''.join(s[0] for s in sets)}")
            made = list(text)
            for i, c in zip(places, out, strict=True):
                made[i] = c.upper() if text[i].isupper() else c
            name = "".join(made)
            if not _listed(name):
                return name


def entities(text: str) -> list[tuple[int, int, str, tuple[tuple[int, int, str], ...]]]:
    """(start, end, type, parts): each part is replaced by itself, with its own kind of surrogate."""
    found = []
    whole = lambda m, kind, how: (m.start(), m.end(), kind, ((m.start(), m.end(), how),))
    if "@" in text:
        found += [whole(m, "email", "email") for m in EMAIL.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [whole(m, "access_key", "key") for m in ACCESS_KEY.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret", ((m.start(1), m.end(1), "secret"),)) for m in ASSIGNED.finditer(text)]
    for run in NUMBER.finditer(text):
        low, high = run.span()
        if high - low < 7:
            continue
        for pattern, kind in ((PHONE, "phone"), (SSN, "ssn"), (IPV4, "ip"), (CARD, "card")):
            found += [whole(m, kind, kind) for m in pattern.finditer(text, low, high + 2) if kind != "card" or is_card(m[0])]  # what stands after the run counts for its last entity
    for m in NAME.finditer(text):
        at, who = ("named", m["named"]) if m["title"] else ("given", f"{m['given']} {m['family']}")
        spans = [(m.start("given"), m.end("given")), (m.start("family"), m.end("family"))] if at == "given" else [(m.start("named") + p.start(), m.start("named") + p.end()) for p in re.finditer(_PART, who)]
        kinds = ["given"] * (len(spans) - 1) + ["family"]
        found.append((spans[0][0], spans[-1][1], "person", tuple((a, b, k) for (a, b), k in zip(spans, kinds, strict=True))))
    rank = {"email": 0, "phone": 1, "card": 2, "ssn": 3, "ip": 4, "access_key": 5, "secret": 6, "person": 7}
    found.sort(key=lambda f: (f[0], rank[f[2]], -f[1]))
    out, end = [], 0
    for f in found:
        if f[0] >= end:
            out.append(f)
            end = f[1]
    return out


def replace(text: str, made: Surrogates) -> tuple[str, list[tuple[str, str, str, int]]]:
    """The text with surrogates; (type, original, surrogate, start in the original) of each entity."""
    out, at, told = [], 0, []
    for start, end, kind, parts in entities(text):
        out.append(text[at:start])
        new, k = [], start
        for a, b, how in parts:
            new += [text[k:a], made.of(how, text[a:b])]
            k = b
        surrogate = "".join(new) + text[k:end]
        told.append((kind, text[start:end], surrogate, start))
        out.append(surrogate)
        at = end
    return "".join(out) + text[at:] if told else text, told


@functools.cache
def surrogates(key: bytes) -> Surrogates:
    return Surrogates(key)


ENTITY = "array<struct<type:string,original:string,surrogate:string,start:int>>"


def anonymise(docs: DataFrame, key: bytes, text: str = "text", found: str = "entities") -> DataFrame:
    """All columns with the text replaced, and one more, the last, that lists the entities. One pass, nothing is moved."""
    ship(docs.sparkSession)
    found = free_name(found, docs.columns)
    kind = pa.list_(pa.struct([("type", pa.string()), ("original", pa.string()), ("surrogate", pa.string()), ("start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = surrogates(key)
        for batch in slices(batches, text, 4 << 20):
            at = batch.schema.get_field_index(text)
            pairs = [(None, []) if t is None else replace(t, made) for t in batch.column(at).to_pylist()]
            told = [[dict(zip(("type", "original", "surrogate", "start"), e, strict=True)) for e in es] for _, es in pairs]
            columns = [pa.array([t for t, _ in pairs], pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, kind)], names=[*batch.schema.names, found])

    typed = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    return typed.mapInArrow(lean(run), StructType([*typed.schema.fields, StructField(found, StructType.fromDDL(f"e {ENTITY}")["e"].dataType)]))


def anonymise_checked(docs: DataFrame, key: bytes, text: str = "text", found: str = "entities") -> DataFrame:
    """anonymise, written once, after the collision check over the entities of all rows (the only column it reads).

    Raises ValueError if two entities share a surrogate or one has two: then no result is given away.
    """
    done = written(anonymise(docs, key, text, found), "anonymised")
    told = done.select(F.explode(f"`{done.columns[-1]}`").alias("e")).select("e.*")
    faults = {r["why"]: r["n"] for r in collisions(told).where("why <> 'original of another'").groupBy("why").agg(F.count("*").alias("n")).collect()}
    if faults:
        raise ValueError(f"surrogates collide: {faults}")
    return done


def collisions(found: DataFrame) -> DataFrame:
    """From a table (type, original, surrogate) its faults by canonical value: (type, value, why).

    "doubled": a surrogate of two entities; "split": an entity with two surrogates; "original of another": a surrogate
    that is itself an entity of the table.
    """
    pair = F.udf(lambda kind, a, b: (canonical(kind, a), canonical(kind, b)), "original string, surrogate string", useArrow=True)
    told = found.where("original is not null").select("type", "original", "surrogate").distinct()
    pairs = told.select("type", pair("type", "original", "surrogate").alias("c")).select("type", "c.original", "c.surrogate").distinct()
    doubled = pairs.groupBy("type", F.col("surrogate").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select("type", "value", F.lit("doubled").alias("why"))
    split = pairs.groupBy("type", F.col("original").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select("type", "value", F.lit("split").alias("why"))
    own = pairs.select("type", F.col("original").alias("value")).distinct()
    others = pairs.where("original <> surrogate").select("type", F.col("surrogate").alias("value")).join(own, ["type", "value"], "left_semi").distinct().withColumn("why", F.lit("original of another"))
    return doubled.unionByName(split).unionByName(others)
