"""Personal data: detected entities get keyed surrogates of the same type and format.

Detected are e-mail addresses, telephone numbers, IPv4 and IPv6 and hardware addresses, payment cards, account numbers (checksums valid), social security
and passport numbers, dates of birth, street addresses, access keys, logins in addresses, assigned passwords and tokens, and names of persons: a known given
name (`sources/names.py`) or a title with all the capitalised words after it, or a name after a phrase such as "my name is" or "Name:".
An entity's canonical form (lower-case address, the last ten digits of a telephone number, surname) decides its surrogate, so one person or
number has one surrogate in the whole corpus, however it is written; the surrogate is then written in the format of
the place: letter case, separators, country code, title, script of the digits. Given names are replaced by names of the same gender and
script, surnames by made-up ones of the same script, cards and accounts by numbers with a valid checksum, secrets character by character with symbols too.

Surrogates come from HMAC-SHA256 of key, type, canonical form and attempt. A collision check over all distinct
entities keeps them distinct and unlike any original: of several originals with one surrogate the first keeps it and
the others, and those whose surrogate is an original, try again with the next attempt until none is left. Only those that try again
take part in a further round, and from the eighth attempt on surrogates grow longer, so that no space of values is used up; IPv4 addresses
cannot grow: if the corpus holds so many that ``rounds`` do not do, an error says so. Given names and dates need no check: they are permuted.

Defined results: null texts stay null and have no entities; empty texts stay empty; repeated rows get the same text, null ids are no matter;
columns of the input are kept, but one with the name of the new column is replaced. Matches that overlap are taken from the left, at one place by
the order of the types.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from dataclasses import dataclass
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.names import BY_NAME as _BY_NAME
from ..sources.names import GIVEN
from .frames import small_batches, written

#: Syllables of made-up surnames by script (fixed values).
SYLLABLES = {
    "latin": ("ba", "bel", "cor", "dan", "der", "el", "fen", "gar", "hol", "jan", "kel", "lan", "mar", "mer", "nor", "os", "per", "ran", "sol", "tan", "ver", "wal", "zin", "rath"),
    "cyrillic": ("ба", "вер", "гор", "дан", "зел", "кор", "лен", "мир", "нов", "пет", "рад", "сол", "тар", "чер"),
    "greek": ("αν", "γερ", "δημ", "καλ", "κων", "λεν", "μαρ", "νικ", "παπ", "σταμ", "τσακ", "φωτ"),
}
TITLES = ("Mr", "Mrs", "Ms", "Mx", "Miss", "Dr", "Prof", "Professor", "Sir", "Rev", "Herr", "Frau", "Monsieur", "Madame", "Mademoiselle", "Mme", "Mlle", "Señor", "Señora", "Señorita", "Sr", "Sra", "Srta", "Doña", "Κύριος", "Κυρία")


def any_of(words) -> str:
    """A pattern of words by their common beginnings, so that a place is not compared with every word."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def made(node: dict) -> str:
        own = [re.escape(c) + made(x) for c, x in sorted(node.items()) if c]
        return "" if not own else f"(?:{'|'.join(own)})" + "?" * ("" in node)

    return made(tree)


_EXTENDED = [chr(c) for c in range(0x100, 0x180)]
_UPPER = "[A-ZÀ-ÖØ-ÞΑ-ΩΆ-ΏА-ЯЁ" + "".join(c for c in _EXTENDED if c.isupper()) + "]"
_CAPITAL = _UPPER + "[a-zß-öø-ÿα-ωά-ώа-яё" + "".join(c for c in _EXTENDED if c.islower()) + "]+"
#: A capitalised word (Schmidt, O'Brien, McDonald, Garcia-Lopez); one or more of them with initials and particles between.
_WORD = rf"(?:{_UPPER}['’])?{_CAPITAL}(?:-?{_CAPITAL})*"
_STEP = rf"(?:(?:von|van|der|den|de la|de los|de|del|della|di|da|dos|du|zu|bin|al|ter|ten) )*(?:{_UPPER}\. )*{_WORD}"
_RUN = f"{_STEP}(?: {_STEP})*"
_GIVEN, _TITLE = any_of(_BY_NAME), any_of(TITLES)
#: Names of months by number, in the languages of dates of birth (fixed values).
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
}
_MONTH = "|".join(sorted({m for own in MONTHS.values() for m in own}, key=len, reverse=True))
_BORN = r"(?i:\b(?:date of birth|birth ?date|born(?: on)?|dob|geboren am|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)\s?[:=]?\s?)"
_DAY = rf"\d{{4}}-\d\d-\d\d|\d\d?[./-]\d\d?[./-]\d{{4}}|\d\d?\.? (?:de )?(?:{_MONTH}) (?:de )?\d{{4}}|(?:{_MONTH}) \d\d?, \d{{4}}"
STREETS = frozenset("Street Avenue Road Lane Drive Boulevard Court Way Square Place Terrace St Ave Rd Ln Blvd Calle Avenida Plaza Paseo Camino Rua".split())
STREET_ENDS = ("straße", "strasse", "str", "weg", "platz", "allee", "gasse")
_LOWER_RUN = r"(?:de la |de los |de |del |du |des |la |le )?"
_STREET = (
    rf"\d{{1,5}}[a-z]? (?:{_CAPITAL} ){{1,3}}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Way|Square|Place|Terrace|St|Ave|Rd|Ln|Blvd)(?!\w)"
    rf"|{_CAPITAL}(?:straße|strasse|str\.|weg|platz|allee|gasse) \d{{1,4}}[a-z]?(?!\w)"
    rf"|\d{{1,4}},? (?:rue|avenue|boulevard|place|impasse|chemin|quai) {_LOWER_RUN}{_CAPITAL}(?:[ -]{_CAPITAL})*"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|Rua) {_LOWER_RUN}{_CAPITAL}(?: {_CAPITAL})*,? \d{{1,4}}(?!\w)"
)
_CALLED = r"(?:[Mm]y name is|I am called|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|(?:[Ff]ull |[Ff]irst |[Ll]ast )?[Nn]ame:|Nom ?:|Nombre:|Signed:|Contact:)"
PATTERN = re.compile(
    "|".join((
        r"(?P<login>(?<=://)[^\s:/@]+:[^\s/@]+(?=@))",
        r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))",
        r"(?P<access_key>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))",
        r"(?P<password>(?i:(?:password|passwd|pwd)\s?[=:]\s?[\"']?)(?P<password_value>[^\s\"']{4,}))",
        r"(?P<token>(?i:(?:token|secret|api_?key)\s?[=:]\s?[\"']?)(?P<token_value>[A-Za-z0-9_-]{16,}))",
        r"(?P<passport>(?i:passport(?: (?:no|number|nr))?\.?\s?[:#]?\s?)(?P<passport_value>[A-Z]{0,2}\d{6,9})(?!\w))",
        rf"(?P<born>{_BORN}(?P<born_value>{_DAY})(?!\w))",
        r"(?P<mac>(?<![\w:-])[0-9A-Fa-f]{2}(?P<_sep>[:-])(?:[0-9A-Fa-f]{2}(?P=_sep)){4}[0-9A-Fa-f]{2}(?![\w:-]))",
        r"(?P<ipv6>(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:]))",
        r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
        r"(?P<ssn>(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]))",
        r"(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))",
        r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))",
        r"(?P<phone>(?<![\w+])\+\d(?:[ .()-]{0,2}\d){7,14}(?!\w)|(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?(?!\w))",
        rf"(?P<address>(?<!\w)(?:{_STREET}))",
        rf"(?P<person>(?<!\w)(?={_UPPER})(?:(?:{_TITLE}\.? )+(?P<titled>{_RUN})|(?P<named>{_GIVEN}(?:-{_CAPITAL})* {_RUN}))(?!\w)|(?<!\w){_CALLED} (?P<called>{_RUN})(?!\w))",
    ))
)
KINDS = ("login", "email", "access_key", "password", "token", "passport", "born", "mac", "ipv6", "iban", "ssn", "card", "ip", "phone", "address", "person")
#: A text without a digit, an at sign or any of these holds no entity but a person: every other pattern needs one of them.
_DIGIT = re.compile(r"[\d@]")
CUES = ("akia", "asia", "passw", "pwd", "token", "secret", "apikey", "api_key", "my name is", "i am called", "ich heiße", "mein name ist", "m'appelle", "m’appelle", "me llamo", "mi nombre", "name:", "nom:", "nom :", "nombre:", "signed:", "contact:")
_NAMES = re.compile(rf"(?<!\w)(?={_UPPER})(?:{_TITLE}\.? |{_GIVEN}[ -])")
_WORDS = re.compile(_WORD)


@dataclass(frozen=True)
class Settings:
    """``key`` is the secret of the surrogates; up to ``broadcast`` collisions are sent to all workers, more are joined; ``rounds`` of attempts at most."""

    key: str
    broadcast: int = 50_000
    rounds: int = 200


def luhn(digits: str) -> int:
    """Checksum of a card number, 0 if valid."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def mod97(iban: str) -> int:
    """Checksum of an account number, 1 if valid."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script_of(word: str) -> str:
    c = ord(word[0])
    return "greek" if 0x370 <= c < 0x400 else "cyrillic" if 0x400 <= c < 0x530 else "latin"


def suspicious(text: str) -> bool:
    """False only for a text without entities."""
    if _DIGIT.search(text):
        return True
    low = text.lower()
    return any(c in low for c in CUES) or low.count(":") > 4 or low.count("-") > 4 or _NAMES.search(text) is not None


def plain_digits(text: str) -> str:
    """The digits of any script, as 0 to 9."""
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def day_of(text: str) -> tuple[date, str] | None:
    """A written date, and the format that writes it."""
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", text):
        order, form = (m[1], m[2], m[3]), "{y:04d}-{m:02d}-{d:02d}"
    elif m := re.fullmatch(r"(\d\d?)([./-])(\d\d?)([./-])(\d{4})", text):
        day_first = int(m[3]) <= 12
        own = ("d", "m") if day_first else ("m", "d")
        order = (m[5], m[3], m[1]) if day_first else (m[5], m[1], m[3])
        wide = ":02d" if len(m[1]) == len(m[3]) == 2 else ""
        form = f"{{{own[0]}{wide}}}{m[2]}{{{own[1]}{wide}}}{m[4]}{{y:04d}}"
    else:
        month = next(x for x in sorted({x for own in MONTHS.values() for x in own}, key=len, reverse=True) if x in text)
        lang = next(x for x, own in MONTHS.items() if month in own)
        number = MONTHS[lang].index(month) + 1
        numbers = re.findall(r"\d+", text)
        order = (numbers[1], str(number), numbers[0])
        form = re.sub(r"\d+", "{}", text).replace(month, f"{{{lang}}}").replace("{}", "{d}", 1).replace("{}", "{y}", 1)
    try:
        return date(*map(int, order)), form
    except ValueError:
        return None


def parts(text: str):
    """(type, start, end, canonical) of every replaceable part, in order."""
    if not suspicious(text):
        return
    for m in PATTERN.finditer(text):
        kind = next(k for k in KINDS if m[k] is not None)
        if kind == "person":
            *before, last = _WORDS.finditer(text, *m.span(next(g for g in ("titled", "named", "called") if m[g])))
            for word in before:
                # a listed name, or each part of a double name; what is not listed is replaced like a surname
                for part in (word,) if word[0] in _BY_NAME else re.compile("[^-]+").finditer(text, *word.span()):
                    yield "given" if part[0] in _BY_NAME else "surname", *part.span(), part[0]
            yield "given" if m["called"] and not before and last[0] in _BY_NAME else "surname", *last.span(), last[0]
        elif kind in ("password", "token", "passport"):
            yield kind, *m.span(f"{kind}_value"), m[f"{kind}_value"]
        elif kind == "born":
            if day := day_of(m["born_value"]):
                yield kind, *m.span("born_value"), day[0].isoformat()
        elif kind == "card":
            digits = plain_digits(m[0])
            if not luhn(digits):
                yield kind, m.start(), m.end(), digits
        elif kind == "iban":
            plain = m[0].replace(" ", "")
            if plain.isascii() and mod97(plain) == 1:
                yield kind, m.start(), m.end(), plain
        elif kind == "ssn":
            yield kind, m.start(), m.end(), plain_digits(m[0])
        elif kind == "phone":
            # with and without country code or trunk prefix a number is one number: its last ten digits
            yield kind, m.start(), m.end(), plain_digits(m[0])[-10:]
        elif kind == "mac":
            yield kind, m.start(), m.end(), re.sub("[:-]", "", m[0]).lower()
        elif kind == "address":
            yield kind, m.start(), m.end(), m[0]
        else:
            yield kind, m.start(), m.end(), m[0].lower() if kind in ("email", "ipv6") else m[0]


class Draw:
    """A stream of keyed numbers."""

    def __init__(self, key: str, *what):
        self.seed, self.n, self.have = (key.encode(), "\0".join(map(str, what)).encode()), 0, 0

    def below(self, n: int) -> int:
        if self.have < 1 << 24:
            block = hmac.new(self.seed[0], self.seed[1] + b"\0%d" % self.n, hashlib.sha256).digest()
            self.have, self.n = int.from_bytes(block, "big"), self.n + 1
        self.have, out = divmod(self.have, n)
        return out


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Symbols that may stand for one another in a secret.
SYMBOLS = "!#$%&*+-.:;=?@^_~"


@lru_cache(maxsize=4096)
def like(c: str, symbols: str) -> str:
    """Characters that may stand for ``c``: of its class, for other scripts of its case and block of 64 code points."""
    for own in _CLASSES:
        if c in own:
            return own
    if c.isalpha():
        first = ord(c) & ~63
        return "".join(x for x in map(chr, range(first, first + 64)) if x.isalpha() and (x.isupper(), x.islower()) == (c.isupper(), c.islower()))
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    return symbols if symbols and not c.isalnum() else c


def alike(draw: Draw, text: str, symbols: str = "", more: int = 0) -> str:
    """Every letter, digit and, if ``symbols`` are given, other character by one of its kind; hexadecimal text stays hexadecimal. ``more`` characters are added."""
    if re.fullmatch(r"(?=.*\d)[0-9a-f]{8,}", text):
        return "".join("0123456789abcdef"[draw.below(16)] for _ in range(len(text) + more))
    long = text + "".join(text[i % len(text)] if len(like(text[i % len(text)], symbols)) > 1 else "a" for i in range(more)) if text else "a" * more
    return "".join((own := like(x, symbols))[draw.below(len(own))] for x in long)


def name_of(draw: Draw, script: str, syllables: int) -> str:
    own = SYLLABLES[script]
    return "".join(own[draw.below(len(own))] for _ in range(syllables)).capitalize()


@lru_cache
def permuted(key: str, kind: tuple[str, str]) -> dict[str, str]:
    """Each given name of a script and gender -> another one."""
    order = sorted(GIVEN[kind], key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())
    return dict(zip(order, order[1:] + order[:1], strict=True))


#: Attempts until surrogates grow by one character more.
PATIENCE = 8


def surrogate(key: str, kind: str, canonical: str, attempt: int = 0) -> str:
    """Canonical form of the surrogate."""
    draw, more = Draw(key, kind, canonical, attempt), attempt // PATIENCE
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        return alike(draw, local, more=more) + "@" + ".".join([*(alike(draw, x) for x in labels[:-1]), "example"])
    if kind == "ip":
        while True:
            own = [1 + draw.below(223), draw.below(256), draw.below(256), 1 + draw.below(254)]
            if own[0] not in (10, 127):
                return ".".join(map(str, own))
    if kind == "phone":
        return str(2 + draw.below(8)) + "".join(_CLASSES[0][draw.below(10)] for _ in range(len(canonical) - 1 + more))
    if kind == "card":
        body = canonical[0] + "".join(_CLASSES[0][draw.below(10)] for _ in canonical[1:-1])
        return next(body + d for d in "0123456789" if not luhn(body + d))
    if kind == "iban":
        body = "".join((_CLASSES[0] if c.isdigit() else _CLASSES[2])[draw.below(10 if c.isdigit() else 26)] for c in canonical[4:])
        return f"{canonical[:2]}{98 - mod97(canonical[:2] + '00' + body):02d}{body}"
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}" + "".join(_CLASSES[0][draw.below(10)] for _ in range(more))
    if kind == "access_key":
        return canonical[:4] + "".join((_CLASSES[0] + _CLASSES[2])[draw.below(36)] for _ in canonical[4:])
    if kind in ("mac", "ipv6"):
        return "".join("0123456789abcdef"[draw.below(16)] if c != ":" else c for c in canonical)
    if kind == "born":
        # all dates move by one keyed number of days: different dates stay different
        moved = date.fromisoformat(canonical).toordinal() + 400 + Draw(key, kind).below(3000)
        return date.fromordinal(moved if moved <= date.max.toordinal() else moved - date.max.toordinal()).isoformat()
    if kind == "address":

        def other(m: re.Match) -> str:
            word = m[0]
            if word[0].isdecimal():
                return alike(draw, word)
            end = next((x for x in STREET_ENDS if word.endswith(x)), "")
            return word if word in STREETS else name_of(draw, script_of(word), 3 + more) + end

        return re.sub(rf"\d+[a-z]?|{_CAPITAL}", other, canonical)
    if kind == "given":
        return permuted(key, _BY_NAME[canonical])[canonical]
    if kind == "surname":
        return name_of(draw, script_of(canonical), 3 + attempt // 4)
    if kind == "login":
        user, _, word = canonical.partition(":")
        return alike(draw, user, "_", more) + ":" + alike(draw, word, "-._~")
    return alike(draw, canonical, "_-" if kind == "token" else SYMBOLS if kind == "password" else "", more)


def shaped(kind: str, place: str, new: str) -> str:
    """The surrogate in the format of its place."""
    if kind == "phone":
        # digits before the last ten (country code, trunk prefix) stay
        kept = max(0, len(plain_digits(place)) - 10)
        new = plain_digits(place)[:kept] + new
    if kind in ("phone", "card", "ssn"):
        own = iter(new)
        written = "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(own))) if c.isdecimal() else c for c in place)
        return written + "".join(own)
    if kind == "iban":
        own = iter(new)
        return "".join(next(own) if c.isalnum() else c for c in place)
    if kind == "mac":
        own = iter(new.upper() if place.upper() == place else new)
        return "".join(next(own) if c.isalnum() else c for c in place)
    if kind == "born":
        _, form = day_of(place)
        day = date.fromisoformat(new)
        return form.format(y=day.year, m=day.month, d=day.day, **{lang: own[day.month - 1] for lang, own in MONTHS.items()})
    if kind == "email" and place != place.lower():
        head = "".join(n.upper() if o.isupper() else n for o, n in zip(place, new, strict=False))
        return head + new[len(head) :]
    if kind == "ipv6" and place != place.lower():
        return new.upper()
    return new


def replaced(key: str, text: str | None, other: dict[tuple[str, str], int]) -> tuple[str | None, list[tuple]]:
    """The text with surrogates, and (type, start, end) of each in the new text. ``other``: attempts above 0."""
    if text is None:
        return None, []
    out, spans, at, size = [], [], 0, 0
    for kind, a, b, canonical in parts(text):
        new = shaped(kind, text[a:b], surrogate(key, kind, canonical, other.get((kind, canonical), 0)))
        out += [text[at:a], new]
        size += a - at
        spans.append((kind, size, size + len(new)))
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), spans


def marks(text) -> list:
    """A text's identity: two hashes."""
    return [F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(911), text).alias("m2")]


def entities(documents: DataFrame) -> DataFrame:
    """(m1, m2, kind, canonical): distinct entities of every text."""

    def found(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for m1, m2, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                for kind, canonical in sorted({(k, c) for k, _, _, c in parts(text.as_py())}):
                    for col, x in zip(cols, (m1, m2, kind, canonical), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["m1", "m2", "kind", "canonical"])

    text = documents["text"]
    return documents.where(F.length(text) > 0).select(*marks(text), text).mapInArrow(found, "m1 long, m2 long, kind string, canonical string")


#: Types whose surrogates are permutations and cannot collide.
PERMUTED = ("given", "born")


def attempts(known: DataFrame, settings: Settings) -> DataFrame:
    """(kind, canonical, attempt, surrogate) with distinct surrogates, none of them an original of its type."""
    key = settings.key

    @F.arrow_udf("string")
    def made(kind: pa.Array, canonical: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, k, c, a) for k, c, a in zip(kind.to_pylist(), canonical.to_pylist(), attempt.to_pylist(), strict=True)], pa.string())

    made = made.asNondeterministic()
    free = F.col("kind").isin(*PERMUTED)
    known = written(known, "pii-known")
    used = known.where(~free).select("kind", F.col("canonical").alias("surrogate"))
    pending, settled = known.withColumn("attempt", F.lit(0)), []
    for _ in range(settings.rounds):
        now = written(pending.select("kind", "canonical", "attempt", made("kind", "canonical", "attempt").alias("surrogate")), "pii-drawn")
        # few rows have one surrogate: a keyed hash deals originals evenly
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canonical"))
        judged = now.where(~free).withColumn("rank", rank).join(used.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        judged = written(judged.select("kind", "canonical", "attempt", "surrogate", (F.coalesce("taken", F.lit(False)) | (F.col("rank") > 1)).alias("again")), "pii-judged", True)
        good = judged.where("NOT again").select("kind", "canonical", "attempt", "surrogate")
        settled += [good, now.where(free)] if not settled else [good]
        used = used.union(good.select("kind", "surrogate"))
        pending = judged.where("again").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            out = settled[0]
            for more in settled[1:]:
                out = out.union(more)
            return out
    raise RuntimeError(f"no free surrogates after {settings.rounds} attempts: {pending.groupBy('kind').count().collect()}")


RESULT = "struct<text:string,entities:array<struct<kind:string,start:int,end:int>>>"
RESULT_ARROW = pa.struct([("text", pa.string()), ("entities", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def with_surrogates(documents: DataFrame, settings: Settings, name: str = "entities") -> DataFrame:
    """``documents`` with ``text`` replaced, plus ``name`` (kind, start, end in the new text, in characters)."""
    spark = documents.sparkSession
    small_batches(spark)
    key = settings.key
    found = written(entities(documents), "pii-entities")
    known = attempts(found.select("kind", "canonical").distinct(), settings)
    retried = written(known.where("attempt > 0").select("kind", "canonical", "attempt"), "pii-retried", True)
    few = retried.limit(settings.broadcast + 1).collect()
    own = [c for c in documents.columns if c not in ("text", name)]
    row = documents.select(F.struct(F.lit(0).alias("__"), *[documents[c] for c in own]).alias("row"), documents["text"].alias("body"))

    def result(rows) -> pa.Array:
        return pa.array([{"text": t, "entities": [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]} for t, spans in rows], type=RESULT_ARROW)

    if len(few) <= settings.broadcast:
        other = spark.sparkContext.broadcast({(r["kind"], r["canonical"]): r["attempt"] for r in few})

        @F.arrow_udf(RESULT)
        def changed(text: pa.Array) -> pa.Array:
            return result(replaced(key, t.as_py(), other.value) for t in text)

        out = row.withColumn("__pii", changed.asNondeterministic()("body"))
    else:  # too many to send: each text gets its own retried entities
        mine = found.join(retried, ["kind", "canonical"]).groupBy("m1", "m2").agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias("mine"))

        @F.arrow_udf(RESULT)
        def changed_with(text: pa.Array, mine: pa.Array) -> pa.Array:
            return result(replaced(key, t.as_py(), {(x["kind"], x["canonical"]): x["attempt"] for x in o.as_py() or ()}) for t, o in zip(text, mine, strict=True))

        joined = row.select("row", "body", *marks(F.col("body"))).join(written(mine, "pii-mine"), ["m1", "m2"], "left")
        out = joined.select("row", "body", changed_with.asNondeterministic()("body", "mine").alias("__pii"))
    new = {"text": F.col("__pii.text")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns if c != name], F.col("__pii.entities").alias(name))
