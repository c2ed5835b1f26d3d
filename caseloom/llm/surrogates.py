"""Operator 9, PII: detected entities get keyed surrogates of the same type and shape.

A surrogate is a function of a secret key, the entity's type and its canonical
form (e.g. the digits of a phone number), so one entity has one surrogate in all
documents and spellings, whichever task meets it. Digits stay digits, letters
stay letters of their case and script, separators and lengths stay; card numbers
keep a right check digit, addresses stay addresses, names keep script and gender.

Collision check: the corpus's distinct entities are listed, a name once, with the
gender most texts give it. Where two of one type share a surrogate, or a surrogate
is itself an entity of the corpus, all but one are drawn anew with the next attempt
number until none is left; names of all genders are one type here. Only these few
exceptions are brought back to documents; all other surrogates are made in place.

Defined results: null and empty texts stay as they are; texts without entities
are not touched. Repeated rows get equal results. A type whose shape has fewer
values than the corpus has entities gets longer surrogates after some attempts,
so distinctness always wins over length.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import mapped, pick, slices, stored

KEY = b"surrogate-key-1"
#: Attempts of one shape before a surrogate grows by one character each time.
SAME_SHAPE = 48
#: At most so many exceptions are sent to all executors.
BROADCAST_ROWS = 50_000

_TITLES = {
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Señorita Srta Signora Госпожа Κυρία",
    "m": "Mr Sir Mister Herr Monsieur Señor Sr Signor Господин Κύριος",
    "u": "Dr Prof Professor Mx",
}
GENDER = {t: g for g, words in _TITLES.items() for t in words.split()}
# Common given names that are hardly ever other words. With a capitalised word after them they name a person without a title.
_GIVEN = {
    "f": "Alice Amelia Andrea Angela Anna Barbara Beatrice Camille Carmen Caroline Catherine Charlotte Christine Claudia Deborah Diana Elena Elizabeth "
    "Emily Emma Eva Fatima Francesca Giulia Greta Hannah Helen Ingrid Isabel Jessica Johanna Julia Karen Katharina Laura Linda Lucia Margaret Maria "
    "Marie Martha Melanie Michelle Monika Natalia Nicole Olga Patricia Paula Petra Rachel Rebecca Rosa Sabine Sandra Sarah Silvia Sofia Sophie Stephanie "
    "Susan Svetlana Teresa Ursula Valentina Veronica Victoria",
    "m": "Adrian Alberto Alejandro Alexander Andreas Andrew Anthony Antonio Benjamin Bernard Bruno Carlos Charles Christian Christopher Daniel David "
    "Dmitri Eduardo Edward Enrique Fernando Florian Francisco Frederic Friedrich George Giovanni Guillaume Hans Heinrich Henry Ivan Jacques James Javier "
    "Jean Johannes John Jonathan Jorge Joseph Juan Julien Jürgen Kevin Klaus Laurent Luca Luis Manuel Marco Martin Matthew Matthias Michael Miguel "
    "Mohammed Nicolas Olivier Pablo Patrick Paul Pedro Peter Philippe Pierre Ricardo Richard Robert Sebastian Sergio Stefan Stephen Thomas Timothy Vladimir "
    "William Wolfgang",
}
GIVEN = {n: g for g, words in _GIVEN.items() for n in words.split()}


def _class_of(wanted: Callable[[str], bool]) -> str:
    """The inside of a character class: letters and marks for which a test holds, as ranges."""
    codes = [n for n in range(0x323B0) if wanted(unicodedata.category(chr(n)))]
    first = [n for n, before in zip(codes, [-2, *codes], strict=False) if n != before + 1]
    last = [n for n, after in zip(codes, [*codes[1:], -2], strict=True) if after != n + 1]
    return "".join(re.escape(chr(x)) + ("-" + re.escape(chr(y)) if y > x else "") for x, y in zip(first, last, strict=True))


#: Letters that may begin a name (capitals, and those of scripts without case), and letters and marks that may go on.
_UP = f"[{_class_of(lambda c: c in ('Lu', 'Lt', 'Lo'))}]"
_IN = _class_of(lambda c: c[0] in "LM")
#: A name's part: inner capitals and apostrophes belong to it, a possessive s does not. Or an initial.
_WORD = rf"{_UP}(?:[{_IN}]|['’](?!s(?![{_IN}]))(?=[{_IN}]))*"
_PARTICLES = (
    "van von vom der den de del della di da do dos das du la las le los lo el al bin ibn ben bint ter ten te ten zu zum zur und y e af av".split()
)
_PARTICLE = rf"(?:{'|'.join(sorted(set(_PARTICLES), key=len, reverse=True))})"
_ELIDED = r"(?:(?:[dl]|dell|dall|all)['’])?"
_GAP = r"[ \t\u00a0\u202f]{1,3}"
_TITLE = rf"(?:{'|'.join(sorted(GENDER, key=len, reverse=True))})"
_PART = rf"(?:{_UP}\.(?={_GAP}{_UP})|{_ELIDED}{_WORD}(?![^\W]|[{_IN}]))"
_LEAD = rf"(?:{_PARTICLE}(?:{_GAP}|-))*"
NAME_PART = re.compile(rf"{_ELIDED}{_WORD}|{_PARTICLE}(?![{_IN}])")
LATER = re.compile(rf"(?<![\w'’])(?P<lead>(?:{_PARTICLE}(?:{_GAP}|-))*){_ELIDED}(?P<word>{_WORD})(?![^\W]|[{_IN}])")
ONE_TITLE = re.compile(rf"\b{_TITLE}\b")

_DIGITS = tuple("0123456789")
_KEYWORDS = ("passw", "pwd", "passphrase", "token", "secret", "api_key", "api-key", "apikey", "access", "auth", "private")
_CLOUD = ("AKIA", "ASIA", "AGPA", "AIDA")
_SERVICE = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "sk-", "sk_live_", "AIza")
_TITLED = tuple(GENDER)
#: Stands for: some capitalised word of the text is a given name.
_NAMED = tuple(GIVEN)
_CAPITALISED = re.compile(r"\b[A-Z][^\W\d_]+")
#: Type, substrings of which a text must hold one to be searched at all, and the pattern. In order of precedence.
PATTERNS: tuple[tuple[str, tuple[str, ...], re.Pattern], ...] = (
    ("email", ("@",), re.compile(r"(?<![\w.+%-])[\w][\w.+%-]{0,63}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?![\w-])")),
    ("key_block", ("-----BEGIN",), re.compile(r"(?s)-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?P<value>.*?)(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|\Z)")),
    ("secret", _KEYWORDS, re.compile(
        r"(?i)\b(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)\b"
        # Whole, if quoted; else up to a space, of four characters or with a digit, so that "token: no" is left alone.
        r"[\"']?\s{0,3}(?:=>|:=|[:=])\s{0,3}(?:\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|[\"']?(?P<value>[^\s\"',;]{4,}|(?=[^\s\"',;]{0,3}\d)[^\s\"',;]+))"
    )),
    ("secret", ("earer", "asic", "EARER", "ASIC"), re.compile(r"(?i)\b(?:bearer|basic)[ \t]{1,3}(?P<value>(?=[\w.~+/=-]{0,200}\d)[\w.~+/-]{8,}={0,2})")),
    ("secret", ("eyJ",), re.compile(r"\b(?P<value>eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)")),
    ("cloud_key", _CLOUD, re.compile(r"\b(?:AKIA|ASIA|AGPA|AIDA)(?P<value>[A-Z0-9]{16})\b")),
    ("service_key", _SERVICE, re.compile(r"\b(?:ghp_|gho_|ghs_|github_pat_|glpat-|xox[abp]-|sk-|sk_live_|AIza)(?P<value>[A-Za-z0-9_-]{16,})")),
    ("iban", _DIGITS, re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")),
    ("ssn", _DIGITS, re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("card", _DIGITS, re.compile(r"(?<![\d.-])[2-6]\d{3}(?:\d{9,12}|[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|[ -]\d{6}[ -]\d{5})(?![\d-])")),
    # Any run of groups and colons, which ipaddress then decides on.
    ("ip6", (":",), re.compile(r"(?<![\w:.])(?:[0-9a-fA-F]{0,4}:){2,8}(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9a-fA-F]{1,4})?(?!\w|:\w|::|\.\d)")),
    ("ip", _DIGITS, re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)")),
    ("phone", _DIGITS, re.compile(
        r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}(?!\d)"
        # Trunk prefixes 1 and 8 stay, as country codes do.
        r"|(?<![\w.(+-])(?:[18][ .-]?)?(?P<value>(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-](?:\d{4}|\d{2}[ .-]\d{2}))(?![\w-])"
        # Ten or eleven digits in a row only after a word that says so.
        r"|(?i:\b(?:tel|telephone|phone|call|cell|mobile|fax|whatsapp)\b)[^\w\n]{1,3}(?:(?i:us|me|at|no|number)[^\w\n]{1,3}){0,2}(?P<bare>\d{10,11})(?!\d)"
        r"|(?<![\w.(+-])(?!\d\d[./-]\d\d[./-]\d{4}\b)(?:\(0[1-9]\d{0,4}\) ?|0[1-9]\d{0,4}[ ./-])\d{2,8}(?:[ ./-]\d{2,8}){0,4}(?![\w-])"
    )),
    ("name", _TITLED, re.compile(
        rf"\b(?P<title>{_TITLE}(?:\.?{_GAP}{_TITLE}\b)*)\.?{_GAP}(?P<value>{_LEAD}{_PART}(?:(?:{_GAP}|-){_LEAD}{_PART})*)"
    )),
    ("name", _NAMED, re.compile(
        rf"(?<![\w'’-])(?P<value>(?P<given>{'|'.join(sorted(GIVEN, key=len, reverse=True))})(?:(?:{_GAP}|-){_LEAD}{_PART}){{1,4}})"
    )),
)

DIGITS = "0123456789"
HEX = "0123456789abcdef"
# Letters by script, for surrogates of names: vowels and consonants.
SCRIPTS = {
    "LATIN": ("aeiou", "bdfgklmnprstv"), "CYRILLIC": ("аеиоу", "бвгдклмнпрст"), "GREEK": ("αειου", "βγδκλμνπρστ"),
}
#: Endings that name surrogates take by gender and script.
ENDINGS = {
    ("f", "LATIN"): "a", ("m", "LATIN"): "o", ("f", "CYRILLIC"): "а", ("m", "CYRILLIC"): "н", ("f", "GREEK"): "α", ("m", "GREEK"): "ς",
}


class Stream:
    """Numbers below a bound from a keyed hash, as many as are asked for."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self.key, self.seed, self.block, self.pool = key, "\x1f".join(parts).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, bound: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % bound

    def pick(self, letters: str) -> str:
        return letters[self.below(len(letters))]


def luhn(digits: str) -> str:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


#: Country codes of one and two digits; all others have three. Fixed values.
_ONE = "17"
_TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def country_code(number: str) -> int:
    """How many characters of a canonical number are its plus sign and country code, or its trunk 0."""
    if not number.startswith("+"):
        return int(number.startswith("0"))
    return 2 if number[1:2] in _ONE else 3 if number[1:3] in _TWO else 4


def script_of(text: str) -> str:
    name = unicodedata.name(next((c for c in text if c.isalpha()), "a"), "LATIN").split()[0]
    return name if name in SCRIPTS else "LATIN"


def canonical(kind: str, value: str) -> str:
    """One form for all spellings of an entity."""
    if kind in ("phone", "card", "ssn"):
        return value[:1].strip("(0123456789") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip6":
        return ipaddress.IPv6Address(value).packed.hex(":", 2)
    if kind.startswith("name"):
        return unicodedata.normalize("NFC", value).replace("’", "'").lower()
    if kind == "email":
        return value.lower()
    return value


def letterwise(stream: Stream, value: str) -> str:
    """Digits to digits, letters to letters; all else stays."""
    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) and re.search(r"\d", value)
    out = []
    for c in value:
        if hexadecimal:
            out.append(stream.pick(HEX if value.islower() or value.isdigit() else HEX.upper()))
        elif c.isdigit():
            out.append(stream.pick(DIGITS))
        elif c.isalpha():
            vowels, others = SCRIPTS[script_of(c)]
            new = stream.pick(vowels + others)
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity."""
    stream = Stream(key, kind, entity, str(attempt))
    more = max(0, attempt - SAME_SHAPE)
    if kind == "card":
        checked = len(entity) > 1 and luhn(entity[:-1]) == entity[-1]
        body = entity[0] + "".join(stream.pick(DIGITS) for _ in entity[1:-1]) + "".join(stream.pick(DIGITS) for _ in range(more))
        return body + (luhn(body) if checked else stream.pick(DIGITS))
    if kind == "phone":
        fixed = country_code(entity)
        return entity[:fixed] + "".join(stream.pick(DIGITS) for _ in entity[fixed:]) + "".join(stream.pick(DIGITS) for _ in range(more))
    if kind == "ssn":
        return "".join(stream.pick(DIGITS) for _ in range(len(entity) + more))
    if kind == "ip":
        # Octets keep their number of digits while attempts last, then any octet will do.
        span = {1: (1, 9), 2: (10, 99), 3: (100, 255)}
        octets = [span[len(o)] if not more else (0, 255) for o in entity.split(".")]
        return ".".join(str(low + stream.below(high - low + 1)) for low, high in octets)
    if kind == "ip6":
        return b"".join(stream.below(1 << 16).to_bytes(2, "big") for _ in range(8)).hex(":", 2)
    if kind == "iban":
        return entity[:2] + letterwise(stream, entity[2:]) + "".join(stream.pick(DIGITS) for _ in range(more))
    if kind == "email":
        local, _, domain = entity.partition("@")
        hosts, _, top = domain.rpartition(".")
        return letterwise(stream, local) + "".join(stream.pick(SCRIPTS["LATIN"][1]) for _ in range(more)) + "@" + letterwise(stream, hosts) + "." + top
    if kind.startswith("name"):
        gender, script = kind.partition("_")[2] or "u", script_of(entity)
        vowels, others = SCRIPTS[script]
        size = max(3, sum(c.isalpha() for c in entity)) + more
        body = "".join(stream.pick(others if k % 2 == 0 else vowels) for k in range(size))
        return body[: size - 1] + ENDINGS[(gender, script)] if (gender, script) in ENDINGS else body
    return letterwise(stream, entity) + "".join(stream.pick(DIGITS) for _ in range(more))


def rendered(kind: str, mention: str, made: str) -> str:
    """A canonical surrogate in the spelling of one mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        own = iter(made.lstrip("+"))
        out = [next(own, "") if c.isalnum() else c for c in mention]
        return "".join(out) + "".join(own)
    if kind == "email":
        return made.upper() if mention.isupper() else made
    if kind.startswith("name"):
        # Apostrophes stay; marks that stand alone go with their letter.
        own, out = iter(made), []
        for c in unicodedata.normalize("NFC", mention):
            if c in "'’":
                out.append(c)
            elif c.isalpha():
                new = next(own, "")
                out.append(new.upper() if c.isupper() or (c == mention[0] and not out and not c.islower()) else new)
        return "".join(out) + "".join(own)
    return made


def is_ip6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


def settled_names(found: list[tuple[int, int, str, str]]) -> dict[str, str]:
    """The kind of each name: the gender that most mentions give it, if one does."""
    votes: dict[str, int] = {}
    for _, _, kind, entity in found:
        if kind.startswith("name_"):
            votes[entity] = votes.get(entity, 0) + {"name_f": 1, "name_m": -1}.get(kind, 0)
    return {entity: "name_f" if n > 0 else "name_m" if n < 0 else "name_u" for entity, n in votes.items()}


class Spans:
    """Spans of a text that do not overlap, kept in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, start: int, end: int) -> bool:
        """Whether any span overlaps this one. Only the last that starts before its end can."""
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical entity) of each entity, in text order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    taken = Spans()
    lowered = text.lower()
    digits = any(d in text for d in _DIGITS)
    for kind, needs, pattern in PATTERNS:
        if needs is _DIGITS:
            worth = digits
        elif needs is _NAMED:
            worth = not GIVEN.keys().isdisjoint(_CAPITALISED.findall(text))
        else:
            worth = any(x in (lowered if needs is _KEYWORDS else text) for x in needs)
        if not worth:
            continue
        for m in pattern.finditer(text):
            groups = m.groupdict()
            group = next((g for g in ("value", "double", "single", "bare") if groups.get(g) is not None), 0)
            start, end = m.span(group)
            value = m[group]
            if kind == "key_block":
                # Each line of the block is a secret of its own, so that line breaks stay.
                for line in re.finditer(r"[^\s\\]{2,}", value):
                    a, b = start + line.start(), start + line.end()
                    if not taken.meets(a, b):
                        taken.add(a, b)
                        found.append((a, b, "secret", line[0]))
                continue
            if kind == "ip6":
                value = value[:-1] if re.search(r"[^:]:\Z", value) else value
                end = start + len(value)
                # Two groups of letters alone are rather a scope (add::face) than an address.
                if not is_ip6(value) or not (any(c.isdigit() for c in value) or len(re.findall(r"\w+", value)) > 2):
                    continue
            if kind == "card" and not 13 <= len(re.sub(r"\D", "", value)) <= 19:
                continue
            if kind == "phone" and not (9 if value.lstrip("(")[0] == "0" else 8) <= len(re.sub(r"\D", "", value)) <= 15:
                continue
            if start == end or taken.meets(start, end):
                continue
            taken.add(start, end)
            if kind != "name":
                found.append((start, end, kind, canonical(kind, value)))
                continue
            # Name parts are entities of their own, so that a surname alone refers to the same person.
            parts = [(start + p.start(), start + p.end(), p[0]) for p in NAME_PART.finditer(value)]
            known = [GENDER[t] for t in ONE_TITLE.findall(groups.get("title") or "")] + [GIVEN[x] for *_, x in parts if x in GIVEN]
            gender = next((g for g in known if g != "u"), "u")
            for k, (a, b, part) in enumerate(parts):
                own = "name_u" if k == len(parts) - 1 or part in _PARTICLES else f"name_{gender}"
                found.append((a, b, own, canonical("name", part)))
    names = settled_names(found)
    if names:
        # Later mentions without a title.
        for m in LATER.finditer(text):
            start = m.end("lead")
            if canonical("name", text[start : m.end()]) not in names:
                start = m.start("word")
            if canonical("name", text[start : m.end()]) not in names:
                continue
            spans = [(start, m.end()), *((m.start() + p.start(), m.start() + p.end()) for p in NAME_PART.finditer(m["lead"]))]
            for a, b in spans:
                entity = canonical("name", text[a:b])
                # An initial alone tells no one.
                if entity in names and len(entity) > 1 and not taken.meets(a, b):
                    found.append((a, b, names[entity], entity))
        # One gender per name of a text; over the corpus it is settled in settled().
        found = [(a, b, names[entity] if kind.startswith("name_") else kind, entity) for a, b, kind, entity in found]
    return sorted(found)


def replaced(key: bytes, text: str, exceptions: Mapping[tuple[str, str], tuple[str, int]]) -> str:
    """The text with surrogates. Exceptions: other type (a name's settled gender) and attempt of entities as found here."""
    out, at = [], 0
    for start, end, kind, entity in mentions(text):
        settled, attempt = exceptions.get((kind, entity), (kind, 0))
        made = surrogate(key, settled, entity, attempt)
        out += [text[at:start], rendered(kind, text[start:end], made)]
        at = end
    return "".join([*out, text[at:]]) if out else text


ENTITY = pa.struct([("kind", pa.string()), ("entity", pa.string())])


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        ids, found = [], []
        for doc_id, text in zip(batch.column("sig").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for kind, entity in sorted({m[2:] for m in mentions(text or "")}):
                ids.append(doc_id)
                found.append((kind, entity))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([k for k, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["sig", "kind", "entity"]
        )


def _draw(key: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [surrogate(key, r["kind"], r["entity"], r["attempt"]) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "entity", "attempt")), pa.array(made, pa.string())], ["kind", "entity", "attempt", "made"])

    return run


def space(kind: str = "kind") -> F.Column:
    """What surrogates must be distinct in: names of all genders are one namespace."""
    return F.when(F.col(kind).startswith("name"), "name").otherwise(F.col(kind)).alias("space")


def settled(seen: DataFrame) -> DataFrame:
    """(kind, entity) of the corpus, each name once: of the gender that most texts give it, if one does."""
    name = F.col("kind").startswith("name")
    vote = F.when(F.col("kind") == "name_f", 1).when(F.col("kind") == "name_m", -1).otherwise(0)
    votes = seen.where(name).groupBy("entity").agg(F.sum(vote).alias("n"))
    names = votes.select(F.when(F.col("n") > 0, "name_f").when(F.col("n") < 0, "name_m").otherwise("name_u").alias("kind"), "entity")
    return names.unionByName(seen.where(~name).select("kind", "entity").distinct())


def assigned(entities: DataFrame, key: bytes = KEY, draw: Callable | None = None) -> DataFrame:
    """(kind, entity, attempt, made): surrogates of distinct entities without collisions.

    Each round draws for the entities that still collide, and keeps what is free:
    no entity of the corpus, taken by no one, and the smallest entity among equal
    draws. Rounds handle the collisions left, a small and falling share.
    """
    draw = draw or _draw(key)
    real = stored(entities.select("kind", "entity").distinct())
    pending = real.withColumn("attempt", F.lit(0))
    done: DataFrame | None = None
    while True:
        drawn = stored(mapped(pending, draw, "kind string, entity string, attempt int, made string"))
        first = drawn.groupBy(space(), "made").agg(F.min(F.struct("entity", "kind")).alias("own")).select("space", "made", "own.entity", "own.kind")
        taken = real.select(space(), F.col("entity").alias("made"))
        free = first.join(taken, ["space", "made"], "left_anti")
        if done is not None:
            free = free.join(done.select(space(), "made"), ["space", "made"], "left_anti")
        free = free.select("kind", "made", "entity")
        kept = drawn.join(free, ["kind", "made", "entity"], "left_semi").select("kind", "entity", "attempt", "made")
        done = stored(kept if done is None else done.unionByName(kept))
        pending = stored(
            drawn.join(done.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        )
        if pending.isEmpty():
            return done


def signature(text: str = "text") -> F.Column:
    return F.xxhash64(F.col(f"`{text}`"))


def pseudonymize(docs: DataFrame, key: bytes = KEY, text: str = "text", draw: Callable | None = None) -> DataFrame:
    """The same rows and columns, entities in ``text`` replaced.

    Documents are read twice and never shuffled unless the exceptions (entities
    drawn anew, names whose gender here is not the corpus's) exceed a stated
    number; then rows are joined with them by a hash of the text.
    """
    columns = docs.columns
    held = docs.select(signature(text).alias("sig"), F.col(f"`{text}`").alias("text")).where("text is not null")
    seen = stored(mapped(held, _detect, "sig long, kind string, entity string").distinct())
    table = assigned(settled(seen), key, draw).select(space(), "entity", "attempt", F.col("kind").alias("settled"))
    found = seen.select("kind", "entity").distinct().withColumn("space", space())
    odd = found.join(table, ["space", "entity"]).where("attempt > 0 or settled <> kind").select("kind", "entity", "settled", "attempt")
    odd = stored(odd)
    names = [f"c{k}" for k in range(len(columns))]
    rows = docs.toDF(*names)
    own = names[columns.index(text)]
    few = odd.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = {(r["kind"], r["entity"]): (r["settled"], r["attempt"]) for r in odd.collect()} if few else {}
    if few:
        joined = rows
    else:
        by_text = (
            seen.join(odd, ["kind", "entity"]).groupBy("sig")
            .agg(F.sort_array(F.collect_set(F.struct("kind", "entity", "settled", "attempt"))).alias("odd"))
            .withColumnRenamed("sig", "pii_sig")
        )
        joined = rows.join(stored(by_text), signature(own) == F.col("pii_sig"), "left").select(*names, "odd")
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            made = []
            others = [None] * batch.num_rows if few else batch.column("odd").to_pylist()
            for value, rest in zip(batch.column(own).to_pylist(), others, strict=True):
                exceptions = known if few else {(r["kind"], r["entity"]): (r["settled"], r["attempt"]) for r in rest or ()}
                made.append(None if value is None else replaced(key, value, exceptions))
            yield pa.RecordBatch.from_arrays(
                [pa.array(made, pa.string()) if name == own else batch.column(name) for name in names], names
            )

    return mapped(joined, run, schema).toDF(*columns)


def report(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """The query's rows: doc_id, text with surrogates, and the entities found in the input by type."""
    rows = pick(docs, doc_id="doc_id", text="text")
    return pseudonymize(rows.withColumn("n_chars_before", F.length("text").cast("long")), key)
