"""Surrogates for personal data: keyed, type-consistent replacements that stay distinct over the corpus.

Detection finds e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment cards (Luhn and issuer
checked), IBANs (checksum), secret tokens (named as such, by the start of a service's keys, or bearers) and
titled person names of several words, with particles and initials; names without a title, national telephone
numbers but for ten digits in groups, postal addresses and birthdays are not looked for. Equal entities (by canonical value) get equal surrogates
everywhere; a surrogate keeps type, script, letter case, digit layout, and for names the gender of the
title. It is drawn from a keyed hash of type, value and attempt.

Coreference: case, a possessive ending and a +1 before a ten-digit number make no other entity. A title
with a surname alone, or with an initial and a surname, means the one full name with that surname, gender and
initial in the same text, and gets its surname; without one, or with several, it is an entity of its own.

Collision checks: over the distinct entities of the corpus, a surrogate that another entity has drawn,
or that is itself an entity of the corpus, is drawn again (names are compared by surname); later attempts
draw from larger spaces. The entities that need a later attempt travel to the tasks as a broadcast while
they are at most BROADCAST_ENTITIES, else by a join on the hash of the text.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import discard, map_batches, materialize

BROADCAST_ENTITIES = 100_000
#: Copies of the later attempts of one text in the join, over which the rows with that text are spread.
SALTS = 32
#: Attempts after which a form with few values grows.
GROW_AFTER = 6

LOCAL_CHARS = frozenset(string.ascii_letters + string.digits + "._%+-")
LOCAL_LENGTH = 64
DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
NUMBER = re.compile(
    r"(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.]*\d))"
    r"|(?P<card>(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]*\d))"
    r"|(?P<phone>(?<!\w)\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
)
SECRET = re.compile(r"(?i:token|api[_-]?key|secret|password)\s*[=:]\s*[\"']?(?P<secret>[0-9A-Za-z+/_-]{16,})")
# How keys of common services begin; only what follows is redrawn.
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "xoxb-", "xoxp-", "AIza")
SERVICE_KEY = re.compile(r"(?<![\w-])(?P<secret>(?:" + "|".join(KEY_STARTS) + r")[0-9A-Za-z_-]{16,})(?![\w-])|\bBearer (?P<bearer>[0-9A-Za-z._~+/-]{16,}=*)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.]*[\w:])")
# Titles before names by gender, particles inside names, words that end a name where they follow one.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "M", "Señor", "Sr", "Господин"),
    "": ("Dr", "Prof", "Professor", "Doctor"),
}
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "ter", "ten", "bin", "ibn", "al", "y")
NO_NAMES = ("Road", "Street", "Avenue", "Lane", "Square", "Drive", "Hall", "House", "Park", "School", "College", "University", "Company", "Inc", "Ltd", "GmbH")
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]"
_NAME = rf"{_CAPITAL}[\w'’-]+"
PERSON = re.compile(
    r"(?<!\w)(?P<title>" + "|".join(sorted((rf"{t}\.?" if t != "M" else r"M\." for own in TITLES.values() for t in own), key=len, reverse=True))
    + rf") (?P<person>(?:(?:{_CAPITAL}\.|{'|'.join(PARTICLES)}|{_NAME}) ){{0,5}}{_NAME})"
)
POSSESSIVE = re.compile(r"['’](?:[sS])?(?= |$)")

#: Cheap signs without which the longer patterns cannot match.
TWO_DIGITS = re.compile(r"\d\.?\d")
SECRET_WORDS = ("token", "key", "secret", "password")
TITLE_STARTS = tuple(f"{t}{end}" for own in TITLES.values() for t in own for end in (". ", " "))

# Given names by script and gender, syllables of surnames by script.
GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Elena", "Greta", "Ines", "Laura", "Marta", "Nora", "Paula", "Sofia"),
    ("latin", "m"): ("Adrian", "Bruno", "Daniel", "Felix", "Hugo", "Leon", "Martin", "Oscar", "Simon", "Victor"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София", "Юлия"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Максим", "Олег", "Роман", "Юрий"),
}
SYLLABLES = {
    "latin": ("ba", "ber", "dan", "del", "far", "gan", "hal", "kor", "lan", "lin", "mar", "mon", "nel", "ran", "ros", "sel", "tan", "ver", "win", "zan"),
    "cyrillic": ("ба", "бер", "вал", "гор", "дан", "жар", "зал", "кор", "лан", "мар", "мон", "нел", "пав", "ран", "рос", "сел", "тан", "фёд", "хар", "чер"),
}
SURNAME_ENDS = {"latin": ("er", "son", "ini", "ez"), ("cyrillic", "f"): ("ова",), ("cyrillic", "m"): ("ов",)}


def luhn_digit(digits: str) -> str:
    """The check digit that completes a card number."""
    total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def is_card(digits: str) -> bool:
    issuer = re.match(r"4|5[1-5]|2[2-7]|3[47]|6011|65", digits)
    return 13 <= len(digits) <= 19 and bool(issuer) and luhn_digit(digits[:-1]) == digits[-1]


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Places of e-mail addresses: from every @ a bounded way back and a domain forward."""
    reached, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > max(reached, at - LOCAL_LENGTH) and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            reached = domain.end()
        at = text.find("@", max(at + 1, reached))


def ipv6(raw: str) -> str | None:
    """An address in its short form; None for other things with colons, those without a digit or of one group, and wrapped IPv4 addresses."""
    try:
        address = ipaddress.IPv6Address(raw)
    except ValueError:
        return None
    known = re.search(r"\d", raw) and sum(map(bool, raw.split(":"))) > 1 and not address.ipv4_mapped
    return str(address) if known else None


class Entity(NamedTuple):
    """A mention: where it is, its type, canonical value and hint (a name's gender); part: '', or surname or initial, if it names only (an initial and) the surname."""

    start: int
    end: int
    kind: str
    value: str
    hint: str
    part: str = ""


def name_words(person: str) -> list[str]:
    """The words of a name: up to a possessive or a word that ends names; initials and particles only before a name."""
    owner = POSSESSIVE.search(person)
    words = (person[: owner.start()] if owner else person).split(" ")
    end = next((i for i, w in enumerate(words) if i and w in NO_NAMES), len(words))
    while end and (words[end - 1] in PARTICLES or len(words[end - 1].rstrip(".")) < 2):
        end -= 1
    return words[:end]


def persons(text: str) -> list[Entity]:
    """Titled names; a surname alone or after one initial stands for the only full name of the text that it can mean."""
    found = []
    for m in PERSON.finditer(text):
        gender = next(g for g, titles in TITLES.items() if m.group("title").rstrip(".") in titles)
        name = " ".join(name_words(m.group("person")))
        if name:
            found.append(Entity(m.start("person"), m.start("person") + len(name), "person", name.lower(), gender))
    full: dict[str, set[tuple[str, str]]] = {}
    for e in found:
        first, *rest = e.value.split(" ")
        if rest and not first.endswith("."):
            full.setdefault(rest[-1], set()).add((e.value, e.hint))

    def meant(e: Entity) -> Entity:
        """The mention as one of the full name, if only one of that surname, gender and initial is named; a title without gender fits any."""
        first, *rest = e.value.split(" ")
        if len(rest) > 1 or (rest and not first.endswith(".")):
            same = {(v, h) for v, h in full.get(rest[-1], ()) if v == e.value and h}
            return e._replace(hint=min(same)[1]) if not e.hint and len(same) == 1 else e
        names = {(v, h) for v, h in full.get(rest[-1] if rest else first, ()) if (not rest or v[0] == first[0]) and (not e.hint or not h or h == e.hint)}
        names = {(v, h) for v, h in names if h or not any(v == w and g for w, g in names)}
        if len(names) != 1:
            return e
        value, hint = names.pop()
        return e._replace(value=value, hint=hint, part="initial" if rest else "surname")

    return list(map(meant, found))


def entities(text: str | None) -> list[Entity]:
    """The mentions of a text in order, without overlaps."""
    if not text:
        return []
    found = [Entity(a, b, "email", text[a:b].lower(), "") for a, b in addresses(text)]
    low = text.lower()
    for m in SECRET.finditer(text) if any(w in low for w in SECRET_WORDS) else ():
        found.append(Entity(m.start("secret"), m.end("secret"), "secret", m.group("secret"), ""))
    for m in NUMBER.finditer(text) if TWO_DIGITS.search(text) else ():
        kind, raw = m.lastgroup, m.group()
        value = re.sub(r"[^0-9A-Z+]", "", raw)
        if kind == "ip":
            value = ".".join(str(int(x)) for x in raw.split("."))
            valid = all(int(x) < 256 for x in raw.split("."))
        elif kind == "card":
            valid = is_card(value)
        elif kind == "iban":
            valid = 15 <= len(value) <= 34 and iban_rest(value) == 1
        else:
            valid = 10 <= len(value.lstrip("+")) <= 15
            value = value[2:] if value.startswith("+1") and len(value) == 12 else value
        if valid:
            found.append(Entity(m.start(), m.end(), kind, value, ""))
    for m in SERVICE_KEY.finditer(text) if "Bearer " in text or any(w in text for w in KEY_STARTS) else ():
        found.append(Entity(m.start(m.lastgroup), m.end(m.lastgroup), "secret", m.group(m.lastgroup), ""))
    for m in IPV6.finditer(text) if text.count(":") > 1 else ():
        if value := ipv6(m.group()):
            found.append(Entity(m.start(), m.end(), "ipv6", value, ""))
    found += persons(text) if any(w in text for w in TITLE_STARTS) else []
    kept, reached = [], 0
    for span in sorted(found, key=lambda e: (e.start, -e.end)):
        if span.start >= reached:
            kept.append(span)
            reached = span.end
    return kept


class Draw:
    """A keyed stream of choices for one entity and attempt."""

    def __init__(self, *parts: str, key: bytes):
        self.seed, self.key, self.count, self.pool = "\x1f".join(parts).encode("utf-8"), key, 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 32:
            block = hashlib.blake2b(self.seed + self.count.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.pool, self.count = int.from_bytes(block, "big"), self.count + 1
        self.pool, value = divmod(self.pool, n)
        return value


def _redrawn(draw: Draw, text: str) -> str:
    """Letters by letters of the same case, digits by digits; the rest stays."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isascii() and c.isalpha():
            new = chr(97 + draw.below(26))
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate_value(kind: str, value: str, hint: str, attempt: int, key: bytes) -> str:
    """The surrogate of a canonical value, in canonical form."""
    draw = Draw(kind, hint, value, str(attempt), key=key)
    if kind == "email":
        local, _, domain = value.partition("@")
        *labels, top = domain.split(".")
        more = "".join(chr(97 + draw.below(26)) for _ in range(attempt // GROW_AFTER))
        return f"{_redrawn(draw, local)}{more}@{_redrawn(Draw('domain', domain, str(attempt // 4), key=key), '.'.join(labels))}.{top}"
    if kind == "ip":
        least, most = {1: 1, 2: 10, 3: 100}, {1: 9, 2: 99, 3: 255}
        sizes = [len(x) if attempt < GROW_AFTER else 0 for x in value.split(".")]
        return ".".join(str(least.get(n, 1) + draw.below(most.get(n, 254) - least.get(n, 1) + 1)) for n in sizes)
    if kind == "card":
        body = value[:1] + _redrawn(draw, value[1:-1])
        while not is_card(body + luhn_digit(body)):
            body = value[:2] + _redrawn(draw, value[2:-1])
        return body + luhn_digit(body)
    if kind == "iban":
        body = value[:2] + "00" + _redrawn(draw, value[4:])
        return f"{body[:2]}{98 - iban_rest(body):02d}{body[4:]}"
    if kind == "phone":
        if value.startswith("+"):
            return value[:3] + _redrawn(draw, value[3:])
        # area and exchange codes do not begin with 0 or 1
        digits = [str(draw.below(10)) if i % 3 or i > 3 else str(2 + draw.below(8)) for i in range(len(value))]
        return "".join(digits)
    if kind == "ipv6":
        groups = value.split(":")
        # no group becomes 0, which could shorten the address; groups of one digit may grow
        drawn = [f"{(1 << 4 * len(g) - 4) + draw.below(15 << 4 * len(g) - 4):x}" if g and attempt < GROW_AFTER else f"{4096 + draw.below(61440):x}" if g else "" for g in groups]
        return str(ipaddress.IPv6Address(":".join(drawn)))
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", value):
            return "".join("0123456789abcdef"[draw.below(16)] for _ in value)
        start = next((len(w) for w in KEY_STARTS if value.startswith(w)), 0)
        return value[:start] + _redrawn(draw, value[start:])
    script = "cyrillic" if re.search("[а-яё]", value) else "latin"
    syllables = SYLLABLES[script]
    surname = "".join(syllables[draw.below(len(syllables))] for _ in range(2 + attempt))
    ends = SURNAME_ENDS.get((script, hint or "m")) or SURNAME_ENDS["latin"]
    last = surname.capitalize() + ends[draw.below(len(ends))]
    given, names = GIVEN[script, hint or "m"], []
    for i, word in enumerate(value.split(" ")[:-1]):
        name = given[draw.below(len(given))]
        names.append(word if i and word in PARTICLES else f"{name[0]}." if word.endswith(".") else name)
    return " ".join([*names, last])


def short_form(surrogate: str, part: str) -> str:
    """A name as a mention has it: whole, by its surname, or by initial and surname."""
    first, *_, last = surrogate.split(" ") if part else (surrogate, surrogate)
    return surrogate if not part else last if part == "surname" else f"{first[0]}. {last}"


def formatted(kind: str, raw: str, surrogate: str) -> str:
    """The surrogate in the layout and letter case of the text it stands in for."""
    if kind in ("card", "phone", "iban"):
        own, new = [c for c in raw if c.isalnum()], surrogate.lstrip("+")
        symbols = iter([*own[: len(own) - len(new)], *new])  # a country code that is no part of the value stays
        return "".join(next(symbols) if c.isalnum() else c for c in raw)
    if kind == "ip":
        return ".".join(new.zfill(len(old)) for old, new in zip(raw.split("."), surrogate.split("."), strict=True))
    if kind == "person":
        return " ".join(new.upper() if old.isupper() else new for old, new in zip(raw.split(" "), surrogate.split(" "), strict=True))
    if kind == "ipv6":
        return surrogate.upper() if raw.isupper() else surrogate
    if kind == "email":
        if raw.isupper():
            return surrogate.upper()
        if len(raw) == len(surrogate):
            return "".join(s.upper() if r.isupper() else s for r, s in zip(raw, surrogate, strict=True))
    return surrogate


def replaced(text: str | None, attempts: dict[tuple[str, str, str], int], key: bytes) -> tuple[str | None, list[str]]:
    """The text with its surrogates, and the types that were replaced."""
    found = entities(text)
    if not found:
        return text, []
    out, at = [], 0
    for start, end, kind, value, hint, part in found:
        surrogate = surrogate_value(kind, value, hint, attempts.get((kind, value, hint), 0), key)
        out += [text[at:start], formatted(kind, text[start:end], short_form(surrogate, part))]
        at = end
    return "".join([*out, text[at:]]), [e.kind for e in found]


def mentions(texts: DataFrame) -> DataFrame:
    """text_key and kind, value, hint of every mention of every text. texts: text_key (long), text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *e[2:5]) for i, t in enumerate(batch.column(1)) for e in entities(t.as_py())]
            keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[c] for r in rows], pa.string()) for c in (1, 2, 3)]], ["text_key", "kind", "value", "hint"])

    return texts.select("text_key", "text").transform(map_batches, found, "text_key long, kind string, value string, hint string")


def assign_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """kind, value, hint, attempt, surrogate of every distinct entity: no two share one, none is itself an entity.

    Names are compared by their surnames. Of entities that draw the same, the one with the fewest attempts
    keeps it, then the smallest; the others draw again until none clashes.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate_value(k, v, h, a, key) for k, v, h, a in rows], pa.string())], [*batch.schema.names, "surrogate"])

    def compared(column: str) -> Column:
        return F.when(F.col("kind") == "person", F.lower(F.substring_index(column, " ", -1))).otherwise(F.col(column))

    known = materialize(found.select("kind", "value", "hint").distinct(), "entities")
    table = known.withColumn("attempt", F.lit(0))
    schema = "kind string, value string, hint string, attempt int, surrogate string"
    first = Window.partitionBy("kind", "mark").orderBy("attempt", "value", "hint")
    real = known.select("kind", compared("value").alias("mark")).distinct().withColumn("real", F.lit(True))
    before: DataFrame | None = None
    while True:
        tried = table.transform(map_batches, drawn, schema).withColumn("mark", compared("surrogate"))
        checked = tried.withColumn("turn", F.row_number().over(first)).join(real, ["kind", "mark"], "left")
        last, checked = before, materialize(checked.withColumn("clash", (F.col("turn") > 1) | F.col("real").isNotNull()), "surrogates")
        if not checked.where("clash").head(1):
            return checked.select("kind", "value", "hint", "attempt", "surrogate")
        table = checked.select("kind", "value", "hint", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
        before = checked
        if last is not None:
            discard(last)


def pseudonymize(docs: DataFrame, *, key: bytes, broadcast_entities: int = BROADCAST_ENTITIES) -> DataFrame:
    """Per row: doc_id, text with surrogates, n_entities (mentions), kinds (sorted, distinct, comma-separated).

    key: the secret of the keyed hash. Null texts stay null, empty ones empty; null and repeated ids are rows
    like any other; texts of any length are worked on whole, in time that grows with the length; an empty
    table gives no rows; other columns are not looked at, whatever their names.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = mentions(rows)
    later = materialize(assign_surrogates(found, key).where("attempt > 0"), "later-attempts")
    spark = docs.sparkSession
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_entities int, kinds string"
    shared = None
    if later.count() <= broadcast_entities:
        shared = spark.sparkContext.broadcast({(r["kind"], r["value"], r["hint"]): r["attempt"] for r in later.collect()})
        rows = rows.withColumn("later", F.lit(None).cast("array<struct<kind:string,value:string,hint:string,attempt:int>>"))
    else:
        # equal texts have equal entities, and texts of one hash may share theirs; a hot text's rows are spread over its copies
        own = found.distinct().join(later, ["kind", "value", "hint"]).groupBy("text_key").agg(F.collect_list(F.struct("kind", "value", "hint", "attempt")).alias("later"))
        own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(own, ["text_key", "salt"], "left")

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value if shared else {}
        for batch in batches:
            texts, kinds = [], []
            for text, later_own in zip(batch.column(1), batch.column(2), strict=True):
                own = {(x["kind"], x["value"], x["hint"]): x["attempt"] for x in later_own.as_py() or ()}
                new, types = replaced(text.as_py(), own or common, key)
                texts.append(new)
                kinds.append(types)
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, kinds), pa.int32()), pa.array([",".join(sorted(set(k))) for k in kinds], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_entities", "kinds"])

    return rows.select("doc_id", "text", "later").transform(map_batches, changed, out)
