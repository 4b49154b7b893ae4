"""Personal data and secrets replaced by keyed surrogates.

Detected: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card and
other 13- to 19-digit numbers, social-security numbers, IBANs, secrets after
words such as ``token =`` or of a well-known form, and names after a title. Every mention has a canonical
entity (digits alone, lower case, a name's parts); a surrogate is drawn for the
entity by a keyed hash and written in the mention's own format, so all mentions
of an entity agree whatever their spelling (coreference), in every document.
Surrogates keep type and format: digit counts, separators, check digits that
hold, a telephone number's country code, letter case, script (letters come from
the mention's own, names of Latin or Cyrillic script from lists), and a name's
gender. IP addresses come from ranges that are reserved for tests or unused.

Collision checks: over the distinct entities of the whole corpus, a surrogate
that equals a real entity or another entity's surrogate is drawn again (with the
next counter) until none collides, so different entities stay different. Only
entities that were drawn again have to be looked up when texts are rewritten;
they are sent to the tasks if they are few (a checked bound) and joined to the
documents otherwise. The surrogates of all others follow from the key alone.

Defined cases: a null text stays null, an empty text stays empty; very long texts
are read whole; repeated rows get the same surrogates; a null id is as good as
any other, since ids are not read; a text without findings
is returned unchanged; an empty table gives an empty result; other columns of
the table are kept as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodegraph.llm.common import ship, stored, tidied

#: Redrawn entities up to which their counters travel with the tasks; beyond it they are joined.
SENT_ROWS = 200_000

# Given names by script and gender.
NAMES = {
    ("latin", "f"): ("Alice", "Anna", "Carla", "Clara", "Elena", "Emma", "Eva", "Greta", "Helen", "Ines", "Julia", "Laura", "Lena", "Lucy", "Marie", "Nora", "Paula", "Rosa", "Sarah", "Sofia"),
    ("latin", "m"): ("Adam", "Albert", "Bruno", "Carl", "David", "Emil", "Felix", "George", "Henry", "Hugo", "Ivan", "Jacob", "Leo", "Louis", "Marc", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Глеб", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Фёдор"),
}
# Syllables that names are made of, by script.
SYLLABLES = {
    "latin": ("bal", "ber", "dor", "fen", "gar", "hal", "jen", "kel", "lam", "mar", "nor", "pel", "ros", "sel", "tan", "ver", "wil", "zan"),
    "cyrillic": ("бар", "вел", "гор", "дол", "жар", "кор", "лем", "мир", "нов", "пол", "рат", "сол", "тар", "фед"),
}
ENDINGS = {("latin", "f"): ("a", "ina", "ette"), ("latin", "m"): ("o", "in", "ert"), ("cyrillic", "f"): ("а", "ина"), ("cyrillic", "m"): ("ин", "ан")}
# Titles and the gender they tell.
TITLES = {"Mr.": "m", "Mrs.": "f", "Ms.": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr.": "m", "Sra.": "f", "Dr.": "", "Prof.": "", "г-н": "m", "г-жа": "f", "Господин": "m", "Госпожа": "f"}

_EMAIL = re.compile(r"[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,}")
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
_NUMBER = re.compile(
    r"(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<!\w)(?P<card>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{13,19}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"
    r"|(?<!\w)(?P<phone>\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+[2-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ -]?\d{2,4}){1,3}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    re.ASCII,
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)
_SECRET = re.compile(r"(?i:\b(?:token|api[_-]?key|secret|password|passwd|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret>(?=[_\-+/.=]*[A-Za-z0-9])[A-Za-z0-9_\-+/.=]{8,})")
# Forms of secrets that tell themselves.
_KNOWN_SECRET = re.compile(r"(?<![\w-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[\w-]{35})(?![\w-])", re.ASCII)
_SECRET_START = re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza")
_SECRET_WORD = re.compile(r"(?i)token|key|secret|passw")
_NAME = re.compile(r"(?<!\w)(?P<title>" + "|".join(map(re.escape, TITLES)) + r") (?P<name>[^\W\d_]+(?:[ -][^\W\d_]+)?)")
_DIGIT = re.compile(r"[0-9]")
# Country codes of one and of two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@lru_cache(maxsize=1 << 14)
def _script(c: str) -> str:
    return unicodedata.name(c, "LATIN").split()[0].split("-")[0].lower()


def script_of(word: str) -> str:
    return _script(word[0])


@lru_cache(maxsize=1 << 10)
def _letters(block: int, script: str, category: str) -> str:
    """Letters of one script and case among 128 neighbours."""
    return "".join(c for c in map(chr, range(block, block + 128)) if unicodedata.category(c) == category and _script(c) == script)


def code_length(digits: str) -> int:
    """Digits of the country code of an international number."""
    return next((n for n in (1, 2) if digits[:n] in _CODES), 3)


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """Non-overlapping ``(start, end, kind, canonical entity)`` in order."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if _SECRET_WORD.search(text):
        found += [(*m.span("secret"), "secret", m["secret"].lower() if re.fullmatch(r"[0-9A-Fa-f]+", m["secret"]) else m["secret"]) for m in _SECRET.finditer(text)]
    if _SECRET_START.search(text):
        found += [(*m.span(), "secret", m[0]) for m in _KNOWN_SECRET.finditer(text)]
    if _DIGIT.search(text):
        at = 0
        while m := _NUMBER.search(text, at):
            digits = re.sub(r"\D", "", m[0])
            low, high = {"phone": (9, 15), "card": (13, 19)}.get(m.lastgroup, (0, 99))
            if not low <= len(digits) <= high:
                at = m.start() + 1
                continue
            at = m.end()
            kind = m.lastgroup
            if kind == "phone" and m[0][0] == "+":
                # A national number with ten digits is one of country 1.
                kind, digits = ("phone", digits[1:]) if digits[0] == "1" else ("abroad", digits)
            found.append((*m.span(), kind, ".".join(str(int(p)) for p in m[0].split(".")) if m.lastgroup == "ip" else digits))
        for m in _IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and iban_valid(plain):
                found.append((*m.span(), "iban", plain))
        if ":" in text:
            found += [(*m.span(), "ipv6", ":".join(f"{int(p, 16):x}" for p in m[0].split(":"))) for m in _IPV6.finditer(text)]
    for m in _NAME.finditer(text):
        parts, at = re.split(r"[ -]", m["name"]), m.start("name")
        named = [p[0] != p[0].lower() or p[0] == p[0].upper() for p in parts]  # a capital, or a script without case
        if not named[0]:
            continue
        if not all(named):
            parts = parts[:1]
        gender = TITLES[m["title"]]
        for i, p in enumerate(parts):
            script = script_of(p)
            if i == 0 and len(parts) == 2:
                sex = gender or next((s for (c, s), pool in NAMES.items() if c == script and p.title() in pool), "m")
                kind = f"given:{script}:{sex}"
            else:
                kind = f"family:{script}"
            found.append((at, at + len(p), kind, p.lower()))
            at += len(p) + 1
    found.sort(key=lambda m: (m[0], -m[1]))
    kept, end = [], 0
    for m in found:
        if m[0] >= end:
            kept.append(m)
            end = m[1]
    return kept


def _stream(key: bytes, kind: str, entity: str, counter: int) -> Iterator[int]:
    """Keyed pseudo-random bytes."""
    block = 0
    while True:
        yield from hmac.digest(key, f"{kind}\0{entity}\0{counter}\0{block}".encode("utf-8", "surrogatepass"), hashlib.sha256)
        block += 1


def _below(stream: Iterator[int], n: int) -> int:
    return (next(stream) << 24 | next(stream) << 16 | next(stream) << 8 | next(stream)) % n


def _shaped(text: str, stream: Iterator[int], hexadecimal: bool = False) -> str:
    """Letters for letters and digits for digits; everything else stays."""
    out = []
    for c in text:
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef"[_below(stream, 16)])
        elif c.isdigit():
            out.append(str(_below(stream, 10)))
        elif c.isalpha():
            script = _script(c)
            if script in ("latin", "cyrillic"):
                new = "abcdefghijklmnopqrstuvwxyz"[_below(stream, 26)] if script == "latin" else chr(0x430 + _below(stream, 32))
                out.append(new.upper() if c.isupper() else new)
            else:
                pool = _letters(ord(c) & ~127, script, unicodedata.category(c))
                out.append(pool[_below(stream, len(pool))])
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, counter: int) -> str:
    """The canonical surrogate of a canonical entity."""
    s = _stream(key, kind, entity, counter)
    if kind == "email":
        # A domain reserved for documentation; the local part grows by a letter every few counters, so short ones never run out.
        local = entity.rpartition("@")[0]
        return f"{_shaped(local, s)}{'abcdefghijklmnopqrstuvwxyz'[_below(s, 26)] * (counter // 4)}@{_shaped('aaaaaa', s)}.example.org"
    if kind == "ip":
        # 198.18.0.0/15 is for tests; beyond it 240.0.0.0/4, which nobody has.
        first = (198, 18 + _below(s, 2)) if counter < 2 else (240 + _below(s, 15), _below(s, 256))
        return ".".join(map(str, (*first, _below(s, 256), _below(s, 256))))
    if kind == "ipv6":
        return ":".join(["2001", "db8", *(f"{_below(s, 1 << 16):x}" for _ in range(6))])
    if kind == "card":
        body = (entity[0] if entity[0] != "0" else "0") + "".join(str(_below(s, 10)) for _ in entity[1:])
        if luhn(entity):
            body = next(body[:-1] + d for d in "0123456789" if luhn(body[:-1] + d))
        return body
    if kind == "abroad":
        n = code_length(entity)
        return entity[:n] + str(2 + _below(s, 8)) + "".join(str(_below(s, 10)) for _ in entity[n + 1 :])
    if kind == "phone":
        return str(2 + _below(s, 8)) + "".join(str(_below(s, 10)) for _ in entity[1:])
    if kind == "ssn":
        return f"9{_below(s, 100):02d}{_below(s, 100):02d}{_below(s, 10000):04d}"  # the 900s are never issued
    if kind == "iban":
        body = _shaped(entity[4:], s)
        check = next(f"{c:02d}" for c in range(2, 99) if iban_valid(f"{entity[:2]}{c:02d}{body}"))
        return f"{entity[:2]}{check}{body}"
    if kind == "secret":
        # Of letters or digits at least one; grows like an e-mail's local part, so that few of them never run out.
        return _shaped(entity, s, re.fullmatch(r"[0-9a-f]+", entity) is not None) + "".join("abcdef"[_below(s, 6)] for _ in range(counter // 4))
    part, script, *sex = kind.split(":")
    if script not in SYLLABLES:
        return _shaped(entity + entity[-1] * (counter // 4), s)
    if part == "given" and counter == 0:
        pool = NAMES[script, sex[0]]
        return pool[_below(s, len(pool))].lower()
    made = "".join(SYLLABLES[script][_below(s, len(SYLLABLES[script]))] for _ in range(2 + counter // 3))
    return made + (ENDINGS[script, sex[0]][_below(s, len(ENDINGS[script, sex[0]]))] if part == "given" else "")


def written(mention: str, kind: str, new: str) -> str:
    """The surrogate in the mention's format."""
    if kind in ("card", "phone", "abroad", "ssn", "iban"):
        kept = sum(c.isalnum() for c in mention) - len(new)  # a country's code stays
        chars = iter([c for c in mention if c.isalnum()][:kept] + list(new))
        return "".join(next(chars) if c.isalnum() else c for c in mention)
    if kind.startswith(("given", "family")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new.title()
    if kind != "secret" or re.fullmatch(r"[0-9A-Fa-f]+", mention):
        return new.upper() if mention.isupper() else new
    return new


def rewrite(text: str, key: bytes, counters) -> tuple[str, int]:
    """The text with surrogates, and the number of mentions; ``counters(kind, entity)`` tells which draw holds."""
    found, parts, end = mentions(text), [], 0
    for a, z, kind, entity in found:
        parts += [text[end:a], written(text[a:z], kind, surrogate(key, kind, entity, counters(kind, entity)))]
        end = z
    return "".join([*parts, text[end:]]) if found else text, len(found)


def redrawn(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``kind, entity, counter`` of the entities whose first surrogate collides: a stored table."""

    def detect(batches):
        for b in batches:
            seen = {(kind, entity) for t in b.column("text").to_pylist() if t for _, _, kind, entity in mentions(t)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([e for _, e in seen], pa.string())], names=["kind", "entity"])

    def draw(batches, counter):
        for b in batches:
            new = [surrogate(key, k, e, counter) for k, e in zip(b.column("kind").to_pylist(), b.column("entity").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), pa.array(new, pa.string())], names=["kind", "entity", "surrogate"])

    def drawn(df: DataFrame, counter: int) -> DataFrame:
        return df.select("kind", "entity").mapInArrow(lambda b: draw(b, counter), "kind string, entity string, surrogate string").withColumn("counter", F.lit(counter))

    entities = stored(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(detect), "kind string, entity string").distinct(), "entities")
    # Surrogates of a kind and entities of that kind share one space; genders of a script share theirs.
    space = F.regexp_replace("kind", ":[fm]$", "")
    real = entities.select(space.alias("space"), F.col("entity").alias("surrogate")).distinct()
    open_, settled, counter = entities, None, 0
    while True:
        tried = drawn(open_, counter).withColumn("space", space)
        first = tried.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "entity")).alias("first"))
        kept = tried.join(first, ["space", "surrogate"]).where("first.kind = kind and first.entity = entity").join(real, ["space", "surrogate"], "left_anti")
        if settled is not None:
            kept = kept.join(settled.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        kept = stored(kept.select("kind", "entity", "counter", "space", "surrogate"), "settled")
        settled = kept if settled is None else settled.unionByName(kept)
        open_ = stored(open_.join(kept, ["kind", "entity"], "left_anti").select("kind", "entity"), "open")
        counter += 1
        if open_.isEmpty():
            return settled.where("counter > 0").select("kind", "entity", "counter")


def replace(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str = "__n_mentions") -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and the number of mentions in a new last column."""
    ship(docs.sparkSession)
    again = redrawn(docs, key, text_col)
    text_at, width = docs.columns.index(text_col), len(docs.columns)
    schema = StructType([*docs.schema.fields, StructField(count_col, IntegerType())])
    names = schema.names
    few = again.limit(SENT_ROWS + 1).collect()

    def run(batches, look_up):
        for b in batches:
            out = [(None, 0) if t is None else rewrite(t, key, look_up(b, i)) for i, t in enumerate(b.column(text_at).to_pylist())]
            columns = list(b.columns)[:width]
            columns[text_at] = pa.array([t for t, _ in out], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in out], pa.int32())], names=names)

    if len(few) <= SENT_ROWS:
        counters = {(r["kind"], r["entity"]): r["counter"] for r in few}
        return docs.mapInArrow(tidied(lambda batches: run(batches, lambda b, i: lambda k, e: counters.get((k, e), 0))), schema)

    def held(batches):
        for b in batches:
            found = [(h, k, e) for h, t in zip(b.column("hash").to_pylist(), b.column("text").to_pylist()) if t for k, e in {(k, e) for _, _, k, e in mentions(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["hash", "kind", "entity"])

    # By text: its redrawn entities, at most as many as the text has.
    text = F.col(text_col).cast("string")
    by_text = (
        docs.select(F.xxhash64(text).alias("hash"), text.alias("text"))
        .mapInArrow(tidied(held), "hash long, kind string, entity string")
        .join(again, ["kind", "entity"])
        .groupBy("hash")
        .agg(F.collect_set(F.struct("kind", "entity", "counter")).alias("__counters"))
    )
    keyed = docs.withColumn("__hash", F.xxhash64(text))
    joined = keyed.join(by_text, keyed["__hash"] == by_text["hash"], "left").select(*(keyed[c] for c in docs.columns), "__counters")

    def looked_up(b, i):
        own = {(c["kind"], c["entity"]): c["counter"] for c in b.column("__counters")[i].as_py() or ()}
        return lambda k, e: own.get((k, e), 0)

    return joined.mapInArrow(tidied(lambda batches: run(batches, looked_up)), schema)
