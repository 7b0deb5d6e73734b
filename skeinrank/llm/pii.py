"""Personal data and secrets: every detected entity is replaced by a surrogate of its type.

A surrogate is drawn by a keyed hash of the type and the value, so that the same value gets the same surrogate in every
document, without a table; the key is the caller's secret. It keeps the format: digits stay digits, letters stay letters of
their case and script, separators stay; card numbers and bank accounts keep right (or wrong) check digits, addresses stay
addresses, e-mail domains are reserved ones and equal domains stay equal. Persons are known by their names, whatever title
stands before them: a given name is drawn for the person, from those of the gender that the title, or else the given name,
tells; a family name is drawn for the family, and stands for itself wherever it is written after it has occurred as a name
in the same text (but behind an article, where it may be a common word). The text is rewritten in one pass over the original.

The distinct values of the corpus are checked: where two values would share a surrogate, or a surrogate equals a value that
occurs, all but the first draw again, until all are distinct. Values that draw again get longer surrogates by and by, so
that there is always a free one (IP addresses stay addresses and are drawn from all of them). Family names are settled before full names, so that a person keeps one family name. Only
the values that had to draw again are carried to the documents: by a broadcast if they are at most `limit`, else each row
that holds some is joined with its own.

Detected are e-mail and IP addresses (4 and 6), hardware addresses, phone, card, account and social security numbers,
secrets behind a word for one, keys of known forms, long hexadecimal digests, local phone numbers, birthdays and passport numbers behind
a word for them, and names behind a title (Latin, Cyrillic, Chinese) or with a given name of the lists, with hyphens, apostrophes
and particles. Other names without a title, and names all in small letters, are not; offices behind a title are no names.

Edge cases: the body of a secret without letters and digits is replaced by letters; a null text stays null and an empty one
empty; texts without entities are unchanged; version numbers and short numbers are no entities; repeated rows give equal
rows; very long texts are read whole, in time in proportion to them, also without a blank; an empty table gives no rows; other columns, whatever their names, are kept by
`replace` and left out by `surrogates`.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, staged, without

#: Titles that tell a gender, and given names of each, by script.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "г-н", "Господин", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Lady", "г-жа", "Госпожа", "госпожа")
OTHER_TITLES = ("Dr", "Prof", "Professor")
CHINESE_TITLES = ("先生", "女士", "小姐", "太太")
MALE_NAMES = (
    "Adam", "Andrew", "Anthony", "Brian", "Bruno", "Carl", "Carlos", "Charles", "Daniel", "David", "Edward", "Emil", "Felix", "Frank", "George", "Hans", "Henry", "Hugo", "Ivan", "James", "Jean", "John",
    "Jonas", "Jorge", "Joseph", "Juan", "Karl", "Kevin", "Leon", "Luis", "Martin", "Michael", "Oscar", "Paul", "Peter", "Pierre", "Robert", "Simon", "Stefan", "Thomas", "Victor", "William",
    "Ahmed", "Ali", "Arjun", "Chen", "Dmitri", "Hassan", "Hiroshi", "Ibrahim", "Kenji", "Li", "Ming", "Mohammed", "Omar", "Raj", "Rajesh", "Sergei", "Vladimir", "Wei", "Yusuf",
)
FEMALE_NAMES = (
    "Ada", "Alice", "Anna", "Barbara", "Bella", "Carmen", "Clara", "Diana", "Elena", "Elizabeth", "Emma", "Eva", "Flora", "Greta", "Hannah", "Helena", "Irene", "Isabel", "Jane", "Jennifer", "Julia", "Karen",
    "Laura", "Linda", "Lucia", "Margaret", "Maria", "Marie", "Mary", "Nancy", "Nora", "Olga", "Patricia", "Paula", "Sarah", "Sofia", "Susan", "Vera",
    "Aisha", "Ananya", "Fatima", "Leila", "Mei", "Natasha", "Priya", "Sakura", "Yuki", "Zainab",
)
NEUTRAL_NAMES = ("Alex", "Andrea", "Charlie", "Dana", "Kim", "Robin", "Sam", "Sascha")
GIVEN = {"m": MALE_NAMES, "f": FEMALE_NAMES, "n": NEUTRAL_NAMES}
SYLLABLES = ("ba", "bel", "cor", "dan", "del", "fer", "gar", "hol", "kar", "lan", "lor", "mar", "mon", "nor", "par", "ros", "sal", "tor", "val", "win")
#: Particles of family names, and words behind a title that are no names.
PARTICLES = ("van", "von", "de", "del", "della", "di", "da", "dos", "das", "du", "la", "le", "den", "der", "ten", "ter", "zu", "zur", "bin", "ibn", "al", "el", "st")
OFFICES = (
    "President", "Chairman", "Chairwoman", "Chair", "Speaker", "Minister", "Secretary", "Ambassador", "Justice", "Judge", "Mayor", "Governor", "Senator", "Director", "Commissioner", "Doctor", "Professor",
    "Präsident", "Präsidentin", "Minister", "Ministerin", "Direktor", "Bürgermeister", "Président", "Présidente", "Ministre", "Directeur", "Presidente", "Presidenta", "Ministro", "Ministra",
    "The", "A", "An", "And", "Or", "Of", "In", "On", "At", "To", "Is", "Who", "He", "She", "It", "This", "That", "Right", "Wrong",
)
ARTICLES = ("a", "an", "the", "A", "An", "The", "der", "die", "das", "le", "la", "el", "un", "une", "una")

_GENDER = {t: "m" for t in MALE_TITLES} | {t: "f" for t in FEMALE_TITLES}
_OF_NAME = {name: g for g, names in GIVEN.items() for name in names}
_TITLES = "|".join(sorted((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES), key=len, reverse=True))
_GIVEN = "|".join(sorted(_OF_NAME, key=len, reverse=True))
#: A capitalised name, also with a hyphen or an apostrophe in it, and a family name with the particles before it.
_CAPITAL = r"[^\W\d_a-zа-яё]"
_NAME = rf"(?:{_CAPITAL}['’])?{_CAPITAL}[^\W\d_]+(?:[\-'’]{_CAPITAL}[^\W\d_]+)*"
_FAMILY = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME}"
#: What a title stands before without a name.
_NO_NAME = rf"(?!(?:{'|'.join(OFFICES)})\b)"
_DATE = r"\d{1,2}[./\-]\d{1,2}[./\-](?:\d{4}|\d{2})|\d{4}[./\-]\d{1,2}[./\-]\d{1,2}"
_HEX4 = "[0-9A-Fa-f]{1,4}"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+\-])[\w.%+\-]++@(?:[\w\-]++\.)+[^\W\d_]{2,})"
    r"|(?P<secret>\b(?i:password|passwd|pwd|secret|token|api[_\-]?key)\s?[=:]\s?[\"']?[^\s\"']{6,})"
    rf"|(?P<dated>\b(?i:born(?: on)?|date of birth|dob|d\.o\.b\.|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)[ :]{{1,3}}(?P<date>{_DATE})(?![\d]))"
    r"|(?P<papers>\b(?i:passport|passeport|reisepass|pasaporte)(?: (?i:no|nr|number|nummer|numéro|número))?[.:]{0,2} ?(?P<passport>(?=[A-Z]{0,3}\d)[A-Z0-9]{6,9})\b)"
    r"|(?P<called>\b(?i:phone|telephone|tel|call|mobile|cell|fax|text)(?: (?i:me at|us at|at|no|number))?[.:]{0,2} (?P<local>\d{3}[\-. ]\d{4})(?![\d\-]))"
    r"|(?P<key>\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|sk-[A-Za-z0-9_\-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,})\b)"
    r"|(?P<mac>\b[0-9A-Fa-f]{2}(?:[:\-][0-9A-Fa-f]{2}){5}\b(?![:\-]))"
    rf"|(?P<ipv6>(?<![\w:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?:{_HEX4}(?::{_HEX4}){{0,5}})?::(?:{_HEX4}(?::{_HEX4}){{0,5}})?)(?![\w:]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}[\-. ]\d{3}[\-. ]\d{4}(?![\d\-])|(?<![\d\-.])0\d{2,4} \d{3,4} \d{4}(?![\d\-])|(?<![\d\-.])0[1-9](?:[ .]\d{2}){4}(?![\d\-]))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<card>(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d))"
    r"|(?P<hex>\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,}\b)"
    rf"|(?P<name>\b(?P<title>{_TITLES})\.? {_NO_NAME}(?P<first>{_FAMILY})(?: (?P<last>{_FAMILY}))?)"
    rf"|(?P<person>\b(?P<given>(?:{_GIVEN})(?:-(?:{_GIVEN}))?) (?P<family>{_FAMILY}))"
    rf"|(?P<chinese>(?<![\u4e00-\u9fff])[\u4e00-\u9fff]{{1,3}}(?={'|'.join(CHINESE_TITLES)}))"
)
#: An entity holds one of these, or begins with a title, a given name or a key's mark: elsewhere the pattern isn't tried.
_ANCHOR = re.compile(r"[@0-9=:]+")
_TITLE = re.compile(rf"\b(?:{_TITLES})\.? |\b(?:{_GIVEN})[ \-]|AKIA|ASIA|sk-|gh[pousr]_|xox|{'|'.join(CHINESE_TITLES)}")
_REACH = 24
_BLANK = re.compile(r"[ \n]")
_WORD_BEFORE = re.compile(r"(?:^|\W)(\w+) $")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Draw:
    """A stream of numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: str):
        self._seed, self._n, self._pool = "\0".join(parts).encode("utf-8", "surrogatepass"), 0, 0
        self._key, self._left = key, 0

    def below(self, n: int) -> int:
        if self._left < 2**16 * n:
            digest = hashlib.blake2b(self._seed + self._n.to_bytes(4, "little"), key=self._key, digest_size=32).digest()
            self._n, self._pool, self._left = self._n + 1, int.from_bytes(digest, "little"), 2**256
        self._pool, out = divmod(self._pool, n)
        self._left //= n
        return out


def _shape(text: str, draw: Draw, hexes: bool = False) -> str:
    """text with digits and letters drawn anew, each of its kind; hexes: letters stay below g."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            new = "abcdef"[draw.below(6)] if hexes else _LETTERS[draw.below(26)]
            if ord(c) > 127 and "LATIN" not in unicodedata.name(c, ""):
                base = ord(c) & ~0xF  # another letter of the same block
                near = [chr(x) for x in range(base, base + 16) if chr(x).isalpha() and chr(x).isupper() == c.isupper()]
                if len(near) > 1:
                    out.append(near[draw.below(len(near))])
                    continue
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


def _syllables(n: int, draw: Draw) -> str:
    return "".join(SYLLABLES[draw.below(len(SYLLABLES))] for _ in range(n))


def _family(name: str, draw: Draw, attempt: int) -> str:
    if name.isascii() or all("LATIN" in unicodedata.name(c, "") for c in name):
        made = _syllables(2 + draw.below(2) + attempt, draw)
        return made.upper() if name.isupper() else made.capitalize()
    return _shape(name + name[-1] * attempt, draw)


def _account_rest(account: str) -> int:
    """The remainder of an account number by which its check digits are told: 1 if they are right."""
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _account(value: str, draw: Draw, more: int) -> str:
    made = value[:2] + _shape(value[2:] + "0" * more, draw)
    if _account_rest(value) != 1:
        return made
    return made[:2] + f"{98 - _account_rest(made[:2] + '00' + made[4:]):02d}" + made[4:]


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0, family: int = 0) -> str:
    """The surrogate of a value; attempt: how often it has had to draw again, and family: how often its family name has.

    Every second attempt makes it longer by one, so that any number of values of one form can be told apart. A person's
    value is the gender, the given and the family name.
    """
    draw, more = Draw(key, kind, value, str(attempt)), attempt // 2
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        host = Draw(key, "domain", domain.lower(), "0")
        return f"{_shape(local + 'x' * more, draw)}@{_shape(labels[0], host)}.example.{labels[-1]}"
    if kind == "secret":
        head = re.match(r"\w+(?:-\w+)?\s?[=:]\s?[\"']?", value)[0]
        body = value[len(head) :]
        if not any(c.isdigit() or c.isalpha() for c in body):
            body = "x" * len(body)
        hexes = bool(re.fullmatch(r"[0-9a-f]+", body))
        return head + _shape(body + ("a" if hexes else "x") * more, draw, hexes=hexes)
    if kind == "key":
        head = re.match(r"AKIA|ASIA|sk-|gh[pousr]_|xox[abprs]-", value)[0]
        return head + _shape(value[len(head) :] + "X" * more, draw)
    if kind == "iban":
        return _account(value, draw, more)
    if kind in ("hex", "mac", "ipv6"):
        return _shape(value + "0" * more, draw, hexes=True)
    if kind == "ip":
        return ".".join(str(draw.below(254) + 1) for _ in range(4))
    if kind == "birthday" and attempt < 16:
        # Day and month fit either order; years keep their length.
        year = lambda x: str(1930 + draw.below(80)) if len(x) == 4 else f"{draw.below(100):02d}"
        parts = re.split(r"([./\-])", value)
        four = [i for i in (0, 4) if len(parts[i]) == 4] or [4]
        return "".join(year(x) if i in four else x if i % 2 else str(1 + draw.below(12)).zfill(len(x)) for i, x in enumerate(parts))
    if kind == "card":
        made = [c for c in _shape(value + "0" * more, draw)]
        places = [i for i, c in enumerate(made) if c.isdigit()]
        if _luhn([int(c) for c in value if c.isdigit()]) == 0:
            made[places[-1]] = "0"
            made[places[-1]] = str(-_luhn([int(made[i]) for i in places]) % 10)
        return "".join(made)
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .\-(])", value)
        head = country[0] if country else ""
        return head + _shape(value[len(head) :] + "0" * more, draw)
    if kind == "family":
        return _family(value, draw, attempt)
    if kind == "name":
        gender, given, last = value.split("|")
        pool = GIVEN[gender] if given.isascii() or "LATIN" in unicodedata.name(given[0], "") else None
        first = pool[draw.below(len(pool))] + _syllables(more, draw) if pool else _shape(given + given[-1] * more, draw)
        return f"{first} {surrogate('family', last, key, family)}"
    return _shape(value + "0" * more, draw)


def _named(m: re.Match) -> tuple[str, str, int, int]:
    """The person or family of a match; the span is that of the names, without the title."""
    if m.lastgroup == "chinese":
        return "family", m[0], m.start(), m.end()
    first, last = (m["first"], m["last"]) if m["title"] else (m["given"], m["family"])
    start = m.start("first" if m["title"] else "given")
    if last is None:
        return "family", first, start, m.end()
    gender = _GENDER.get(m["title"] or "") or _OF_NAME.get(first.partition("-")[0], "n")
    return "name", f"{gender}|{first}|{last}", start, m.end()


#: Entities told by a word before them: the group that holds them, and their kind.
_INNER = {"dated": ("date", "birthday"), "papers": ("passport", "passport"), "called": ("local", "phone")}


def entities(text: str | None) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) of every entity of a text, in order."""
    out = []
    for a, b in _windows(text) if text else ():
        for m in PATTERN.finditer(text, a, b):
            kind = m.lastgroup
            if kind in _INNER:
                inner, shown = _INNER[kind]
                out.append((shown, m[inner], m.start(inner), m.end(inner)))
            else:
                out.append(_named(m) if kind in ("name", "person", "chinese") else (kind, m[0], m.start(), m.end()))
    return out


def _windows(text: str) -> list[tuple[int, int]]:
    """Where entities can be: around the anchors, out to white space; in order and apart from each other."""
    spots = [(m.start() - _REACH, m.end() + _REACH) for m in _ANCHOR.finditer(text)] + [(m.start(), m.end() + 4 * _REACH) for m in _TITLE.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spots):
        if out and a <= out[-1][1]:
            if b <= out[-1][1]:
                continue
            a = out.pop()[0]
        else:
            # No further back than the last window, nor on than the next blank: every character is looked at a few times.
            low = out[-1][1] if out else 0
            a = max(text.rfind(" ", low, max(0, a)), text.rfind("\n", low, max(0, a)), low - 1) + 1
        end = _BLANK.search(text, b)
        out.append((a, end.start() if end else len(text)))
    return out


def rewrite(text: str | None, key: bytes, again: dict[tuple[str, str], int]) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds that were found; names count as name, with or without a given one."""
    found = entities(text)
    if not found:
        return text, []
    last = lambda kind, value: value.split("|")[-1] if kind in ("name", "family") else ""
    families = {last(k, v): surrogate("family", last(k, v), key, again.get(("family", last(k, v)), 0)) for k, v, *_ in found if last(k, v)}
    # Written in capitals it is the same name.
    families = {n.upper(): made.upper() for n, made in families.items() if len(n) > 2} | families
    # A family name that also stands alone refers to the same person.
    alone = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(families, key=len, reverse=True)))})(?!\w)") if families else None

    def swap(m: re.Match) -> str:
        before = _WORD_BEFORE.search(m.string[max(0, m.start() - 8) : m.start()])
        return m[0] if before and before[1] in ARTICLES else families[m[0]]

    def gap(a: int, b: int) -> str:
        return alone.sub(swap, text[a:b]) if alone else text[a:b]

    out, at = [], 0
    for kind, value, a, b in found:
        out += [gap(at, a), surrogate(kind, value, key, again.get((kind, value), 0), again.get(("family", last(kind, value)), 0) if kind == "name" else 0)]
        at = b
    return "".join([*out, gap(at, len(text))]), ["name" if k == "family" else k for k, *_ in found]


def _finder(batches):
    for batch in batches:
        kinds, values = [], []
        for text in batch["text"]:
            for kind, value, _, _ in entities(text.as_py()):
                kinds.append(kind)
                values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])


def _drawer(key: bytes):
    def draw(batches):
        for batch in batches:
            made = [surrogate(k, v, key, n, f) for k, v, n, f in zip(*(batch[c].to_pylist() for c in ("kind", "value", "attempt", "family")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("kind", "value", "attempt", "family")), pa.array(made, pa.string())], names=["kind", "value", "attempt", "family", "made"])

    return draw


def drawn_again(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the values whose first surrogate was taken: a staged table, mostly empty.

    Family names, also those of persons, are values of the kind family.
    """
    values = staged(docs.select("text").mapInArrow(_finder, "kind string, value string").distinct(), "pii-values")
    last = F.substring_index("value", "|", -1)
    families = values.where("kind in ('name', 'family')").select(F.lit("family").alias("kind"), last.alias("value")).distinct()
    again = _settled(families.withColumn("family", F.lit(0)), key)
    own = again.select(F.lit("name").alias("kind"), F.col("value").alias("last"), F.col("attempt").alias("family"))
    named = values.where("kind <> 'family'").withColumn("last", last).join(own, ["kind", "last"], "left")
    return again.union(_settled(named.select("kind", "value", F.coalesce("family", F.lit(0)).alias("family")), key))


def _settled(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of those of values (kind, value, family) that had to draw again until all were distinct."""
    shape = "kind string, value string, attempt int, family int, made string"
    table = staged(values.select("kind", "value", F.lit(0).alias("attempt"), "family").mapInArrow(_drawer(key), shape), "pii-drawn")
    plain = F.when(F.col("kind") == "name", F.replace(F.substring("value", 3, 2**30), F.lit("|"), F.lit(" "))).otherwise(F.col("value"))
    originals = table.select("kind", plain.alias("made"), F.lit(True).alias("taken")).distinct()
    while True:
        # Settled values keep their surrogate before those that drew again, then by value.
        place = F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "value"))
        checked = table.withColumn("place", place).join(originals, ["kind", "made"], "left")
        clash = (F.col("place") > 1) | F.col("taken").isNotNull()
        marked = staged(checked.select("kind", "value", "attempt", "family", "made", clash.alias("clash")), "pii-checked")
        if marked.where("clash").isEmpty():
            return marked.where("attempt > 0").select("kind", "value", "attempt")
        redrawn = marked.where("clash").select("kind", "value", (F.col("attempt") + 1).cast("int").alias("attempt"), "family").mapInArrow(_drawer(key), shape)
        table = marked.where("not clash").select("kind", "value", "attempt", "family", "made").union(redrawn)


def _rewriter(key: bytes, again: dict[tuple[str, str], int] | None):
    def run(batches):
        for batch in batches:
            texts, kinds = [], []
            own = [None] * batch.num_rows if again is not None else batch["again"].to_pylist()
            for text, mine in zip(batch["text"], own, strict=True):
                table = again if again is not None else {(x["kind"], x["value"]): x["attempt"] for x in mine or ()}
                new, found = rewrite(text.as_py(), key, table)
                texts.append(new)
                kinds.append(found)
            yield pa.RecordBatch.from_arrays([batch["whole"], pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["whole", "text", "kinds"])

    return run


def _occurrences(rows: DataFrame) -> DataFrame:
    """(row, kind, value) of all entities and family names of rows (row, text), without repeats within a row."""

    def find(batches):
        for batch in batches:
            found = [(r, k, v) for r, t in zip(batch["row"].to_pylist(), batch["text"], strict=True) for k, v, *_ in entities(t.as_py())]
            found += [(r, "family", v.split("|")[-1]) for r, k, v in found if k == "name"]
            yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate((("row", pa.int64()), ("kind", pa.string()), ("value", pa.string())))})

    return rows.select("row", "text").mapInArrow(find, "row long, kind string, value string").distinct()


def _replaced(docs: DataFrame, key: bytes, limit: int) -> DataFrame:
    """(whole, text, kinds) per row of docs: its other columns as they were, the new text, and the kinds found."""
    again = drawn_again(docs, key)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*others).alias("whole"), "text")
    schema = T.StructType([rows.schema["whole"], T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    few = again.head(limit + 1)
    if len(few) <= limit:
        return rows.mapInArrow(_rewriter(key, {(r.kind, r.value): r.attempt for r in few}), schema)
    # More than may be broadcast: each row, known by a number of its own, gets those of its values that had to draw again.
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    own = staged(_occurrences(rows).join(again, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("again")), "pii-own")
    ids = staged(own.select("row"), "pii-ids")
    hit = among(rows, ids, ["row"], limit).join(own, "row")
    rest = without(rows, ids, ["row"], limit).withColumn("again", F.lit(None).cast(own.schema["again"].dataType))
    return hit.unionByName(rest).select("whole", "text", "again").mapInArrow(_rewriter(key, None), schema)


def replace(docs: DataFrame, key: bytes, limit: int = 10_000) -> DataFrame:
    """docs with every entity in text replaced; all columns of docs. Whoever knows key can tell surrogates of guessed values."""
    out = _replaced(docs, key, limit)
    return out.select(*[F.col("text") if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns])


def surrogates(docs: DataFrame, key: bytes, limit: int = 10_000) -> DataFrame:
    """Per document: doc_id, text (with surrogates), n_entities, kinds (sorted, comma-separated, with repeats)."""
    out = _replaced(docs.select("doc_id", "text"), key, limit)
    return out.select("whole.doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), F.array_join(F.array_sort("kinds"), ",").alias("kinds"))
