"""PII surrogates: keyed, type-consistent replacements of detected entities.

Types: email, phone, ip, card, ssn, iban, secret (long hex strings, access key ids, and what is
assigned to a password, token or key, if it has eight characters and a digit) and person (a name after an
honorific, and where the text names that person again without one). A surrogate is a keyed permutation of the
entity's own shape: digits become digits, letters become letters of the same script, class (vowel, consonant) and
case, separators stay. So format and script match, and

* coreference holds: a surrogate hangs on the key and the entity's canonical form only (case-folded; phones
  without separators; names word by word), in every document and format;
* distinctness holds: permutations are one-to-one, and none leaves an entity as it is. A check over all distinct
  entities of the table looks for surrogates that meet each other or an entity that is really there. Entities that
  do are made anew, each under the next key of its own, until none does; their list is applied in every document. It
  is broadcast if it has at most BROADCAST_AGAIN entries, else joined to the documents that hold them. Where the
  table's entities fill over a quarter of all texts of a shape (short names), a surrogate may be another entity of
  the table, which is itself replaced everywhere.

What a checker tests stays true: a card passes (or fails) the check-digit test as before, an IBAN the mod-97 test, an
address stays in its class (private, loopback, link-local, multicast, reserved or public). Given names of the lists
are replaced from the list of their gender; an honorific's gender picks the list where a name is in both or none;
other names keep their pattern of vowels and consonants. Domains of emails keep their last part. Digits of a
card's length that fail the check-digit test count as a card where they are written in groups of four, as no other
number is; else they are left alone.

The key is the Spark setting KEY_SETTING; without it each session has a random one, so surrogates can't be reversed,
but differ from session to session.

Defined results: a null text stays null, with no entities; texts without entities stay as they are; repeated
rows get equal results; an empty table gives no rows; a text is read whole whatever its length, in linear time; columns
other than those named pass through unchanged.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, table, written

KEY_SETTING = "spark.tessera.surrogate.key"
#: Entities made anew that may be broadcast; keys an entity may try.
BROADCAST_AGAIN, TRIES = 100_000, 16
ROUNDS = 8
TYPES = ("email", "phone", "ip", "card", "ssn", "iban", "secret", "person")

# Given names, a list for each gender.
MALE = ("james john robert michael david william thomas charles daniel matthew paul mark andrew peter george henry "
        "hans karl jürgen stefan pierre jean luc antoine carlos juan pedro miguel luis diego").split()  # fmt: skip
FEMALE = ("mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa anna laura emma alice "
          "ursula monika sabine petra marie claire sophie camille maria carmen ana lucia elena rosa").split()  # fmt: skip
HONORIFICS = {"Mr": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Don": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Madame": "f", "Mme": "f", "Dr": "", "Prof": ""}

_CLASSES = ["0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "áéíóúàèìòùâêîôûäëïöü", "ñç", "".join(map(chr, range(0x430, 0x450))), "αβγδεζηθικλμνξοπρστυφχψω"]
#: Scripts whose letters follow each other: Hebrew, Arabic, Devanagari, kana, ideographs, Hangul.
_RANGES = [(0x5D0, 0x5EB), (0x621, 0x63B), (0x905, 0x93A), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)]
_CLASS_OF = {c: k for k, chars in enumerate(_CLASSES) for c in chars}

_NAME = r"[^\W\d_][\w'’-]+"
#: Classes of addresses: first address and size; all others are public.
_NETS = [(0, 1 << 24), (10 << 24, 1 << 24), (127 << 24, 1 << 24), (169 << 24 | 254 << 16, 1 << 16), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16), (224 << 24, 1 << 28), (240 << 24, 1 << 28)]
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]*+(?<=\w)@[\w-]+(?:\.[\w-]*\w)+)"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{32,64}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z]))"
    r"|(?<![A-Za-z])(?:[Pp]ass(?:word|wd)|PASSWORD|[Pp]wd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API_KEY)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?(?=[^\s\"'<>,;]{0,200}\d)(?P<credential>[^\s\"'<>,;@]{8,}+)(?!@)"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\d(])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    rf"|(?P<person>\b(?:{'|'.join(HONORIFICS)})\.?[ ]+{_NAME}(?:[ ]+{_NAME}){{0,2}})"
)
#: A text with none of these holds no entity.
_HINT = re.compile(rf"[@\d]|[0-9A-Fa-f]{{32}}|AKIA|\b(?:{'|'.join(HONORIFICS)})\b")


def _prf(key: bytes, label: str, size: int, turn: int, value: int, bits: int) -> int:
    data = b"%b|%b|%d|%d|%x" % (key, label.encode(), size, turn, value)
    return int.from_bytes(hashlib.shake_256(data).digest(bits // 8 + 1)) & ((1 << bits) - 1)


def _feistel(x: int, size: int, key: bytes, label: str, back: bool) -> int:
    """A permutation of the numbers below size, or its inverse."""
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ _prf(key, label, size, turn, left, half), left
            else:
                left, right = right, left ^ _prf(key, label, size, turn, right, half)
        x = left << half | right
        if x < size:
            return x


def permute(x: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of the numbers below size without a fixed point, if size is over 1."""
    if size < 2:
        return x
    step = 1 + _prf(key, label, size, -1, 0, 64) % (size - 1)
    return _feistel((_feistel(x, size, key, label, True) + step) % size, size, key, label, False)


def _class(c: str) -> tuple[int, int]:
    """Size of a character's class and its place there; (1, 0) if it stays."""
    if (k := _CLASS_OF.get(c)) is not None:
        return len(_CLASSES[k]), _CLASSES[k].index(c)
    for low, high in _RANGES:
        if low <= ord(c) < high:
            return high - low, ord(c) - low
    return 1, 0


def _of_class(c: str, place: int) -> str:
    if (k := _CLASS_OF.get(c)) is not None:
        return _CLASSES[k][place]
    for low, high in _RANGES:
        if low <= ord(c) < high:
            return chr(low + place)
    return c


def _lower(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _cased(new: str, like: str) -> str:
    return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for n, c in zip(new, like, strict=True))


def shaped(text: str, key: bytes, label: str, taken: tuple[str, ...] = ()) -> str:
    """A lower-case text permuted within its shape; never one of those taken, if it isn't itself."""
    classes = [_class(c) for c in text]
    size = 1
    for n, _ in classes:
        size *= n
    new = text
    while True:
        x = 0
        for c in new:
            n, place = _class(c)
            x = x * n + place
        x = permute(x, size, key, f"{label}|{_shape(text)}")
        out = []
        for c, (n, _) in zip(reversed(text), reversed(classes), strict=True):
            x, place = divmod(x, n)
            out.append(_of_class(c, place) if n > 1 else c)
        new = "".join(reversed(out))
        if new not in taken:
            return new


def _shape(text: str) -> str:
    return "".join(c if (n := _class(c))[0] == 1 else f"<{n[0]}:{_CLASS_OF.get(c, ord(c) >> 8)}>" for c in text)


def _digits(old: str, new: str) -> str:
    """old with its digits replaced in order."""
    it = iter(new)
    return "".join(next(it) if c in "0123456789" else c for c in old)


def _number(digits: str, key: bytes, label: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, label)).zfill(len(digits)) if digits else ""


def luhn(digits: str) -> int:
    """The check digit that makes the number pass when it is appended."""
    total = sum(v if i % 2 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_check(country: str, rest: str) -> int:
    """The check digits that make an IBAN pass."""
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _net(address: int) -> tuple[int, int] | None:
    return next(((low, size) for low, size in _NETS if low <= address < low + size), None)


def canonical(kind: str, text: str) -> str:
    """The form that all spellings of an entity share. A phone without country code is of the numbering plan whose
    formats are found without one, so it has code 1."""
    if kind == "phone":
        digits = "".join(c for c in text if c in "0123456789")
        return digits if text.startswith("+") else f"1{digits}"
    if kind in ("card", "ssn"):
        return "".join(c for c in text if c in "0123456789")
    if kind == "person":
        return " ".join(_lower(text).split()[1:])
    return _lower(text).replace(" ", "") if kind == "iban" else _lower(text)


def units(kind: str, text: str) -> list[tuple[str, str]]:
    """The entities, by canonical form, that an occurrence consists of: a name's words that aren't given names of the
    lists are one each, as they refer to the same family wherever they stand."""
    if kind != "person":
        return [(kind, canonical(kind, text))]
    names = canonical(kind, text).split()
    return [("name", n) for k, n in enumerate(names) if k or len(names) == 1 or n not in MALE + FEMALE]


def _own_key(key: bytes, again: dict[tuple[str, str], int], unit: tuple[str, str]) -> bytes:
    turn = again.get(unit, 0) if again else 0
    return hashlib.sha256(b"%b|%d" % (key, turn)).digest() if turn else key


def _word(word: str, key: bytes) -> str:
    return shaped(word, key, "name", tuple(MALE + FEMALE) if word not in MALE + FEMALE else ())


def _person(text: str, key: bytes, again: dict) -> str:
    head, _, rest = text.partition(" ")
    gender = HONORIFICS.get(head.rstrip("."), "")
    parts = re.split(r"( +)", rest)
    names = [k for k, p in enumerate(parts) if p.strip()]
    for order, k in enumerate(names):
        word = _lower(parts[k])
        if order == 0 and len(names) > 1 and (new := _given(word, gender, key)):
            parts[k] = new
        else:
            parts[k] = _cased(_word(word, _own_key(key, again, ("name", word))), parts[k])
    return f"{head} {''.join(parts)}"


def _given(word: str, gender: str, key: bytes) -> str | None:
    """Another given name of the gender's list; none if the word is in neither list."""
    lists = [(sex, own) for sex, own in (("m", MALE), ("f", FEMALE)) if word in own]
    own = next((own for sex, own in lists if not gender or sex == gender), lists[0][1] if lists else None)
    return own and own[permute(own.index(word), len(own), key, f"given{len(own)}{own[0]}")].capitalize()


def surrogate(kind: str, text: str, key: bytes, again: dict[tuple[str, str], int] | None = None) -> str:
    """again: entities, as units() has them, that take a later key."""
    if kind == "person":
        return _person(text, key, again or {})
    if kind == "name":
        return _cased(_word(_lower(text), _own_key(key, again, ("name", _lower(text)))), text)
    return _surrogate(kind, text, key, _own_key(key, again, (kind, canonical(kind, text))) if again else key)


@functools.lru_cache(1 << 16)
def _surrogate(kind: str, text: str, base: bytes, key: bytes) -> str:
    if kind == "phone":
        digits = "".join(c for c in text if c in "0123456789")
        return _digits(text, digits[:-10] + _number(digits[-10:], key, "phone"))
    if kind == "card":
        digits = canonical(kind, text)
        body = _number(digits[:-1], key, "card")
        return _digits(text, body + str((luhn(body) + int(digits[-1]) - luhn(digits[:-1])) % 10))
    if kind == "ssn":
        return _digits(text, _number(canonical(kind, text), key, "ssn"))
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, text.split("."))))
        if net := _net(x):
            x = net[0] + permute(x - net[0], net[1], key, f"ip{net[0]}")
        else:  # walk the cycle to the next public address
            x = permute(x, 1 << 32, key, "ip")
            while _net(x):
                x = permute(x, 1 << 32, key, "ip")
        return ".".join(map(str, x.to_bytes(4)))
    if kind == "secret" and re.fullmatch("AKIA[0-9A-Z]{16}", text):
        return "AKIA" + shaped(text[4:].lower(), key, "access").upper()
    if kind == "secret" and re.fullmatch("[0-9A-Fa-f]+", text) is None:
        low = _lower(text)
        return _cased(shaped(low, key, "secret"), text)
    if kind == "secret":
        low = text.lower()
        new = f"{permute(int(low, 16), 16 ** len(low), key, 'secret'):0{len(low)}x}"
        return new if text == low else new.upper() if text == text.upper() else _cased(new, text)
    if kind == "email":  # a later key moves the mailbox; a domain is the same for all its addresses
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        new = [shaped(_lower(p), base, "domain") for p in labels[:-1]]
        return _cased(shaped(_lower(local), key, "local"), local) + "@" + ".".join([_cased(n, p) for n, p in zip(new, labels[:-1], strict=True)] + labels[-1:])
    old = canonical(kind, text).upper()
    rest = shaped(old[4:].lower(), key, f"iban{old[:2]}").upper()
    check = (int(old[2:4]) + iban_check(old[:2], rest) - iban_check(old[:2], old[4:])) % 100
    new = iter(f"{old[:2]}{check:02}{rest}")
    return "".join(c if c == " " else next(new) for c in text)


def entities(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(type, start, stop) of each entity, none within another: first those of PATTERN, in order, then bare names
    of the persons found (type name; a listed given name before one belongs to it, as type person)."""
    if text is None or not _HINT.search(text):
        return
    found, names = [], set()
    for m in PATTERN.finditer(text):
        kind, stop = m.lastgroup, m.end()
        if kind == "person":  # names are capitalised; what follows them isn't part of the name
            words = list(re.finditer(r"\S+", m.group()))
            last = 1
            while last < len(words) and words[last].group()[0].isupper():
                last += 1
            if last < 2:
                continue
            stop = m.start() + words[last - 1].start() + len(_bare_name(words[last - 1].group()))
            names.add(_bare_name(words[last - 1].group()))
        elif kind == "card" and " " not in m.group() and "-" not in m.group():
            if luhn(m.group()[:-1]) != int(m.group()[-1]):
                continue
        elif kind == "credential":
            kind, stop = "secret", m.start(kind) + len(m.group(kind).rstrip(".!?:)]}"))
            found.append((kind, m.start("credential"), stop))
            continue
        found.append((kind, m.start(), stop))
    yield from found
    if names:
        yield from _bare(text, found, names)


def _bare_name(word: str) -> str:
    """Without a genitive ending and closing marks."""
    return re.sub(r"(?:['’]s)?\W*$", "", word) if word[-1:] in "s'’-" else word


def _bare(text: str, found: list[tuple[str, int, int]], names: set[str]) -> Iterator[tuple[str, int, int]]:
    """Where the names stand outside the entities found. One expression of all names would be tried name by name at
    each place, so words are looked up."""
    nth = 0
    for m in re.finditer(r"[^\W\d_][\w'’-]*", text):
        while nth < len(found) and found[nth][2] <= m.start():
            nth += 1
        if (name := _bare_name(m.group())) in names and not (nth < len(found) and found[nth][1] < m.end()):
            yield "name", m.start(), m.start() + len(name)


def replace(text: str, key: bytes, again: dict[tuple[str, str], int] | None = None) -> tuple[str, dict[str, int]]:
    out, at, counts = [], 0, {}
    for kind, start, stop in sorted(entities(text), key=lambda e: e[1]):
        new = surrogate(kind, text[start:stop], key, again)
        if kind == "name":
            kind = "person"
            if given := re.search(r"(?<!\w)([^\W\d_]+)( +)$", text[max(at, start - 40) : start]):
                if given.group(1)[0].isupper() and (other := _given(_lower(given.group(1)), "", key)):
                    new, start = f"{other}{given.group(2)}{new}", start - len(given.group())
        out += text[at:start], new
        at = stop
        counts[kind] = counts.get(kind, 0) + 1
    return ("".join(out) + text[at:] if at else text), counts


def _made(kind: str, entity: str, key: bytes, turn: int) -> str:
    """The canonical surrogate of a canonical entity under its turn-th key."""
    text = f"+{entity}" if kind == "phone" else entity.upper() if kind == "iban" or entity.startswith("akia") and len(entity) == 20 else entity
    return canonical(kind, surrogate(kind, text, key, {(kind, entity): turn} if turn else None))


def found_entities(docs: DataFrame) -> DataFrame:
    """(type, entity): the distinct entities of the table."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = {u for t in batch.column(0).to_pylist() for kind, a, b in entities(t) for u in (units(kind, t[a:b]) if kind != "name" else [("name", _lower(t[a:b]))])}
        return pa.record_batch([pa.array(c, pa.string()) for c in zip(*sorted(found), strict=True)], ["type", "entity"]) if found else None

    return arrow_map(docs.select("text"), kernel, "type string, entity string").distinct()


def _with_surrogates(turns: DataFrame, key: bytes) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        more = [pa.array([_made(*r[:2], key, r[2]) for r in rows], pa.string()), pa.array([_shape(r[1]) for r in rows], pa.string()), pa.array([float(math.prod(min(_class(c)[0], 1 << 20) for c in r[1][:40])) for r in rows], pa.float64())]
        return pa.record_batch([*batch.columns, *more], ["type", "entity", "turn", "surrogate", "shape", "space"])

    return arrow_map(turns.select("type", "entity", "turn"), kernel, "type string, entity string, turn int, surrogate string, shape string, space double")


def collisions(made: DataFrame) -> DataFrame:
    """(type, entity) of rows (type, entity, turn, surrogate, shape, space) to be made anew: the surrogate is an entity
    of the table, or another entity has it, on the same key or an earlier one. Of those that share one under equal keys
    the first stays."""
    full = made.groupBy("type", "shape").agg(F.count("*").alias("n"), F.min("space").alias("space")).where("4 * n > space").select("type", "shape")
    real = made.join(full, ["type", "shape"], "left_anti").select("type", F.col("entity").alias("surrogate"))
    shared = made.groupBy("type", "surrogate").agg(F.min(F.struct("turn", "entity")).alias("first"), F.count("*").alias("n")).where("n > 1").select("type", "surrogate", "first")
    clash = made.join(real, ["type", "surrogate"], "left_semi").select("type", "entity")
    later = made.join(shared, ["type", "surrogate"]).where(F.struct("turn", "entity") != F.col("first")).select("type", "entity")
    return clash.unionByName(later).distinct()


def made_anew(docs: DataFrame, key: bytes, tries: int = TRIES) -> DataFrame | None:
    """(type, entity, turn) of the entities that don't take the first key; None if all do."""
    turns = written(found_entities(docs).withColumn("turn", F.lit(0)), "entities")
    for _ in range(tries):
        made = written(_with_surrogates(turns, key), "surrogates")
        again = written(collisions(made), "collisions")
        if not again.take(1):
            later = turns.where("turn > 0")
            return later if later.take(1) else None
        raised = turns.join(again.withColumn("more", F.lit(1)), ["type", "entity"], "left")
        turns = written(raised.select("type", "entity", (F.col("turn") + F.coalesce("more", F.lit(0))).alias("turn")), "entities")
    raise ValueError(f"surrogates collide under {tries} keys")


def session_key(spark: SparkSession) -> bytes:
    """The key of the setting, else a random one, the same throughout a session."""
    if found := spark.conf.get(KEY_SETTING, None):
        return found.encode()
    if not hasattr(spark, "_tessera_surrogate_key"):
        spark._tessera_surrogate_key = secrets.token_bytes(32)
    return spark._tessera_surrogate_key


def _joined_anew(docs: DataFrame, again: DataFrame) -> DataFrame:
    """docs with _again, an array of (type, entity, turn) that its text holds; texts are named by their hash."""
    name = F.sha2(F.col("text").cast("binary"), 256)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [(h, *u) for h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for u in {u for kind, a, b in entities(t) for u in (units(kind, t[a:b]) if kind != "name" else [("name", _lower(t[a:b]))])}]
        return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["_text", "type", "entity"]) if rows else None

    held = arrow_map(docs.select(name.alias("_text"), "text"), kernel, "_text string, type string, entity string").distinct()
    lists = held.join(again, ["type", "entity"]).groupBy("_text").agg(F.collect_list(F.struct("type", "entity", "turn")).alias("_again"))
    return docs.join(lists, name == lists["_text"], "left").drop("_text")


def pseudonymised(docs: DataFrame, key: bytes | None = None, counts: bool = True, broadcast_again: int = BROADCAST_AGAIN) -> DataFrame:
    """docs with the text replaced and, if asked, n_entities array<int>, a count for each of TYPES, as the last
    column. Without a key, the session's."""
    own = session_key(docs.sparkSession) if key is None else key
    names = docs.columns
    at = names.index("text")
    again, sent, joined = made_anew(docs, own), None, False
    numbered = docs.toDF(*(f"c{k}" for k in range(len(names))))
    if again is not None:
        if joined := again.count() > broadcast_again:
            numbered = _joined_anew(numbered.withColumnRenamed(f"c{at}", "text"), again).withColumnRenamed("text", f"c{at}")
        else:
            sent = docs.sparkSession.sparkContext.broadcast({(r["type"], r["entity"]): r["turn"] for r in again.collect()})

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = ([{(u["type"], u["entity"]): u["turn"] for u in x or ()} for x in batch.column(len(names)).to_pylist()]) if joined else [sent.value if sent else None] * batch.num_rows
        done = [(None, {}) if t is None else replace(t, own, x) for t, x in zip(batch.column(at).to_pylist(), lists, strict=True)]
        columns = [pa.array([d[0] for d in done], pa.string()) if k == at else c for k, c in enumerate(batch.columns[: len(names)])]
        if counts:
            columns.append(pa.array([[d[1].get(t, 0) for t in TYPES] for d in done], pa.list_(pa.int32())))
        return pa.record_batch(columns, fields)

    fields = [*(f"c{k}" for k in range(len(names))), *["counts"] * counts]
    schema = ", ".join(f"`c{k}` {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)) + ", counts array<int>" * counts
    return arrow_map(numbered, kernel, schema).toDF(*names, *["n_entities"] * counts)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col("n_entities")[k].alias(f"n_{t}") for k, t in enumerate(TYPES)]
    return done.select("doc_id", "text", *counts)
