"""Normalising names and addresses in native expressions. Steps whose results several others use are columns of their
own, so that they are computed once. Word tables are parameters, see words.Tables."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.words import DEFAULT, Tables

LEGAL, TLDS = DEFAULT.legal, DEFAULT.tlds


def _map(table) -> Column:
    cells = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")


def lookup(words: Column, table: Column) -> Column:
    """Each word by the map, itself where it has no entry; empty entries drop the word."""
    return F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), lambda w: w != "")


def has_native(text: Column) -> Column:
    """A letter beyond Latin."""
    return F.coalesce(text.rlike(r"[\p{L}&&[^\x{0}-\x{24F}]]"), F.lit(False))


def non_latin(text: Column) -> Column:
    """Some character beyond ASCII and no ASCII letter."""
    return F.coalesce(text.rlike(r"[^\x00-\x7F]") & ~text.rlike("[A-Za-z]"), F.lit(False))


def is_unlettered(text: Column) -> Column:
    """No letter a-z, accents aside; unlike non_latin, true for texts without any letter."""
    return F.coalesce(~folded(text).rlike("[a-z]"), F.lit(False))


#: Fixed values of the skeleton: digraphs in the order in which they are replaced, then single letters, then letters
#: whose repeats fall together.
DIGRAPHS = (("ph", "f"), ("sh", "s"), ("ch", "c"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("zh", "s"))
LETTERS = ("mwzqcdyx", "nvskktik")
REPEATED = "bcdfghijklnpqrstvxyz"
_FOLDS = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isascii() and unicodedata.combining(d[1])}
#: Latin letters that are a plain one with marks, and the plain ones.
ACCENTED, PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.lower(F.translate(F.regexp_replace(text, r"[\x{300}-\x{36F}]", ""), ACCENTED, PLAIN))


def accented(text: Column) -> Column:
    """Some Latin letter with a mark, or a mark by itself."""
    return text.rlike(r"[\x{300}-\x{36F}]") | (F.translate(text, ACCENTED, PLAIN) != text)


def skeleton(word: Column) -> Column:
    """The consonants of a word under which spellings of one sound meet; words of digits stay."""
    s = word
    for a, b in DIGRAPHS:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.substring(s, 1, 1), F.translate(F.substr(s, F.lit(2)), "h", ""))
    s = F.translate(s, *LETTERS)
    s = F.concat(F.substring(s, 1, 1), F.translate(F.substr(s, F.lit(2)), "aeiou", ""))
    s = F.regexp_replace(s, rf"([{REPEATED}])\1+", "$1")
    return F.when(word.rlike("^[0-9]+$"), word).otherwise(s)


_SOUNDS, _SAME, _VOWELS = str.maketrans(*LETTERS), re.compile(rf"([{REPEATED}])\1+"), str.maketrans("", "", "aeiou")


@functools.lru_cache(1 << 17)
def skeleton_of(word: str) -> str:
    """skeleton, outside of Spark, of a word of a-z and 0-9."""
    if word.isdigit():
        return word
    s = word
    for a, b in DIGRAPHS:
        s = s.replace(a, b)
    s = (s[:1] + s[1:].replace("h", "")).translate(_SOUNDS)
    return _SAME.sub(r"\1", s[:1] + s[1:].translate(_VOWELS))


def join_initials(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def unwrapped_domain(text: Column) -> Column:
    """The name in a web address: without scheme, www and the last part."""
    host = F.regexp_extract(F.lower(text), r"^(?:[a-z]+://)?(?:www\.)?([^/:?#]+)", 1)
    return F.regexp_replace(host, rf"(\.(?:{'|'.join(TLDS)}))+$", "")


#: Between the names of one business.
ALIAS = r"\b(?:f/?k/?a|a/?k/?a|d/?b/?a|formerly known as|formerly|trading as|doing business as|nee)\b"


def legal_free(words: Column, legal: tuple[str, ...] = LEGAL) -> Column:
    """Words without legal suffixes, all of them if nothing else is there."""
    rest = F.filter(words, lambda w: ~w.isin(*legal))
    return F.when(F.size(rest) > 0, rest).otherwise(words)


def _split(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _first(words: str, n: int | None) -> Column:
    return F.col(words) if n is None else F.slice(words, 1, n)


def with_name(rows: DataFrame, column: str, tables: Tables = DEFAULT, skeletons: int | None = None) -> DataFrame:
    """rows with the normalised columns of a folded business name: full, core (without legal suffixes), its letters run
    together, the cores of the first and last of several names, skeletons, and whether a web address or another name was
    in it. Null is the empty name."""
    tlds = "|".join(t.replace(".", r"\.") for t in tables.tlds)
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(text, r"^\W*(?:(?:m/s|messrs|mr|mrs|ms)\b\.?\s*)+", " "), r"\+?\d[\d\-\s().]{6,}\d", " ")
    out = rows.withColumn("_s", plain)
    out = out.withColumn("_d", F.regexp_replace("_s", rf"(?:https?://)?(?:www\.)?\b([a-z0-9][a-z0-9\-]*)\.(?:{tlds})\b", " $1 "))
    marks = F.replace(F.replace(F.replace("_d", F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    out = out.withColumn("n_domain", F.col("_s") != F.col("_d")).withColumn("_m", marks).withColumn("_a", F.regexp_replace("_m", ALIAS, " | "))
    words = _split(join_initials(F.trim(F.regexp_replace("_a", r"[^\p{L}\p{M}\p{N}|]+", " "))))
    out = out.withColumn("n_alias", F.col("_a") != F.col("_m")).withColumn("_t", lookup(words, _map(tables.canonical)))
    names = F.split(F.regexp_replace(F.array_join("_t", " "), r"^(?:(?:mr|mrs|ms|messrs|\|) )+", ""), r"\|")
    out = out.withColumn("_p", F.filter(F.transform(names, _split), lambda p: F.size(p) > 0))
    out = out.withColumn("_w", F.flatten("_p")).withColumn("_c", legal_free(F.col("_w"), tables.legal))
    alt = lambda k: F.coalesce(F.array_join(legal_free(F.get("_p", k), tables.legal), " "), F.array_join("_c", " "))
    out = out.withColumns({
        "n_full": F.array_join("_w", " "), "n_core": F.array_join("_c", " "), "n_concat": F.array_join("_c", ""),
        "n_alt_a": alt(F.lit(0)), "n_alt_b": alt(F.size("_p") - 1), "n_skel": F.array_join(F.transform(_first("_c", skeletons), skeleton), " "),
    })
    return out.drop("_s", "_d", "_m", "_a", "_t", "_p", "_w", "_c")


def numbers(words: Column) -> Column:
    """First six distinct numbers of up to 12 digits, without leading zeros."""
    digits = F.filter(words, lambda w: w.rlike("^[0-9]{1,12}$"))
    return F.slice(F.array_distinct(F.transform(digits, lambda w: w.cast("bigint").cast("string"))), 1, 6)


def with_address(rows: DataFrame, column: str, country: Column, tables: Tables = DEFAULT, skeletons: int | None = None) -> DataFrame:
    """rows with the normalised columns of a folded address, under the profile of its country: all words, those outside
    of landmark components, telling words and their skeletons, numbers, the state, components. A component that names a
    state is its code. A null word is an empty address. skeletons: of so many words, if not of all."""
    by = lambda of: F.coalesce(*(F.when(F.col("_profile") == p, of(p)) for p in ("US", "IN", "FR")), of("GEN"))
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    parts = F.transform(F.split(text, ","), lambda c: F.btrim(c, F.lit(" .-/#")))
    out = rows.withColumn("_profile", profile(country)).withColumn("_raw", F.when(F.trim(text).isin(*tables.null_words), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda c: ~c.isin(*tables.null_words))))
    out = out.withColumn("_raw", F.transform("_raw", lambda c: F.regexp_replace(c, r"\b(\d+)(?:st|nd|rd|th)\b", "$1")))
    clean = F.transform("_raw", lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), r"(?<=\d)(?=\p{L})|(?<=\p{L})(?=\d)", " "), r"[^\p{L}\p{M}\p{N}]+", " ")))
    out = out.withColumn("_c", F.filter(clean, lambda c: c != ""))
    closed = lambda p: {k.replace(" ", ""): v for k, v in tables.states.get(p, {}).items()}
    several = lambda p: [k for k in sorted(tables.states.get(p, {}), key=lambda k: (-len(k), k)) if " " in k]

    def joined(p: str) -> Column:
        """Names of several words within a component are closed up."""
        c = F.col("_c")
        return F.when(F.exists(c, lambda x: x.rlike(rf"\b(?:{'|'.join(several(p))})\b")), F.transform(c, lambda x: _closed(x, several(p)))).otherwise(c) if several(p) else c

    out = out.withColumn("_c", by(joined))
    code = by(lambda p: F.transform("_c", lambda c: F.coalesce(F.try_element_at(_map(closed(p) | {v: v for v in closed(p).values()}), F.replace(c, F.lit(" "), F.lit(""))), F.lit(""))))
    out = out.withColumn("_state", code)
    words = by(lambda p: F.transform(F.arrays_zip("_c", "_state"), lambda z: F.when(z["_state"] != "", F.array(z["_state"])).otherwise(lookup(_split(z["_c"]), _map({**tables.cities.get(p, {}), **tables.street.get(p, {})})))))
    out = out.withColumn("_w", F.filter(words, lambda w: F.size(w) > 0)).withColumn("a_state", F.coalesce(F.get(F.filter("_state", lambda x: x != ""), F.lit(0)), F.lit("")))
    out = out.withColumn("_all", F.flatten("_w")).withColumn("_nums", numbers(F.flatten(F.transform("_raw", lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))))))
    alpha = F.array_distinct(F.filter("_all", lambda w: w.rlike(r"^\p{L}{3,}$") & ~w.isin(*tables.stop) & (w != F.col("a_state"))))
    empty = (F.size("_all") == 0) & (F.size("_nums") == 0)
    out = out.withColumn("_alpha", alpha).withColumns({
        "a_full": F.array_join("_all", " "), "a_core": F.array_join(F.flatten(F.filter("_w", lambda w: ~F.get(w, F.lit(0)).isin(*tables.landmarks))), " "), "a_alpha": F.array_join("_alpha", " "),
        "a_skel": F.array_join(F.transform(_first("_alpha", skeletons), skeleton), " "), "a_nums": F.array_join("_nums", " "), "a_first_num": F.coalesce(F.get("_nums", F.lit(0)), F.lit("")),
        "a_ncomp": F.when(empty, F.lit(0)).otherwise(F.size("_raw")).cast("smallint"), "a_empty": empty,
    })
    return out.drop("_profile", "_raw", "_c", "_state", "_w", "_all", "_nums", "_alpha")


def _closed(text: Column, names: list[str]) -> Column:
    for name in names:
        text = F.regexp_replace(text, rf"\b{name}\b", name.replace(" ", ""))
    return text


@F.pandas_udf(StringType())
def ascii_folded(texts: pd.Series) -> pd.Series:
    """Lower case, compatibility forms and accents folded; letters of other scripts stay."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())


@functools.lru_cache(1 << 17)
def nysiis_code(word: str) -> str:
    """New York State Identification and Intelligence System code, without a length limit."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return word
    for a, b in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(a):
            w = b + w[len(a) :]
            break
    for a, b in (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")):
        if w.endswith(a):
            w = w[: -len(a)] + b
            break
    key, w, i = w[0], list(w), 1
    while i < len(w):
        rest = "".join(w[i : i + 3])
        if rest.startswith("EV"):
            w[i : i + 2] = "AF"
        elif w[i] in "AEIOU":
            w[i] = "A"
        elif w[i] in "QZM":
            w[i] = {"Q": "G", "Z": "S", "M": "N"}[w[i]]
        elif rest.startswith("KN"):
            w[i] = "N"
        elif w[i] == "K":
            w[i] = "C"
        elif rest.startswith("SCH"):
            w[i : i + 3] = "SSS"
        elif rest.startswith("PH"):
            w[i : i + 2] = "FF"
        elif w[i] == "H" and (w[i - 1] not in "AEIOU" or (i + 1 < len(w) and w[i + 1] not in "AEIOU")):
            w[i] = w[i - 1]
        elif w[i] == "W" and w[i - 1] in "AEIOU":
            w[i] = w[i - 1]
        if w[i] != key[-1]:
            key += w[i]
        i += 1
    if key.endswith("S") and len(key) > 1:
        key = key[:-1]
    if key.endswith("AY"):
        key = key[:-2] + "Y"
    return key.rstrip("A") if len(key) > 1 and key.rstrip("A") else key[:1]


@F.pandas_udf(StringType())
def nysiis(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else nysiis_code(w))


def nysiis_codes(text: str) -> str:
    """The code of each word of a text."""
    return " ".join(map(nysiis_code, text.split()))


@F.pandas_udf(StringType())
def nysiis_words(texts: pd.Series) -> pd.Series:
    """nysiis_codes of texts."""
    return texts.map(lambda t: None if t is None else nysiis_codes(t))


US = ("us", "usa", "united states", "united states of america")
IN, FR = ("in", "india"), ("fr", "france")


def profile(country: Column) -> Column:
    """US, IN, FR or GEN; any other label is GEN."""
    c = F.lower(F.trim(country))
    return F.when(c.isin(*US), "US").when(c.isin(*IN), "IN").when(c.isin(*FR), "FR").otherwise("GEN")


def embedding_text(name: Column, address: Column) -> Column:
    return F.concat(F.lit("query: "), F.concat_ws(" | ", name, address))


def reranker_text(name: Column, address: Column, country: Column) -> Column:
    clip = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 100)
    return F.concat(F.lit("name: "), clip(name), F.lit(" address: "), clip(address), F.lit(" country: "), clip(country))
