"""How a matched record differs from its query: sorted tags of name and address noise.

Words are runs of a-z and 0-9 after Latin marks are folded. Where a name or address has no words, tags that compare
words don't apply. The tags' names and these word lists are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.similarity import capped_levenshtein
from tessera.operators.tokens import char_ngrams

LEGAL = ("inc", "llc", "ltd", "limited", "private", "pvt", "corp", "corporation", "co", "company", "incorporated", "plc", "llp", "sarl", "sas", "sasu", "eurl", "sci", "sa", "cie", "freres", "fils", "pc", "pllc")
DESCRIPTORS = ("service", "services", "center", "centre", "enterprises", "group", "holdings", "solutions", "industries", "trading", "associates", "partners")
STREET = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "trl": "trail", "cv": "cove", "dr": "drive", "ln": "lane", "blvd": "boulevard", "bd": "boulevard",
    "hwy": "highway", "ct": "court", "pl": "place", "sq": "square", "pkwy": "parkway", "ter": "terrace", "cir": "circle", "twp": "township", "r": "rue",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(T.folded(text), F.lit("([a-z0-9]+)"), F.lit(1))


def _tags(**tags: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tags.items()))))


def _same(a: Column, b: Column) -> Column:
    """Equal as sets."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def _some(a: Column) -> Column:
    return F.size(a) > 0


def _trigrams(text: Column) -> Column:
    squashed = F.regexp_replace(T.folded(text), "[^a-z0-9]", "")
    return F.when(squashed == "", F.array(F.lit(""))).otherwise(F.array_distinct(char_ngrams(squashed, 3)))


def name_tags(a: Column, b: Column, legal: tuple[str, ...] = LEGAL, descriptors: tuple[str, ...] = DESCRIPTORS) -> Column:
    """Tags of the second name against the first."""
    x, y = words(a), words(b)
    both = _some(x) & _some(y)
    apart = both & ~F.arrays_overlap(x, y)
    s, t = _trigrams(a), _trigrams(b)
    near = F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t))
    core = lambda w: F.filter(w, lambda v: ~v.isin(*legal))
    suffix = lambda w: F.filter(w, lambda v: v.isin(*legal))
    same_core = both & _same(core(x), core(y)) & ~_same(x, y)
    extra = F.array_except(y, x)
    grown = both & _some(extra) & (F.size(F.array_except(x, y)) == 0)
    changed = F.filter(F.zip_with(F.array_sort(x), F.array_sort(y), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda z: ~z["p"].eqNullSafe(z["q"]))
    one = F.get(changed, F.lit(0))
    return _tags(
        non_latin_name=~T.folded(b).rlike("[a-z]"),
        diacritic_injected=T.accented(b) & ~T.accented(a),
        domain_or_handle_name=F.lower(F.trim(b)).rlike(r"\.(com|net|in|co\.in|fr)\b|^www|^#"),
        bracket_or_junk_noise=b.rlike(r"[\[\]{}<>|]|^\s*(--|\.\.\.)"),
        name_zero_token_overlap=apart,
        name_RANDOM_replacement=apart & (near < 0.2),
        legal_suffix_dropped=same_core & _some(F.array_except(suffix(x), suffix(y))),
        legal_suffix_added=same_core & _some(F.array_except(suffix(y), suffix(x))),
        token_appended=grown,
        token_appended_descriptor=grown & F.exists(extra, lambda w: w.isin(*descriptors)),
        word_transposition=both & (x != y) & (F.array_sort(x) == F.array_sort(y)),
        name_truncated=both & (F.size(extra) == 0) & _some(F.array_except(x, y)),
        typo_in_name=both & (F.size(x) == F.size(y)) & ~_same(x, y) & (F.size(changed) == 1) & F.coalesce(capped_levenshtein(one["p"], one["q"], 3).between(1, 2), F.lit(False)),
    )


def address_tags(a: Column, b: Column, street: dict[str, str] = STREET) -> Column:
    """Tags of the second address against the first; an empty one has its own tag only."""
    digits = lambda w: F.filter(w, lambda v: v.rlike("^[0-9]+$"))
    rest = lambda w: F.filter(w, lambda v: ~v.rlike("^[0-9]+$"))
    x, y = rest(words(a)), rest(words(b))
    n, m = digits(words(a)), digits(words(b))
    short = F.create_map(*(F.lit(v) for kv in street.items() for v in kv))
    long = lambda w: F.transform(w, lambda v: F.coalesce(F.try_element_at(short, v), v))
    some_short = F.exists(F.concat(x, y), lambda v: v.isin(*street))
    shared, back = F.filter(x, lambda v: F.array_contains(y, v)), F.filter(y, lambda v: F.array_contains(x, v))
    reordered = (x != y) & (F.array_sort(x) == F.array_sort(y))
    letters = F.regexp_replace(b, r"[^\p{L}]", "")
    numbers = _some(n) & _some(m) & ~_same(n, m)
    tags = _tags(
        null_literal_token=F.contains(b, F.lit("<NULL>")),
        address_UPPERCASED=(letters != "") & ~letters.rlike(r"[^\p{Lu}]"),
        addr_diacritic_injected=T.accented(b) & ~T.accented(a),
        hash_or_pobox_prefix=b.rlike(r"(?i)(^|[,\s])#|\bPO BOX\b|\bP\.O\b"),
        street_type_abbreviated=~_same(x, y) & F.arrays_overlap(long(x), long(y)) & some_short,
        component_reordered=reordered,
        component_reordered_partial=~(F.array_sort(x) == F.array_sort(y)) & _some(shared) & (shared != back),
        number_perturbed=numbers & F.arrays_overlap(n, m),
        number_fully_changed=numbers & ~F.arrays_overlap(n, m),
        number_dropped=_some(n) & ~_some(m),
        address_component_dropped=(F.size(F.array_except(y, x)) == 0) & _some(F.array_except(x, y)),
    )
    return F.when(F.trim(b) == "", F.array(F.lit("address_EMPTY"))).otherwise(tags)
