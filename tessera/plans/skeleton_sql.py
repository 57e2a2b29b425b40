"""functions.text.skeleton in SQL, over a relation toks (tok)."""

from __future__ import annotations

from tessera.functions.text import DIGRAPHS, LETTERS, REPEATED

_first = "tok"
for _a, _b in DIGRAPHS:
    _first = f"replace({_first}, '{_a}', '{_b}')"
_last = "s3"
for _c in REPEATED:
    _last = f"regexp_replace({_last}, '{_c}{_c}+', '{_c}', 'g')"

SKELETON_SQL = f"""sk0 as (select tok, {_first} as s from toks),
sk1 as (select tok, translate(s[1:1] || translate(s[2:], 'h', ''), '{LETTERS[0]}', '{LETTERS[1]}') as s1 from sk0),
sk2 as (select tok, s1[1:1] || translate(s1[2:], 'aeiou', '') as s3 from sk1),
skeletons as (select tok, case when regexp_matches(tok, '^[0-9]+$') then tok else {_last} end as skeleton from sk2)"""
