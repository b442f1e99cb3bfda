"""Parts of SQL that several queries are held against."""

from __future__ import annotations

from tessera.functions import text as T

LETTERS = f"'{T.SEATS}', '{T.SEATS_AS}'"
DIGITS = f"'{T.DIGITS}', '{T.DIGITS_AS}'"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
MARKED = f"regexp_replace(text, '{T.MARKS}', '', 'g')"


def fold(x: str) -> str:
    return f"translate({x}, {LETTERS})"


def tokens_sql(x: str, level: str = T.PLAIN) -> str:
    plain = f"regexp_extract_all(translate({fold(x)}, {DIGITS}), '{T.TOKEN}')"
    if level == T.PLAIN:
        return plain
    kept = f"list_filter({plain}, lambda w: NOT list_contains({STOP}, w))"
    if level == T.STOPPED:
        return kept
    return f"list_transform({kept}, lambda w: {clitics_sql('w')})"


def clitics_sql(w: str) -> str:
    cases = " ".join(f"WHEN starts_with({w}, '{p}') AND length({w}) - {len(p)} >= {T.STEM} THEN substr({w}, {len(p) + 1})" for p in T.CLITICS)
    return f"CASE {cases} ELSE {w} END"


TOK = tokens_sql("text")
CLEAN = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '{T.MARKS}', '', 'g'),
'[.…]{{4,}}', ' ', 'g'), '({T.LETTER})-\n({T.LETTER})', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
