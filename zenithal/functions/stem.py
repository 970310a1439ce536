"""English stems by the published Porter2 rules, as SQL expressions over a column ``w``.

Each step is one expression in functions and patterns that Spark and other SQL engines read alike, so a chain of projections
stems a table of distinct words (:func:`stems`), and the same text is a chain of subqueries elsewhere (:func:`stem_sql`).
``p1`` and ``p2`` are the lengths before the regions R1 and R2; a ``y`` that counts as a consonant is ``Y`` in between."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Words with stems of their own, and words that stay (the last eight after plurals are cut).
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
KEPT_LATER = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]

#: Endings and what they become, in R1 (two steps) and, deleted, in R2.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

_V, _N = "[aeiouy]", "[^aeiouy]"
_SHORT = f"({_N}{_V}[^aeiouywxY]$|^{_V}{_N}$)"  # a short syllable at the end


def _has(pattern: str, of: str = "w") -> str:
    return f"regexp_extract({of}, '{pattern}', 0) <> ''"


def _cut(n: int | str, of: str = "w") -> str:
    return f"substr({of}, 1, length({of}) - {n})"


def _one_of(words: list[str]) -> str:
    return "w IN (" + ", ".join(f"'{x}'" for x in words) + ")"


def _endings(table: dict[str, str], region: str, extra: dict[str, str]) -> str:
    """The longest ending that is there decides; it is replaced if it lies in the region and meets its own condition."""
    cases = []
    for end in sorted(table, key=len, reverse=True):
        asks = f"length(w) - {len(end)} >= {region}" + (f" AND {extra[end]}" if end in extra else "")
        cases.append(f"WHEN {_has(end + '$')} THEN CASE WHEN {asks} THEN concat({_cut(len(end))}, '{table[end]}') ELSE w END")
    return "CASE " + " ".join(cases) + " ELSE w END"


_AFTER = f"""CASE WHEN {_has('(at|bl|iz)$', 'x')} THEN concat(x, 'e') WHEN {_has('(bb|dd|ff|gg|mm|nn|pp|rr|tt)$', 'x')} THEN {_cut(1, 'x')}
 WHEN length(x) <= p1 AND {_has(_SHORT, 'x')} THEN concat(x, 'e') ELSE x END"""
_ED = "(eedly|ingly|edly|eed|ing|ed)$"

#: (columns that stay, columns that a step makes): each step reads those of the one before.
STEPS: list[dict[str, str]] = [
    {"w": "CASE WHEN length(w) <= 2 THEN w WHEN substr(w, 1, 1) = '''' THEN substr(w, 2) ELSE w END", "fixed": "CASE " + " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in SPECIAL.items()) + f" WHEN {_one_of(KEPT)} OR length(w) <= 2 THEN w END"},
    {"w": "regexp_replace(w, '^y', 'Y')"},
    {"w": f"regexp_replace(w, '({_V})y', '{{1}}Y', 'g')"},
    {"p1": f"CASE WHEN {_has('^(gener|commun|arsen)')} THEN length(regexp_extract(w, '^(gener|commun|arsen)', 0)) WHEN {_has(f'^.*?{_V}{_N}')} THEN length(regexp_extract(w, '^.*?{_V}{_N}', 0)) ELSE length(w) END"},
    {"p2": f"CASE WHEN {_has(f'^.*?{_V}{_N}', 'substr(w, p1 + 1)')} THEN p1 + length(regexp_extract(substr(w, p1 + 1), '^.*?{_V}{_N}', 0)) ELSE length(w) END"},
    {"w": "regexp_replace(w, '(''s''|''s|'')$', '')"},
    {"w": f"CASE WHEN {_has('sses$')} THEN {_cut(2)} WHEN {_has('(ied|ies)$')} THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END WHEN {_has('(us|ss)$')} THEN w WHEN {_has(f'{_V}.+s$')} THEN {_cut(1)} ELSE w END"},
    {"fixed": f"CASE WHEN fixed IS NULL AND {_one_of(KEPT_LATER)} THEN w ELSE fixed END"},
    {"e": f"regexp_extract(w, '{_ED}', 0)"},
    {"x": "CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(w) - length(e) >= p1 THEN concat(substr(w, 1, length(w) - length(e)), 'ee') ELSE w END ELSE substr(w, 1, length(w) - length(e)) END"},
    {"w": f"CASE WHEN e = '' THEN w WHEN e IN ('eed', 'eedly') THEN x WHEN {_has(_V, 'x')} THEN {_AFTER} ELSE w END"},
    {"w": f"CASE WHEN {_has(f'.{_N}[yY]$')} THEN concat({_cut(1)}, 'i') ELSE w END"},
    {"w": _endings(SECOND, "p1", {"ogi": _has("logi$"), "li": _has("[cdeghkmnrt]li$")})},
    {"w": _endings(THIRD, "p1", {"ative": "length(w) - 5 >= p2"})},
    {"w": _endings(dict.fromkeys(FOURTH, ""), "p2", {"ion": _has("[st]ion$")})},
    {"w": f"CASE WHEN {_has('e$')} THEN CASE WHEN length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT ({_has(_SHORT, _cut(1))})) THEN {_cut(1)} ELSE w END WHEN {_has('ll$')} AND length(w) - 1 >= p2 THEN {_cut(1)} ELSE w END"},
    {"w": "coalesce(fixed, lower(w))"},
]
_COLUMNS = ("w", "fixed", "p1", "p2", "e", "x")


def _projections(first: str, replaced: str, last: str, others: tuple[str, ...] = ()) -> list[list[str]]:
    """For each step the columns that it gives; ``first``: the group's sign in replacements, ``last``: what ends a replacement of all."""
    out, known = [], ["word", "w", *others]
    for step in STEPS:
        made = {k: v.replace("{1}", first).replace(replaced, last) for k, v in step.items()}
        known += [c for c in _COLUMNS if c in made and c not in known]
        out.append([f"{made[c]} AS {c}" if c in made else c for c in known])
    return out


def stems(words: DataFrame, word: str = "word", others: tuple[str, ...] = ()) -> DataFrame:
    """(word, stem) of each row of a table of lower-case words, and its columns ``others``; null for null."""
    rows = words.selectExpr(f"`{word}` AS word", f"`{word}` AS w", *others)
    for columns in _projections("$1", ", 'g')", ")", others):
        rows = rows.selectExpr(*columns)
    return rows.selectExpr("word", "w AS stem", *others)


def stem_sql(source: str) -> str:
    """SQL of (word, stem) for a subquery with a column ``word``, for engines whose patterns know ``\\1`` and a flag for all."""
    sql = f"SELECT word, word AS w FROM ({source})"
    for columns in _projections("\\1", "\0", "\0"):
        sql = f"SELECT {', '.join(columns)} FROM ({sql})"
    return f"SELECT word, w AS stem FROM ({sql})"
