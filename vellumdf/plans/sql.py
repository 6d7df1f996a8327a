"""SQL fragments of the oracle queries.

Written against DuckDB's functions and RE2: no look-around, other splitting and
other aggregates than the Spark plans they are compared with.
"""

from __future__ import annotations

from ..functions.text import L, STOPS, WORD, WS
from ..lexicons import ABBREVIATIONS, LEXICONS, STOP

Q = WORD.replace("'", "''")


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))


def units(source: str = "documents", key: str = "doc_id", lang: str = "lang", text: str = "text") -> str:
    return f"units AS (SELECT {key} AS unit_id, CASE WHEN {lang} IN ('de','en') THEN {lang} ELSE 'und' END AS lang, coalesce({text}, '') AS text FROM {source})"


def words(expr: str) -> str:
    return f"list_transform(regexp_extract_all({expr}, '{Q}'), lambda x: replace(lower(regexp_replace(x, '(\\p{{L}})Σ([^\\p{{L}}]|$)', '\\1ς\\2', 'g')), '’', ''''))"


TOKENS = f"lists AS (SELECT unit_id, lang, {words('text')} AS w FROM units), tokens AS (SELECT unit_id, lang, unnest(w) AS word, (generate_subscripts(w, 1) - 1)::INT AS pos FROM lists)"
FREQ = "freq AS (SELECT unit_id, lang, word, count(*) AS f, min(pos) AS first_pos FROM tokens GROUP BY ALL)"

_ABBR = "|".join(ABBREVIATIONS)
_ONE = rf"(^|[^{L}])((?i:{_ABBR})|[{L}])\.({WS}|$)".replace("'", "''")
#: Points behind abbreviations are hidden one after the other: matches of one pass cannot touch each other.
_HIDE = "text"
for _ in range(3):
    _HIDE = rf"regexp_replace({_HIDE}, '{_ONE}', '\1\2' || chr(1) || '\3', 'g')"
_MARK = rf"regexp_replace({_HIDE}, '({STOPS})({WS}|$)', '\1' || chr(2) || '\2', 'g')"
_MARK = rf"regexp_replace({_MARK}, '\n[ \t]*\n', chr(2), 'g')"
SENTENCES = f"""sent_lists AS (SELECT unit_id, lang, list_filter(list_transform(string_split({_MARK}, chr(2)), lambda x: replace(x, chr(1), '.')), lambda x: regexp_matches(x, '{Q}')) AS s FROM units),
sents AS (SELECT unit_id, lang, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent FROM sent_lists),
sent AS (SELECT *, {words("sentence")} AS w, len({words("sentence")}) AS n FROM sents)"""
PARAGRAPHS = rf"""par_lists AS (SELECT unit_id, lang, list_filter(regexp_split_to_array(text, '\n{WS}*\n'), lambda x: regexp_matches(x, '{Q}')) AS p FROM units),
pars AS (SELECT unit_id, lang, unnest(p) AS paragraph, generate_subscripts(p, 1) - 1 AS par FROM par_lists),
par AS (SELECT *, {words("paragraph")} AS w, len({words("paragraph")}) AS n FROM pars)"""
IS_STOP = f"((lang = 'de' AND word IN ({quoted(STOP['de'])})) OR (lang = 'en' AND word IN ({quoted(STOP['en'])})))"


def in_lexicon(name: str) -> str:
    return f"((lang = 'de' AND word IN ({quoted(LEXICONS[name]['de'].split())})) OR (lang = 'en' AND word IN ({quoted(LEXICONS[name]['en'].split())})))"


LETTERS = r"length(regexp_replace(word, '[^\p{L}]', '', 'g'))"
SYLLABLES = """CASE WHEN lang = 'de' THEN greatest(1, len(regexp_extract_all(word, 'au|äu|eu|ei|ai|ie|[aeiouyäöü]')))
  ELSE greatest(1, len(regexp_extract_all(word, '[aeiouy]+')) - CASE WHEN suffix(word, 'e') AND NOT regexp_matches(word, '[^aeiouy]le$') AND len(regexp_extract_all(word, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"""


def unrounded(sql: str) -> str:
    """The query with every round(x, n) as (x)."""
    out, at = [], 0
    while (a := sql.find("round(", at)) >= 0:
        depth, comma, k, text = 1, -1, a + 6, False
        while depth:
            text ^= sql[k] == "'"
            if not text:
                depth += {"(": 1, ")": -1}.get(sql[k], 0)
                comma = k if sql[k] == "," and depth == 1 else comma
            k += 1
        out += [sql[at:a], "(", unrounded(sql[a + 6 : comma]), ")"]
        at = k
    return "".join([*out, sql[at:]])


def inner(sql: str, name: str) -> str:
    """A query as a named part of another."""
    return f"{name} AS ({sql})"


#: Stretches of MTLD in one direction: a fold over the words, each with the place of the same word before it.
def stretches(name: str, place: str, before: str) -> str:
    step = (
        "struct_pack(i := b.i, prev := b.prev, started := CASE WHEN (a.kinds + (b.prev < a.started)::INT)::DOUBLE / (b.i + 1 - a.started) <= 0.72::DOUBLE THEN b.i + 1 ELSE a.started END, "
        "kinds := CASE WHEN (a.kinds + (b.prev < a.started)::INT)::DOUBLE / (b.i + 1 - a.started) <= 0.72::DOUBLE THEN 0 ELSE a.kinds + (b.prev < a.started)::INT END, "
        "ended := a.ended + CASE WHEN (a.kinds + (b.prev < a.started)::INT)::DOUBLE / (b.i + 1 - a.started) <= 0.72::DOUBLE THEN 1 ELSE 0 END)"
    )
    return f"""{name} AS (SELECT unit_id, n, r.ended + CASE WHEN n > r.started THEN (1 - r.kinds::DOUBLE / (n - r.started)) / 0.28::DOUBLE ELSE 0 END AS factor FROM (
      SELECT unit_id, count(*) AS n, list_reduce(list_prepend(struct_pack(i := -1, prev := -1, started := 0, kinds := 0, ended := 0), list(struct_pack(i := ({place})::INT, prev := ({before})::INT, started := 0, kinds := 0, ended := 0) ORDER BY {place})), lambda a, b: {step}) AS r
      FROM placed GROUP BY unit_id))"""


MTLD = f"""placed AS (SELECT unit_id, pos, count(*) OVER (PARTITION BY unit_id) AS total, coalesce(lag(pos) OVER same, -1) AS before, lead(pos) OVER same AS behind FROM tokens WINDOW same AS (PARTITION BY unit_id, word ORDER BY pos)),
  {stretches("there", "pos", "before")}, {stretches("back", "total - 1 - pos", "coalesce(total - 1 - behind, -1)")},
  stretch AS (SELECT u.unit_id, CASE WHEN t.factor > 0 AND b.factor > 0 THEN (t.n / t.factor + b.n / b.factor) / 2 END AS mtld FROM units u LEFT JOIN there t USING (unit_id) LEFT JOIN back b USING (unit_id))"""
