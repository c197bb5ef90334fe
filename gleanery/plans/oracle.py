"""SQL pieces for DuckDB, written apart from the column functions that they check."""

from __future__ import annotations

import re

from gleanery.config import DEFAULT as C
from gleanery.functions.classify import EMPLOYMENT
from gleanery.functions.text import COMPANY_SUFFIXES, TITLE_FORMS, TITLE_NOISE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g'))"


def any_term(x: str, terms: list[str]) -> str:
    if not terms:
        return "false"
    alternatives = "|".join(re.escape(t.lower()).replace("\\ ", " ").replace("\\-", "-") for t in terms)
    return f"regexp_matches({x}, {q('(^|[^a-z0-9])(' + alternatives + ')($|[^a-z0-9])')})"


def first_term(x: str, terms: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {any_term(x, [t])} THEN {q(t)}" for t in terms) + " END"


def company(x: str) -> str:
    words = f"concat(' ', trim(regexp_replace({fold(x)}, '[^a-z0-9]+', ' ', 'g')))"
    return f"trim(regexp_replace({words}, '( ({'|'.join(COMPANY_SUFFIXES)}))+$', ''))"


def title(x: str) -> str:
    x = f"regexp_replace({fold(x)}, '\\(.*?\\)|\\[.*?\\]', ' ', 'g')"
    for pattern, form in TITLE_FORMS:
        x = f"regexp_replace({x}, {q(pattern)}, {q(form)}, 'g')"
    x = f"regexp_replace({x}, '[^a-z0-9+#]+', ' ', 'g')"
    x = f"regexp_replace({x}, {q(chr(92) + 'b(' + '|'.join(TITLE_NOISE) + ')' + chr(92) + 'b')}, ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def classes(x: str, patterns: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {q(k)}" for k, p in patterns.items()) + f" ELSE {q(otherwise)} END"


def employment(x: str) -> str:
    return classes(fold(x), EMPLOYMENT, "unspecified")


def host(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract(coalesce({url}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"


def on_domains(name: str, domains: list[str]) -> str:
    return "(" + " OR ".join(f"{name} = {q(d)} OR ends_with({name}, {q('.' + d)})" for d in domains) + ")"


LOCAL = f"(coalesce(source IN ({', '.join(map(q, C.local_sources))}), false) OR {any_term(fold('location_text'), C.home_places)})"


def likes(left: str, right: str, least: float) -> str:
    """CTEs that give `alike` (t, u, likeness): the titles t of one table (c, t) and u of another that occur with the same c
    and whose word-sorted forms have a common subsequence of `least` percent of their letters. For WITH RECURSIVE."""
    words = lambda t: f"array_to_string(list_sort(list_filter(string_split({t}, ' '), lambda v: v <> '')), ' ')"
    return f"""
both_titles AS (SELECT DISTINCT a.t AS t, b.t AS u, {words('a.t')} AS x, {words('b.t')} AS y FROM (SELECT DISTINCT c, t FROM {left}) a JOIN (SELECT DISTINCT c, t FROM {right}) b USING (c)),
forms AS (SELECT DISTINCT x, y FROM both_titles WHERE x <> y AND 200 * least(length(x), length(y)) >= {least} * (length(x) + length(y))),
letters(x, y, i, r) AS (SELECT x, y, 0, list_transform(range(0, length(y) + 1), lambda v: 0) FROM forms UNION ALL
  SELECT x, y, i + 1, list_reduce(list_prepend([0], list_transform(range(1, length(y) + 1), lambda k: [CASE WHEN x[i + 1] = y[k] THEN r[k] + 1 ELSE r[k + 1] END])), lambda acc, v: list_append(acc, greatest(acc[len(acc)], v[1]))) FROM letters WHERE i < length(x)),
measured AS (SELECT x, y, 200.0 * r[len(r)] / (length(x) + length(y)) AS likeness FROM letters WHERE i = length(x)),
alike AS (SELECT t, u, CASE WHEN x = y THEN 100.0 ELSE likeness END AS likeness FROM both_titles LEFT JOIN measured USING (x, y) WHERE x = y OR likeness >= {least})"""
