"""Text functions on columns: folding, cleaning, term matching, company and title forms."""

from __future__ import annotations

import html.entities
import json
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import markup

NULL_STRING = "string"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII characters: those with one, and the rest."""
    one, to, more = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if not unicodedata.decomposition(char):
            continue
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            one.append(char)
            to.append(folded)
        elif folded:
            more[char] = folded
    return "".join(one), "".join(to), more


FOLD_FROM, FOLD_TO, FOLD_MORE = _folding()


def constant_map(values: dict[str, str]) -> Column:
    """A map literal, however many entries it has."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def fold(c: Column) -> Column:
    """Compatibility forms decomposed, accents dropped, other non-ASCII characters removed, lower case; null
    gives ''.

    The expression is large: make it a column of its own before it is used more than once."""
    c = F.coalesce(c, F.lit(""))
    known = constant_map(FOLD_MORE)

    def replaced(chars: Column) -> Column:
        more = F.filter(chars, lambda ch: F.translate(ch, "".join(FOLD_MORE), "") == "")
        spelled = F.aggregate(more, c, lambda out, ch: F.replace(out, ch, F.element_at(known, ch)))
        # a text has few different characters with accents: each is looked up once, not all letters of the text
        few = F.aggregate(chars, spelled, lambda out, ch: F.replace(out, ch, F.translate(ch, FOLD_FROM, FOLD_TO)))
        return F.when(F.size(chars) <= 64, few).otherwise(F.translate(spelled, FOLD_FROM, FOLD_TO))

    others = F.array_distinct(F.split(F.regexp_replace(c, r"[\x00-\x7F]+", ""), ""))
    rest = F.regexp_replace(let(others, replaced), r"[^\x00-\x7F]+", "")
    return F.lower(F.when(F.octet_length(c) == F.length(c), c).otherwise(rest))


def clean(c: Column) -> Column:
    """Spaces collapsed within lines, lines trimmed, at most one blank line between others."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(" "))
    c = F.regexp_replace(c, r"\r\n?|[\x0B\x0C\x1C-\x1E\x85  ]", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: Names that count without their semicolon too, the longest first.
_BARE = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
REFERENCE = rf"^&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{_BARE}))"
#: Numbers of the C1 range mean the characters of code page 1252.
_C1 = {str(n): bytes([n]).decode("cp1252", "replace") if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(n) for n in range(0x80, 0xA0)} | {"0": "\ufffd", "13": "\r"}


def unescape(c: Column) -> Column:
    """Named and numeric character references replaced, as HTML defines them."""
    names, c1 = constant_map(dict(html.entities.html5)), constant_map(_C1)

    def char_of(number: Column) -> Column:
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        bad = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        control = number.between(1, 8) | number.between(0xE, 0x1F) | number.between(0x7F, 0x9F) | number.between(0xFDD0, 0xFDEF) | (number == 0xB) | (number % 0x10000 >= 0xFFFE)
        known = F.when(number < 0xA0, F.element_at(c1, number.cast("string")))
        return F.coalesce(known, F.when(bad, "\ufffd").when(control, "").otherwise(char))

    def resolved(part: Column) -> Column:
        return let(F.struct(part.alias("part"), F.regexp_extract(part, REFERENCE, 0).alias("ref"), F.regexp_extract(part, rf"^&({_BARE})", 1).alias("bare")), replaced)

    def replaced(s: Column) -> Column:
        part, ref, bare = s["part"], s["ref"], s["bare"]
        digits = F.regexp_extract(ref, "^&#[xX]?([0-9A-Fa-f]+)", 1)
        base = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        number = F.when(F.length(digits) > 12, 999_999_999).otherwise(base.cast("long"))
        char = F.when(digits != "", let(number, char_of)).otherwise(F.element_at(names, F.substring(ref, 2, 40)))
        rest = lambda taken: F.substring(part, F.length(taken) + 1, F.length(part))
        # an unknown name may start with one that needs no semicolon
        short = F.when(bare != "", F.concat(F.element_at(names, bare), F.substring(rest(bare), 2, 1 << 30)))
        return F.when(ref == "", part).otherwise(F.coalesce(F.concat(char, rest(ref)), short, part))

    def whole(c: Column) -> Column:
        parts = F.transform(F.split(c, "(?=&)"), lambda p: F.when(p.startswith("&"), resolved(p)).otherwise(p))
        return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)

    return let(c, whole)


def html_to_text(c: Column) -> Column:
    """Text of an HTML fragment: no scripts or styles, items dashed, block tags on lines of their own. Markup that is
    escaped as a whole is read once more. Not for use within lambdas: see html_to_texts."""
    return clean(markup.lines(c))


def html_to_texts(c: Column) -> Column:
    """html_to_text of each element of an array."""
    return F.transform(markup.lines_each(c), clean)


def term_pattern(terms: list[str]) -> str:
    return r"(?<![a-z0-9])(?:" + "|".join(re.escape(t.lower()) for t in terms) + r")(?![a-z0-9])"


def written_in(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text, within others or not. Far cheaper than a pattern: what needs one of
    the words asks this first where texts are long. Words that hold another one need not be asked for."""
    least = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    return reduce(or_, [text.contains(w) for w in least])


def has_term(folded: Column, term: str) -> Column:
    return folded.contains(term.lower()) & folded.rlike(term_pattern([term]))


def has_any(folded: Column, terms: list[str]) -> Column:
    return folded.rlike(term_pattern(terms)) if terms else F.lit(False)


def occurring(folded: Column, terms: list[str], whole: bool = False) -> Column:
    """The distinct terms that occur, in no order. One pass: at each place where a term may begin, a look-ahead
    takes the longest term; shorter ones that the longer ones begin with are added after. whole: the texts are long,
    most hold no term and are passed over."""
    ordered = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))
    found = F.array_distinct(F.regexp_extract_all(folded, F.lit(r"(?<![a-z0-9])(?=(" + "|".join(re.escape(t) for t in ordered) + r")(?![a-z0-9]))"), F.lit(1)))
    if whole:
        found = F.when(written_in(folded, ordered), found).when(folded.isNotNull(), F.array().cast("array<string>"))
    within = {t: [s for s in ordered if s != t and re.search(rf"^{re.escape(s)}(?![a-z0-9])", t)] for t in ordered}
    within = {t: parts for t, parts in within.items() if parts}
    if not within:
        return found
    return let(found, lambda f: F.array_distinct(F.concat(f, F.flatten(F.array(*[F.when(F.array_contains(f, t), F.array(*map(F.lit, parts))).otherwise(F.array().cast("array<string>")) for t, parts in within.items()])))))


def first_term(folded: Column, terms: list[str], whole: bool = False) -> Column:
    """The first term in the order of the list that occurs. whole: see `occurring`."""
    if not terms:
        return F.lit(None).cast(NULL_STRING)
    listed = F.array(*[F.lit(t) for t in terms])
    return let(occurring(folded, terms, whole), lambda f: F.when(F.size(f) == 0, F.lit(None)).otherwise(F.get(F.filter(listed, lambda t: F.array_contains(f, F.lower(t))), F.lit(0))))


def hits(folded: Column, terms: list[str], whole: bool = False) -> Column:
    """All terms that occur, in the order of the list. whole: see `occurring`."""
    none = F.array().cast("array<string>")
    listed = F.array(*[F.lit(t) for t in terms])
    return let(occurring(folded, terms, whole), lambda f: F.when(F.size(f) == 0, none).otherwise(F.filter(listed, lambda t: F.array_contains(f, F.lower(t)))))


#: Legal forms at the end of company names.
COMPANY_SUFFIXES = ["inc", "llc", "ltd", "limited", "pvt", "private", "gmbh", "corp", "corporation", "co", "company", "plc", "sa", "ag", "bv", "srl", "pty", "llp", "oy", "ab", "sas", "kk"]
#: Rewritings of titles, in order.
TITLE_FORMS = [
    (r"\bfront[\s-]?end\b", "frontend"),
    (r"\bback[\s-]?end\b", "backend"),
    (r"\bfull[\s-]?stack\b", "fullstack"),
    (r"\bsr\b\.?", "senior"),
    (r"\bjr\b\.?", "junior"),
    (r"\bengr\b", "engineer"),
    (r"\bdev\b", "developer"),
    (r"\breact\.?js\b", "react"),
    (r"\bnode\.?js\b", "node"),
    (r"\bnext\.?js\b", "nextjs"),
]
#: Phrases that say nothing about the role.
TITLE_NOISE = ["100 remote", "fully remote", "remote first", "remote", "worldwide", "anywhere", "work from home", "wfh", "hybrid", "onsite", "on site", "full time", "part time", "m f d", "f m d", "m w d", "all genders", "urgent", "hiring", "immediate joiner"]


def company_form(folded: Column) -> Column:
    words = F.regexp_replace(folded, "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), F.trim(words)), rf"(?: (?:{'|'.join(COMPANY_SUFFIXES)}))+$", ""))


def title_form(folded: Column) -> Column:
    c = F.regexp_replace(folded, r"\(.*?\)|\[.*?\]", " ")
    for pattern, form in TITLE_FORMS:
        c = F.regexp_replace(c, pattern, form)
    c = F.regexp_replace(c, "[^a-z0-9+#]+", " ")
    c = F.regexp_replace(c, rf"\b(?:{'|'.join(TITLE_NOISE)})\b", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fingerprint(company: Column, title: Column) -> Column:
    return F.sha1(F.concat(company, F.lit("|"), title))


def slug(folded: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, 40), F.lit("")), F.lit("unknown"))


#: Fixed value: an e-mail address.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0))


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def title_similarity(a: Column, b: Column) -> Column:
    """0 to 100: twice the longest common subsequence of the word-sorted titles over their lengths."""
    return let(F.struct(sorted_words(a).alias("x"), sorted_words(b).alias("y")), lambda s: sorted_similarity(s["x"], s["y"]))


def similar(a: Column, b: Column, least: float) -> Column:
    """title_similarity(a, b) >= least, but for most pairs without computing it: the edit distance of the
    word-sorted titles is at most the number of their letters outside the common subsequence."""

    def decide(s: Column) -> Column:
        x, y = s["x"], s["y"]
        bound = 100 * (1 - F.levenshtein(x, y) / (F.length(x) + F.length(y)))
        return F.when(x == y, F.lit(True)).when(bound < least, F.lit(False)).otherwise(sorted_similarity(x, y) >= least)

    return let(F.struct(sorted_words(a).alias("x"), sorted_words(b).alias("y")), decide)


def sorted_similarity(x: Column, y: Column) -> Column:
    letters = lambda s: F.filter(F.split(s, ""), lambda ch: ch != "")

    def extend(row: Column, ch: Column) -> Column:
        # row: lengths for the prefixes of y so far; the next row is built from the left
        start = F.struct(F.array(F.lit(0)).alias("out"), F.lit(1).alias("at"))

        def step(acc: Column, other: Column) -> Column:
            left, up, diagonal = F.element_at(acc["out"], -1), F.get(row, acc["at"]), F.get(row, acc["at"] - 1)
            return F.struct(F.array_append(acc["out"], F.when(ch == other, diagonal + 1).otherwise(F.greatest(left, up))).alias("out"), (acc["at"] + 1).alias("at"))

        return F.aggregate(letters(y), start, step, lambda acc: acc["out"])

    last = F.aggregate(letters(x), F.array_repeat(F.lit(0), F.length(y) + 1), extend, lambda row: F.element_at(row, -1))
    total = F.length(x) + F.length(y)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * last / total)
