"""Personal data by weak supervision. DataFrame functions only.

Four strict kinds (email, ip, card, phone) are always reported. Looser patterns propose further spans.
Four labelers vote on every span, strict or not: the shape of the value, gazetteers, cue words before it,
and what touches it. Expectation-maximisation over the counts of each vote pattern estimates how reliable
the labelers are and how likely each pattern is to be personal data. These soft labels train a naive Bayes
classifier on the features of a span, which decides about the looser spans.

The texts are read once; spans with votes and features go to a written table. What reaches the driver is a
count for each combination of kind, votes and features: at most KINDS x 3^4 x feature values rows, whatever
the corpus. Positions are code points, ends exclusive.

Null texts count as empty. Repeated rows are reported each. A looser span that meets a strict one is left
out. An empty table gives an empty result. Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut

#: The strict kinds, in order. Possessive groups and the look-behind only spare retries that cannot match,
#: so that long runs of letters or digits take linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no span of the kind.
NEEDS = {"email": "@", "ip": None, "card": None, "phone": "+", "ssn": "-", "local": None, "spelled": "dot", "name": None}

#: Gazetteers.
FIRST_NAMES = """
Aaron Abigail Adam Adrian Agnes Alan Albert Alejandro Alexander Alexandra Alfred Alice Alicia Amanda Amelia Amy Ana Andrea Andreas Andrew Angela
Anita Anna Anne Anthony Antonio Arthur Barbara Beatrice Benjamin Bernard Bernd Brian Camille Carl Carla Carlos Carmen Carol Caroline Catherine
Charles Charlotte Chloe Christian Christina Christine Christopher Claire Claudia Daniel David Deborah Dennis Diana Diego Dieter Dominique Donald
Dorothy Edward Elena Elisabeth Elizabeth Emily Emma Eric Erika Ernst Eva Felix Fernando Florence Francisco Frank Franz Fritz Gabriel Georg George
Gerhard Grace Guillaume Hannah Hans Heinrich Helen Helga Henri Henry Isabel Isabelle Ivan Jack Jacques James Jan Janet Javier Jean Jennifer Jessica
Joan Johann John Jorge Jose Joseph Juan Julia Julian Julie Karen Karl Katharina Kevin Klaus Lars Laura Lauren Linda Lisa Louis Louise Lucas Lucia
Luis Luise Lukas Manuel Marc Marco Margaret Maria Marie Mario Mark Markus Marta Martha Martin Mary Matthew Max Michael Michel Miguel Monica Monika
Nancy Nicolas Nicole Oliver Olivia Otto Pablo Patricia Patrick Paul Paula Pedro Peter Petra Philip Philippe Pierre Rachel Rafael Ralf Raul Rebecca
Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Sofia Sophie Stefan Stephen Susan Susanne Teresa Thomas Ulrich Ursula Victor Werner William
Wolfgang Yves
""".split()
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sr", "Sra", "Don"]
DOMAIN_ENDINGS = "com org net edu gov mil int info biz io dev app co me tv us uk de fr es it nl be ch at pt pl se no dk fi ie cz gr ru ua tr cn jp kr in au nz ca br mx ar cl".split()
#: Words before a span that speak for or against personal data.
CUES = [
    "mail", "email", "e-mail", "courriel", "correo", "contact", "contacts", "kontakt", "contacto", "call", "calls", "phone", "phones", "telephone", "telefon", "tel", "fax", "mobile", "cell", "handy",
    "reach", "write", "card", "cards", "carte", "karte", "tarjeta", "visa", "mastercard", "ssn", "social security", "name", "named", "dear", "from", "by", "user", "client", "server", "host", "login", "address",
]
ANTI_CUES = ["version", "isbn", "issn", "order", "orders", "invoice", "serial", "build", "release", "section", "chapter", "figure", "fig", "page", "pages", "part", "model", "example"]
#: Characters before a span that are searched for these words.
NEAR = 40


def by_letter(words: list[str]) -> str:
    """A pattern of words grouped by their first letter, so that most places fail at once."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{k}(?:{'|'.join(rest)})" for k, rest in groups.items())


def any_word(words: list[str]) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])"


LOOSE = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}(?:\x20at\x20|\x20?\[at\]\x20?|\x20?\(at\)\x20?)[A-Za-z0-9-]{1,63}(?:\x20dot\x20|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?)[A-Za-z]{2,10}",
    "name": r"(?<![A-Za-z])(?=[A-Z])(?:(?:" + "|".join(TITLES) + r")\.?|(?:" + by_letter(FIRST_NAMES) + r"))\x20[A-Z][a-z]{1,30}(?![A-Za-z])",
}
KINDS = [*BASE, *LOOSE]
LABELERS = ["shape", "gazetteer", "context", "edges"]
FEATURES = ["length", "left", "right", "cue", "listed"]
SPAN = "struct<kind:int,start:int,end:int,value:string,left:string,after:string,cue:int>"
#: Between spans that stand in one list, which share the words before it.
LISTED = r"^[\s,;/|&]*(?:(?:and|or|und|oder|et|ou|y|o)\s+)?$"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    back = F.reverse(digits(value))
    number = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda i: number(i) * 2 - F.when(number(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda n, i: n + F.when(i % 2 == 0, doubled(i)).otherwise(number(i)))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        small = lambda p: F.when(F.length(bare(p)) <= 3, F.concat(F.lit("0"), bare(p)).cast("int") <= 255).otherwise(False)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often `use` names it, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, start: int, op: Callable[[Column, Column], Column]) -> Column:
    """The results of an associative op over the ints up to each place. They are taken in runs of about the
    square root of their number: one fold that appends to one array would take quadratic time."""
    none = F.array().cast("array<int>")

    def fold(piece: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), none.alias("out"))
        step = lambda acc, x: bind(op(acc["at"], x), lambda r: F.struct(r.alias("at"), F.array_append(acc["out"], r).alias("out")))
        return F.aggregate(piece, begin, step, lambda acc: acc["out"])

    first = F.lit(start)

    def pieced(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return bind(size, lambda c: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / c).cast("int")), lambda i: F.slice(v, i * c + 1, c)))

    def joined(pieces: Column) -> Column:
        heads = fold(F.transform(pieces, lambda p: F.aggregate(p, first, lambda a, x: op(a, x))), first)
        heads = F.concat(F.array(first), F.slice(heads, F.lit(1), F.size(pieces) - 1))
        return F.flatten(F.zip_with(pieces, heads, fold))

    return bind(values, lambda v: F.when(F.size(v) == 0, none).otherwise(bind(pieced(v), joined)))


def spans_of(found: Column, gaps: Column, number: int) -> Column:
    """The matches with their positions and the cue that holds for them, from the matches and the pieces
    between them."""
    near = lambda gap: F.lower(F.right(gap, F.lit(NEAR)))
    own = lambda gap: F.when(near(gap).rlike(any_word(ANTI_CUES)), 2).when(near(gap).rlike(any_word(CUES)), 1).when(gap.rlike(LISTED), -1).otherwise(0)

    def placed(g: Column) -> Column:
        with_gap = F.zip_with(found, F.slice(g, F.lit(1), F.size(found)), lambda m, x: F.struct(m.alias("value"), x.alias("gap")))
        parts = F.zip_with(with_gap, F.slice(g, F.lit(2), F.size(found)), lambda p, x: F.struct(p["value"].alias("value"), p["gap"].alias("gap"), F.left(x, F.lit(1)).alias("after")))
        return bind(parts, with_places)

    def with_places(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: F.length(p["gap"]) + F.length(p["value"])), 0, lambda a, x: a + x)
        cues = running(F.transform(parts, lambda p: own(p["gap"])), 0, lambda a, x: F.when(x < 0, a).otherwise(x))
        places = F.zip_with(ends, cues, lambda e, c: F.struct(e.alias("end"), c.alias("cue")))
        return F.zip_with(parts, places, span)

    def span(p: Column, at: Column) -> Column:
        start = at["end"] - F.length(p["value"])
        return F.struct(F.lit(number).alias("kind"), start.alias("start"), at["end"].alias("end"), p["value"].alias("value"), F.right(p["gap"], F.lit(1)).alias("left"), p["after"].alias("after"), at["cue"].alias("cue"))

    return bind(gaps, placed)


def apart(loose: Column, base: Column) -> Column:
    """The loose spans that meet no base span: both are sorted by start and swept once in each direction."""
    far = 2**31 - 1
    strict = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("tag"), b["end"].alias("end"), F.lit(-1).alias("i")))
    other = F.transform(loose, lambda x, i: F.struct(x["start"].alias("start"), F.lit(1).alias("tag"), x["end"].alias("end"), i.alias("i")))

    def swept(events: Column) -> Column:
        before = running(F.transform(events, lambda e: F.when(e["tag"] == 0, e["end"]).otherwise(0)), 0, F.greatest)
        behind = running(F.transform(F.reverse(events), lambda e: F.when(e["tag"] == 0, e["start"]).otherwise(far)), far, F.least)
        edges = F.zip_with(before, F.reverse(behind), lambda a, b: F.struct(a.alias("before"), b.alias("behind")))
        free = F.zip_with(events, edges, lambda e, x: F.when((e["tag"] == 1) & (x["before"] <= e["start"]) & (x["behind"] >= e["end"]), e["i"]))
        return F.transform(F.array_compact(free), lambda i: F.get(loose, i))

    return F.when((F.size(loose) == 0) | (F.size(base) == 0), loose).otherwise(bind(F.sort_array(F.concat(strict, other)), swept))


def matches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, loose): arrays of spans; failing strict matches are dropped."""
    patterns = BASE | LOOSE
    none = F.array().cast("array<string>")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()}
    df = df.select("*", *[(F.when(F.contains("text", F.lit(NEEDS[k])), h).otherwise(none) if NEEDS[k] else h).alias(f"hit_{k}") for k, h in hits.items()])
    empty = F.array().cast(f"array<{SPAN}>")
    found = {k: F.when(F.size(f"hit_{k}") > 0, spans_of(F.col(f"hit_{k}"), F.split("text", F.lit(p), -1), KINDS.index(k))).otherwise(empty) for k, p in patterns.items()}
    df = df.select("doc_id", *[s.alias(k) for k, s in found.items()])
    passing = lambda k: F.filter(k, lambda x: valid(k, x["value"]))
    strict = F.flatten(F.array(*[passing(k) for k in BASE]))
    df = df.select("doc_id", strict.alias("base"), F.flatten(F.array(*LOOSE)).alias("loose"))
    return df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", bind(F.struct("base", "loose"), lambda s: apart(s["loose"], s["base"])).alias("loose"))


def judged(span: Column, strict: bool) -> Column:
    """A span with the labelers' votes (1, 0, or -1: abstains) and the classifier's features."""
    kind, value, left, right, cue = (span[x] for x in ("kind", "value", "left", "after", "cue"))
    name, spelled, email = (kind == KINDS.index(k) for k in ("name", "spelled", "email"))
    listed = (
        F.when(name, value.rlike("^(?:" + "|".join(FIRST_NAMES) + r")\x20"))
        .when(email | spelled, F.lower(value).rlike("[^a-z](?:" + "|".join(DOMAIN_ENDINGS) + ")$"))
    )
    clean_left, clean_right = (left == "") | ~left.rlike("[A-Za-z0-9_@#/=-]"), (right == "") | ~right.rlike("[A-Za-z0-9_@#/=-]")
    shape = F.lit(True) if strict else F.when(name, value.rlike(r"^\S+\x20[A-Z][a-z]{2,}$")).when(kind == KINDS.index("ssn"), ~value.rlike("^(?:000|666|9)|-00-|0000$")).when(kind == KINDS.index("local"), value.rlike(r"^\(?[2-9]")).otherwise(True)
    vote = lambda c: F.coalesce(c.cast("int"), F.lit(-1))
    kind_of = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z0-9]"), 2).otherwise(3)
    return F.struct(
        kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.lit(strict).alias("strict"),
        vote(shape).alias("shape"), vote(listed).alias("gazetteer"), F.when(cue == 2, 0).when(cue == 1, 1).otherwise(-1).alias("context"), (clean_left & clean_right).cast("int").alias("edges"),
        F.least(F.length(value) / 6, F.lit(5)).cast("int").alias("length"), kind_of(left).alias("left"), kind_of(right).alias("right"),
        cue.alias("cue"), vote(listed).alias("listed"),
    )


def estimate(patterns: dict[tuple, float], rounds: int = 60) -> dict[tuple, float]:
    """P(personal data | kind, votes) by EM, from the counts of (kind, votes)."""
    prior = {k: 0.7 for k, *_ in patterns}
    true_pos, false_pos = [0.8] * len(LABELERS), [0.3] * len(LABELERS)
    soft: dict[tuple, float] = {}
    for _ in range(rounds):
        for key in patterns:
            kind, *votes = key
            yes, no = prior[kind], 1 - prior[kind]
            for v, t, f in zip(votes, true_pos, false_pos):
                if v >= 0:
                    yes, no = yes * (t if v else 1 - t), no * (f if v else 1 - f)
            soft[key] = yes / max(yes + no, 1e-300)
        for k in prior:
            n = sum(c for key, c in patterns.items() if key[0] == k)
            prior[k] = (sum(c * soft[key] for key, c in patterns.items() if key[0] == k) + 1.4) / (n + 2)
        for j in range(len(LABELERS)):
            cast = [(key, c) for key, c in patterns.items() if key[1 + j] >= 0]
            for rates, weigh, start in ((true_pos, lambda p: p, 0.8), (false_pos, lambda p: 1 - p, 0.3)):
                hit = sum(c * weigh(soft[key]) for key, c in cast if key[1 + j] == 1)
                rates[j] = (hit + 10 * start) / (sum(c * weigh(soft[key]) for key, c in cast) + 10)
            if true_pos[j] < false_pos[j]:  # labelers are taken to be better than chance
                true_pos[j] = false_pos[j] = (true_pos[j] + false_pos[j]) / 2
    return soft


def train(counts: list[tuple[tuple, tuple, float]]) -> dict[tuple, float]:
    """P(personal data | kind, features) for the combinations seen, from (kind and votes, features, count)."""
    patterns: dict[tuple, float] = {}
    for key, _, n in counts:
        patterns[key] = patterns.get(key, 0) + n
    soft = estimate(patterns)
    mass: dict[tuple, list[float]] = {}
    for key, features, n in counts:
        for cell in [(key[0],), *((key[0], i, v) for i, v in enumerate(features))]:
            both = mass.setdefault(cell, [0.0, 0.0])
            both[0] += n * (1 - soft[key])
            both[1] += n * soft[key]
    out = {}
    for key, features, _ in counts:
        n0, n1 = mass[(key[0],)]
        odds = math.log((n1 + 1) / (n0 + 1))
        for i, v in enumerate(features):
            m0, m1 = mass[(key[0], i, v)]
            odds += math.log((m1 + 1) / (n1 + 6)) - math.log((m0 + 1) / (n0 + 6))
        out[(key[0], *features)] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return out


def listing(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of docs."""
    spans = F.concat(F.transform("base", lambda x: judged(x, True)), F.transform("loose", lambda x: judged(x, False)))
    rows = cut(matches(docs).select("row", "doc_id", spans.alias("spans")), "spans")
    each = rows.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    counts = each.groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    model = train([((r.kind, *(r[x] for x in LABELERS)), tuple(r[x] for x in FEATURES), r.n) for r in sorted(counts)])
    schema = "kind int, " + ", ".join(f"{x} int" for x in FEATURES) + ", p double"
    table = docs.sparkSession.createDataFrame([(*k, p) for k, p in model.items()], schema)
    # the model has a row for each combination seen, bounded as above
    added = each.where("not strict").join(F.broadcast(table), ["kind", *FEATURES]).where(F.col("p") >= threshold)
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    out = rows.join(added, "row", "left")
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda x: x["strict"]), plain)
    out = out.select("doc_id", base.alias("base"), F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("added"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listing(F.col("base")), 256).alias("base_sha256"),
        listing(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
