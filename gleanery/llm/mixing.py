"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed for each cell of source, language and topic. Raking scales the cells in turn to
the target shares of sources, languages and topics until all three hold. A token budget, a share of the
corpus's tokens, scales the factors. A document's probability is its cell's scaled factor, 1 at most; what
is left over is its weight, so that each cell has its tokens in expectation, counted with weights: plentiful
cells are thinned at weight 1, scarce ones stay whole and count several times. No cell sets the scale of the
others. Without a budget the largest factor does, as many tokens as the scarcest cell allows without weights.
No document comes twice. A hash of the doc_id decides, so runs agree on equal probabilities.

Topics are clusters of words (`topics`), the default of `mix` and `mix_weights`. No one can name shares for
clusters beforehand: each language's share is dealt over its topics in proportion to their tokens to the power
TEMPER, so that rare topics gain and common ones lose, and topics and languages agree on what they ask. The
form of the text is a cheaper topic, with shares of its own, for `weigh` and `sample`.

Each target names some values; all others count as REST. So the cells number at most the product of the
named values, which the caller wrote: the sums are gathered to the driver and raked there. A share for
values that the corpus lacks cannot be met; it is dealt over the values it has, in proportion. Where the cells
that exist cannot meet all margins together, a warning says how far off the raking ended; `margins` lists them.
The texts are read once: what they give is written beside the rows, and the rest works on that table.

Null source, language and topic count as '' (REST unless named). Null texts have no tokens: they don't
count, and take their cell's probability. A null doc_id is decided by the hash of null. Repeated rows get
the same decision. Empty tables give empty results.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import topics
from gleanery.llm.common import cut, fresh

REST = "*"
ROUNDS = 200
TOLERANCE = 1e-10
#: Shares that end further off than this are warned of.
FAR = 0.01
#: Production targets: no source above a fifth, English at half, tables and marked-up text small.
TARGETS = {
    "source": {"src0": 0.2, REST: 0.8},
    "lang": {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.11, REST: 0.02},
    "topic": {"prose": 0.9, "table": 0.05, "symbols": 0.05},
}
#: Power of a topic's tokens within its language: 1 keeps the corpus's shares, 0 makes topics equal.
TEMPER = 0.5
SEED = 20
#: Tokens of the mix, counted with weights, as a share of the corpus's tokens.
BUDGET = 1.0


def topic_of(text: Column) -> Column:
    """The form of a text: `table` where cells are parted by bars or tabs, on one line in two at least; `symbols`
    where a twentieth of the characters are neither letters, digits, spaces nor common marks; else `prose`."""
    text = F.coalesce(text, F.lit(""))
    lines = F.regexp_count(text, F.lit(r"[^\r\n]+"))
    cells = F.regexp_count(text, F.lit(r"(?m)^.*?(?:\x20\|\x20|\t).*$"))
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\s.,;:!?'\"()|-]+", ""))
    return F.when((cells > 0) & (2 * cells >= lines), "table").when(odd * 20 > F.length(text), "symbols").otherwise("prose")


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def rake(cells: dict[tuple, float], targets: list[dict[str, float]]) -> dict[tuple, float]:
    """Factor of each cell, so that the scaled cells have the target shares along each dimension."""
    cells = {c: n for c, n in cells.items() if n > 0}
    total = sum(cells.values())
    factor = dict.fromkeys(cells, 1.0)
    shares = []
    for d, target in enumerate(targets):
        there = {c[d] for c in cells}
        held = {v: s for v, s in target.items() if v in there and s > 0}
        scale = sum(held.values())
        shares.append({v: s / scale for v, s in held.items()} if scale else {})
    for _ in range(ROUNDS):
        off = 0.0
        for d, share in enumerate(shares):
            if not share:
                continue
            have: dict[str, float] = {}
            for c, n in cells.items():
                have[c[d]] = have.get(c[d], 0.0) + n * factor[c]
            ratio = {v: share.get(v, 0.0) * total / h if h else 0.0 for v, h in have.items()}
            off = max([off, *(abs(r - 1) for r in ratio.values())])
            for c in cells:
                factor[c] *= ratio[c[d]]
        if off < TOLERANCE:
            break
    return factor


def tempered(cells: dict[tuple, float], language: dict[str, float], power: float = TEMPER) -> dict[str, float]:
    """Shares of the topics: each language's share over its topics by their tokens to a power."""
    mass: dict[str, dict[str, float]] = {}
    for (_, lang, topic), n in cells.items():
        if n > 0 and language.get(lang, 0.0) > 0:
            own = mass.setdefault(lang, {})
            own[topic] = own.get(topic, 0.0) + n
    scale = sum(language[x] for x in mass)
    out: dict[str, float] = {}
    for lang, own in mass.items():
        whole = sum(n**power for n in own.values())
        for topic, n in own.items():
            out[topic] = out.get(topic, 0.0) + language[lang] / scale * n**power / whole
    return out


def reached(cells: dict[tuple, float], factor: dict[tuple, float], targets: list[dict[str, float]]) -> list[tuple[int, str, float, float]]:
    """(dimension, value, target share among the values that exist, share reached) for each value of each target."""
    total = sum(n * factor.get(c, 0.0) for c, n in cells.items()) or 1.0
    out = []
    for d, target in enumerate(targets):
        there = {c[d] for c, n in cells.items() if n > 0}
        scale = sum(s for v, s in target.items() if v in there) or 1.0
        for v, s in target.items():
            have = sum(n * factor.get(c, 0.0) for c, n in cells.items() if c[d] == v) / total
            out.append((d, v, s / scale if v in there else 0.0, have))
    return out


def celled(docs: DataFrame, targets: dict[str, dict[str, float]], topic: Column | None, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs (but for the columns to drop) with their tokens and cell, written once."""
    n, cell, *_ = names(docs)
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text")) if topic is None else topic}

    def held(d: str) -> Column:
        named = [v for v in targets[d] if v != REST]
        return F.coalesce(values[d], F.lit("")) if not targets[d] else F.when(values[d].isin(named), values[d]).otherwise(REST)

    rows = docs.withColumn(n, tokens_of(F.col("text"))).withColumn(cell, F.concat_ws("\x1f", *[held(d) for d in targets]))
    return cut(rows.drop(*drop), "cells")


def raked(rows: DataFrame, cell: str, n: str, targets: dict[str, dict[str, float]]) -> tuple[dict, dict, dict]:
    """Tokens and factor of each cell, and the targets; an empty target of topics is tempered from the tokens."""
    sums = rows.groupBy(cell).agg(F.sum(n).alias("n")).collect()  # bounded by the named values and the topics
    cells = {tuple(r[0].split("\x1f")): float(r[1] or 0) for r in sums}
    targets = {d: t or tempered(cells, targets["lang"]) for d, t in targets.items()}
    factors = rake(cells, list(targets.values()))
    off = max((abs(want - have) for _, _, want, have in reached(cells, factors, list(targets.values()))), default=0.0)
    if factors and off > FAR:
        warnings.warn(f"no weights meet all target shares: one is off by {off:.3f}", stacklevel=3)
    return cells, factors, targets


def weigh(
    docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, topic: Column | None = None, seed: int = SEED, budget: float | None = None, drop: tuple[str, ...] = ()
) -> DataFrame:
    """docs plus n_tokens, cell (three values), factor, probability and sampled, under fresh names given
    by `names(docs)`, and the weight of a sampled row, named by `weight_name(docs)`."""
    n, cell, factor, chance, sampled = names(docs)
    weight = weight_name(docs)
    rows = celled(docs, targets, topic, drop)
    _, factors, _ = raked(rows, cell, n, targets)
    scale = 1 / (max(factors.values(), default=1.0) or 1.0) if budget is None else budget
    cells = [("\x1f".join(c), f, min(1.0, f * scale), max(1.0, f * scale)) for c, f in sorted(factors.items())]
    table = docs.sparkSession.createDataFrame(cells, f"`{cell}` string, `{factor}` double, `{chance}` double, `{weight}` double")
    rows = rows.join(F.broadcast(table), cell, "left")
    rows = rows.withColumns({factor: F.coalesce(factor, F.lit(0.0)), chance: F.coalesce(chance, F.lit(0.0)), weight: F.coalesce(weight, F.lit(1.0))})
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return rows.withColumn(sampled, uniform < F.col(chance))


def margins(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, topic: Column | None = None) -> DataFrame:
    """(dimension, value, target, reached): what the raking was asked and what it came to."""
    n, cell, *_ = names(docs)
    cells, factors, targets = raked(celled(docs, targets, topic, ("text",)), cell, n, targets)
    rows = [(list(targets)[d], v, want, have) for d, v, want, have in reached(cells, factors, list(targets.values()))]
    return docs.sparkSession.createDataFrame(rows, "dimension string, value string, target double, reached double")


def names(docs: DataFrame) -> tuple[str, ...]:
    return tuple(fresh(docs, x) for x in ("n_tokens", "cell", "factor", "probability", "sampled"))


def weight_name(docs: DataFrame) -> str:
    return fresh(docs, "weight")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float | None = BUDGET) -> DataFrame:
    """The sampled rows of docs with n_tokens and weight: how often a row counts in the mix."""
    n, _, _, _, sampled = names(docs)
    return weigh(docs, targets, budget=budget).where(F.col(sampled)).select(*docs.columns, n, weight_name(docs))


def mix_weights(docs: DataFrame, budget: float = BUDGET, drop: tuple[str, ...] = (), clusters: int = topics.TOPICS) -> DataFrame:
    """`weigh` with clusters as topics, whose shares are tempered."""
    topic = fresh(docs, "_topic")
    rows = topics.assign(docs, topic, clusters)
    return weigh(rows, TARGETS | {"topic": {}}, F.col(topic), budget=budget, drop=(*drop, topic))


def mix(docs: DataFrame, budget: float = BUDGET, clusters: int = topics.TOPICS) -> DataFrame:
    """`sample` with clusters as topics."""
    n, _, _, _, sampled = names(docs)
    return mix_weights(docs, budget, (), clusters).where(F.col(sampled)).select(*docs.columns, n, weight_name(docs))
