"""Periodic runs of words, found with a suffix automaton whose suffix links are a link-cut tree.

A run is a stretch of words with smallest period q (words q apart are equal) of LEAST_WORDS words and LEAST_TURNS
periods at least, that no neighbouring word extends. Words are appended to a suffix automaton one by one. The
suffixes of the text so far are the path from the root of the suffix links to the newest state; their last
occurrences before colour the path in segments, and appending recolours it: an access in the link-cut tree, which
passes each segment once (amortised logarithmic). A segment whose suffixes ended last at j, i - j words ago,
holds a suffix of just i - j words if its lengths span that number: then the text ends with a square of that
period, and its root has no smaller one. Each square is extended to its run once.

Only parts of a text that could hold a run enter the automaton: in a run each word past the first period has
occurred at most q words before, (LEAST_TURNS - 1) q words in a row. Parts with so many words in a row that
recur within 2^k words are taken for each k, with 2^k words before them. No run is missed: a run lies within
its part, and is extended in the whole text.

A word is dropped by `collapse` if a run contains it past its first period. Rows are judged one by one, so no row
moves. Words are what white space of ASCII (space, tab to carriage return) separates.

Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows are judged alike. Nulls and
extra columns elsewhere pass through unchanged. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import small_batches

LEAST_WORDS = 6
LEAST_TURNS = 4
WORD = re.compile(r"[^ \t-\r]+")
#: Words of texts that are looked at together (or one text).
HELD_WORDS = 500_000
RUN = pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()})
RUN_SCHEMA = "array<struct<start: bigint, length: bigint, period: bigint>>"


class LinkCutTree:
    """A rooted tree whose paths from the root are recoloured. Node 0 is no node. Each path of one colour is a splay
    tree by depth; its root knows the colour, and as parent the node that the path hangs from."""

    def __init__(self):
        self.left, self.right, self.parent, self.colour = [0], [0], [0], [-1]

    def add(self, parent: int) -> int:
        """A new leaf."""
        self.left.append(0)
        self.right.append(0)
        self.parent.append(parent)
        self.colour.append(-1)
        return len(self.left) - 1

    def insert_above(self, node: int) -> int:
        """A new node between node and its parent, of the node's colour."""
        self.splay(node)
        new, above = self.add(node), self.left[node]
        self.left[node], self.left[new] = new, above
        if above:
            self.parent[above] = new
        return new

    def splay(self, x: int) -> None:
        left, right, parent, colour = self.left, self.right, self.parent, self.colour

        def rotate(x: int) -> None:
            p = parent[x]
            g = parent[p]
            if g and left[g] == p:
                left[g] = x
            elif g and right[g] == p:
                right[g] = x
            else:
                colour[x] = colour[p]
            if left[p] == x:
                child = left[p] = right[x]
                right[x] = p
            else:
                child = right[p] = left[x]
                left[x] = p
            if child:
                parent[child] = p
            parent[p], parent[x] = x, g

        while True:
            p = parent[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = parent[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def recolour(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path from the root to node a colour: (deepest node, colour before) of its segments, upwards."""
        out, x, below = [], node, 0
        while x:
            self.splay(x)
            out.append((x, self.colour[x]))
            cut_off = self.right[x]
            if cut_off:
                self.colour[cut_off] = self.colour[x]
            self.right[x] = below
            below, x = x, self.parent[x]
        self.colour[below] = colour
        self.splay(node)
        return out


def squares(ids: list[int]) -> Iterator[tuple[int, int]]:
    """(last place, period) of the squares in ids whose root has no smaller period."""
    tree = LinkCutTree()
    root = newest = tree.add(0)
    length, link, following = [0, 0], [0, 0], [{}, {}]
    for i, word in enumerate(ids):
        state, before = tree.add(0), newest
        length.append(i + 1)
        link.append(root)
        following.append({})
        while before and word not in following[before]:
            following[before][word] = state
            before = link[before]
        if before:
            target = following[before][word]
            if length[target] > length[before] + 1:
                clone = tree.insert_above(target)
                length.append(length[before] + 1)
                link.append(link[target])
                following.append(dict(following[target]))
                link[target] = clone
                while before and following[before].get(word) == target:
                    following[before][word] = clone
                    before = link[before]
                target = clone
            link[state] = target
        tree.parent[state] = link[state]
        newest = state
        segments = tree.recolour(state, i)
        for (node, last), (above, _) in zip(segments, [*segments[1:], (0, -1)]):
            if last >= 0 and length[above] < i - last <= length[node]:
                yield i, i - last


def stretches(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true flags of a length."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    keep = end - start >= least
    return start[keep], end[keep]


def parts(ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """The parts of texts (laid one behind the other, from starts on) that could hold runs."""
    n = len(ids)
    if not n:
        return []
    order = np.argsort(ids, kind="stable")
    back = np.full(n, n + 1)  # how far back the word occurs last
    same = ids[order[1:]] == ids[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    sizes = np.diff(starts, append=n)
    begin = np.repeat(starts, sizes)
    back[back > np.arange(n) - begin] = n + 1
    cover = np.zeros(n + 1, np.int32)
    within = 1
    while within < 2 * max(1, int(sizes.max()) // LEAST_TURNS):
        least = within // 2 + 1  # the smallest period of this round
        lo, hi = stretches(back <= within, max((LEAST_TURNS - 1) * least, LEAST_WORDS - within))
        np.add.at(cover, np.maximum(lo - within, begin[lo] if len(lo) else lo), 1)
        np.add.at(cover, hi, -1)
        within *= 2
    inside = np.cumsum(cover)[:n] > 0
    first = inside & (np.diff(inside, prepend=False) | (np.arange(n) == begin))
    lo = np.flatnonzero(first)
    last = inside & np.concatenate([~inside[1:] | first[1:], [True]])
    return list(zip(lo.tolist(), (np.flatnonzero(last) + 1).tolist()))


def runs_of(text: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, by start and period; they lie in the spans."""
    out = set()
    for lo, hi in spans:
        known: dict[int, int] = {}  # by period, where the last run ends
        for i, period in squares(text[lo:hi]):
            i += lo
            if known.get(period, -1) >= i:
                continue
            start, end = i - 2 * period + 1, i + 1
            while start and text[start - 1] == text[start - 1 + period]:
                start -= 1
            while end < len(text) and text[end] == text[end - period]:
                end += 1
            known[period] = end - 1
            if end - start >= max(LEAST_WORDS, LEAST_TURNS * period):
                out.add((start, end - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def judged(words: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    numbers: dict[str, int] = {}
    ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in text), np.int64, len(text)) for text in words]
    filled = [k for k, text in enumerate(words) if text]
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if not filled:
        return out
    starts = np.cumsum([0, *(len(words[k]) for k in filled[:-1])])
    spans: dict[int, list[tuple[int, int]]] = {}
    for lo, hi in parts(np.concatenate([ids[k] for k in filled]), starts):
        at = int(np.searchsorted(starts, lo, "right")) - 1
        spans.setdefault(at, []).append((lo - int(starts[at]), hi - int(starts[at])))
    for at, found in spans.items():
        out[filled[at]] = runs_of(ids[filled[at]].tolist(), found)
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that are in no run past its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return " ".join(words)


def detect(docs: DataFrame, text: str = "text", runs: str = "runs") -> DataFrame:
    """docs with the runs of the text (start and length in words, period), and the text without their repeats."""
    others = [c for c in docs.columns if c != text]
    if runs in others:
        raise ValueError(f"docs have a column {runs}: name another")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            all_runs, rest, at = [], [], 0
            while at < len(texts):
                held, size = [], 0
                while at < len(texts) and size < HELD_WORDS:
                    held.append(WORD.findall(texts[at] or ""))
                    size += len(held[-1])
                    at += 1
                for words, some in zip(held, judged(held)):
                    all_runs.append([dict(zip(("start", "length", "period"), r)) for r in some])
                    rest.append(collapsed(words, some))
            columns = [batch.column(c) for c in others] + [pa.array(rest, pa.string()), pa.array(all_runs, pa.list_(RUN))]
            yield pa.RecordBatch.from_arrays(columns, [*others, text, runs])

    schema = docs.drop(text).withColumns({text: F.lit(None).cast("string"), runs: F.lit(None).cast(RUN_SCHEMA)}).schema
    with small_batches(docs.sparkSession):
        return docs.mapInArrow(found, schema)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, with one period of each run."""
    runs = "_runs"
    while runs in docs.columns:
        runs += "_"
    return detect(docs, text, runs).select(*docs.columns)


def sharpest(runs: Column) -> Column:
    """The run with the greatest length by its period, exactly; of equal ones the first by start and period."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
