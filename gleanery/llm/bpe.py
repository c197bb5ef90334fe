"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A merge list needs only so much lookahead. Take the encodings of a prefix and of any longer text: rule by rule,
the point up to which they agree moves left only where a rule joins the token before it (u) with one that starts
at it (v), and then by the length of u. The next rule that moves it must take up a v that begins with this u. So
the longest chain of rules of falling priority, each with a right part that begins with the left part of the one
before, weighted by the lengths of the left parts, bounds how far back a text's end reaches: `lookahead`. Tokens
that end further back than that are stable, whatever follows. The encoder merges a window of STEP symbols and
the lookahead, emits the stable tokens and keeps the rest; what it holds does not grow with the text.

The stages before the merges are transducers too: special tokens are cut out of the raw text, then come
composed forms (NFC), lower case, and words. Each holds back what later characters can change: the start of a
special token, the characters since the last one that composes with nothing before it, the last word. A word
longer than OPEN goes to the window as it comes. White space separates words and is in no token. The tokens of
short words are kept in a table of at most MEMO words.

The decoder turns ids to bytes and bytes to text as they come, and holds an unfinished character back. It gives
the tokens with spaces between, as files without a decoder say, or (`readable`) the bytes the tokens stand for,
with a space for the end of a word.

Files of this shape are read: merges with a mark for word ends, byte-level symbols, the normalizers and
splitter below, plain special tokens. Their tables are bounded by the file and travel with the tasks.

Null texts count as empty and have no tokens; no tokens decode to an empty text. Nulls, repeated rows and extra
columns elsewhere pass through unchanged. An empty table gives an empty one. Strings of special tokens in a text
become these tokens. A run of combining marks is held until it ends, however long it is.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import small_batches

#: Symbols of a window besides the lookahead, letters of a word that is not kept whole, letters fed at a time.
STEP = 1024
OPEN = 256
PIECE = 65_536
#: Words whose tokens a task keeps (as many that came before besides), and the longest of them.
MEMO = 200_000
MEMO_LETTERS = 64

#: The word pattern of the file, and ranges that its library counts neither as letters nor as numbers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
UNCLASSED = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    "\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Marks that its library neither reorders nor composes.
UNORDERED = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50"
    "\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97"
    "\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
#: Capitals younger than Python's tables, as first, last, distance to the small letter; sigma has one small form.
YOUNG = [
    (0x3A3, 0x3A3, 32), (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561),
    (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]

LETTER = rf"[\p{{L}}--[{UNCLASSED}]]"
OTHER = rf"[^\s[\p{{L}}\p{{N}}--[{UNCLASSED}]]]"
NUMBER = rf"[\p{{N}}--[{UNCLASSED}]]"


def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Tables:
    """What a tokenizer file says, and its sufficient lookahead."""

    def __init__(self, text: str):
        told = json.loads(text)
        model, end = told["model"], told["model"]["end_of_word_suffix"]
        normal = [(x["type"], x.get("pattern"), x.get("content")) for x in (told["normalizer"] or {}).get("normalizers", [])]
        parts = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{"type": None}]
        split, *level = [(x["type"], x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in parts]
        shape = (
            normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and split == ("Split", {"Regex": SPLIT}, "Removed", True, None, None) and level == [("ByteLevel", None, None, None, False, False)]
            and end and not model.get("continuing_subword_prefix") and not model.get("ignore_merges") and not model.get("dropout") and told["decoder"] is None
            and all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in told["added_tokens"])
        )
        if not shape:
            raise ValueError("a file of word-end BPE with NFC, lower case and byte-level words is needed")
        self.end, vocab = end, model["vocab"]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.first = [vocab[c] for c in byte_letters()]
        self.last = [vocab[c + end] for c in byte_letters()]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(pairs)}
        self.measure()

    def measure(self) -> None:
        """The symbols of each token, and how far back the end of a text can reach."""
        self.symbols = dict.fromkeys([*self.first, *self.last], 1)
        begins: dict[int, int] = {}  # the left part of a token
        reach: dict[int, int] = {}  # the longest chain so far whose last rule has this left part
        self.lookahead = 1
        for (a, b), new in zip(self.rank, self.made):
            if a not in self.symbols or b not in self.symbols or new in self.symbols:
                raise ValueError("a merge list is needed that makes each token once, from symbols and tokens made before")
            behind, part = 0, b
            while part is not None:
                behind, part = max(behind, reach.get(part, 0)), begins.get(part)
            reach[a] = max(reach.get(a, 0), self.symbols[a] + behind)
            self.lookahead = max(self.lookahead, reach[a])
            begins[new] = a
            self.symbols[new] = self.symbols[a] + self.symbols[b]


class Memo(dict):
    """The tokens of pieces of text without white space: at most MEMO, and as many of the generation before, from
    which pieces in use are taken over."""

    def __init__(self, tokens_of: Callable[[str], tuple[int, ...]]):
        self.tokens_of, self.before = tokens_of, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self.before.get(piece) or self.tokens_of(piece)
        if len(piece) <= MEMO_LETTERS:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Text in pieces to ids: `feed` gives the ids that are stable, `finish` the rest."""

    def __init__(self, tables: Tables, step: int = STEP, open_at: int = OPEN):
        self.tables, self.memo, self.step, self.open_at = tables, Memo(self.tokens_of), step, open_at
        self.plain, self.unclassed = regex.compile(SPLIT), re.compile(f"[{UNCLASSED}]")
        self.word = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|{OTHER}+")
        self.space, self.control = regex.compile(r"\s+"), re.compile("[\x1c-\x1f]")  # str.split takes these for spaces
        self.runs = [regex.compile(rf"(?V1){LETTER}*"), regex.compile(rf"(?V1){OTHER}*")]
        self.apart = re.compile(f"([{UNORDERED}])")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(tables.special, key=len, reverse=True))) + ")") if tables.special else None
        self.young = {c: c + by for first, last, by in YOUNG for c in range(first, last + 1)}
        self.odd = re.compile(f"[{UNORDERED}{''.join(map(chr, self.young))}]")
        self.clear()

    def clear(self) -> None:
        self.raw = self.loose = self.held = ""  # before special tokens, composition, words
        self.run, self.window = None, []  # the open word: its pattern and symbols

    # merges

    def merged(self, symbols: list[int]) -> list[int]:
        """The tokens of symbols: the rule of highest priority first, the leftmost place first."""
        rank, made, none = self.tables.rank.get, self.tables.made, len(self.tables.made)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def push(self, text: str) -> list[int]:
        """Letters of the open word; its stable tokens."""
        first, out = self.tables.first, []
        size, reach, symbols = self.step + self.tables.lookahead, self.tables.lookahead, self.tables.symbols
        self.window += [first[b] for b in text.encode()]
        start = 0
        while len(self.window) - start > size:  # the last symbol waits: it may be the word's end
            at = start
            for token in self.merged(self.window[start : start + size]):
                if at + symbols[token] > start + size - reach:
                    break
                at += symbols[token]
                out.append(token)
            start = at
        del self.window[:start]
        return out

    def close(self) -> list[int]:
        """The end of the open word."""
        symbols, self.window, self.run = self.window, [], None
        return self.merged([*symbols[:-1], self.tables.last[self.tables.first.index(symbols[-1])]]) if symbols else []

    def split(self, piece: str) -> list[str]:
        return (self.word if not piece.isascii() and self.unclassed.search(piece) else self.plain).findall(piece)

    def tokens_of(self, piece: str) -> tuple[int, ...]:
        words = self.split(piece)
        if len(words) > 1:
            return tuple(chain.from_iterable(map(self.memo.__getitem__, words)))
        if len(piece) > self.open_at:
            return (*self.push(piece), *self.close())
        data, first = piece.encode(), self.tables.first
        return tuple(self.merged([*[first[b] for b in data[:-1]], self.tables.last[data[-1]]])) if data else ()

    # the stages before

    def words(self, text: str, final: bool) -> list[int]:
        """Lower-case text, cut at any place, to ids."""
        out: list[int] = []
        if self.run:
            more = self.run.match(text).end()
            out += self.push(text[:more])
            if more == len(text) and not final:
                return out
            out += self.close()
            text = text[more:]
        text, self.held = self.held + text, ""
        pieces = self.space.split(text) if self.control.search(text) else text.split()
        if pieces and not final and not self.space.match(text[-1]):
            self.held = pieces.pop()
        out.extend(chain.from_iterable(map(self.memo.__getitem__, pieces)))
        if len(self.held) > self.open_at:
            *before, tail = self.split(self.held)
            if before and before[-1] == "'" and len(tail) == 1:
                tail = before.pop() + tail  # the first letters of a contraction, perhaps
            out.extend(chain.from_iterable(map(self.memo.__getitem__, before)))
            if len(tail) > self.open_at:
                self.run = next(r for r in self.runs if r.match(tail).end())
                out += self.push(tail)
                tail = ""
            self.held = tail
        return out

    def composed(self, text: str, final: bool) -> list[int]:
        text = self.loose + text
        at = len(text)
        if not final:
            at -= 1
            while at > 0 and joins_before(text[at]):
                at -= 1
        text, self.loose = text[:max(at, 0)], text[max(at, 0) :]
        if not latin(text):
            if self.odd.search(text):
                text = "".join(unicodedata.normalize("NFC", x) for x in self.apart.split(text)).translate(self.young)
            else:
                text = unicodedata.normalize("NFC", text)
        return self.words(text.lower(), final)

    def feed(self, text: str, final: bool = False) -> list[int]:
        text = self.raw + text
        self.raw = ""
        if not self.special:
            return self.composed(text, final)
        out: list[int] = []
        *before, text = self.special.split(text)
        for plain, token in zip(before[::2], before[1::2]):
            out += self.composed(plain, True)
            out.append(self.tables.special[token])
        if not final:
            longest = max(map(len, self.tables.special)) - 1
            for n in range(min(longest, len(text)), 0, -1):
                if any(s.startswith(text[-n:]) for s in self.tables.special):
                    text, self.raw = text[:-n], text[-n:]
                    break
        return out + self.composed(text, final)

    def finish(self) -> list[int]:
        out = self.feed("", True)
        self.clear()
        return out


def latin(text: str) -> bool:
    """Whether all characters are Latin-1: these are composed, and none is odd."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def joins_before(char: str) -> bool:
    """Whether a character may be reordered or composed with one before it: where in doubt, it may."""
    if char < "\u0300":
        return False
    if "\u3400" <= char <= "\u9fff" or "\u0400" <= char <= "\u0482":
        return False
    start = unicodedata.normalize("NFD", char)[0]
    return unicodedata.combining(start) != 0 or unicodedata.category(start) in ("Mc", "Mn") or "\u1161" <= start <= "\u1175" or "\u11a8" <= start <= "\u11c2"


class Decoder:
    """Ids in pieces to text: bytes are text once their character is complete."""

    def __init__(self, tables: Tables, readable: bool = False):
        if readable:
            of = {c: bytes([b]) for b, c in enumerate(byte_letters())}
            special = set(tables.special.values())
            spell = lambda t: b"".join(of[c] for c in t)
            self.bytes = {i: t.encode() if i in special else spell(t.removesuffix(tables.end)) + (b" " if t.endswith(tables.end) else b"") for i, t in tables.tokens.items()}
        else:
            self.bytes = {i: b" " + t.encode() for i, t in tables.tokens.items()}
        self.skip = 0 if readable else 1
        self.clear()

    def clear(self) -> None:
        self.left, self.state = self.skip, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        """Ids that the file does not have give nothing."""
        data = b"".join([self.bytes.get(i, b"") for i in ids])
        if self.left and data:
            data, self.left = data[self.left :], 0
        return self.state.decode(data)

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.clear()
        return out


def read_tables(path: str) -> str:
    """The tokenizer file's text, read by the driver: executors need not have the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def packed(ids: array) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    if array("I", [1]).tobytes()[0] != 1:
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def unpacked(data: bytes) -> array:
    ids = array("I", data)
    if array("I", [1]).tobytes()[0] != 1:
        ids.byteswap()
    return ids


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """docs without the text, with its token ids (binary: little-endian unsigned 32-bit integers) and their number."""
    file, others = read_tables(path), [c for c in docs.columns if c != text]
    if {ids, count} & set(others):
        raise ValueError(f"docs have a column {ids} or {count}: name others")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(file)
        encoder = Encoder(tables)
        for batch in batches:
            out, sizes = [], []
            for value in batch.column(text):
                found, whole = array("I"), value.as_py() or ""
                for at in range(0, len(whole), PIECE):
                    found.extend(encoder.feed(whole[at : at + PIECE]))
                found.extend(encoder.finish())
                out.append(packed(found))
                sizes.append(len(found))
            columns = [batch.column(c) for c in others] + [pa.array(out, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*others, ids, count])

    fields = docs.drop(text).withColumns({ids: F.lit(None).cast("binary"), count: F.lit(None).cast("long")}).schema
    with small_batches(docs.sparkSession):
        return docs.mapInArrow(encoded, fields)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text", readable: bool = False) -> DataFrame:
    """rows without the ids, with their text."""
    file, others = read_tables(path), [c for c in rows.columns if c != ids]
    if text in others:
        raise ValueError(f"rows have a column {text}: name another")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Tables(file), readable)
        for batch in batches:
            out = []
            for value in batch.column(ids):
                found = unpacked(value.as_py() or b"")
                parts = [decoder.feed(found[at : at + PIECE]) for at in range(0, len(found), PIECE)]
                out.append("".join(parts) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(out, pa.string())], [*others, text])

    with small_batches(rows.sparkSession):
        return rows.mapInArrow(decoded, rows.drop(ids).withColumn(text, F.lit(None).cast("string")).schema)
