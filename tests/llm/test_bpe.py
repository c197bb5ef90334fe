"""The BPE transducers against the tokenizers library, and against themselves cut at other places."""

import hashlib
import os
import random
import sys
import unicodedata

import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from gleanery.llm import bpe, queries  # noqa: E402
from gleanery.session import table  # noqa: E402

PATH = P.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return bpe.Tables(bpe.read_tables(PATH))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def streamed(tables, text, cuts, step=bpe.STEP, open_at=bpe.OPEN):
    encoder, out, at = bpe.Encoder(tables, step, open_at), [], 0
    while at < len(text):
        n = next(cuts)
        out += encoder.feed(text[at : at + n])
        at += n
    return out + encoder.finish()


def cuts(seed, most):
    rnd = random.Random(seed)
    while True:
        yield rnd.randint(1, most)


ODD = "aabbcdeésßΣİſ'’'' \n\t\x1c\x85 !?.,-<|>019²½éạ̸़̧̀́가ᄀ𝐀日本語のकड़😀ﬃ" + "ᪿ᷷\U00012560\U00011de3\U00011935\U00011930Ƛ\U00010d50Ⴀtrevmlld"
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|endof", "exhilarating", "'re", "'ve", "'ll", "the", "ing"]


@pytest.mark.parametrize("seed", range(8))
def test_any_cut_gives_the_ids_of_the_library(tables, library, seed):
    rnd = random.Random(seed)
    for _ in range(150):
        text = "".join(rnd.choice(PARTS) if rnd.random() < 0.15 else rnd.choice(ODD) for _ in range(rnd.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert streamed(tables, text, cuts(seed, 7), rnd.choice([33, 100]), rnd.choice([4, 10, 300])) == want, repr(text)
        decoder = bpe.Decoder(tables)
        parts = [decoder.feed(want[i : i + 3]) for i in range(0, len(want), 3)]
        assert "".join(parts) + decoder.finish() == library.decode(want, skip_special_tokens=False)


def test_every_character(tables, library):
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    encoder = bpe.Encoder(tables)
    for at in range(0, len(chars), 4000):
        text = " ".join(f"a{c}1{c}!" for c in chars[at : at + 4000])
        if encoder.feed(text) + encoder.finish() != library.encode(text, add_special_tokens=False).ids:
            wrong = [hex(ord(c)) for c in chars[at : at + 4000] if encoder.feed(f"a{c}1{c}!") + encoder.finish() != library.encode(f"a{c}1{c}!", add_special_tokens=False).ids]
            pytest.fail(f"{wrong}")
    marks = [c for c in chars if unicodedata.combining(c)]
    text = " ".join(f"á{c} ạ{c} a{c}ְ" for c in marks)
    assert encoder.feed(text) + encoder.finish() == library.encode(text, add_special_tokens=False).ids


def test_the_lookahead_suffices_for_long_words_and_a_short_one_does_not(tables, library):
    rnd = random.Random(3)
    parts = sorted(t for t in tables.tokens.values() if t.isascii() and t.isalpha() and t.islower())
    texts = ["".join(rnd.choice(parts) for _ in range(500)) for _ in range(40)] + ["a" * 5000, "exhilar" * 700]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [streamed(tables, t, cuts(1, 400), 40, 50) for t in texts] == want
    short = bpe.Tables(bpe.read_tables(PATH))
    short.lookahead = 4
    assert [streamed(short, t, cuts(1, 400), 40, 50) for t in texts] != want


def test_what_is_held_is_bounded(tables):
    encoder = bpe.Encoder(tables)
    for _ in range(300):
        encoder.feed("antidisestablishment" * 50)
        assert len(encoder.window) <= bpe.STEP + tables.lookahead + 1000 and len(encoder.held) <= bpe.OPEN and len(encoder.raw + encoder.loose) < 20
    encoder.memo.clear()
    for i in range(bpe.MEMO * 2 + 10):
        encoder.memo[f"{i:x}"]
    assert len(encoder.memo) <= bpe.MEMO and len(encoder.memo.before) <= bpe.MEMO


def test_merge_lists_that_are_not_proper_are_refused():
    text = bpe.read_tables(PATH)
    with pytest.raises(ValueError):
        bpe.Tables(text.replace('["i","n"]', '["in","n"]', 1) if '["i","n"]' in text else text.replace('"i n"', '"in n"', 1))
    with pytest.raises(ValueError):
        bpe.Tables(bpe.read_tables(P.path("byte_bpe_50k.json")))


def test_readable_text_round_trip(tables):
    encoder, decoder = bpe.Encoder(tables), bpe.Decoder(tables, readable=True)
    ids = encoder.feed("Größe, ÉTÉ 日本 it's 😀<|endoftext|>") + encoder.finish()
    parts = [decoder.feed([i]) for i in ids]
    assert "".join(parts) + decoder.finish() == "größe , été 日本 it 's 😀 <|endoftext|>"
    assert "�" not in "".join(parts)


def test_rows(spark, library):
    rows = [(1, "Hello the world", "x"), (None, None, None), (3, "", "x"), (1, "Hello the world", "x"), (5, "word " * 60_000 + "z" * 30_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.source, r.n_tokens, bpe.unpacked(r.ids).tolist()) for r in bpe.encode(docs, PATH).collect())
    want = sorted((i or 0, s, len(ids), ids) for i, t, s in rows for ids in [library.encode(t or "", add_special_tokens=False).ids])
    assert str(got) == str(want)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(library.decode(w[3], skip_special_tokens=False) for w in want)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("ids", F.lit(1)), PATH)
    named = bpe.encode(docs.withColumn("ids", F.lit(1)), PATH, ids="packed")
    assert named.columns == ["doc_id", "source", "ids", "packed", "n_tokens"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_query(spark, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in table(spark, DATA, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(library.decode(ids, skip_special_tokens=False).encode())))
    got = queries.op11_bpe(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
