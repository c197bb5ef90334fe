import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import license_scan, line_dedup, pii, secret_scan, url_filter

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def brute_pii(text):
    text = text or ""
    spans = [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]
    spans.sort(key=lambda s: (s[1], list(PLAIN).index(s[0])))
    return spans


def as_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PIECES = ["a.b@c.d", "@x.y", "a@b.c_x@y.z", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.0.0.1", "4785380592391139", "4785 3805-9239 1139", "4785  3805", "+1 (743) 555-3824", "+12", "+1234567890123456", "é", "😀", " ", "-", "12", "x", "0000000000000", "a@b", "a@b..c", "+1 ((((", "\n", "743-555-3824", "123-45-6789", "call Maria Lopez", "me at host dot com", "mail ", "version "]


def pii_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    return texts + [None, "", "a" * 60_000, "1" * 30_000 + ".", "1." * 20_000, "a@" + "b." * 20_000, "a@b.c " * 800, "+1 " * 9000]


def test_pii_base_spans(spark):
    texts = pii_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_pii(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(as_text(want).encode()).hexdigest(), (t or "")[:80]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in PLAIN)
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in PLAIN] == [f"{k}:{a}:{b}" for k, a, b in want]
        assert len(spans) == len(want) + r.n_added


def test_pii_adds_spans(spark):
    rows = [(i, f"please call {c} 743-555-38{i:02d} or mail joe at host{i} dot com, dear Maria Lopez.") for i, c in enumerate(["me on"] * 60)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kinds = {s.split(":")[0] for r in got for s in r.spans.split(",") if s}
    assert {"local", "spelled", "name"} <= kinds


def test_pii_cues_are_words_and_hold_for_lists(spark):
    rows = [(0, "hotel border baby 10.0.0.1"), (1, "mail: a@b.com, c@d.org and e@f.net; g@h.de"), (2, "version 1.2.3.4"), (3, "server 10.0.0.1 said 10.0.0.2")]
    found = pii.matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cues = {r.doc_id: [s.cue for s in r.base] for r in found}
    assert cues == {0: [0], 1: [1, 1, 1, 1], 2: [2], 3: [1, 0]}


def test_loose_spans_that_meet_strict_ones_are_left_out(spark):
    rng = random.Random(5)
    pieces = ["743-555-3824", "+1 743-555-3824", "123-45-6789", "4785 3805-9239 1139", "Maria Lopez", "a.b@c.d", " ", ", ", "x"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    for r in pii.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        loose = [(k, *m.span()) for k, p in pii.LOOSE.items() for m in re.finditer(p, texts[r.doc_id])]
        base = [s[1:] for s in brute_pii(texts[r.doc_id])]
        want = sorted(s for s in loose if not any(a < s[2] and s[1] < b for a, b in base))
        assert sorted((pii.KINDS[s.kind], s.start, s.end) for s in r.loose) == want, texts[r.doc_id]


def test_pii_of_a_log_takes_near_linear_time(spark):
    text = "server " + " ".join(f"10.{i // 65536}.{i // 256 % 256}.{i % 256}" for i in range(100_000))
    began = time.time()
    assert pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_ip == 100_000
    assert time.time() - began < 60


def test_pii_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_em_separates_reliable_patterns():
    soft = pii.estimate({(0, 1, 1, 1, 1): 100, (0, 0, 0, 0, 0): 80, (0, 1, -1, -1, 1): 50})
    assert soft[(0, 1, 1, 1, 1)] > 0.9 and soft[(0, 0, 0, 0, 0)] < 0.1


SECRET_PLAIN = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute_secrets(text):
    out = []
    for kind, pattern in SECRET_PLAIN.items():
        for m in pattern.finditer(text or ""):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(SECRET_PLAIN).index(s[0])))


def test_secret_base_spans(spark):
    rng = random.Random(2)
    pieces = ["token", "SECRET", "secreſt", " = ", ":", '"', "'", "api_key", "apikey", "abcdef012345", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "g", "é", "\n", " ", "password=", "x.y/z+w", "%41", "\\u0041"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 16))) for _ in range(400)] + [None, "", "f" * 50_000, "token " * 9000, "AKIA" * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in secret_scan.find(df).collect()}
    for i, t in enumerate(texts):
        want = brute_secrets(t)
        assert got[i].base_sha256 == hashlib.sha256(as_text(want).encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[0] == k for s in want) for k in SECRET_PLAIN)
        assert not want or set(as_text(want).split(",")) <= set(got[i].spans.split(","))


WRAPPERS = {
    "url": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(sorted(WRAPPERS)), min_size=1, max_size=4), st.text(alphabet="xyz é", max_size=20))
def test_secret_layers_round_trip(chain, around):
    secret = "password=Zx9kLmN0pQrStUv"
    wrapped = secret
    for name in chain:
        wrapped = WRAPPERS[name](wrapped)
    text = f"{around} {wrapped} {around}"
    found = secret_scan.hidden(text)
    a = len(around) + 1
    assert any(k.endswith("-assign") and s >= a and e <= a + len(wrapped) for k, s, e in found), found
    if chain[-1] in ("base64", "gzip"):
        assert any(k.endswith("-assign") and (s, e) == (a, a + len(wrapped)) for k, s, e in found)


def test_percent_layer_maps_to_exact_place():
    text = "é token%3Dabcdefghijklmnop end"
    assert secret_scan.hidden(text) == [("url-assign", 2, text.index(" end"))]


def test_decoding_ends_on_cycles_and_bombs(monkeypatch):
    assert secret_scan.hidden("%25" * 1000) == []
    monkeypatch.setattr(secret_scan, "LAYER_BYTES", 1000)
    bomb = base64.b64encode(zlib.compress(b"a" * 100_000)).decode()
    place = 2, 2 + len(bomb)  # its content is a run of hex digits, found since layers of any size are scanned
    assert sorted(secret_scan.hidden(f"x {bomb}")) == [("base64-opaque", *place), ("base64-zip-hex", *place)]


@pytest.mark.parametrize("wrap", sorted(WRAPPERS))
def test_repeated_layers_are_reported_at_each_place(wrap):
    token = WRAPPERS[wrap]("password=Zx9kLmN0pQrStUv")
    text = f"a {token} b {token}\n" * 3
    assert len({s[1:] for s in secret_scan.hidden(text) if s[0].endswith("-assign")}) == 6


def test_tokens_with_the_same_inner_text_are_reported_each():
    plain, packed = (WRAPPERS[w]("password=Zx9kLmN0pQrStUv") for w in ("base64", "gzip"))
    text = f"{plain} {packed} {WRAPPERS['base64'](plain)} {plain}"
    starts = [0, len(plain) + 1, len(plain) + len(packed) + 2, len(text) - len(plain)]
    assert sorted(a for k, a, _ in secret_scan.hidden(text) if k.endswith("-assign")) == starts


SECRET = "password=Zx9kLmN0pQrStUv"


@pytest.mark.parametrize("around", [45, 46, 200])
@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, zlib.compress])
def test_base64_over_lines(around, pack):
    body = base64.encodebytes(pack(("k" * around + f" {SECRET} tail").encode())).decode()
    for text in (f"see\n{body}\nend", f"{body.rstrip().rstrip('=')}\nword and more", body.replace("\n", "\r\n")):
        assert any(k.endswith("-assign") for k, _, _ in secret_scan.hidden(text)), text


def test_base64_over_lines_maps_to_the_lines():
    body = base64.encodebytes(("k" * 60 + f" {SECRET} tail").encode()).decode().rstrip()
    lines = body.split("\n")
    assert len(lines) == 2 and ("base64-assign", len(lines[0]) + 3, len(body) + 2) in secret_scan.hidden(f"a\n{body}\nb c")
    split = base64.encodebytes(("k" * 45 + f" {SECRET} tail").encode()).decode().rstrip()
    assert ("base64-assign", 2, len(split) + 2) in secret_scan.hidden(f"a\n{split}\nb c")


@pytest.mark.parametrize("wrap", ["base64", "gzip", "zlib"])
@pytest.mark.parametrize("before", ["https://h.example/path/x/", "a-b_c/", "x/", "/", "long-name-of-a-thing_"])
def test_base64_behind_other_characters(wrap, before):
    token = WRAPPERS[wrap](SECRET)
    for text in (before + token, before + token.rstrip("=") + "/x/y", f"{before}{token.rstrip('=')}Q"):
        found = [s for s in secret_scan.hidden(text) if s[0].endswith("-assign")]
        assert found and all(len(before) <= b and a <= len(before) + len(token) for _, a, b in found), text


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_all_members_are_read(pack):
    token = base64.b64encode(pack(b"first ") + pack(b"second ") + pack(SECRET.encode())).decode()
    assert any(k.endswith("-assign") for k, _, _ in secret_scan.hidden(f"x {token} y"))


def test_one_bad_byte_does_not_hide_a_run():
    run = WRAPPERS["url"](SECRET)
    for text in (f"{run}%FF", f"%FE{run}%ff%C3", f"%E2%82{run}"):
        assert any(k.endswith("url-assign") for k, _, _ in secret_scan.hidden(f"x {text} y")), text
    packed = base64.b64encode(gzip.compress(b"\xff\xfe" * 20 + SECRET.encode() + b"\xff")).decode()
    assert [k for k, _, _ in secret_scan.hidden(f"x {packed} y")] == ["base64-zip-assign"]
    lone = "\\ud800" + WRAPPERS["unicode"](SECRET)
    assert any(k == "unicode-assign" for k, _, _ in secret_scan.hidden(lone))


def test_settled_is_the_fixpoint_of_single_steps():
    rng = random.Random(3)
    parts = ["%", "25", "%25", "41", "\\u00", "\\", "u005c", "5c", "%5C", "u0025", "3D", "%C3%A9", "%FF", "é", "x", "longer text"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        layer = text
        while True:
            step = secret_scan.replaced(layer, secret_scan.PERCENT, secret_scan.unpercent) or secret_scan.replaced(layer, secret_scan.ESCAPE, secret_scan.unescape)
            if step is None:
                break
            layer = step[0]
        got, origin = secret_scan.settled(text)
        assert got.lower() == layer.lower(), text
        assert origin.span(0, len(got)) == (0, len(text)) or not got


@pytest.mark.parametrize("text", ["%" + "25" * 500_000 + "3D", "%3" * 400_000 + "5", "a%252b " * 140_000, "\\u005c" + "u005c" * 200_000])
def test_nested_escapes_take_linear_time(text):
    began = time.time()
    secret_scan.hidden(text)
    assert time.time() - began < 30


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, lambda b: gzip.compress(gzip.compress(b))])
def test_layers_of_any_size_are_scanned(monkeypatch, pack):
    monkeypatch.setattr(secret_scan, "LAYER_BYTES", 100_000)
    monkeypatch.setattr(secret_scan, "WINDOW_BYTES", 50_000)
    monkeypatch.setattr(secret_scan, "OVERLAP_BYTES", 1_000)
    inner = base64.b64encode(SECRET.encode()).decode()
    for place in (0, 49_990, 150_000, 399_000):
        for hidden in (SECRET, inner):
            data = b"a b " * (place // 4) + b" " + hidden.encode() + b" c d" * ((400_000 - place) // 4)
            token = base64.b64encode(pack(data)).decode()
            found = secret_scan.hidden(f"x {token} y")
            assert any(k.endswith("-assign") and (a, b) == (2, 2 + len(token)) for k, a, b in found), (place, found)
            assert any(k.endswith("-opaque") for k, _, _ in found)


def test_secret_empty(spark):
    assert secret_scan.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_rule(host, path, rules):
    fit = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, "allow")


@pytest.mark.parametrize("ranges", [1, 7])
def test_url_rules(spark, ranges):
    rng = random.Random(4)
    labels, words = ["a", "b", "co", "x-y", "com"], ["/", "/en", "/en/", "/en/7", "/de/8/x", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    rules = [(host(), rng.choice(words), rng.choice(["allow", "block"])) for _ in range(40)] + [("", "/en/7", "block")]
    urls = [f"http{rng.choice(['', 's'])}://{host().upper()}{rng.choice(words)}{rng.choice(['', '?q=://z/', '#f'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "://", "http://?x", "x://a.b?://c/", "http://com/en/7" + "9" * 5000] + ["http://hot.com/en/"] * 200
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, action string"), ranges=ranges).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h = re.match(r"[^/?#]*", rest)[0]
        p = re.match(r"[^?#]*", rest[len(h) :])[0]
        assert (got[i].host, got[i].path) == (h.lower(), p)
        assert (got[i].rule, got[i].verdict) == brute_rule(h.lower(), p, rules), u


def test_url_empty(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, rules).count() == 0
    one = spark.createDataFrame([(None, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(one, rules).collect()] == [(None, "a", "/b", None, "allow")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup(spark, limit):
    rows = [(i, f"own {i}\nmenu\n\nmenu", "s") for i in range(6)] + [(10, "menu\nrest", None), (11, None, "s"), (12, "menu " * 9000, "t")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.clean(df, min_pages=3, ratio=0.5, limit=limit).collect()}
    assert [(got[i].text, got[i].n_lines, got[i].n_dropped) for i in (0, 10, 11, 12)] == [("own 0\n", 4, 2), ("menu\nrest", 2, 0), ("", 1, 0), ("menu " * 9000, 1, 0)]
    assert line_dedup.clean(df.limit(0)).count() == 0


def brute_license(text, threshold):
    low = (text or "").encode().lower()
    words = license_scan.words_of(low.decode())
    places, base, found, score = [], set(), set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.encode().split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, template in license_scan.TEMPLATES:
        listed = license_scan.words_of(template)
        t, size = set(listed), license_scan.block_words(len(listed), threshold)
        if len(t & set(words)) < threshold * len(t) - 1e-9:
            continue
        share = max(len(t & set(words[i : i + size])) for i in range(max(1, len(words) - size + 1))) / len(t)
        if share >= threshold - 1e-9:
            found.add(label)
            score = max(score, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score


def test_notices_are_found_however_they_are_wrapped(spark):
    rng = random.Random(8)
    fill = " ".join(f"w{rng.randrange(900)}" for _ in range(400))
    rows = []
    for label, text in license_scan.TEMPLATES:
        for width, mark in ((40, "# "), (72, " * "), (10_000, "")):
            lines, line = [], ""
            for w in text.split():
                if len(line) + len(w) > width:
                    lines.append(mark + line)
                    line = ""
                line += w + " "
            rows.append((len(rows), f"{fill}\n" + "\n".join([*lines, mark + line]) + f"\n{fill}", label))
    scattered = " ".join(f"{w} {fill}" for w in "Released under the MIT License".split())
    rows.append((len(rows), scattered, ""))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    for i, _, label in rows[:-1]:
        assert label in got[i].labels.split(",") and got[i].score == 1.0
    assert (got[len(rows) - 1].labels, got[len(rows) - 1].score) == ("", 0.0)


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_license_join_is_exact(spark, threshold):
    rng = random.Random(6)
    vocabulary = sorted({w.decode() for _, t in license_scan.TEMPLATES for w in license_scan.words_of(t)}) + ["É", "x"]
    texts = []
    for _ in range(300):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(license_scan.TEMPLATES)[1].split() + rng.choices(vocabulary, k=rng.randrange(5))
            lines.append(" ".join(w for w in rng.sample(words, len(words)) if rng.random() < 0.9))
        texts.append("\n".join(lines))
    texts += [None, "", "MIT\nLicense", "mit-license apache license", "general public license " * 3000, "mit license", "mit license"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, labels int")
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(df, threshold=threshold).collect()}
    for i, t in enumerate(texts):
        want = brute_license(t, threshold)
        assert got[i][:-1] == want[:-1] and abs(got[i][-1] - want[-1]) < 1e-9, t
    assert license_scan.scan(df.limit(0)).count() == 0
