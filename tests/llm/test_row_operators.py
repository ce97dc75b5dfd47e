"""Operators that read one text at a time: patterns and formats against plain versions, and awkward rows."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangekeep.llm import ogg, pii, quality, secrets, spiece, toxicity, warc

from .helpers import LONG, awkward, clashing, empty, rows_of

# -- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


PIECES = ["token", "Secret", "API_KEY", "apikey", "passwd", "=", ":", " ", '"', "'", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "é", ".", "x9", "\n"]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_secret_patterns(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == plain_secrets(text)


def test_entropy():
    def slow(s, n=secrets.WINDOW):
        n = min(n, len(s))
        return max(-sum(c / n * math.log2(c / n) for c in Counter(s[i : i + n]).values()) for i in range(len(s) - n + 1))

    r = random.Random(1)
    for _ in range(50):
        s = "".join(r.choice("abcdef0123") for _ in range(r.randint(1, 60)))
        assert abs(secrets.peak_entropy(s) - slow(s)) < 1e-9
    many = [("hex", i * 60, i * 60 + 30) for i in range(8000)]
    text = ("a" * 30 + " Zm9vYmFyMTIzNDU2Nzg5MGFi ").ljust(60) * 8000
    assert len(secrets.entropy_spans(text, many)) == 8000 and secrets.entropy_spans(text, [("assign", 0, len(text))]) == []
    r = random.Random(4)
    for _ in range(200):
        text = " ".join(r.choice(["Zm9vYmFyMTIzNDU2Nzg5MGFi", "x", "Qm9vYmFyMTIzNDU2Nzg5MGFi9"]) for _ in range(6))
        taken = [("hex", a, a + r.randint(1, 30)) for a in (r.randrange(len(text)) for _ in range(r.randint(0, 4)))]
        assert secrets.entropy_spans(text, taken) == [s for s in secrets.entropy_spans(text) if not any(a < s[2] and s[1] < b for _, a, b in taken)]
    assert secrets.entropy_spans("x Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZkFC9 y") == [("entropy", 2, 35)]
    for clear in ("550e8400-e29b-41d4-a716-446655440000", "thonertionedandtheotherthing", "00000000000000000000000a", "some-words-and-2024-more-words"):
        assert secrets.entropy_spans(clear) == []


def test_secret_rows(spark):
    got = secrets.detect(clashing(spark))
    assert got.count() == 10 and got.filter("n_assign + n_access + n_hex > 0").count() == 0
    assert secrets.detect(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, 'set token = "deadbeefdeadbeefdeadbeefdead" now')], "doc_id long, text string")
    row = secrets.detect(one).first()
    assert (row.n_assign, row.n_hex) == (1, 1)
    base = "assign:4:41,hex:13:41"
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and row.spans == base
    assert secrets.redact(one).first()["text"] == 'set <assign>" now'
    assert secrets.redact(awkward(spark)).filter("text is null").count() == 1


# -- personal data


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return out


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", "b@c.d", "@", ".", "1", "255", "256", "+1", "(", "4", " ", "-", "é", "1.2.3.4", "4111111111111111", "x.y@z"]), max_size=14))
def test_pii_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_pii(text)


@pytest.fixture(scope="module")
def tagger():
    tagger = pii.Tagger()
    loss = tagger.train(pii.labelled_windows(["the of and to in that is was he for it with as his on be at by "] * 3, n=1500), 160)
    assert loss < 0.2
    return tagger


def test_tagger_gradient():
    import numpy as np

    tagger = pii.Tagger()
    made = pii.labelled_windows(["some words"], n=2)
    x, y = (np.stack([m[j] for m in made], axis=1)[:10] for j in (0, 1))
    y = np.zeros_like(y)
    _, g = tagger.loss(x, y)
    for name in ("T", "O", "Uf", "Wb", "E"):
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was, sides = tagger.p[name][i], []
        for step in (0.01, -0.01):
            tagger.p[name][i] = was + step
            sides.append(tagger.loss(x, y)[0])
        tagger.p[name][i] = was
        assert abs((sides[0] - sides[1]) / 0.02 * 10 - g[name][i]) < 0.02 * max(1, abs(g[name][i]))


def test_tagger_finds_forms(tagger):
    r, found, total = random.Random(5), 0, 0
    for _ in range(150):
        kind, form = pii.made_up(r)
        text = "the of and to in that " * 4 + form + " is was he for it " * 4
        base = pii.base_spans(text)
        if base:
            continue
        total += 1
        found += any(k == kind for k, _, _ in pii.tag_texts(tagger, [text], [base])[0])
    assert total > 30 and found / total > 0.7
    assert pii.tag_texts(tagger, ["plain words without any digit, " * 50], [[]]) == [[]]


def test_pii_reads_all_that_may_be_a_form():
    for form in ("john at example dot com", "jane AT example dot org", "jane [ at ] example [ . ] org", "jo[  at  ]x[.]org", "jo\tat\tx dot de"):
        assert pii.reads_as("email", form) and pii.needed("plain words " + form, [])
    r = random.Random(2)
    parts = ["at", "AT", "At", "dot", "DOT", "[", "]", "(", ")", " ", "  ", "\n", "@", ".", "jo", "x", "com", "7", "_", "é", "-"]
    read = 0
    for _ in range(400_000):
        s = "".join(r.choice(parts) for _ in range(r.randint(3, 9)))
        if any(pii.reads_as(k, s) for k in pii.KINDS):
            read += 1
            assert pii.TRIGGER.search(s), s
    assert read > 100


def test_tagger_finds_bare_forms(tagger):
    forms = ["john at example dot com", "jane AT example dot org", "maria [ at ] example [ . ] org", "peter at network dot de"]
    texts = ["the of and to in that " * 4 + f + " is was he for it " * 4 for f in forms]
    assert sum(any(k == "email" for k, _, _ in found) for found in pii.tag_texts(tagger, texts, [[]] * len(texts))) >= 2


def plain_tags(tagger, text):
    """All windows of a text, one by one; one Viterbi pass over all of it."""
    import numpy as np

    ids, T = pii.char_ids(text), len(pii.TAGS)
    total, mass = np.zeros((len(ids), T)), np.full((len(ids), 1), 1e-6)
    for at in range(0, len(ids), pii.STRIDE):
        part = ids[at : at + pii.WINDOW]
        x = np.full((pii.WINDOW, 1), 32)
        x[: len(part), 0] = part
        for j, e in enumerate(tagger.emissions(x)[: len(part), 0]):
            w = 1 - abs(j - (pii.WINDOW - 1) / 2) / (pii.WINDOW / 2)
            total[at + j] += e * w
            mass[at + j] += w
    e = total / mass
    best = {t: (e[0][t] - 1e4 * (pii.TAGS[t][0] == "I"), [t]) for t in range(T)}
    for row in e[1:]:
        step = {}
        for t in range(T):
            s, f = max((best[f][0] + tagger.p["T"][f, t] + tagger.forbidden[f, t], -f) for f in range(T))
            step[t] = (s + row[t], [*best[-f][1], t])
        best = step
    tags, found, start = [*max(best.values())[1], 0], [], None
    for j, t in enumerate(tags):
        if start is not None and pii.TAGS[t][0] != "I":
            found += pii.within(pii.TAGS[tags[start]][2:], text, start, j)
            start = None
        if pii.TAGS[t][0] == "B":
            start = j
    return pii.apart(found, pii.base_spans(text))


def test_tagging_against_a_plain_version(tagger, monkeypatch):
    """Windows without a trigger, batches of windows and of stretches change nothing."""
    monkeypatch.setattr(pii, "GROUP", 7)
    monkeypatch.setattr(pii, "DECODE", 900)
    r, texts = random.Random(12), ["", "x", "7"]
    for _ in range(40):
        parts = ["the of and to in that is was he for it "[: r.randint(5, 39)] * r.randint(1, 9) for _ in range(3)]
        texts.append(parts[0] + pii.made_up(r)[1] + parts[1] + r.choice([pii.made_up(r)[1], pii.distractor(r), ""]) + parts[2])
    got = pii.tag_texts(tagger, texts, [pii.base_spans(t) for t in texts])
    want = [plain_tags(tagger, t) if t else [] for t in texts]
    assert got == want and sum(map(bool, want)) > 10


def test_viterbi_of_lanes():
    import numpy as np

    tagger = pii.Tagger()
    r = np.random.default_rng(1)
    tagger.p["T"] = r.standard_normal(tagger.p["T"].shape).astype(np.float32)
    lengths = np.array([9, 6, 6, 2, 1])
    e = r.standard_normal((9, 5, len(pii.TAGS))).astype(np.float32)
    both = tagger.viterbi(e, lengths)
    for k, n in enumerate(lengths):
        assert both[:n, k].tolist() == tagger.viterbi(e[:n, k : k + 1], np.array([n]))[:, 0].tolist() and not both[n:, k].any()


def test_any_number_of_digits():
    for text in ("1.2.3." + "0" * 5000, "1.2.3." + "9" * 5000, "9" * 5000, "+" + "9" * 5000, "1 " * 5000, "a@" + "9" * 5000 + ".x", "0" * 5000 + "255.0.0.1"):
        base = pii.base_spans(text)
        pii.within("card", text, 0, len(text))
        assert [k for k, _, _ in base] == (["ip"] if text.startswith(("1.2.3.0", "000")) else ["email"] if "@" in text else [])
    assert pii.within("card", "4111 1111 1111 1111 and 5500-0000-0000-0004", 0, 43) == [("card", 0, 19), ("card", 24, 43)]
    two = "a at b dot c or " * 9 + "x (at) y.org"
    assert len(pii.within("email", two, 0, len(two))) == 10


def test_pii_rows(spark, tagger):
    got = pii.detect(clashing(spark), tagger=tagger)
    assert got.count() == 10 and got.select(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0
    assert pii.detect(empty(spark), tagger=tagger).count() == 0
    text = "mail me@x.org or 10.0.0.1 or +1 (555) 123-4567 or 4111 1111 1111 1111."
    row = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), tagger=tagger).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert row.spans.startswith("email:5:13,ip:17:25,card:")
    assert pii.fit(empty(spark), steps=2) is not None


# -- Ogg


def test_ogg_checksum():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    data = bytes(range(256)) * 3
    assert ogg.page_crc(data) == slow(data)


@pytest.mark.parametrize("n", [0, 1, 64, 255, 4080, 4081, 65025, 70000, 300000])
def test_ogg_round_trip(n):
    payload = ogg.pad(random.Random(n).randbytes(n))
    assert len(payload) % 64 == 0 and payload
    media = ogg.encode(payload)
    read = ogg.decode(media)
    assert read["payload"] == payload and read["streams"] == 2 and read["times"][-1] == len(payload) / ogg.RATE
    for at in (30, len(media) // 2, len(media) - 1):
        broken = media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :]
        with pytest.raises(ogg.OggError):
            ogg.decode(broken)
    with pytest.raises(ogg.OggError):
        ogg.decode(media[:-1])


def test_ogg_order_of_pages():
    media = ogg.encode(ogg.pad(random.Random(1).randbytes(200_000)))
    starts = [m.start() for m in re.finditer(b"OggS\x00", media)] + [len(media)]
    pages = [media[a:b] for a, b in zip(starts, starts[1:])]
    assert b"".join(pages) == media and len(pages) > 5
    with pytest.raises(ogg.OggError):
        ogg.decode(b"".join([*pages[:-3], pages[-2], pages[-3], pages[-1]]))
    with pytest.raises(ogg.OggError):
        ogg.decode(b"".join(pages[:2] + pages[3:]))


def test_ogg_rows(spark):
    got = ogg.digest(clashing(spark)).collect()
    assert len(got) == 10 and ogg.digest(empty(spark)).count() == 0
    by = {}
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: r.n_bytes), sorted(awkward(spark).collect(), key=lambda r: len((r.text or "").encode()))):
        raw = ogg.pad((t or "").encode())
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(raw))
        assert by.setdefault(r.payload_sha256, r.media_sha256) == r.media_sha256
    assert {r.tail_crc32 for r in got if r.n_bytes == 0} == {zlib.crc32(bytes(64))}


# -- WARC


def test_chunks():
    for n in (0, 1, 4096, 4097, 20000):
        data = random.Random(n).randbytes(n)
        assert warc.unchunk(warc.chunked(data)) == data
    assert warc.unchunk(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc"):
        with pytest.raises(warc.WarcError):
            warc.unchunk(bad)


def test_warc_rows(spark):
    big = "é<p>" * 60_000
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "u\r\nv", ""), (5, "http://c/", big), (6, "http://d/", big), (7, "e", "y"),
            (7, "e", "y"), (None, "f", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("sha", F.lit("own"))
    got = {(r.page_id, r.record_type): r for r in warc.round_trip(pages).collect()}
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    for i, _, html in rows:
        ids = [x for x in groups[html or ""] if x is not None]
        last = max(ids) if ids else None
        r = got[i, "response" if i == last else "revisit"]
        raw = (html or "").encode()
        assert r.payload_bytes == len(raw) and r.refers_to == (None if i == last else last)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert warc.round_trip(pages).count() == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0
    least = {r.page_id: r.record_type for r in warc.round_trip(pages, least=10).collect()}
    assert least[1] == "response" and least[5] == "revisit"


def test_warc_segments_out_of_order(spark):
    payload = random.Random(1).randbytes(100_000).hex().encode()
    records = list(warc.page_records("a", 9, "http://x/", payload, None))
    assert len(records) > 3
    random.Random(2).shuffle(records)
    def archives(rs):
        return spark.createDataFrame([(bytearray(r),) for r in rs], "data binary")
    row = warc.read(archives(records), payloads=True).first()
    assert bytes(row.payload) == payload and row.page_id == 9
    for bad in (records[:-1], [*records, records[0]]):
        with pytest.raises(Exception, match="segment|total|HTTP"):
            warc.read(archives(bad)).collect()


# -- SentencePiece

needs_model = pytest.mark.skipif(not os.path.exists(spiece.MODEL), reason="no model file")


@needs_model
def test_parity():
    with open(spiece.MODEL, "rb") as f:
        codec = spiece.Codec(f.read())
    texts = ["", " ", "a", "two  spaces", "a   b    c     d", "tab\tnew\n\nline", "▁mark▁▁", "日本語 émoji 🎉 x", "          ten", "</s><s><unk> <0x41>",
             " lead", "trail  ", "a" + " " * 33 + "b", "x" * 3000, LONG[:5000]]
    r = random.Random(3)
    texts += ["".join(r.choice("ab é▁ \n.T日") for _ in range(r.randint(0, 40))) for _ in range(500)]
    ids = codec.encode(texts)
    assert ids == codec.slow.encode(texts)
    assert codec.decode(ids) == codec.slow.decode(ids)


@needs_model
def test_parity_is_verified_for_all_texts(monkeypatch):
    with open(spiece.MODEL, "rb") as f:
        codec = spiece.Codec(f.read())
    seen, verified = set(), codec.verified
    monkeypatch.setattr(codec, "verified", lambda texts, packed: seen.update(texts) or verified(texts, packed))
    texts = ["some plain words", "two  spaces and ▁marks", "words again", "", " lead"]
    codec.encode(texts)
    assert {"some", "plain", "words", "again"} <= seen and texts[1] in seen
    codec.slow = type("Other", (), {"encode": lambda self, texts, num_threads: [[7]] * len(texts)})()
    assert codec.encode(["some words"])  # known ones are verified already
    for text in ("unseen", "two  spaces"):
        with pytest.raises(ValueError, match="differ"):
            codec.encode([text])


@needs_model
def test_words_are_decoded_once_and_texts_are_as_if_decoded_whole(monkeypatch):
    with open(spiece.MODEL, "rb") as f:
        codec = spiece.Codec(f.read())
    r = random.Random(5)
    texts = ["", " ", "two  spaces", " lead", "trail  ", "▁mark▁▁", "日本語 🎉🎉 \ufffd x", "</s> <unk> <0x41><0xE6> <0x41>", "\x00 \x7f\t\n", LONG[:5000]]
    texts += ["".join(r.choice("ab é▁ \n.T日🎉<") for _ in range(r.randint(0, 40))) for _ in range(500)]
    ids, backs = codec.round_trip(texts)
    assert codec.apart and ids == codec.encode_bytes(texts)
    lists = [np.frombuffer(x, "<i4").tolist() for x in ids]
    assert lists == codec.slow.encode(texts) and backs == codec.decode(lists)
    sent, decode = [], codec.decode
    monkeypatch.setattr(codec, "decode", lambda ids: sent.extend(ids) or decode(ids))
    assert codec.round_trip(texts) == (ids, backs) and not sent
    assert codec.round_trip(["two newwords two newwords", "newwords"])[1] == ["two newwords two newwords", "newwords"]
    assert len(sent) == 2  # words, of five
    for size in (3, 60, 400, 1500):  # words are let go and learned anew
        monkeypatch.setattr(codec, "CACHE", size)
        for at in range(0, len(texts), 7):
            assert codec.round_trip(texts[at : at + 7]) == (ids[at : at + 7], backs[at : at + 7])
            assert codec.known.keys() == codec.backs.keys() and codec.again <= codec.known.keys()
    codec.CACHE = 10
    codec.known, codec.backs, codec.odd, codec.again = {}, {}, set(), set()
    for batch in ("a b", "a c", "d e f g h i j", "k"):
        codec.round_trip([batch])
    assert codec.known.keys() == {"a", "k"}  # a came twice, so it stayed when the others went


def field(number, kind, value):
    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])
    if kind == 0:
        return varint(number << 3) + varint(value)
    if kind == 5:
        import struct
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)],
              ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("▁ab", -3.1, 1), ("ab", -3.5, 1), ("aba", -4.0, 1)]
    body = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, s) + field(3, 0, k)) for p, s, k in pieces)
    data = body + field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity"))
    codec = spiece.Codec(data)
    r = random.Random(1)
    texts = ["".join(r.choice("ab é") for _ in range(r.randint(0, 20))) for _ in range(200)]
    assert codec.encode(texts) == codec.slow.encode(texts)


def test_texts_are_decoded_whole_where_words_run_into_each_other():
    """Without a piece for the marker, its bytes and those of the word before it are decoded in one run."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], ("a", -2.0, 1), ("b", -2.5, 1)]
    body = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, s) + field(3, 0, k)) for p, s, k in pieces)
    codec = spiece.Codec(body + field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity")))
    texts = ["a é b", "é é", "", "ab a"]
    ids, backs = codec.round_trip(texts)
    assert not codec.apart and backs == codec.decode([np.frombuffer(x, "<i4").tolist() for x in ids])


@needs_model
def test_spiece_rows(spark):
    got = spiece.encode(clashing(spark), with_ids=True)
    rows = got.collect()
    assert len(rows) == 10 and all(r.round_trip for r in rows) and spiece.encode(empty(spark)).count() == 0
    assert [r.n_tokens for r in rows if r.n_bytes == 0] == [0, 0]
    back = spiece.decode(got.select("doc_id", "ids"))
    assert rows_of(back.select("text")) == rows_of(awkward(spark).select(F.coalesce("text", F.lit(""))))


# -- classifiers


def labelled(spark, good, bad, label, n=120):
    r = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        y = i % 3 != 0
        docs.append((i, good(r) if y else bad(r)))
        labels.append((i, int(y), int(y)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def words(r, n=40):
    return " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(1, 8))) for _ in range(n))


def test_quality(spark):
    docs, labels = labelled(spark, words, lambda r: (words(r, 3).upper() + "!! ") * 12, "quality")
    labels = labels.union(spark.createDataFrame([(0, 1, 1), (500, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    got = quality.classify(docs, labels).collect()
    assert len(got) == 120 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)
    rows = quality.classify(clashing(spark), labels).collect()
    assert len(rows) == 10 and all(r.score is not None for r in rows)
    assert quality.classify(empty(spark), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    model = quality.fit(docs, labels)
    twice = docs.union(docs.filter("doc_id < 9").withColumn("text", F.concat(F.lit("~"), "text")))  # texts that share a labelled id
    assert {k: np.round(v, 9).tolist() for k, v in model.items() if k != "classes"} == {
        k: np.round(v, 9).tolist() for k, v in quality.fit(twice, labels).items() if k != "classes"}
    kept = quality.keep_good(docs.withColumn("Quality_Score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "Quality_Score"] and rows_of(kept, "doc_id") == sorted(((r.doc_id,) for r in got if r.predicted), key=repr)


def test_discriminant_against_a_plain_version():
    """Density differences by determinants and inverses alone."""
    r = np.random.default_rng(5)
    n = len(quality.NAMES)
    sides = [r.standard_normal((60, n)) * r.uniform(0.5, 2, n) + r.uniform(-1, 1, n) for _ in range(2)]
    pooled = sum(x.var(axis=0) for x in sides) / 2
    model = {"centre": r.standard_normal(n), "scale": r.uniform(1, 2, n), "classes": [quality.gaussian(x, pooled, 0.1) for x in sides], "prior": 0.3}
    stats = r.standard_normal((30, n)) * 3
    logs = []
    for x in sides:
        cov = 0.9 * np.cov(x.T, bias=True) + 0.1 * np.diag(pooled) + 1e-6 * np.eye(n)
        d = (stats - model["centre"]) / model["scale"] - x.mean(axis=0)
        logs.append([-0.5 * (v @ np.linalg.inv(cov) @ v + math.log(np.linalg.det(cov))) for v in d])
    want = [1 / (1 + math.exp(a - b - 0.3)) for a, b in zip(*logs)]
    assert np.allclose(quality.probabilities(model, stats), want, rtol=1e-6)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(deadline=None, max_examples=500)
@given(st.text("abcx", max_size=11))
def test_automaton(token):
    terms = ["abba", "abcab", "cabbage", "aabbccab", "bcbcbcbca"]
    near = toxicity.Trie(terms).near(token)
    want = min(((d, t) for t in terms if (d := lev(token, t)) <= toxicity.edits(t)), default=None)
    assert near == (None if want is None else (want[1], want[0]))


@settings(deadline=None, max_examples=300)
@given(st.text("abcx", max_size=11))
def test_automaton_of_stems(token):
    terms = ["abba*", "abcabbca*", "bcbcbcbc*"]
    near = toxicity.Trie(terms).near(token)
    want = min(((d, t) for t in terms if (d := min(lev(token[:i], t[:-1]) for i in range(len(token) + 1))) <= toxicity.edits(t)), default=None)
    assert near == (None if want is None else (want[1], want[0]))


def test_lexicon_keeps_words_and_distinct_stems(spark):
    r = random.Random(2)
    forms = ["schwachlich", "schwachliche", "schwachlichen", "schwachlicher"]
    rows = [(i, words(r, 9) + (f" {r.choice(forms)} {words(r, 3)} {r.choice(forms)}" if i % 2 else ""), i % 2) for i in range(200)]
    terms, _ = toxicity.lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int"), 100, 100)
    assert len(terms) == len(set(terms)) and {*forms} <= {*terms} and any(t.startswith("schwach") and t.endswith("*") for t in terms)
    finder = toxicity.Finder(terms, frozenset())
    assert [h[3] > 0 for h in finder.hits("schwahclich schwaclichen schwachlich")[1]] == [True, True, False]


def test_score_is_the_regression_of_the_hits(spark):
    """op8's score from plain parts: hits by edit distance, weights by context, the logistic function."""
    model = {"terms": ["idiot", "pathetic"], "clean": frozenset({"idiom"}), "weights": [1.5, 2.0, 0.5, 1.0, -2.0]}
    texts = ["", "You idiit, what a pathetic idiom", 'they said "an idiot" once', "İİ idiot", "plain words"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", toxicity.score(F.col("text"), model).alias("s")).orderBy("i").collect()]
    for text, row in zip(texts, got):
        low, ws, spans = toxicity.lowered(text), [], []
        for m in re.finditer(r"[^\W_]+", low):
            near = min(((lev(m[0], t), t) for t in model["terms"] if lev(m[0], t) <= toxicity.edits(t)), default=None)
            if near and m[0] not in model["clean"]:
                ws.append(toxicity.weight(low, *m.span(), near[0]))
                spans.append(f"{near[1]}:{m.start()}:{m.end()}")
        n = len(re.findall(r"[^\W_]+", low))
        x = [math.log1p(sum(ws)), math.sqrt(sum(ws) / max(1, n)), math.log1p(len({s.split(":")[0] for s in spans})), min(1.0, max(ws, default=0.0)), 1.0]
        assert abs(row.score - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model["weights"]))))) < 1e-9
        assert row.spans == ",".join(spans) and len(low) == len(text)


def test_toxicity_hits():
    finder = toxicity.Finder(["idiot", "pathetic", "lowei*"], frozenset({"idiom"}))
    assert [h[2:] for h in finder.hits(toxicity.lowered("You IDI0T, idiit pathetiic idiom loweichen"))[1]] == [("idiot", 1), ("idiot", 1), ("pathetic", 1), ("lowei*", 0)]
    quoted, plain = 'they said "an idiot" once', "what an idiot once"
    at = quoted.index("idiot")
    assert toxicity.weight(quoted, at, at + 5, 0) < toxicity.weight(plain, plain.index("idiot"), plain.index("idiot") + 5, 0)


def test_toxicity(spark):
    bad = ["zwackel", "grumpfig", "blorrt"]
    docs, labels = labelled(spark, lambda r: words(r, 15) + f" {r.choice(bad)} " + words(r, 15) + f" {r.choice(bad)} " + words(r, 5), words, "toxic", 240)
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 240 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) >= 0.9 * len(held)
    rows = toxicity.classify(clashing(spark), labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(empty(spark), labels).count() == 0
