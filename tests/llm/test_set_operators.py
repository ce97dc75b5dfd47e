"""Operators over the whole corpus, against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rangekeep.llm import decontam, dedup, lm

from .helpers import awkward, clashing, empty, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def vocabulary(r, n=400):
    return ["".join(r.choice("abcdefghijklmnoprstué") for _ in range(r.randint(2, 9))) for _ in range(n)]


# -- near-duplicates


@pytest.fixture(scope="module")
def copies():
    """Texts with exact copies, near copies of all degrees, and a large group of near copies of one text."""
    r = random.Random(4)
    vocab = vocabulary(r)
    texts = [" ".join(r.choices(vocab, k=r.randint(1, 160))) for _ in range(120)]
    for i in range(60):
        w = texts[i].split()
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            k, at = r.choice("sid"), r.randrange(len(w))
            w[at : at + (k != "i")] = [] if k == "d" else [r.choice(vocab)]
        texts.append(" ".join(w))
    base = r.choices(vocab, k=150)
    for _ in range(90):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab) + "x"
        texts.append(" ".join(w))
    texts += texts[:20] + [texts[0]] * 30
    r.shuffle(texts)
    return list(enumerate(texts))


def brute_links(rows):
    by = {t: dedup.labelled_shingles(np.array([int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little") for w in words(t)], np.uint64))
          for _, t in rows}
    keys = sorted(by)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if dedup.similarity(by[a], by[b]) >= dedup.THRESHOLD}


def brute_classes(rows, links):
    root = {t: t for _, t in rows}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in links:
        root[find(a)] = find(b)
    classes = {}
    for i, t in rows:
        classes.setdefault(find(t), []).append(i)
    return {i: min(ids) for ids in classes.values() for i in ids}


def test_alignment():
    def exact(a, b):  # longest common subsequence of labelled shingles
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1] / (len(a) + len(b) - row[-1])

    r = random.Random(2)
    for _ in range(200):
        a = [r.randint(0, 30) for _ in range(r.randint(1, 60))]
        b = list(a)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 2)] = [r.randint(0, 30)] * r.randint(0, 2)
        x, y = (dedup.labelled_shingles(np.array(s, np.uint64)) for s in (a, b))
        if min(len(x), len(y)) == 0:
            continue
        got, want = dedup.similarity(x, y), exact(x.tolist(), y.tolist())
        assert got <= want + 1e-9 and (want < 0.8 or abs(got - want) < 1e-9)
    assert len(set(dedup.labelled_shingles(np.zeros(50, np.uint64)).tolist())) == 46


def test_near_duplicates(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    links = brute_links(copies)
    want = brute_classes(copies, links)
    rows = dedup.classes(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] for r in rows)
    kept = dedup.keep_one(docs.withColumn("gone", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "gone"] and rows_of(kept, "doc_id") == sorted(((i,) for i in set(want.values())), key=repr)


def test_pairs_in_small_buckets_are_all_found(spark):
    r = random.Random(9)
    vocab = vocabulary(r)
    rows = []
    for g in range(40):
        base = r.choices(vocab, k=120)
        for _ in range(3):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(vocab) + "q"
            rows.append((len(rows), " ".join(w)))
    got = {(bytes(x.a), bytes(x.b)) for x in dedup.links(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    key = lambda t: hashlib.md5(t.encode()).digest()
    want = {tuple(sorted((key(a), key(b)))) for a, b in brute_links(rows)}
    assert got == want


def test_links_of_short_texts_are_exact(spark):
    r = random.Random(4)
    vocab = vocabulary(r)
    made = []
    for n in (8, 9, 10, 12, 16):
        for _ in range(12):
            w = r.choices(vocab, k=n)
            made += [w, [*w, r.choice(vocab)], [r.choice(vocab), *w]]
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    links = dedup.links(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    key = lambda t: hashlib.md5(t.encode()).digest()
    want = {tuple(sorted((key(a), key(b)))) for a, b in brute_links(rows)}
    assert len(want) >= 120 and {(bytes(x.a), bytes(x.b)) for x in links} == want


def test_classes_of_large_groups_are_whole(spark):
    r = random.Random(21)
    vocab = vocabulary(r)
    def edited(w, n):
        w = list(w)
        for at in r.sample(range(len(w)), n):
            w[at] = r.choice(vocab) + "q"
        return w

    base = r.choices(vocab, k=150)
    near = [base] + [edited(base, 2) for _ in range(150)]
    made = near + [edited(w, 3) for w in near[1:]]  # the last are near those they come from alone
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    want = brute_classes(rows, brute_links(rows))
    got = dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: x.class_id for x in got} == want


@pytest.mark.parametrize("size", [400, 700, 2000])
def test_classes_of_hot_groups_are_whole(spark, size, monkeypatch):
    """Up to 4 edits: some texts are near few others alone, and some near none."""
    r = random.Random(size)
    vocab = vocabulary(r)
    base = r.choices(vocab, k=150)
    made = [base, r.choices(vocab, k=90)]
    while len(made) < size:
        w = list(base)
        for at in r.sample(range(len(w)), r.randint(1, 4)):
            w[at] = r.choice(vocab) + "q"
        made.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    by = [dedup.labelled_shingles(np.array([int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little") for w in ws], np.uint64)) for ws in made]
    near = np.argwhere(np.triu(dedup.shared_shingles(by, by) * 1.8 >= 0.8 * np.add.outer(*[[len(x) for x in by]] * 2) - 1e-6, 1))
    want = brute_classes(rows, [(rows[i][1], rows[j][1]) for i, j in near if dedup.similarity(by[i], by[j]) >= dedup.THRESHOLD])
    assert len(set(want.values())) > 2
    monkeypatch.setattr(dedup, "BLOCK_TEXTS", 100)
    got = dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: x.class_id for x in got} == want


def test_shared_shingles(monkeypatch):
    r = np.random.default_rng(3)
    left, right = ([r.choice(300, size=r.integers(0, 90), replace=False).astype(np.uint64) for _ in range(20)] for _ in range(2))
    monkeypatch.setattr(dedup, "COLUMNS", 37)
    assert dedup.shared_shingles(left, right).tolist() == [[len({*x.tolist()} & {*y.tolist()}) for y in right] for x in left]
    assert dedup.shared_shingles([], right).shape == (0, 20) and not dedup.shared_shingles([left[0][:0]], right).any()


def test_rows_that_share_an_id_are_judged_each_for_itself(spark):
    long = [" ".join(vocabulary(random.Random(k), 60)) for k in range(3)]
    docs = spark.createDataFrame([(1, long[0]), (1, long[1]), (2, long[0]), (3, long[1]), (3, long[2]), (3, long[2]), (4, None), (4, "")], "doc_id long, text string")
    kept = sorted(((x.doc_id, x.text or "") for x in dedup.keep_one(docs).collect()))
    assert kept == sorted([(1, long[0]), (1, long[1]), (3, long[2]), (4, "")])
    items = spark.createDataFrame([(1, long[1])], "item_id long, text string")
    kept = sorted((x.doc_id, x.text or "") for x in decontam.clean(docs, items).collect())
    assert kept == sorted([(1, long[0]), (2, long[0]), (3, long[2]), (3, long[2]), (4, ""), (4, "")])


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randint(200, 299), r.randint(200, 299)) for _ in range(70)]
    edges = [(a, b) for a, b in edges if a != b]
    got = dict(rows_of(dedup.components(spark.createDataFrame(edges, "a long, b long"))))
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == root


def test_near_duplicates_of_awkward_rows(spark):
    rows = dedup.classes(clashing(spark)).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    assert by[8] == {1} and by[2] == by[3] == {2} and by[4] == {4} and by[None] == {None} and by[5] == {5}
    assert dedup.classes(empty(spark)).count() == 0
    kept = dedup.keep_one(clashing(spark))
    assert kept.columns == clashing(spark).columns and rows_of(kept, "doc_id") == sorted([(1,), (2,), (4,), (5,), (6,), (7,), (None,)], key=repr)


# -- decontamination


def brute_decontamination(docs, items):
    out = []
    windows = []
    for i, t in items:
        w = words(t)
        k = min(len(w), decontam.WINDOW)
        windows += [(str(i) if i is not None else "", tuple(w[s : s + k])) for s in range(len(w) - k + 1)] if w else []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    ids.add(item)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    r = random.Random(6)
    vocab = vocabulary(r, 60)
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(25)]
    items += [(25, "THE É the"), (26, None), (27, ""), (28, "same same same same"), (None, "null item here"), (3, "another text of item three"), items[4]]
    docs = []
    for i in range(80):
        parts = r.choices(vocab, k=r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randint(0, 3) if len(w) > 13 else 0
            at = r.randint(0, len(parts))
            parts[at:at] = w[a : len(w) - r.randint(0, 2)] if r.random() < 0.5 else w
        docs.append((i, r.choice([" ", ", ", "\n"]).join(p.upper() if r.random() < 0.2 and p.isascii() else p for p in parts)))
    docs += [(100, None), (101, ""), (102, "same " * 30), (None, "null item here"), docs[0], docs[0], (7, "another text of item three, again")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"th": F.lit("x"), "w": F.lit(1), "n_hit": F.lit(2)}).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("len", F.lit(1))
    order = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute_decontamination(docs, items)
    assert rows_of(decontam.find(d, b), *order) == want
    old, decontam.BROADCAST_ROWS = decontam.BROADCAST_ROWS, 0  # the joins that shuffle give the same
    try:
        assert rows_of(decontam.find(d, b), *order) == want
    finally:
        decontam.BROADCAST_ROWS = old
    clean = [(i, t) for i, t in docs if not brute_decontamination([(i, t)], items)[0][5]]
    assert rows_of(decontam.clean(d, b), "doc_id", "text") == sorted(clean, key=repr) and len(clean) < len(docs)
    plan = decontam.find(d, b)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_decontamination_of_texts_that_repeat_themselves(spark):
    d = spark.createDataFrame([(1, "same " * 20_000), (2, "a b " * 10_000), (3, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "same " * 20_000), (2, "a b " * 5_000), (3, "same " * 15)], "item_id long, text string")
    got = {x.doc_id: (x.n_hit, x.n_items) for x in decontam.find(d, b).collect()}
    assert got == {1: (20_000, 2), 2: (20_000, 1), 3: (0, 0)}


def test_decontamination_of_awkward_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    order = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert rows_of(decontam.find(clashing(spark), none), *order) == brute_decontamination(rows, [])
    assert decontam.find(empty(spark), none).count() == 0
    items = [(1, "x"), (2, "ÀÉ"), (3, "text with some words")]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontam.find(clashing(spark), b), *order) == brute_decontamination(rows, items)


# -- language model


def test_texts_are_read_without_a_step_of_python_for_each_token(monkeypatch):
    """As tokens() and shape() say, but by whole columns."""
    r = random.Random(4)
    alphabet = ["a", "Z", "É", "ß", "日", "7", "!", ".", "|", "\x00", "\x1c", "\x85", "\xa0", " ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", "plain ", "W1% "]
    texts = ["", " ", None, "x", " \t x \r\n"] + ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(400)]
    each = [[*lm.tokens(t or ""), lm.END] for t in texts]
    count = Counter(w for ws in each[::2] for w in ws)
    by_shape = {}
    for w, c in count.items():
        n, k = by_shape.get(lm.shape(w), (0, 0))
        by_shape[lm.shape(w)] = (n + c, k + 1)
    known = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:60]
    v = lm.Vocabulary(known, by_shape, sum(count.values()), len(count), head=30)
    place, first = {t: i for i, (t, _) in enumerate(known)}, {t for t, _ in known[:30]}
    forms = [[lm.shape(w) for w in ws] for ws in each]
    monkeypatch.setattr(lm, "tokens", None)
    monkeypatch.setattr(lm, "shape", None)
    words, ends = lm.split(pa.array(texts))
    assert words.to_pylist() == [w for ws in each for w in ws] and ends.tolist() == np.cumsum([len(ws) for ws in each]).tolist()
    assert lm.shapes(words).tolist() == [s for f in forms for s in f]
    assert lm.shapes(words[3:9]).tolist() == [s for f in forms for s in f][3:9] and lm.shapes(words[:0]).tolist() == []
    entries, base, share, n_known, others = v.read(pa.array(texts))
    assert all((a == b).all() for a, b in zip(entries, v.entries(pa.array(texts)), strict=True))
    for ws, fs, e, b, s, n, o in zip(each, forms, entries, base, share, n_known, others.to_pylist(), strict=True):
        assert [x == v.stand_in[f] for x, f in zip(e, fs, strict=True)] == [w not in first for w in ws]
        here = [w for w in ws if w in place]
        assert n == len(here) and {x["token"]: x["m"] for x in o} == Counter(w for w in ws if w not in place)
        assert abs(b - sum(math.log10(count[w] + 0.1) for w in here)) < 1e-9
        assert abs(s - sum((math.log10(count[w] + 0.1) if w in place else 0) - v.norm[f] for w, f in zip(ws, fs) if w not in first)) < 1e-9


def test_language_model(spark):
    r = random.Random(8)
    styles = [vocabulary(r, 80), [w.upper() + "!!" for w in vocabulary(r, 80)], [w + "%%%" for w in vocabulary(r, 80)]]
    docs = [(i, " ".join(r.choices(styles[i % 3], k=r.randint(5, 120)))) for i in range(300)] + [(300, None), (301, ""), (None, "no id"), (5, "twice"), (5, "twice")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"uid": F.lit(1), "base": F.lit(2), "score": F.lit("x")}).repartition(3)
    got = lm.score(d, head=150, known=200, steps=60).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = Counter()
    for i, t in docs:
        if not held(i):
            count.update(lm.tokens(t or ""))
            count[b""] += 1
    total, distinct = sum(count.values()), len(count)
    want = []
    for i, t in docs:
        ws = [*lm.tokens(t or ""), b""]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        want.append((i, held(i), len(ws), sum(count[w] > 0 for w in ws), total, round(base, 6)))
    assert sorted([(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got], key=repr) == sorted(want, key=repr)
    unseen = [x for x in got if x.held_out]
    assert sum(x.score for x in unseen) > sum(x.base_score for x in unseen)
    assert lm.score(empty(spark), steps=5).count() == 0
    rows = lm.score(clashing(spark), steps=5).collect()
    assert len(rows) == 10 and all(math.isfinite(x.score) for x in rows)
    named = lm.score(clashing(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), steps=5)
    assert {x.doc_id for x in named.collect()} == {None, *(f"d{i}" for i in range(1, 9))}


def test_score_against_a_plain_network(spark):
    """The score of a text, by loops over gates, classes and tokens alone."""
    r = random.Random(3)
    some = vocabulary(r, 60)
    docs = [(i, " ".join(r.choices(some, k=r.randint(0, 90)))) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    v, net, counts = lm.fit(d, head=20, known=30, steps=20)
    c = {bytes(x.token): x.c for x in counts.collect()}
    p, H = {k: w.astype(float) for k, w in net.p.items()}, lm.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))
    order = sorted(c, key=lambda t: (-c[t], t))
    top = set(order[:20])
    ends = [*v.start.tolist()]
    entries = sorted([(s, False, b"") for s in range(lm.N_SHAPES)] + [(lm.shape(t), True, t) for t in order[:20]], key=lambda e: e[:2])
    place = {t: i for i, (_, own, t) in enumerate(entries) if own}
    alone = {s: i for i, (s, own, _) in enumerate(entries) if not own}

    def plain(text):
        h, x, total = [0.0] * H, v.end, 0.0
        for t in [*lm.tokens(text), lm.END]:
            g = p["E"][x] @ p["W"] + p["b"]
            u = np.array(h) @ p["U"]
            z, q = ([sig(g[i + o] + u[i + o]) for i in range(H)] for o in (0, H))
            n = [math.tanh(g[2 * H + i] + q[i] * u[2 * H + i]) for i in range(H)]
            h = [n[i] + z[i] * (h[i] - n[i]) for i in range(H)]
            s = lm.shape(t)
            x = place[t] if t in top else alone[s]
            k = max(i for i, a in enumerate(ends[:-1]) if a <= x)
            of = [math.exp(sum(h[i] * p["C"][i, j] for i in range(H)) + p["cb"][j]) for j in range(len(ends) - 1)]
            within = {j: math.exp(p["M"][j] @ np.array(h) + p["mb"][j]) for j in range(ends[k], ends[k + 1])}
            total += math.log10(of[k] / sum(of) * within[x] / sum(within.values()))
            if t not in top:
                rest = [w for w in c if w not in top and lm.shape(w) == s]
                total += math.log10((c.get(t, 0) + 0.1) / (sum(c[w] for w in rest) + 0.1 * (len(rest) + 1)))
        return total

    vocabulary_of = lm.fit
    lm.fit = lambda *_, **__: (v, net, counts)
    try:
        got = {x.doc_id: x.score for x in lm.score(d).collect()}
    finally:
        lm.fit = vocabulary_of
    for i, t in docs[:12]:
        assert abs(got[i] - plain(t)) < 1e-3 * max(1, abs(plain(t)))


def network(n_words=30):
    known = [(f"w{i}".encode(), 100 - i) for i in range(n_words)] + [(b"", 50)]
    shapes = {}
    for t, c in known:
        n, v = shapes.get(lm.shape(t), (0, 0))
        shapes[lm.shape(t)] = (n + c, v + 1)
    v = lm.Vocabulary(known, shapes, sum(c for _, c in known), len(known), head=20)
    return v, lm.Network(v.start, v.klass)


def test_network_is_a_distribution():
    v, net = network()
    h = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    logp, _ = net.log_probs(np.repeat(h, v.size, axis=0), np.arange(v.size))
    assert abs(np.exp(logp).sum() - 1) < 1e-5


def test_network_learns_from_every_token(spark):
    words, r, nets = [f"w{i % 40}" for i in range(70_000)], random.Random(3), []
    tail = words[66_000:]
    r.shuffle(tail)
    for text in (" ".join(words), " ".join(words[:66_000] + tail)):  # equal counts; only what follows 66,000 tokens differs
        v, net, _ = lm.fit(spark.createDataFrame([(i, text) for i in range(1, 3)], "doc_id long, text string").coalesce(1), steps=3)
        nets.append(net)
    assert any(not np.allclose(nets[0].p[k], nets[1].p[k], atol=1e-6) for k in nets[0].p)
    v, net = network()
    streams = [np.full(n, 3) for n in (5, 1, 7000, 33, 2)]
    assert net.learn(iter(streams), v.end, lanes=4) == 7041


def test_network_gradient():
    v, net = network()
    stream = np.random.default_rng(2).integers(0, v.size, 200)
    x, y = stream[:20, None], stream[1:21, None]

    def loss():
        states, _ = net.run(x, np.zeros((1, lm.HIDDEN), np.float32), net.prepare())
        return -net.log_probs(states.reshape(-1, lm.HIDDEN), y.ravel())[0].sum()

    g = {}
    states, _ = net.run(x, np.zeros((1, lm.HIDDEN), np.float32), net.prepare())
    net.log_probs(states.reshape(-1, lm.HIDDEN), y.ravel(), g)
    for name in ("C", "M", "mb"):
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was, sides = net.p[name][i], []
        for step in (0.02, -0.02):
            net.p[name][i] = was + step
            sides.append(loss())
        net.p[name][i] = was
        assert abs((sides[0] - sides[1]) / 0.04 - g[name][i]) < 0.05 * max(1, abs(g[name][i]))
    before = loss()
    net.train(np.tile(stream, 4), v.end, 60, lanes=4)
    assert loss() < before


def test_state_is_carried_over_windows():
    v, net = network()
    texts = [np.random.default_rng(i).integers(0, v.size, n) for i, n in enumerate((1, 5, 64, 65, 300, 700))]
    each = [net.score([t], v.end)[0] for t in texts]
    assert np.allclose(net.score(texts, v.end, lanes=2), each, rtol=1e-4)
    old, lm.SPAN = lm.SPAN, 1000
    try:
        assert np.allclose(net.score(texts, v.end), each, rtol=1e-4)
    finally:
        lm.SPAN = old


def test_lanes_are_filled_from_group_to_group(monkeypatch):
    v, net = network()
    r = np.random.default_rng(4)
    groups = [[r.integers(0, v.size, n) for n in sizes] for sizes in ([2000, 3, 70], [1], [], [64, 65, 1500], [5] * 40, [900, 128])]
    want = [[net.score([t], v.end)[0] for t in texts] for texts in groups]
    for open_groups, least, most in ((8, 32, 42), (1, 74, 90)):  # the longest text takes 32 windows; one group at a time, those of each add up
        monkeypatch.setattr(lm, "OPEN", open_groups)
        windows, run = [], net.run
        monkeypatch.setattr(net, "run", lambda *a: windows.append(1) or run(*a))
        got = dict(net.score_groups(iter(groups), v.end, lanes=4))
        monkeypatch.setattr(net, "run", run)
        assert sorted(got) == list(range(6)) and least <= len(windows) <= most
        assert all(np.allclose(got[k], texts, rtol=1e-4) for k, texts in enumerate(want))
    assert list(net.score_groups(iter([]), v.end)) == [] and net.score([], v.end).tolist() == []


def test_the_sample_is_not_looked_up_text_by_text(spark, monkeypatch):
    calls, entries = [], lm.Vocabulary.entries
    monkeypatch.setattr(lm.Vocabulary, "entries", lambda self, texts: calls.append(len(texts)) or entries(self, texts))
    monkeypatch.setattr(lm, "learn_all", lambda *_: 0)
    lm.fit(spark.createDataFrame([(i, f"w{i % 7} w{i % 5}") for i in range(300)], "doc_id long, text string"), steps=1)
    assert sum(calls) > 200 and len(calls) <= 3


def test_gradients_of_a_step():
    """Against differences of the loss, for parameters of every kind; more rows than are worked out at a time."""
    v, net = network()
    lanes, size = 300, 12
    stream = np.random.default_rng(5).integers(0, v.size, (size + 1, lanes))
    x, y, h = stream[:-1], stream[1:], np.random.default_rng(6).uniform(-0.5, 0.5, (lanes, lm.HIDDEN)).astype(np.float32)
    assert x.size > lm.PIECE

    def loss():
        states, _ = net.run(x, h, net.prepare())
        return -net.log_probs(states.reshape(-1, lm.HIDDEN), y.ravel())[0].mean()

    m, s = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(2))
    start = {k: w.copy() for k, w in net.p.items()}
    net.step(x, y, h, m, s, 1, 0.001)
    net.p.update({k: w.copy() for k, w in start.items()})
    for name in net.p:
        i = np.unravel_index(np.abs(m[name]).argmax(), m[name].shape)
        was, sides = net.p[name][i], []
        for by in (0.02, -0.02):
            net.p[name][i] = was + by
            sides.append(loss())
        net.p[name][i] = was
        assert abs((sides[0] - sides[1]) / 0.04 - 10 * m[name][i]) < 0.03 * abs(10 * m[name][i]) + 1e-5, name
