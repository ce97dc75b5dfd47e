"""Toxicity: Levenshtein automata met with a trie of abusive terms, scored in context.

The terms are learned from labelled rows: words, and stems (prefixes), whose distinct left contexts lie
almost all in toxic texts.  Counting contexts rather than texts keeps copies from weighing more than once.
A token is looked up by running its Levenshtein automaton (bit-parallel, one bit a position) over the trie;
words under 5 letters must match exactly, under 8 with one edit at most, longer ones with two.  A stem must be met at the
beginning of a token, with one edit at most, or none under 8 letters; the commoner words stay terms beside
their stems.  Tokens near a
term that are common in clean texts are not abuse.  Each hit is weighed by its distance and its context window:
quotation lowers it, direct address raises it.  A logistic regression over the sums gives the score.

The fit takes at most SAMPLE labelled rows of each class, chosen by a hash of the id; null or contradictory
labels are left out; of rows that share a labelled id, the text that sorts first is learned from.  A term must reach a share of the toxic
sample, so their number does not grow with the input.  Without rows of both classes all scores are 0.5.  Null texts count as empty; empty
texts, and texts without hits, get the score of no hits.  Repeated rows get equal scores; whole texts are read.  Offsets of spans are code
points of the text.
"""

from __future__ import annotations

import math
import re
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, fields, stage, text_udf

#: Labelled rows of each class that the fit takes at most.
SAMPLE = 6_000
#: Of a stem's contexts, the share from which a form of it is a term of its own.
FORM_SHARE = 0.1
THRESHOLD = 0.5
TOKEN = re.compile(r"[^\W_]+(?:[@$!][^\W_]+)*")
#: Digits and marks that stand for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
QUOTES = re.compile(r"[\"“”„«»]")
ADDRESS = re.compile(r"\b(?:you|your|you're|u|du|dich|tu|te|vous|usted|eres)\b")
CONTEXT = 60
#: Clean tokens that a worker remembers at most.
REMEMBER = 400_000


def edits(term: str) -> int:
    """Edits that a term allows; that of a stem ends in *."""
    if term.endswith("*"):
        return 0 if len(term) - 1 < 8 else 1
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def lowered(text: str) -> str:
    """In small letters, each in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Trie:
    """Terms in a trie; a term ending in * is a stem that tokens may go on from."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        parts = set()
        for term in terms:
            node, word = self.root, term.rstrip("*")
            for c in word:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(term)
            k = edits(term)
            cuts = [len(word) * i // (k + 1) for i in range(k + 2)]
            parts |= {word[a:b] for a, b in zip(cuts, cuts[1:])}
        # of k+1 parts of a term, k edits leave one whole: tokens without any part need no automaton
        self.some = re.compile("|".join(map(re.escape, sorted(parts)))) if parts else None

    def near(self, token: str) -> tuple[str, int] | None:
        """The term nearest to token, with its distance; None if none is near enough."""
        if self.some is None or not self.some.search(token):
            return None
        n = len(token)
        full = (1 << (n + 1)) - 1
        mask: dict[str, int] = {}
        for i, c in enumerate(token):
            mask[c] = mask.get(c, 0) | 1 << i
        best: tuple[int, str] | None = None
        todo = [(self.root, 1, 3, 7)]
        while todo:
            node, r0, r1, r2 = todo.pop()
            for c, below in node.items():
                if c == "":
                    for term in below:
                        # states: bit i of r_j is set if i characters of the token are read with j edits at most; a stem may stop at any
                        d = next((j for j, r in enumerate((r0, r1, r2)) if (r if term.endswith("*") else r >> n & 1)), 3)
                        if d <= edits(term) and (best is None or (d, term) < best):
                            best = (d, term)
                    continue
                m = mask.get(c, 0)
                s0 = (r0 & m) << 1
                s1 = ((r1 & m) << 1 | r0 | r0 << 1 | s0 << 1) & full
                s2 = ((r2 & m) << 1 | r1 | r1 << 1 | s1 << 1) & full
                if s2:
                    todo.append((below, s0, s1, s2))
        return None if best is None else (best[1], best[0])


def variants(token: str) -> list[str]:
    """The token, and what it stands for if digits and marks play letters or letters are drawn out."""
    plain = token.translate(LEET) if not token.isalpha() and any(c.isalpha() for c in token) else token
    short = re.sub(r"(.)\1{2,}", r"\1", plain)
    return list(dict.fromkeys((token, plain, short)))


class Finder:
    """Hits of a text.  Verdicts on tokens are remembered within a worker's task."""

    def __init__(self, terms: list[str], clean: frozenset[str]):
        self.trie, self.clean = Trie(terms), clean
        self.bad: dict[str, tuple[str, int]] = {}
        self.good: set[str] = set()

    def verdict(self, token: str) -> tuple[str, int] | None:
        found = [(d + (v != token), t) for v in variants(token) for t, d in [self.trie.near(v) or ("", 9)] if t]
        if not found or (min(found)[0] > 0 and token in self.clean):
            return None
        return min(found)[1], min(found)[0]

    def hits(self, low: str) -> tuple[int, list[tuple[int, int, str, int]]]:
        """Number of tokens of a lowered text, and (start, end, term, distance) of each hit."""
        tokens = TOKEN.findall(low)
        seen = set(tokens)
        if len(self.good) > REMEMBER:
            self.good = set()
        for t in seen - self.good - self.bad.keys():
            v = self.verdict(t)
            if v:
                self.bad[t] = v
            else:
                self.good.add(t)
        if seen.isdisjoint(self.bad):
            return len(tokens), []
        return len(tokens), [(*m.span(), *self.bad[m.group()]) for m in TOKEN.finditer(low) if m.group() in self.bad]


def weight(text: str, start: int, end: int, distance: int) -> float:
    """A hit's weight by its distance and the window around it."""
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    w = 0.8**distance
    addressed = ADDRESS.search(before[-20:].lower()) or ADDRESS.search(after[:20].lower())
    if len(QUOTES.findall(before)) % 2 == 1 and QUOTES.search(after) and not addressed:
        return 0.3 * w
    return w * (1.25 if addressed else 1.0)


def features(low: str, n: int, hits: list[tuple[int, int, str, int]]) -> list[float]:
    """Sums over the hits of a lowered text of n tokens."""
    ws = [weight(low, a, b, d) for a, b, _, d in hits]
    total = sum(ws)
    return [math.log1p(total), math.sqrt(total / max(1, n)), math.log1p(len({t for _, _, t, _ in hits})),
            min(1.0, max(ws, default=0.0))]


def contexts(text: str) -> tuple:
    """The distinct (previous token, token) pairs of a text, tab-joined."""
    tokens = TOKEN.findall(lowered(text))
    return (sorted({f"{p}\t{t}" for p, t in zip(["", *tokens], tokens)}),)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """Up to `limit` labelled rows of each class outside the held-out fold, as (doc_id, text, y)."""
    rows = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (bucket(F.col("doc_id"), 5) != 0))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    first = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for y in (0, 1)]
    ids = F.broadcast(first[0].union(first[1]))  # 2 * limit rows of two numbers at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ids, "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def lexicon(rows: DataFrame, n_clean: int, n_toxic: int) -> tuple[list[str], DataFrame]:
    """Terms from the sample, and its table of words (w, toxic, clean: distinct left contexts in either class)."""
    pairs = rows.select("y", F.explode(text_udf(fields("p array<string>"), lambda: contexts)(F.col("text"))["p"]).alias("p")).distinct()
    pairs = pairs.select("y", F.substring_index("p", "\t", -1).alias("w"))
    counts = pairs.groupBy("w").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    counts = stage(rows.sparkSession, counts, "toxicity-words")
    # stems: prefixes with a mark at the end; whole words: without
    length = F.char_length("w")
    stems = F.when(length > 4, F.transform(F.sequence(F.lit(4), F.least(length - 1, F.lit(9))),
                                           lambda k: F.concat(F.substring("w", F.lit(1), k), F.lit("*")))).otherwise(F.array().cast("array<string>"))
    keyed = counts.filter((length >= 4) & ~F.col("w").rlike("^[0-9]+$")).select(F.explode(F.concat(F.array("w"), stems)).alias("t"), "toxic", "clean")
    sums = keyed.groupBy("t").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    strong = sums.filter((F.col("toxic") >= F.greatest(F.lit(5), F.lit(n_toxic // 100))) & (rate >= 30))
    found = {r["t"]: r["toxic"] for r in strong.collect()}
    words = {t for t in found if not t.endswith("*")}
    kept: list[str] = []
    for t in sorted((t for t in found if t.endswith("*")), key=lambda t: (len(t), t)):
        stem = t[:-1]
        if any(stem.startswith(k[:-1]) for k in kept):
            continue
        # the longest stem that covers nearly as much, unless one word does
        while longer := max((u for u in found if u.endswith("*") and len(u) == len(stem) + 2 and u.startswith(stem)
                             and found[u] >= 0.9 * found[stem + "*"]), key=lambda u: (found[u], u), default=None):
            stem = longer[:-1]
        if stem + "*" not in kept and not any(found[w] >= 0.9 * found[stem + "*"] for w in words if w.startswith(stem)):
            kept.append(stem + "*")
    # of the forms that a stem covers, the common ones stay terms, to be met misspelled; the endings of others tell little
    rest = [w for w in words if all(found[w] >= FORM_SHARE * found[k] for k in kept if w.startswith(k[:-1]))]
    return sorted([*rest, *kept]), counts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        limit: int = SAMPLE) -> dict | None:
    """Terms, clean look-alikes and weights; None without labelled rows of both classes."""
    rows = stage(docs.sparkSession, sample(docs, labels, id_col, text_col, label_col, limit), "toxicity-sample")
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_clean, n_toxic = size.get(0, 0), size.get(1, 0)
    if min(n_clean, n_toxic) == 0:
        return None
    terms, counts = lexicon(rows, n_clean, n_toxic)
    # look-alikes: tokens near a term whose contexts are not mostly toxic; the sample bounds them
    rare = Finder(terms, frozenset())
    near = text_udf(fields("near boolean"), lambda: lambda t: (rare.verdict(t) is not None,))
    alike = counts.filter(F.col("clean") / n_clean >= 0.2 * F.col("toxic") / n_toxic).filter(near(F.col("w"))["near"])
    clean = frozenset(r["w"] for r in alike.select("w").collect())
    finder = Finder(terms, clean)
    def made():
        return lambda t: (features(low := lowered(t), *finder.hits(low)),)

    got = rows.select("doc_id", "y", text_udf(fields("x array<double>"), made)(F.col("text"))["x"].alias("x")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([float(r["y"]) for r in got])
    return {"terms": terms, "clean": clean, "weights": logistic(x, y)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> list[float]:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _scorer(model: dict | None):
    if model is None:
        return lambda text: (0.5, "")
    finder = Finder(model["terms"], model["clean"])

    def one(text: str) -> tuple:
        low = lowered(text)
        n, hits = finder.hits(low)
        x = features(low, n, hits)
        z = sum(a * b for a, b in zip([*x, 1.0], model["weights"], strict=True))
        spans = ",".join(f"{t}:{a}:{b}" for a, b, t, _ in hits)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), spans

    return one


def score(text: Column, model: dict | None) -> Column:
    """A struct of the probability of label 1, and the hits as term:start:end, comma-joined."""
    return text_udf(fields("score double,spans string"), partial(_scorer, model))(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, spans."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("s"))
    return rows.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "s.score",
                       (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), "s.spans")
