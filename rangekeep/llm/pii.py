"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans (email, ip, card, phone) are the leftmost, non-overlapping matches of four patterns, less those that fail
their check.  The network finds written-around forms besides ("name [at] host dot com", "1[.]2[.]3[.]4"): it reads
overlapping windows of a text, their emissions are averaged where windows overlap, and one Viterbi pass over
each covered stretch reconciles them.  Of a tagged span, all parts count that read as its kind (FORMS) once
marks are undone, begin and end with words, and overlap no base span.

All forms hold a digit, an at sign or the word "at", in brackets or bare (TRIGGER).  Windows that hold one outside base spans are read, with
SIDE windows before and after them; no other window can hold a part that would count.

The network is trained in numpy from labelled spans: texts' own windows, with their base spans as labels, into which further
forms of known extent are written.  Contexts come from at most SAMPLE texts chosen by a hash of the id.

Null or empty texts have no spans.  Repeated rows get equal spans.  Texts are read whole, however long, GROUP windows at a time; extra
columns pass.
"""

import math
import random
import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, span_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits are taken whole, so a match starts at a run's first digit.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Written-around forms: how words may stand for the marks of a kind.  Up to eight blanks stand between two parts.
GAP = r"\s{0,8}"
AT_WORD = rf"(?:{GAP}[\[({{<]?{GAP}\b(?:at|AT)\b{GAP}[\])}}>]?{GAP}|{GAP}@{GAP})"
DOT_WORD = rf"(?:{GAP}[\[({{<]{GAP}(?:dot|DOT|\.){GAP}[\])}}>]{GAP}|\s{{1,8}}(?:dot|DOT)\s{{1,8}}|\.)"
FORMS = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+{AT_WORD}[A-Za-z0-9-]+(?:{DOT_WORD}[A-Za-z0-9-]+)+"),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:{GAP}[\[({{]?{GAP}(?:\.|dot){GAP}[\])}}]?{GAP}[0-9]{{1,3}}){{3}}"),
    "card": re.compile(r"[0-9](?:[ ./_-]{0,3}[0-9]){12,18}"),
    "phone": re.compile(r"\+?\(?[0-9](?:[ ()./-]{0,4}[0-9]){8,14}"),
}
#: The same within a text: between words' ends.
WITHIN = {k: re.compile(rf"(?<![^\s,;:])(?:{p.pattern})(?![A-Za-z0-9])") for k, p in FORMS.items()}
#: What every form holds: a digit, an at sign, or an "at" that is a word.
TRIGGER = re.compile(r"[0-9@]|\b(?:at|AT)\b")

WINDOW, STRIDE = 96, 48
EMBED, HIDDEN = 10, 16
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
SAMPLE = 200
STEPS, LANES = 260, 64
#: Windows that are read together, and those before and after one with a trigger that are read too.
GROUP = 512
SIDE = 1
#: Characters of stretches, about, that are decoded together.
DECODE = 1 << 18


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern: for each at sign, the longest local part before it that no earlier
    match has taken."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = AT_EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def at_most_255(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) < 3 or len(value) == 3 and value <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then by start."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(at_most_255(g) for g in m.groups())]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def reads_as(kind: str, s: str) -> bool:
    """Whether a written-around form is its kind once the marks are undone."""
    if FORMS[kind].fullmatch(s) is None:
        return False
    if kind == "email":
        return True
    if kind == "ip":
        return all(at_most_255(p) for p in re.findall("[0-9]+", s))
    if kind == "card":
        return luhn("".join(c for c in s if "0" <= c <= "9"))
    return not s.isdigit()


def within(kind: str, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """All parts of a tagged span that read as its kind, or else as another."""
    s = text[a:b]
    for k in (kind, *(x for x in KINDS if x != kind)):
        found = [(k, a + m.start(), a + m.end()) for m in WITHIN[k].finditer(s) if reads_as(k, m.group())]
        if found:
            return found
    return []


def char_ids(text: str) -> np.ndarray:
    """ASCII as it is, other letters and other characters as one id each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, codes, np.where(codes < 0x250, 128, 129)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """A bidirectional LSTM over characters, linear emissions, and a linear-chain CRF."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        def make(*shape, scale=None):
            return (r.standard_normal(shape) * (scale or 1 / math.sqrt(shape[0]))).astype(np.float32)
        self.p = {"E": make(130, EMBED, scale=0.5), "O": make(2 * HIDDEN, len(TAGS)), "o": np.zeros(len(TAGS), np.float32),
                  "T": np.zeros((len(TAGS), len(TAGS)), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": make(EMBED, 4 * HIDDEN), f"U{d}": make(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        # an I tag follows a tag of its kind only
        self.forbidden = np.zeros((len(TAGS), len(TAGS)), np.float32)
        for j, t in enumerate(TAGS):
            for i, before in enumerate(TAGS):
                if t[0] == "I" and before[2:] != t[2:]:
                    self.forbidden[i, j] = -1e4

    def lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, lanes, HIDDEN) in the order of time, read forwards or backwards."""
        H, U, table = HIDDEN, self.p[f"U{d}"], self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]
        h = c = np.zeros((x.shape[1], H), np.float32)
        out = np.empty((*x.shape, H), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = table[x[t]] + h @ U
            s = sigmoid(g[:, : 3 * H])
            i, f, o, n = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :], np.tanh(g[:, 3 * H :])
            c_new = f * c + i * n
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, n, tc))
            h, c = o * tc, c_new
            out[t] = h
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, lanes, tags) for ids x (time, lanes)."""
        return np.concatenate([self.lstm(x, "f"), self.lstm(x, "b")], axis=2) @ self.p["O"] + self.p["o"]

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags (time, lanes) for emissions (time, lanes, tags) of lanes of these lengths; O behind a lane's end."""
        trans = (self.p["T"] + self.forbidden).T  # (to, from)
        score = e[0] + np.where([t[0] == "I" for t in TAGS], np.float32(-1e4), np.float32(0))
        back = np.zeros(e.shape, np.int8)
        back[1:] = np.arange(len(TAGS))  # behind a lane's end nothing changes
        for t in range(1, len(e)):
            live = int(np.searchsorted(-lengths, -t))  # lanes come longest first
            m = score[:live, None, :] + trans
            back[t, :live] = m.argmax(axis=2)
            score[:live] = m.max(axis=2) + e[t, :live]
        tags = np.zeros(e.shape[:2], np.int8)
        lanes, at = np.arange(e.shape[1]), score.argmax(axis=1)
        for t in range(len(e) - 1, -1, -1):
            tags[t] = np.where(t < lengths, at, 0)
            at = back[t, lanes, at]
        return tags

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood a character, and its gradients."""
        p, H = self.p, HIDDEN
        keep: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.lstm(x, d, keep[d]) for d in "fb"], axis=2)
        e = states @ p["O"] + p["o"]
        T, B, K = e.shape
        trans = (p["T"] + self.forbidden).astype(np.float64)
        # forwards and backwards sums, each step in log space
        def lse(m: np.ndarray, axis: int) -> np.ndarray:
            top = m.max(axis=axis, keepdims=True)
            return np.log(np.exp(m - top).sum(axis=axis)) + top.squeeze(axis)
        alpha, beta = np.empty((T, B, K)), np.zeros((T, B, K))
        alpha[0] = e[0] + np.where([t[0] == "I" for t in TAGS], -1e4, 0.0)
        for t in range(1, T):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(T - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        gold = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0].sum(axis=0) + trans[y[:-1], y[1:]].sum(axis=0)
        de = np.exp(alpha + beta - z[:, None])
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        g = {"T": np.zeros((K, K))}
        for t in range(1, T):
            g["T"] += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(g["T"], (y[:-1].ravel(), y[1:].ravel()), -1)
        de = de.astype(np.float32)
        flat = de.reshape(-1, K)
        g["O"], g["o"] = states.reshape(-1, 2 * H).T @ flat, flat.sum(axis=0)
        ds = de @ p["O"].T
        g["E"] = np.zeros_like(p["E"])
        for k, d in enumerate("fb"):
            dx = np.empty((T, B, 4 * H), np.float32)
            g[f"U{d}"] = np.zeros_like(p[f"U{d}"])
            nh = nc = 0.0
            for t, h0, c0, i, f, o, n, tc in reversed(keep[d]):
                dh = ds[t, :, k * H : (k + 1) * H] + nh
                dc = dh * o * (1 - tc * tc) + nc
                gate = np.concatenate([dc * n * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - n * n)], axis=1)
                dx[t] = gate
                g[f"U{d}"] += h0.T @ gate
                nh, nc = gate @ p[f"U{d}"].T, dc * f
            fx, ids = dx.reshape(-1, 4 * H), x.reshape(-1)
            g[f"b{d}"], g[f"W{d}"] = fx.sum(axis=0), p["E"][ids].T @ fx
            np.add.at(g["E"], ids, fx @ p[f"W{d}"].T)
        n = T * B
        return float((z - gold).sum() / n), {k: v / B for k, v in g.items()}

    def train(self, examples: list[tuple[np.ndarray, np.ndarray]], steps: int, rate: float = 0.02, seed: int = 4) -> float:
        """Adam over batches of windows; returns the last batches' mean loss."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        recent: list[float] = []
        for step in range(1, steps + 1):
            pick = r.integers(0, len(examples), LANES)
            x, y = (np.stack([examples[i][j] for i in pick], axis=1) for j in (0, 1))
            loss, g = self.loss(x, y)
            recent = [*recent[-9:], loss]
            norm = math.sqrt(sum(float((q * q).sum()) for q in g.values()))
            lr = rate * (0.05 ** (step / steps))
            for k, q in g.items():
                q = q * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (q - m[k])
                v[k] += 0.01 * (q * q - v[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return float(np.mean(recent)) if recent else 0.0


def made_up(r: random.Random) -> tuple[str, str]:
    """A kind and a form of it, plain or written around."""
    kind = r.choice(KINDS)
    word = lambda a, b: "".join(r.choice("abcdefghijklmnoprstuvwyz") for _ in range(r.randint(a, b)))
    if kind == "email":
        at, dot = r.choice([("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "."), ("(at)", "(dot)"), (" @ ", "."),
                            (" {at} ", " {dot} "), (" <at> ", " <dot> "), *[(" at ", " dot ")] * 3, (" AT ", " dot "), (" [ at ] ", " [ . ] ")])
        name = word(3, 8) + r.choice(["", "", ".", "_"] ) + r.choice(["", word(2, 6), str(r.randint(1, 99))])
        return kind, name.rstrip("._") + at + dot.join([word(4, 9), *([word(3, 7)] if r.random() < 0.3 else []), r.choice(["com", "org", "net", "de"])])
    if kind == "ip":
        return kind, r.choice([".", "[.]", " . ", "(.)", "[dot]", " dot "]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = [r.randint(1, 9)] + [r.randint(0, 9) for _ in range(14)]
        tail = next(d for d in range(10) if luhn("".join(map(str, [*body, d]))))
        s = "".join(map(str, [*body, tail]))
        return kind, r.choice(["", " ", "-", ".", "/", "_", " - "]).join(s[i : i + 4] for i in range(0, 16, 4))
    a, b, c = r.randint(100, 999), r.randint(100, 999), r.randint(1000, 9999)
    form = r.choice(["+1 ({}) {}-{}", "+1-{}-{}-{}", "({}) {}-{}", "{}-{}-{}", "({}) {} {}", "+44 {} {} {}", "{}.{}.{}", "+49 {}/{}{}"])
    return kind, form.format(a, b, c)


def distractor(r: random.Random) -> str:
    """Digits and marks that are nobody's."""
    return r.choice([lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}", lambda: "%x" % r.getrandbits(r.choice([64, 128, 160])),
                     lambda: str(r.randint(1, 10 ** r.randint(1, 9))), lambda: f"token = \"{r.getrandbits(160):040x}\"",
                     lambda: f"{r.randint(1, 2100)}-{r.randint(1, 12)}-{r.randint(1, 28)}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59)}",
                     lambda: f"{r.randint(1, 99)}.{r.randint(0, 99)}%", lambda: f"CC BY-NC {r.randint(1, 4)}.0."])()


def labelled_windows(texts: list[str], n: int = 3000, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of ids and tags: contexts from texts, their base spans, and spans and distractors written in."""
    r = random.Random(seed)
    texts = [t for t in texts if t] or ["the of and a in to "]
    out = []
    for _ in range(n):
        t = r.choice(texts)
        at = r.randrange(max(1, len(t) - WINDOW))
        parts: list[tuple[str, str]] = [("O", t[at : at + r.randint(5, 50)])]
        for _ in range(r.choice([0, 1, 1, 2])):
            gap = r.choice([" ", " ", " ", "\n", ", ", ": "])
            parts += [("O", gap), made_up(r) if r.random() < 0.7 else ("O", distractor(r)), ("O", r.choice([" ", ".", ", ", "!!", "\n", "%%%"]))]
            at = r.randrange(max(1, len(t) - WINDOW))
            parts.append(("O", t[at : at + r.randint(5, 40)]))
        text, tags = "", []
        for kind, s in parts:
            text += s
            tags += ["O"] * len(s) if kind == "O" else [f"B-{kind}", *[f"I-{kind}"] * (len(s) - 1)]
        for kind, a, b in base_spans(text):
            if all(x == "O" for x in tags[a:b]):
                tags[a:b] = [f"B-{kind}", *[f"I-{kind}"] * (b - a - 1)]
        start = r.randrange(max(1, len(text) - WINDOW + 1))
        # a span that the window cuts goes on inside it as if it began there
        cut = tags[start : start + WINDOW]
        if cut and cut[0][0] == "I":
            cut[0] = "B" + cut[0][1:]
        text = text[start : start + WINDOW].ljust(WINDOW)
        cut += ["O"] * (WINDOW - len(cut))
        out.append((char_ids(text), np.array([TAGS.index(x) for x in cut])))
    return out


def needed(text: str, base: list[tuple[str, int, int]]) -> list[int]:
    """Numbers of the windows (from STRIDE times the number on) to read: see above."""
    taken, out, k, last = sorted((a, b) for _, a, b in base), set(), 0, max(0, len(text) - 1) // STRIDE
    for m in TRIGGER.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] <= m.start():
            continue
        here = m.start() // STRIDE
        out.update(range(max(0, here - WINDOW // STRIDE + 1 - SIDE), min(last, here + SIDE) + 1))
    return sorted(out)


#: The middle of a window weighs most where windows overlap.
WEIGHT = (1 - np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2) / (WINDOW / 2)).astype(np.float32)[:, None]


class Stretch:
    """Windows of a text (number i) that follow one another, and the sums of their emissions."""

    def __init__(self, i: int, windows: list[int], ids: np.ndarray):
        self.i, self.windows, self.at = i, windows, windows[0] * STRIDE
        size = min(len(ids) - self.at, (windows[-1] - windows[0]) * STRIDE + WINDOW)
        self.ids, self.total, self.mass = ids[self.at : self.at + size], np.zeros((size, len(TAGS)), np.float32), np.full((size, 1), 1e-6, np.float32)

    def add(self, window: int, e: np.ndarray) -> None:
        a = window * STRIDE - self.at
        n = min(WINDOW, len(self.ids) - a)
        self.total[a : a + n] += e[:n] * WEIGHT[:n]
        self.mass[a : a + n] += WEIGHT[:n]


def stretches(i: int, windows: list[int], ids: np.ndarray) -> list[Stretch]:
    runs: list[list[int]] = []
    for w in windows:
        if runs and w - runs[-1][-1] < WINDOW // STRIDE + 1:
            runs[-1].append(w)
        else:
            runs.append([w])
    return [Stretch(i, r, ids) for r in runs]


def decode(tagger: Tagger, done: list[Stretch], texts: list[str], out: list[list[tuple[str, int, int]]]) -> None:
    """Tag stretches whose windows are all read, and add to out what reads as its kind."""
    done.sort(key=lambda s: -len(s.ids))
    while done:
        lanes = max(1, DECODE // len(done[0].ids))
        some, done[:lanes] = done[:lanes], []
        lengths = np.array([len(s.ids) for s in some])
        e = np.zeros((lengths[0], len(some), len(TAGS)), np.float32)
        for k, s in enumerate(some):
            e[: lengths[k], k] = s.total / s.mass
        tags = tagger.viterbi(e, lengths)
        for k in np.flatnonzero(tags.any(axis=0)).tolist():
            s, start = some[k], None
            for j, tag in enumerate([*tags[: lengths[k], k].tolist(), 0]):
                if start is not None and TAGS[tag][0] != "I":
                    out[s.i] += within(TAGS[tags[start, k]][2:], texts[s.i], s.at + start, s.at + j)
                    start = None
                if TAGS[tag][0] == "B":
                    start = j


def tag_texts(tagger: Tagger, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans that the network adds, for each text: those that overlap no base span and none before them."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    jobs: list[tuple[Stretch, int]] = []
    held: list[Stretch] = []

    def read() -> None:
        x = np.full((WINDOW, len(jobs)), 32, np.int64)
        for k, (s, w) in enumerate(jobs):
            part = s.ids[w * STRIDE - s.at :][:WINDOW]
            x[: len(part), k] = part
        e = tagger.emissions(x)
        for k, (s, w) in enumerate(jobs):
            s.add(w, e[:, k])
        jobs.clear()

    for i, (text, base) in enumerate(zip(texts, bases)):
        windows = needed(text, base)
        for s in stretches(i, windows, char_ids(text)) if windows else ():
            held.append(s)
            for w in s.windows:
                jobs.append((s, w))
                if len(jobs) == GROUP:
                    read()
        if sum(len(s.ids) for s in held) >= DECODE or i + 1 == len(texts):
            if jobs:
                read()
            decode(tagger, held, texts, out)
    for i, found in enumerate(out):
        if found:
            out[i] = apart(found, bases[i])
    return out


def apart(found: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans of found, by start, that overlap no base span and none kept before them."""
    taken, kept, k, end = sorted((a, b) for _, a, b in base), [], 0, 0
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        while k < len(taken) and ends[k] <= a:
            k += 1
        if a >= end and (k == len(taken) or taken[k][0] >= b):
            kept.append((kind, a, b))
            end = b
    return kept


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> Tagger:
    """The network, trained on at most SAMPLE texts' contexts; without texts, on the made-up spans alone."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text != ''")
    first = F.broadcast(rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct())
    texts = rows.join(first, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE)
    tagger = Tagger()
    tagger.train(labelled_windows([r["text"] for r in texts.toLocalIterator()]), steps)
    return tagger


SCHEMA = fields("n_email long,n_ip long,n_card long,n_phone long,base_spans string,spans string,n_spans long")
#: Texts whose windows are read together.
TEXTS = 256


def scan(text: Column, tagger: Tagger) -> Column:
    """A struct of counts by kind, base spans and all spans ("kind:start:end" by kind, then start)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = []
            for at in range(0, len(column), TEXTS):
                texts = [t or "" for t in column.slice(at, TEXTS).to_pylist()]
                bases = [base_spans(t) for t in texts]
                for base, more in zip(bases, tag_texts(tagger, texts, bases)):
                    every = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
                    rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), span_text(base), span_text(every), len(every)))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=SCHEMA.names)

    return F.arrow_udf(run, SCHEMA).asNondeterministic()(text)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, base spans' counts by kind and digest, all spans and their number."""
    tagger = tagger or fit(docs, id_col, text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col), tagger).alias("f"))
    return found.select("doc_id", "f.n_email", "f.n_ip", "f.n_card", "f.n_phone",
                        F.sha2(F.col("f.base_spans"), 256).alias("base_sha256"), "f.spans", "f.n_spans")
