"""Language-model scoring: a gated recurrent unit with a class-factored softmax, and a unigram base.

Tokens are words between ASCII white space, with A-Z lowered, and one end for each text.  Counts are taken over
all training texts (a shuffle that grows with the corpus).  The softmax's vocabulary is the HEAD most frequent tokens and
one stand-in for each shape of the others (kind of last character, short or long, plain letters or not); vocabulary entries of a shape form
classes of up to CLASS members, and P(token) = P(class | state) P(entry | class, state), times, for stand-ins, the
token's smoothed share of its shape by corpus counts.  An unseen token takes its shape's share of a single
unseen word, as in the base.

The recurrent weights are trained in numpy by backpropagation through windows of WINDOW tokens, the state carried on.  They
start from STEPS steps over at most SAMPLE texts chosen by a hash of their ids; then every token of all training texts
is learned from once: each task goes on from there over its texts, and the tasks' weights are averaged by their tokens, in two levels of
partial sums.  Scoring carries the state across windows too, so a text's
log-probability is that of the whole text.  Counts of the most frequent tokens, KNOWN at most, travel with the tasks; those of the
others are joined in by a shuffle.

Texts are read by whole columns in Arrow, split(), and shapes of tokens by shapes(); tokens() and shape() say the same of one text or token.

Null texts count as empty: their one token is the end.  Repeated rows each count in the corpus, and get equal
scores.  Without any training text all counts are 0 and the network stays as initialised.
"""

import ctypes
import math
from itertools import batched
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, stage

END = b""
SMOOTH = 0.1
HEAD = 2000
KNOWN = 200_000
CLASS = 48
EMBED, HIDDEN = 24, 32
#: Columns of each gate's weights: update, reset, candidate.
GATES = [slice(i * HIDDEN, (i + 1) * HIDDEN) for i in range(3)]
WINDOW = 32
#: Lanes and window of scoring.
LANES, SPAN = 192, 64
#: Groups of texts whose scoring may have begun and not ended.
OPEN = 4
#: Texts that the recurrent weights start from, at most, and steps over them.
SAMPLE = 1500
STEPS = 500
#: Lanes of a task that learns from its texts, tokens of a lane at a time, and its rate.
LEARN_LANES, LEARN_SPAN, LEARN_RATE = 192, 512, 0.002
#: Rows that are multiplied together.
BLOCK = 512
#: Rows whose logits are held at a time, so that they stay in a processor's cache.
PIECE = 3072
#: What counts as 0 in gradients: numbers whose squares a processor would only handle slowly.
TINY = np.float32(1e-15)
#: Distinct tokens that a counting task holds before it passes them on.
HOLD = 400_000

LAST = {c: i for i, c in enumerate(b"., %*#$&!|", 2)}
LAST_OF = np.array([LAST.get(c, 1 if c >= 128 or chr(c).isalnum() else 12) for c in range(256)])


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts in turn, with an END after those of each, and where each text's stop."""
    t = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    t = pc.binary_join_element_wise(t, pc.if_else(pc.equal(t, ""), "", " "), "")  # a last space leaves an empty token behind it
    lists = pc.ascii_split_whitespace(t)
    return lists.values.cast(pa.binary()), lists.offsets.to_numpy()[1:]


def shape(token: bytes) -> int:
    """A number for a token's form."""
    if not token:
        return 0
    plain = token.isascii() and not any(48 <= c < 58 for c in token)
    return int(1 + (LAST_OF[token[-1]] * 2 + (len(token) < 6)) * 2 + plain)


#: Bytes that no plain token has.
ODD = np.array([c >= 128 or 48 <= c < 58 for c in range(256)])


def shapes(words: pa.Array) -> np.ndarray:
    """The shapes of binary tokens."""
    _, ends, data = pa.concat_arrays([words, pa.array([b" "])]).buffers()  # so that there is a byte
    ends, data = np.frombuffer(ends, np.int32)[: len(words) + 1], np.frombuffer(data, np.uint8)
    odd, size = np.concatenate([[0], np.cumsum(ODD[data[: ends[-1]]])])[ends], np.diff(ends)
    return np.where(size > 0, 1 + (LAST_OF[data[ends[1:] - 1]] * 2 + (size < 6)) * 2 + (np.diff(odd) == 0), 0)


N_SHAPES = 1 + 13 * 4


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over the column `text`, the end included."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).rename_columns(schema.names)

        for batch in batches:
            found = pc.value_counts(split(batch.column(0))[0])
            held.append(pa.table([found.field(0), found.field(1)], schema=schema))
            size += len(found)
            if size > 2 * HOLD:
                held = [merged()]
                size = len(held[0])
                if size > HOLD:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from merged().to_batches()
        held = []
        give_back()

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def most_frequent(counts: DataFrame, known: int) -> list[tuple[bytes, int]]:
    """The tokens with the largest counts, in their order: as many whole levels of frequency as hold `known` tokens
    at most.  A histogram of the levels finds where to stop, so no task sorts the vocabulary."""
    level = F.floor(64 * F.log2("c"))
    levels = counts.groupBy(level.alias("at")).agg(F.count("*").alias("n")).collect()  # 64 levels a doubling
    total, least = 0, None
    for r in sorted(levels, key=lambda r: -r["at"]):
        total += r["n"]
        if total > known:
            break
        least = r["at"]
    if least is None:
        return []
    top = counts.filter(level >= least).select("token", "c").toArrow()
    return sorted(((bytes(t), c) for t, c in zip(*(x.to_pylist() for x in top.columns))), key=lambda r: (-r[1], r[0]))


class Vocabulary:
    """Entries of the softmax in the order of their classes, and what is known of tokens."""

    def __init__(self, known: list[tuple[bytes, int]], by_shape: dict[int, tuple[int, int]], total: int, distinct: int, head: int = HEAD):
        top = [t for t, _ in known[:head]]
        entries: list[tuple[int, bytes | None]] = [(s, None) for s in range(N_SHAPES)] + [(shape(t), t) for t in top]
        entries.sort(key=lambda e: (e[0], e[1] is not None))
        self.start, self.klass = [], np.zeros(len(entries), np.int64)
        place: dict[bytes, int] = {}
        self.stand_in = np.zeros(N_SHAPES, np.int64)
        for i, (s, t) in enumerate(entries):
            if i % CLASS == 0:  # neighbours in the order of shapes share a class
                self.start.append(i)
            self.klass[i] = len(self.start) - 1
            if t is None:
                self.stand_in[s] = i
            else:
                place[t] = i
        self.start = np.array([*self.start, len(entries)])
        self.size = len(entries)
        self.total, self.distinct = total, distinct
        self.base_norm = math.log10(total + SMOOTH * (distinct + 1))
        # the shapes' sums without the softmax's own tokens
        rest = {s: [n, v] for s, (n, v) in by_shape.items()}
        for t, c in known[:head]:
            rest[shape(t)][0] -= c
            rest[shape(t)][1] -= 1
        self.norm = np.array([math.log10(n + SMOOTH * (v + 1)) for n, v in (rest.get(s, (0, 0)) for s in range(N_SHAPES))])
        self.known = pa.array([t for t, _ in known], pa.binary())
        n = len(known)
        shapes = np.array([shape(t) for t, _ in known], np.int64)
        self.log_count = np.log10(np.array([c for _, c in known], float) + SMOOTH) if n else np.zeros(0)
        self.entry = np.array([place.get(t, -1) for t, _ in known], np.int64)
        inner = self.entry >= 0
        #: what a known token adds to the network's log-probability of its entry
        self.share = np.where(inner, 0.0, self.log_count - self.norm[shapes]) if n else np.zeros(0)
        if n:
            self.entry = np.where(inner, self.entry, self.stand_in[shapes])
        # a last place, -1, for all others
        self.log_count, self.share, self.entry = np.append(self.log_count, 0.0), np.append(self.share, 0.0), np.append(self.entry, 0).astype(np.int32)
        self.end = place.get(END, int(self.stand_in[0]))

    def read(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of each text: entries; sums over known tokens of log10(c+SMOOTH) and of shares, with the norms of unknown ones;
        number of known tokens; the others with their counts in the text."""
        words, at, rest, forms, ends = self._places(texts)
        start = np.concatenate([[0], ends[:-1]])
        share = self.share[at]
        share[rest] = -self.norm[forms]
        others = pa.table({"of": np.searchsorted(ends, rest, side="right"), "token": words.take(pa.array(rest)), "m": np.ones(len(rest), np.int64)})
        others = others.group_by(["of", "token"], use_threads=False).aggregate([("m", "sum")]).sort_by("of").combine_chunks()
        cuts = np.searchsorted(others["of"].to_numpy(), np.arange(len(ends) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.concat_arrays(others[c].chunks) if len(others) else pa.array([], k)
                                            for c, k in (("token", pa.binary()), ("m_sum", pa.int64()))], ["token", "m"])
        return (self._entries(at, rest, forms, ends), np.add.reduceat(self.log_count[at], start), np.add.reduceat(share, start),
                np.diff(ends, prepend=0) - np.diff(np.searchsorted(rest, ends), prepend=0), pa.ListArray.from_arrays(pa.array(cuts), pairs))

    def entries(self, texts: pa.Array) -> list[np.ndarray]:
        return self._entries(*self._places(texts)[1:])

    def _places(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of all texts in turn, their places among the known, where those of others are, these ones' shapes, and the
        texts' ends."""
        words, ends = split(texts)
        at = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy()
        rest = np.flatnonzero(at < 0)
        return words, at, rest, shapes(words.take(pa.array(rest))), ends

    def _entries(self, at: np.ndarray, rest: np.ndarray, forms: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        entry = self.entry[at]
        entry[rest] = self.stand_in[forms]
        return np.split(entry, ends[:-1])


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """A column, GROUP rows at a time."""
    return (column.slice(at, GROUP) for at in range(0, len(column), GROUP))


def flush(x: np.ndarray, tiny: np.float32) -> None:
    """Numbers well below tiny become 0, in place, by two roundings: what is far larger keeps its value to within about tiny."""
    c = tiny * np.float32(1 << 24)
    x += c
    x -= c


def settle() -> None:
    """One large block, taken and given back: from then on the C library keeps the memory of smaller ones, else each of numpy's
    temporary arrays would be taken from the system anew."""
    np.empty(31 << 20, np.uint8)


def give_back() -> None:
    """What is kept but not in use goes back to the system: a task's process may stand idle beside Spark's own for long."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def exp_sums(z: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """exp(z - m) in place and its rows' sums, with the logarithms of the true sums; m is 0 where no value reaches 80."""
    m = z.max(axis=1) if bound > 80 else None
    if m is not None:
        z -= m[:, None]
    np.exp(z, out=z)
    s = np.einsum("ij->i", z)
    return s, np.log(s) if m is None else np.log(s) + m


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for a long a, BLOCK rows at a time: the library takes a shorter way with small matrices."""
    n, out = len(a) // BLOCK * BLOCK, np.empty((len(a), b.shape[1]), np.float32)
    np.matmul(a[:n].reshape(-1, BLOCK, a.shape[1]), b, out=out[:n].reshape(-1, BLOCK, b.shape[1]))
    np.matmul(a[n:], b, out=out[n:])
    return out


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for long ones, likewise."""
    n = len(a) // BLOCK * BLOCK
    out = (a[:n].reshape(-1, BLOCK, a.shape[1]).swapaxes(1, 2) @ b[:n].reshape(-1, BLOCK, b.shape[1])).sum(axis=0)
    out += a[n:].T @ b[n:]
    return out


class Network:
    """Embedding, gated recurrent unit and two-level softmax, in 32-bit numpy."""

    def __init__(self, start: np.ndarray, klass: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        n, c = len(klass), len(start) - 1
        self.start, self.klass = start, klass
        def make(*shape):
            return (r.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": make(n, EMBED) * math.sqrt(n) * 0.3, "W": make(EMBED, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
                  "U": make(HIDDEN, 3 * HIDDEN), "C": make(HIDDEN, c) * 0.1, "cb": np.zeros(c, np.float32),
                  "M": make(HIDDEN, n).T.copy() * 0.1, "mb": np.zeros(n, np.float32)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def prepare(self) -> np.ndarray:
        """Input projections of all entries, by gate; those of the first two gates halved, as run() takes them."""
        E, W = self.p["E"], np.vstack([self.p["W"], self.p["b"]])
        W = np.stack([W[:, g] for g in GATES])
        W[:2] *= np.float32(0.5)
        return np.hstack([E, np.ones((len(E), 1), np.float32)]) @ W

    def run(self, x: np.ndarray, h: np.ndarray, table: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States before each target, for inputs x (time, lanes), and the last state.  Each gate's numbers lie together; the
        logistic function of a is 0.5 + 0.5 tanh(a / 2)."""
        half = np.float32(0.5)
        U = np.stack([self.p["U"][:, g] for g in GATES])
        U[:2] *= half
        out = np.empty((len(x), len(h), HIDDEN), np.float32)
        for t in range(len(x)):
            gx, gh = table.take(x[t], axis=1), h @ U
            zr = gx[:2]
            zr += gh[:2]
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            (z, r), n, rg, part = zr, gx[2], gh[2], gh[0]
            rg *= r
            n += rg
            np.tanh(n, out=n)
            np.subtract(h, n, out=part)
            part *= z
            if keep is not None:
                keep.append((h, z, r, n, rg, part))
            h = np.add(part, n, out=out[t])
        return out, h.copy()

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of entries y after states h; with grads, the loss's gradient too.  Rows go in the order of their
        entries' classes, so those of a class lie together, and by PIECE of them.  A last number of each state, 1, takes the biases."""
        p, n = self.p, len(y)
        order = np.argsort(self.klass[y].astype(np.int16), kind="stable")
        C, M = np.vstack([p["C"], p["cb"]]), np.hstack([p["M"], p["mb"][:, None]])
        # states lie within -1 and 1, which bounds what the logits can be
        bounds = [float(np.abs(w).sum(axis=1).max()) for w in (C.T, M)]
        result, dh, gc, gm = np.empty(n), np.empty((n, HIDDEN), np.float32), np.zeros_like(C), np.zeros_like(M)
        back_C, width = p["C"].T.copy(), int(np.diff(self.start).max())
        for first in range(0, n, PIECE):
            rows = order[first : first + PIECE]
            own_y, at = y[rows], np.arange(len(rows))
            k = self.klass[own_y]
            h1 = np.ones((len(rows), HIDDEN + 1), np.float32)
            h1[:, :HIDDEN] = h.take(rows, axis=0)
            e, z = times(h1, C), np.empty((len(rows), width), np.float32)
            target, member = at * e.shape[1] + k, at * width + own_y - self.start[k]
            # the members' logits of each row's own class, in one table
            cuts = np.searchsorted(k, np.arange(k[0], k[-1] + 2)).tolist()
            parts = [(slice(i, min(i + BLOCK, j)), slice(self.start[c], self.start[c + 1]))
                     for c, j0, j in zip(range(k[0], k[-1] + 1), cuts, cuts[1:]) for i in range(j0, j, BLOCK)]
            for i, members in parts:
                w = members.stop - members.start
                np.matmul(h1[i], M[members].T, out=z[i, :w])
                if w < width:
                    z[i, w:] = -np.inf
            out = e.ravel().take(target).astype(np.float64) + z.ravel().take(member)
            (s, log_s), (s2, log_s2) = exp_sums(e, bounds[0]), exp_sums(z, bounds[1])
            out -= log_s
            out -= log_s2
            result[rows] = out
            if grads is None:
                continue
            for d, own, total in ((e, target, s), (z, member, s2)):
                d *= (1 / total)[:, None]
                d.ravel()[own] -= 1
            gc += crossed(h1, e)
            back = times(e, back_C)
            for i, members in parts:
                own = z[i, : members.stop - members.start]
                gm[members] += own.T @ h1[i]
                back[i] += own @ p["M"][members]
            dh[rows] = back
        if grads is None:
            return result, None
        grads["C"], grads["cb"], grads["M"], grads["mb"] = gc[:HIDDEN], gc[HIDDEN], gm[:, :HIDDEN].copy(), gm[:, HIDDEN].copy()
        return result, dh

    def train(self, stream: np.ndarray, end: int, steps: int, lanes: int = 48, rate: float = 0.012) -> float:
        """Adam over windows of the token stream, dealt to lanes; returns the last windows' mean loss."""
        if len(stream) < lanes * (WINDOW + 1):
            lanes = max(1, len(stream) // (WINDOW + 1))
        per = len(stream) // lanes if lanes else 0
        if per < 2:
            return 0.0
        lane = stream[: per * lanes].reshape(lanes, per).T
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        h, at, recent = np.zeros((lanes, HIDDEN), np.float32), 0, []
        for step in range(1, steps + 1):
            if at + 1 >= per:
                at, h = 0, np.zeros_like(h)
            part = lane[at : at + WINDOW + 1]
            x, y = part[:-1], part[1:]
            at += WINDOW
            loss, h = self.step(x, y, h, m, v, step, rate * min(1.0, step / 20) * (0.05 ** (step / steps)))
            recent = [*recent[-19:], loss]
        return float(np.mean(recent))

    def step(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, m: dict, v: dict, step: int, lr: float) -> tuple[float, np.ndarray]:
        """One of Adam's steps, on a window from states h; its mean loss and the states after it."""
        table, keep, g = self.prepare(), [], {}
        states, h_next = self.run(x, h, table, keep)
        logp, dh = self.log_probs(states.reshape(-1, HIDDEN), y.reshape(-1), g)
        n, H, one = len(logp), HIDDEN, np.float32(1)
        dh = dh.reshape(states.shape)
        back = np.stack([self.p["U"][:, gate].T for gate in GATES])
        # of the three gates' sums, the third as it takes the last state, and of the third's inputs
        dx = np.empty((4, *states.shape), np.float32)
        nxt = np.zeros_like(dh[0])
        for t in range(len(x) - 1, -1, -1):
            _, z, r, c, rg, part = keep[t]
            dz, dr, du, dn = dx[:, t]
            nxt += dh[t]
            kept = nxt * z
            nxt -= kept
            np.multiply(part, nxt, out=dz)
            np.multiply(c, c, out=dn)
            np.subtract(one, dn, out=dn)
            dn *= nxt
            np.multiply(dn, r, out=du)
            np.subtract(dn, du, out=dr)
            dr *= rg
            nxt, more, most = dx[:3, t] @ back
            nxt += more
            nxt += most
            nxt += kept
        before = np.concatenate([keep[0][0][None], states[:-1]])
        g["U"] = np.hstack((before.swapaxes(1, 2) @ dx[:3]).sum(axis=1))
        dz, dr, du, dn = dx.reshape(4, -1, H)
        # sums by entry, which the gradients of embeddings and input weights need; added two numbers at a time
        ids = x.reshape(-1)
        order = np.argsort(ids.astype(np.int16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        some, sums = ids[first], [np.add.reduceat(d.take(order, axis=0).view(np.complex64), first, axis=0) for d in (dz, dr, dn)]
        sums = np.hstack(sums).view(np.float32)
        g["W"], g["b"] = self.p["E"][some].T @ sums, sums.sum(axis=0)
        g["E"] = np.zeros_like(self.p["E"])
        g["E"][some] = sums @ self.p["W"].T
        norm = math.sqrt(sum(float(np.vdot(q, q)) for q in g.values())) / n
        clip = min(1.0, 1.0 / (norm + 1e-9)) / n
        # a tenth of the gradient, whose square is a hundredth; the second mean's correction is taken out of the root
        root = math.sqrt(1 - 0.99**step)
        tenth, least, fall = np.float32(0.1 * clip), np.float32(1e-7 * root), np.float32(lr * root / (1 - 0.9**step))
        for k, q in g.items():
            q *= tenth
            flush(q, TINY)
            m[k] *= np.float32(0.9)
            m[k] += q
            q *= q
            v[k] *= np.float32(0.99)
            v[k] += q
            if step % 64 == 0:  # until then what is not 0 stays large enough
                flush(m[k], TINY)
                flush(v[k], TINY * TINY)
            np.sqrt(v[k], out=q)
            q += least
            np.divide(m[k], q, out=q)
            q *= fall
            self.p[k] -= q
        return -float(logp.mean()), h_next

    def learn(self, streams: Iterator[np.ndarray], end: int, lanes: int = LEARN_LANES, rate: float = LEARN_RATE) -> int:
        """Adam over windows of all texts' entries, each a target once; returns their number."""
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        held, size, step, seen = [np.array([end])], 1, 0, 0

        def spend(stream: np.ndarray, lanes: int) -> np.ndarray:
            nonlocal step, seen
            per = (len(stream) - 1) // lanes
            lane = np.lib.stride_tricks.as_strided(stream, (per + 1, lanes), (stream.itemsize, per * stream.itemsize))
            h = np.zeros((lanes, HIDDEN), np.float32)
            for a in range(0, per, WINDOW):
                part, step = lane[a : a + WINDOW + 1], step + 1
                _, h = self.step(part[:-1], part[1:], h, m, v, step, rate * min(1.0, step / 20))
                seen += part[1:].size
            return stream[lanes * per :]

        for text in streams:
            for a in range(0, len(text), lanes * LEARN_SPAN):
                held.append(text[a : a + lanes * LEARN_SPAN])
                size += len(held[-1])
                if size > lanes * LEARN_SPAN:
                    held = [spend(np.concatenate(held), lanes)]
                    size = len(held[0])
        rest = np.concatenate(held)
        while len(rest) > 1:
            rest = spend(rest, max(1, min(lanes, (len(rest) - 1) // WINDOW)))
        return seen

    def score(self, texts: list[np.ndarray], end: int, lanes: int = LANES) -> np.ndarray:
        """Natural log-probability of each whole text."""
        return next((logp for _, logp in self.score_groups(iter([texts]), end, lanes)), np.zeros(0))

    def score_groups(self, groups: Iterator[list[np.ndarray]], end: int, lanes: int = LANES) -> Iterator[tuple[int, np.ndarray]]:
        """Natural log-probabilities of the whole texts of each group, with the group's number, as soon as its last text is done.
        Texts take turns in the lanes, the longest of a group first, and the next group's fill the lanes that fall free, while OPEN
        groups at most are under way.  Each text starts from the zero state after an end, and keeps its state from window to window."""
        table, made, more = self.prepare(), 0, True
        flat, waiting, out, left = np.zeros(0, np.int32), np.zeros((0, 4), np.int64), {}, {}
        # of the texts in the lanes: group, place in it, next token and stop within flat; the entries before these, and states
        live, last, h = waiting, np.zeros(0, np.int64), np.zeros((0, HIDDEN), np.float32)
        while True:
            while more and len(live) + len(waiting) < lanes and len(out) < OPEN:
                texts = next(groups, None)
                if texts is None:
                    more = False
                    break
                sizes = np.array([len(t) for t in texts], np.int64)
                order = np.argsort(sizes, kind="stable")[::-1]
                new = np.stack([np.full(len(order), made), order, np.zeros_like(order), sizes[order]], axis=1)
                rest = np.concatenate([live, waiting])
                flat = np.concatenate([flat[:0], *(flat[a:b] for a, b in rest[:, 2:].tolist()), *(texts[i] for i in order)])
                rest = np.concatenate([rest, new])
                rest[:, 3] = np.cumsum(rest[:, 3] - rest[:, 2])
                rest[:, 2] = np.concatenate([[0], rest[:-1, 3]])
                live, waiting = rest[: len(live)], rest[len(live) :]
                out[made], left[made] = np.zeros(len(texts)), len(texts)
                made += 1
            free = lanes - len(live)
            begun, waiting = waiting[:free], waiting[free:]
            live = np.concatenate([live, begun])
            last, h = np.append(last, np.full(len(begun), end)), np.concatenate([h, np.zeros((len(begun), HIDDEN), np.float32)])
            size = min(SPAN, int((live[:, 3] - live[:, 2]).max(initial=0)))
            if size:
                at = live[:, 2] + np.arange(size)[:, None]
                real = at < live[:, 3]
                y = flat.take(at, mode="clip")
                states, h = self.run(np.concatenate([last[None], y[:-1]]), h, table)
                logp = np.zeros(y.shape)
                logp[real] = self.log_probs(states[real], y[real])[0]
                sums, last = logp.sum(axis=0), y[-1]
                live[:, 2] += size
                for g in np.unique(live[:, 0]).tolist():
                    own = live[:, 0] == g
                    out[g][live[own, 1]] += sums[own]
            stay = live[:, 2] < live[:, 3]
            for g, n in zip(*(x.tolist() for x in np.unique(live[~stay, 0], return_counts=True))):
                left[g] -= n
            live, last, h = live[stay], last[stay], h[stay]
            for g in [g for g, n in left.items() if not n]:
                yield g, out.pop(g)
                del left[g]
            if not (more or out):
                return


def learn_all(texts: DataFrame, vocabulary: Vocabulary, network: Network) -> int:
    """Let the network learn from the whole column `text`, on Spark; returns the number of tokens."""
    held = texts.sparkSession.sparkContext.broadcast((vocabulary, network.p))
    schema = pa.schema([("n", pa.int64()), ("w", pa.binary())])

    def row(n: int, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start = held.value
        own = Network(vocabulary.start, vocabulary.klass)
        own.p = {k: w.copy() for k, w in start.items()}
        settle()
        with np.errstate(over="ignore"):
            n = own.learn((e for b in batches for texts in slices(b.column(0)) for e in vocabulary.entries(texts)), vocabulary.end)
        if n:
            yield row(n, np.concatenate([own.p[k].ravel() for k in sorted(own.p)]).astype(np.float64) * n)
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for b in batches:
            for k, w in zip(*(c.to_pylist() for c in b.columns)):
                n, total = n + k, total + np.frombuffer(w)
        if n:
            yield row(n, total)

    tasks = stage(texts.sparkSession, texts.select("text").mapInArrow(run, "n long, w binary"), "lm-weights")
    few = max(1, math.isqrt(tasks.count()))
    n, total = 0, 0.0
    for r in tasks.repartition(few).mapInArrow(add, "n long, w binary").toLocalIterator():
        n, total = n + r["n"], total + np.frombuffer(bytes(r["w"]))
    at = 0
    for k in sorted(network.p) if n else ():
        size = network.p[k].size
        network.p[k] = (total[at : at + size] / n).reshape(network.p[k].shape).astype(np.float32)
        at += size
    return n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, known: int = KNOWN,
        steps: int = STEPS) -> tuple[Vocabulary, Network, DataFrame]:
    """The vocabulary, the trained network, and all counts (token, c) of the training texts."""
    spark = docs.sparkSession
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(bucket(F.col(id_col), 10) != 0)
    counts = stage(spark, count_tokens(train), "lm-counts")

    def shapes_of(column: pa.Array) -> pa.Array:
        return pa.array(shapes(column), pa.int32())

    shapes_of.__annotations__ = {"column": pa.Array, "return": pa.Array}
    sums = counts.groupBy(F.arrow_udf(shapes_of, "int")("token").alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    by_shape = {r["s"]: (r["n"], r["v"]) for r in sums}
    rows = most_frequent(counts, known)
    vocabulary = Vocabulary(rows, by_shape, sum(n for n, _ in by_shape.values()), sum(v for _, v in by_shape.values()), head)
    first = train.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = train.join(F.broadcast(first.distinct()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE)
    stream = [np.array([vocabulary.end])]
    for some in batched(texts.select("text").toLocalIterator(), 100):  # a start only: learn_all reads all of every text
        stream += vocabulary.entries(pa.array([r["text"] for r in some], pa.string()))
    network = Network(vocabulary.start, vocabulary.klass)
    with np.errstate(over="ignore"):
        network.train(np.concatenate(stream), vocabulary.end, steps)
    learn_all(train, vocabulary, network)
    return vocabulary, network, counts


#: What scoring a text gives besides its id.
NAMES = ["uid", "n", "n_known", "base", "score", "others"]
SCORED_SQL = "uid long, n long, n_known long, base double, score double, others array<struct<token:binary,m:long>>"
#: Texts that are read or scored together.
GROUP = 4096


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row for each row of docs: doc_id (of any type), held_out, n_tokens, n_known, train_tokens, base_score, score, and both scores a
    token."""
    spark = docs.sparkSession
    vocabulary, network, counts = fit(docs, id_col, text_col, **settings)
    held = spark.sparkContext.broadcast((vocabulary, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = held.value
        part, count, held_back = TaskContext.get().partitionId(), 0, {}
        settle()

        def groups() -> Iterator[list[np.ndarray]]:
            nonlocal count
            made = 0
            for batch in batches:
                for at in range(0, batch.num_rows, GROUP):
                    ids, texts = (c.slice(at, GROUP) for c in batch.columns)
                    entries, base, share, n_known, others = vocabulary.read(texts)
                    n = np.array([len(e) for e in entries])
                    held_back[made] = share, [ids, pa.array((part << 40) + count + np.arange(len(ids))), pa.array(n), pa.array(n_known),
                                              pa.array(base - n * vocabulary.base_norm)], others
                    count, made = count + len(ids), made + 1
                    yield entries

        with np.errstate(over="ignore"):
            for k, logp in network.score_groups(groups(), vocabulary.end):
                share, made, others = held_back.pop(k)
                yield pa.RecordBatch.from_arrays([*made, pa.array(logp / math.log(10) + share), others], names=["doc_id", *NAMES])
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCORED_SQL}"
    scored = stage(spark, rows.mapInArrow(run, schema), "lm-scored")
    # tokens beyond the known ones: their counts come by a join
    others = scored.select("uid", F.explode("others").alias("o")).select("uid", "o.token", "o.m")
    found = others.join(counts, "token", "left").groupBy("uid").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more_known"))
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return scored.drop("others").join(found, "uid", "left").select(
        "doc_id", (bucket(F.col("doc_id"), 10) == 0).alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("n_known") + more_known).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
        ((F.col("base") + more) / F.col("n")).alias("base_per_token"), ((F.col("score") + more) / F.col("n")).alias("score_per_token"))
