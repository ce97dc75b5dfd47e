"""Secret scans: fixed patterns, and runs of high entropy within windows.

Base spans are the leftmost, non-overlapping matches of three patterns (assignments, access keys, long hex
runs).  A candidate string besides them belongs to the narrowest character class that it is drawn from (hex, alphanumeric, base 64), and
is slid over with a window of fixed length; the Shannon entropy of the window's characters is kept by adding and removing one
character's count a step.  A window whose entropy reaches the class's threshold marks the candidate as a secret, unless the
allow-list clears it.

Null or empty texts have no spans.  Repeated rows each get the same spans.  Whole texts are scanned; the
patterns take linear time, so very long texts only take longer.  Extra columns pass through untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, span_text, text_udf

ASSIGN = re.compile(
    r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of hex characters are maximal, so the leftmost ones of 24 or more are these.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex")

WINDOW = 20
#: Bits a character from which a window counts, by what the candidate is made of.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Strings that look random but are none: placeholders, UUIDs, runs of words joined by marks, one letter case.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"(?i)(?:example|sample|dummy|placeholder|changeme|redacted|xxxx)",
        r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
        r"^[A-Za-z]*$",
        r"^[0-9=_+/-]*$",
        r"^(?:[A-Za-z]+|[0-9]+)(?:[-_/=+](?:[A-Za-z]+|[0-9]+))*$",
        r"(.)\1{7,}",
    )
)


def char_class(s: str) -> str | None:
    """Which alphabet a candidate is drawn from; None if letters and digits don't mix."""
    digit, alpha = any("0" <= c <= "9" for c in s), any(c.isalpha() for c in s)
    if not (digit and alpha):
        return None
    if all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s):
        return "hex"
    return "base64" if any(c in "+/=_-" for c in s) else "alnum"


def peak_entropy(s: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits, of any window of s.  sum(c*log2 c) changes by one
    character's count that comes in and one that goes out at each step."""
    n = min(window, len(s))
    if n == 0:
        return 0.0
    xlog = [0.0] + [k * math.log2(k) for k in range(1, n + 2)]
    count: dict[str, int] = {}
    total = 0.0
    best = 0.0
    for i, c in enumerate(s):
        k = count.get(c, 0)
        total += xlog[k + 1] - xlog[k]
        count[c] = k + 1
        if i >= n:
            out = s[i - n]
            k = count[out]
            total += xlog[k - 1] - xlog[k]
            count[out] = k - 1
        if i >= n - 1:
            best = max(best, math.log2(n) - total / n)
    return best


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's matches, by start, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entropy_spans(text: str, taken: Iterable[tuple[str, int, int]] = ()) -> list[tuple[str, int, int]]:
    """Candidates of high entropy that overlap no span of `taken` and that no allow-list entry clears."""
    taken = sorted((a, b) for _, a, b in taken)
    out, k, end = [], 0, 0  # end: the furthest that a span reaches which begins before the candidate's end
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            end = max(end, taken[k][1])
            k += 1
        s = m.group()
        kind = char_class(s)
        if kind is None or m.start() < end:
            continue
        if peak_entropy(s) >= THRESHOLDS[kind] and not any(p.search(s) for p in ALLOW):
            out.append(("entropy", *m.span()))
    return out


def _scan(text: str) -> tuple:
    base = base_spans(text)
    both = sorted(base + entropy_spans(text, base), key=lambda s: (s[1], s[0] == "entropy", s[0]))
    n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    return (*n, span_text(base), span_text(both), len(both))


SCHEMA = fields("n_assign long,n_access long,n_hex long,base_spans string,spans string,n_spans long")


def scan(text: Column) -> Column:
    """A struct with counts by kind, the base spans and all spans ("kind:start:end", comma-joined)."""
    return text_udf(SCHEMA, lambda: _scan)(text)


def _redact(text: str) -> tuple:
    base = base_spans(text)
    out, at = [], 0
    for kind, a, b in sorted(base + entropy_spans(text, base), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind}>"] if a >= at else []
        at = b
    return ("".join(out) + text[at:],)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each secret of the text column is replaced by its kind in angle brackets; overlapping ones by one
    mark.  Nulls stay null."""
    masked = text_udf(fields("text string"), lambda: _redact)(F.col(text_col))["text"]
    return docs.withColumn(text_col, F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(masked))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, base spans' counts by kind and digest, all spans and their number."""
    found = docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("found"))
    return found.select(
        "doc_id", "found.n_assign", "found.n_access", "found.n_hex",
        F.sha2(F.col("found.base_spans"), 256).alias("base_sha256"), "found.spans", "found.n_spans",
    )
