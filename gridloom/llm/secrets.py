"""Secret scans with multipart credential linking.

Strong patterns (assignments of secrets, access key ids, long hexadecimal strings) are reported
wherever they stand. Weak candidates (user or client names, endpoints, opaque tokens) mean little
alone, so they are only reported if a complementary part stands in the same scope: an opaque
token needs an identifier or an endpoint, an identifier or endpoint needs a secret. Scopes are
paragraphs, cut at blank lines; a part that runs over a cut belongs to every scope it touches.

Identifiers, secrets and endpoints are joined as intervals: scopes and parts of a document are
sorted by place once, and each candidate asks by binary search whether its scope holds a part of the
other role, so a document with many candidates takes n log n steps and never makes pairs. All parts
of a scope lie in one document, so the scan is a narrow pass without a shuffle.

Results for odd input: null counts as the empty text, which has no spans (the hash is that of the
empty string); very long texts are read whole; spans that tie on their start are listed by kind and
end; repeated rows, null and repeated ids are rows of their own; extra columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which spans of one place are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "opaque")
STRONG = 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is a whole run, as [0-9a-f]+ is greedy
IDENTIFIER = re.compile(
    r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A
)
ENDPOINT = re.compile(
    r"""\b(?:https?|ftp|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:host(?:name)?|server|endpoint|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{3,}""",
    re.I | re.A,
)
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_ENTROPY = 3.5


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _opaque(token: str) -> bool:
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= MIN_ENTROPY


def strong_spans(text: str) -> list[Span]:
    out = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [Span("hex", *m.span()) for m in HEX.finditer(text)]


class _Parts:
    """Intervals of one role, asked whether any of them touches the scopes of a span."""

    def __init__(self, spans: list[Span], breaks: list[int]):
        spans = sorted((s.start, s.end) for s in spans)
        self.starts = [s for s, _ in spans]
        self.ends = list(accumulate((e for _, e in spans), max))  # the furthest end so far
        self.breaks = breaks

    def near(self, span: Span) -> bool:
        first, last = bisect_right(self.breaks, span.start), bisect_left(self.breaks, span.end)
        k = bisect_left(self.starts, self.breaks[last]) if last < len(self.breaks) else len(self.starts)
        return k > 0 and (first == 0 or self.ends[k - 1] > self.breaks[first - 1])


def find_spans(text: str) -> list[Span]:
    """All spans of a text: the strong ones, and weak ones that a complementary part backs."""
    strong = strong_spans(text)
    identifiers = [Span("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    endpoints = [Span("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    weak: list[Span] = []
    taken = sorted((s.start, s.end) for s in [*strong, *identifiers, *endpoints])
    starts = [s for s, _ in taken]
    ends = list(accumulate((e for _, e in taken), max))  # the furthest end so far
    opaque = []
    if strong or identifiers or endpoints:  # an opaque token alone is never reported
        for m in OPAQUE.finditer(text):
            k = bisect_left(starts, m.end())
            if not (k and ends[k - 1] > m.start()) and _opaque(m.group()):
                opaque.append(Span("opaque", *m.span()))
    if identifiers or endpoints or opaque:
        breaks = [m.start() for m in re.finditer(r"\n[^\S\n]*\n", text)]
        secret = _Parts([*(s for s in strong if s.kind != "access"), *opaque], breaks)
        other = _Parts([*(s for s in strong if s.kind == "access"), *identifiers, *endpoints], breaks)
        weak = [s for s in [*identifiers, *endpoints] if secret.near(s)] + [s for s in opaque if other.near(s)]
    return sorted([*strong, *weak], key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` with spans as an array of ``kind, start, end`` (code points, end exclusive)."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[s._asdict() for s in find_spans(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(item))], names=["doc_id", "spans"])

    return picked.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def digest(spans: DataFrame) -> DataFrame:
    """Counts of strong spans, a hash of their places and all spans as one string, for ``scan``."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    strong = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:STRONG]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:STRONG]],
        F.sha2(F.array_join(F.transform(strong, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"),
        *[count(k).alias(f"n_{k}") for k in KINDS[STRONG:]],
    )


def base_sha256(text: str) -> str:
    """Plain form of the hash in ``digest``, for tests."""
    spans = sorted(strong_spans(text), key=lambda s: (s.start, KINDS.index(s.kind)))
    return hashlib.sha256(joined(spans).encode()).hexdigest()
