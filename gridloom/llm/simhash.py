"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints. A document's words (ASCII lower-cased, cut at white space) form shingles; each is
hashed by XXH64, and a bit of the fingerprint is set if it is set in over half of the hashes.

Anchors. Places of the fingerprint are cut into blocks, and in each block a perfect code gives the
anchors: every word lies within the covering radius R of exactly one code word (Golay [23, 12],
R = 3; Hamming [15, 11], R = 1). If x and y differ in at most t bits, the anchor of x, which is
within R of x in each block, is within R + e_i of y in block i for some e_1 + e_2 + .. <= t. So each
fingerprint has one home anchor, and is replicated to every anchor within R + e_i of it with
e_1 + e_2 + .. <= t; a pair within t bits meets at the home anchor of either. Two Golay blocks, the
default, give 2^24 anchors and about 61 replicas for t = 2; a caller with very many fingerprints can
add a Hamming block on the next 15 bits (2^35 anchors, about 150 replicas) to keep anchors small.
Either layout finds exactly the same links.

Comparison per anchor. Only distinct fingerprints are replicated (copies are one row). Rows are
dealt by anchor and streamed in anchor order; home rows are compared with the rows of their
anchor, and the links found in a batch of anchors are thinned to a spanning forest before they
leave the task, so a group of near copies emits links in proportion to its members, not to its
pairs. A large anchor is not compared pair by pair: within it two fingerprints are within two
bits exactly if they share a point at distance one (or are one bit apart), so points of radius
one are sorted instead, which is linear. Components of the links are found by star steps in Spark.

Results for odd input: null or empty text has no words and fingerprint zero, linked like any
other; fewer words than a shingle make one shingle of the whole sequence; repeated rows have the
same fingerprint and component; null ids are never the name of a component unless all its rows
have null ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts, with_least
from .components import components

SEED = 42


class Code(NamedTuple):
    """A perfect cyclic code: length, generator polynomial, covering radius."""

    length: int
    generator: int
    radius: int

    @property
    def checks(self) -> int:
        return self.generator.bit_length() - 1


GOLAY = Code(23, 0b110001110101, 3)  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
HAMMING = Code(15, 0b10011, 1)  # x^4 + x + 1
#: An anchor with more fingerprints than this is searched by points of radius one: the same links.
PAIRWISE_UP_TO = 64
#: Bytes of replicas for each byte of a fingerprint.
REPLICAS = 130


# --- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle (repeats included) as uint64."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    view = memoryview(line)
    return np.array([digest(view[a:b], SEED) for a, b in zip(starts[: 1 - size or None].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, size: int) -> int:
    """64-bit SimHash as an unsigned integer; zero without words."""
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(h: np.ndarray) -> int:
    """64-bit SimHash of hashes, repeats included."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # bounded memory on very long texts
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, fp`` (fp: the fingerprint's bits as a signed long), one row per row of docs."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = picked.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return picked.mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


# --- the code -------------------------------------------------------------------------------


@cache
def _syndromes(code: Code) -> np.ndarray:
    """Remainder by the generator of each single bit of a block."""
    out = []
    for i in range(code.length):
        r = 1 << i
        for k in range(code.length - 1, code.checks - 1, -1):
            if r >> k & 1:
                r ^= code.generator << (k - code.checks)
        out.append(r)
    return np.array(out, np.int64)


@cache
def _patterns(code: Code, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight <= radius + extra by syndrome: starts, patterns, extra bits."""
    s = _syndromes(code)
    pats, syns, more = [], [], []
    for w in range(code.radius + extra + 1):
        c = np.array(list(combinations(range(code.length), w)), np.int64) if w else np.zeros((1, 0), np.int64)
        pats.append((np.int64(1) << c).sum(1, dtype=np.int64))
        syns.append(np.bitwise_xor.reduce(s[c], axis=1) if w else np.zeros(1, np.int64))
        more.append(np.full(len(c), max(0, w - code.radius), np.int64))
    p, y, m = map(np.concatenate, (pats, syns, more))
    order = np.lexsort((m, y))
    return np.searchsorted(y[order], np.arange((1 << code.checks) + 1)), p[order], m[order]


def _block_anchors(code: Code, x: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, extra bits) of every code word within radius + extra of each row's block."""
    start, pats, more = _patterns(code, extra)
    y = np.zeros_like(x)
    for i, s in enumerate(_syndromes(code)):
        y ^= np.where(x >> i & 1, s, 0)
    n = start[y + 1] - start[y]
    row = np.repeat(np.arange(len(x)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[y], n)
    return row, (x[row] ^ pats[k]) >> code.checks, more[k]  # the message bits name the code word


def anchors(fps: np.ndarray, bits: int, codes: tuple[Code, ...] = (GOLAY, GOLAY)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of all replicas; home marks the one anchor within the radius in each block."""
    u = fps.view(np.uint64)
    row, anchor, used, at = np.arange(len(u)), np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), 0
    for code in codes:
        x = (u >> np.uint64(at) & np.uint64((1 << code.length) - 1)).astype(np.int64)
        at += code.length
        r, a, m = _block_anchors(code, x, bits)
        first = np.searchsorted(r, np.arange(len(u) + 1))
        n = (first[1:] - first[:-1])[row]
        old = np.repeat(np.arange(len(row)), n)
        new = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1][row], n)
        keep = used[old] + m[new] <= bits
        old, new = old[keep], new[keep]
        row, anchor, used = row[old], anchor[old] << (code.length - code.checks) | a[new], used[old] + m[new]
    return row, anchor, used == 0


# --- links ----------------------------------------------------------------------------------


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, as stars on the smallest member of each component."""
    if not len(a):
        return a, b
    nodes, k = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = k[: len(a)], k[len(a) :]
    label = np.arange(len(nodes))
    while True:  # min-label hooking with pointer jumping
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _near(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints of one anchor that connect all pairs within ``bits``."""
    u = x.view(np.uint64)
    if len(x) <= PAIRWISE_UP_TO or bits > 2:
        a, b = [], []
        for k in range(len(x) - 1):
            d = np.bitwise_count(u[k + 1 :] ^ u[k])
            hit = np.flatnonzero(d <= bits) + k + 1
            a.append(np.full(len(hit), x[k]))
            b.append(x[hit])
        return np.concatenate(a), np.concatenate(b)
    # points at distance one, and the fingerprint itself: shared by all pairs within two bits
    ones = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    point = (u[:, None] ^ ones[None, :]).ravel()
    owner = np.repeat(np.arange(len(u)), 65)
    if bits == 1:  # only the fingerprints themselves are meeting points
        keep = np.isin(point, u)
        point, owner = point[keep], owner[keep]
        own = np.searchsorted(np.sort(u), point)
        return x[owner], x[np.argsort(u, kind="stable")[own]]
    order = np.argsort(point, kind="stable")
    same = np.flatnonzero(point[order][1:] == point[order][:-1])
    return x[owner[order][same]], x[owner[order][same + 1]]


def _compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole anchors (rows sorted by anchor)."""
    cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[cut, len(anchor)])
    group = np.repeat(np.arange(len(cut)), size)
    homes = np.zeros(len(cut), np.int64)
    np.add.at(homes, group, home)
    live = (size > 1) & (homes > 0)
    a, b = [], []
    for k in np.flatnonzero(live & (size > PAIRWISE_UP_TO)):
        x, y = _near(np.unique(fp[cut[k] : cut[k] + size[k]]), bits)
        a.append(x)
        b.append(y)
    # all smaller anchors at once: each home row against the rows of its anchor
    mine = np.flatnonzero(home & (live & (size <= PAIRWISE_UP_TO))[group])
    for part in np.array_split(mine, max(1, len(mine) * PAIRWISE_UP_TO >> 22)):
        n = size[group[part]]
        i = np.repeat(part, n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cut[group[part]], n)
        near = (fp[i] != fp[j]) & (np.bitwise_count(fp[i].view(np.uint64) ^ fp[j].view(np.uint64)) <= bits)
        a.append(fp[i[near]])
        b.append(fp[j[near]])
    return _forest(np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(distinct: DataFrame, bits: int = 2, codes: tuple[Code, ...] = (GOLAY, GOLAY)) -> DataFrame:
    """``a, b``: a set of links whose components are those of all pairs within ``bits``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(fps), 1024):
                part = fps[k : k + 1024]
                row, anchor, home = anchors(part, bits, codes)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], names=["anchor", "fp", "home"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []

        def done(parts):
            x = [np.concatenate(c) for c in zip(*parts, strict=True)]
            a, b = _compare(*x, bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            anchor, fp, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield done([*rest, (anchor[:cut], fp[:cut], home[:cut])])
                rest = []
            rest.append((anchor[cut:], fp[cut:], home[cut:]))
            if sum(len(r[0]) for r in rest) and rest[0][0][0] != anchor[-1]:
                yield done(rest[:-1])
                rest = rest[-1:]
        if rest:
            yield done(rest)

    n = parts(distinct, REPLICAS)
    # spread first: a small table of fingerprints has few files, but many replicas
    dealt = distinct.repartition(n, "fp").mapInArrow(deal, "anchor long, fp long, home boolean").repartition(n, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def linked(prints: DataFrame, bits: int = 2, codes: tuple[Code, ...] = (GOLAY, GOLAY)) -> DataFrame:
    """``doc_id, fp, component_id`` of a table ``doc_id, fp``; linking by the fingerprint alone."""
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    groups = materialize(groups, "simhash-groups")
    # the roots of components are fingerprints; their smallest ids name the components
    roots = components(links(groups.select("fp"), bits, codes))
    roots = materialize(roots.select(F.col("node").alias("fp"), "root"), "simhash-roots")
    member = materialize(groups.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-members")
    named = with_least(member, "root", "rep", "component_id").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """Per row: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``."""
    prints = materialize(fingerprints(docs, id_col, text_col, size), "simhash-prints")
    out = linked(prints, bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
