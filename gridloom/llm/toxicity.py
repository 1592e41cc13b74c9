"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a learned vector (words of the training sample; all others share one) beside
the mean of learned vectors of its character n-grams, so that unseen forms of a known stem still
count. A GRU reads each window in both directions, attention weighs the places, and a linear
output gives the window's logit. A document's score is that of its highest window; windows of
``WINDOW`` words overlap by ``WINDOW - STRIDE`` and cover the whole text.

Training is one task over a bounded sample, set by a parameter: at most ``PER_CLASS`` labelled
documents a class (smallest salted hashes), each of them whole. Labels are of documents, so after
two epochs over all windows the network learns from the highest window of each document
(multiple-instance learning). The highest of many windows runs higher than that of one, also in
clean texts: how much (by the logarithm of their number) is fitted on the clean documents and taken
off, and the threshold is set on whole documents. The model, a few MB whatever the input, is
broadcast; scoring is a narrow pass in which the gate inputs of each distinct word are worked out
once per worker and kept in a table of bounded size.

Results for odd input: null, empty and wordless texts score 0; very long texts are scored whole;
without labelled rows of both classes every document with words scores the share of toxic training
rows (0 without any); labels that repeat a document count by their largest value, null labels and
labels without a document's text count nowhere, documents that repeat a labelled id teach by one of
their texts; repeated rows and null ids are scored like any other, and equal texts score the same;
extra columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .langid import _Shared, smallest_draws

WINDOW, STRIDE = 48, 32
PER_CLASS = 1000
MAX_WORDS, MIN_DOCS = 20_000, 4
GRAMS = range(3, 7)
GRAM_BITS = 14
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 12, 16, 12
EPOCHS_ALL, EPOCHS_BEST = 2, 6
#: Words whose gate inputs a worker keeps.
TABLE = 250_000
HELD_BIG = 30.0

_words = re.compile(r"\w+").findall


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of all character n-grams of words with their edges marked."""
    c = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(c == 2) - 1
    buckets, owners = [], []
    for n in GRAMS:
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - n + 1 + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        inside = word[: len(h)] == word[n - 1 :]
        buckets.append((h[inside] >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
        owners.append(word[: len(h)][inside])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.int64),) * 2


def _means(table: np.ndarray, buckets: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(owners, kind="stable")
    first = np.searchsorted(owners[order], np.arange(n))
    count = np.bincount(owners, minlength=n)
    out = np.zeros((n, table.shape[1]), np.float32)
    has = np.flatnonzero(count)
    if len(has):
        out[has] = np.add.reduceat(table[buckets[order]], first[has], axis=0) / count[has, None]
    return out


class Network:
    """Parameters, and the forward and backward passes over batches of windows (time first)."""

    def __init__(self, n_words: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        norm = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p: dict[str, np.ndarray] = {
            "words": norm(n_words + 1, WORD_DIM, scale=0.1),
            "grams": norm(1 << GRAM_BITS, CHAR_DIM, scale=0.3),
            "wx": norm(d, 6 * h, scale=d**-0.5),
            "bx": np.tile(np.r_[np.full(h, 1.0), np.zeros(2 * h)], 2).astype(np.float32),
            "u": norm(2, h, 3 * h, scale=h**-0.5),
            "wa": norm(2 * h, ATTENTION, scale=(2 * h) ** -0.5),
            "ba": np.zeros(ATTENTION, np.float32),
            "va": norm(ATTENTION, scale=ATTENTION**-0.5),
            "w": norm(2 * h, scale=(2 * h) ** -0.5),
            "b": np.zeros(1, np.float32),
        }

    def inputs(self, ids: np.ndarray, buckets: np.ndarray, owners: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["words"][ids], _means(self.p["grams"], buckets, owners, len(ids))], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of distinct words, and a last row that holds the state: for padding."""
        g = x @ self.p["wx"] + self.p["bx"]
        pad = np.tile(np.r_[np.full(HIDDEN, HELD_BIG), np.zeros(2 * HIDDEN)], 2).astype(np.float32)
        return np.vstack([g, pad])

    def forward(self, g: np.ndarray, idx: np.ndarray, keep: list | None = None):
        """Logits of the windows idx (T, B) into the rows of g; keep collects what backward needs."""
        p, h = self.p, HIDDEN
        t_n, b_n = idx.shape
        states = np.empty((t_n, b_n, 2 * h), np.float32)
        s = np.zeros((2, b_n, h), np.float32)
        x = np.empty((2, b_n, 3 * h), np.float32)
        for t in range(t_n):
            x[0] = g[idx[t], : 3 * h]
            x[1] = g[idx[t_n - 1 - t], 3 * h :]
            rec = np.matmul(s, p["u"])
            zr = np.tanh((x[..., : 2 * h] + rec[..., : 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(x[..., 2 * h :] + r * rec[..., 2 * h :])
            if keep is not None:
                keep.append((s, z, r, n, rec[..., 2 * h :]))
            s = n + z * (s - n)
            states[t, :, :h] = s[0]
            states[t_n - 1 - t, :, h:] = s[1]
        a = np.tanh(states @ p["wa"] + p["ba"])
        e = a @ p["va"]
        e[idx == len(g) - 1] = -1e9
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logit = pooled @ p["w"] + p["b"][0]
        return (logit, states, a, weight, pooled) if keep is not None else logit

    def backward(self, g: np.ndarray, idx: np.ndarray, kept: list, made: tuple, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        p, h = self.p, HIDDEN
        _, states, a, weight, pooled = made
        t_n, b_n = idx.shape
        d = {"w": pooled.T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["w"]
        dweight = np.einsum("tbh,bh->tb", states, dpool)
        dstates = weight[..., None] * dpool
        de = weight * (dweight - (weight * dweight).sum(0))
        d["va"] = np.einsum("tb,tba->a", de, a)
        da = de[..., None] * p["va"] * (1 - a * a)
        d["wa"] = states.reshape(-1, 2 * h).T @ da.reshape(-1, ATTENTION)
        d["ba"] = da.sum((0, 1))
        dstates += da @ p["wa"].T
        d["u"] = np.zeros_like(p["u"])
        dx = np.empty((t_n, b_n, 6 * h), np.float32)
        ds = np.zeros((2, b_n, h), np.float32)
        for t in range(t_n - 1, -1, -1):
            s, z, r, n, un = kept[t]
            ds[0] += dstates[t, :, :h]
            ds[1] += dstates[t_n - 1 - t, :, h:]
            dn = ds * (1 - z) * (1 - n * n)
            dz = ds * (s - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            drec = np.concatenate([dz, dr, dn * r], axis=2)
            d["u"] += np.matmul(s.transpose(0, 2, 1), drec)
            dx[t, :, : 3 * h] = np.concatenate([dz[0], dr[0], dn[0]], axis=1)
            dx[t_n - 1 - t, :, 3 * h :] = np.concatenate([dz[1], dr[1], dn[1]], axis=1)
            ds = ds * z + np.matmul(drec, p["u"].transpose(0, 2, 1))
        flat = idx.ravel()
        order = np.argsort(flat, kind="stable")
        rows, first = np.unique(flat[order], return_index=True)
        dg = np.zeros_like(g)
        dg[rows] = np.add.reduceat(dx.reshape(-1, 6 * h)[order], first, axis=0)
        return d, dg[:-1]


class _Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, d: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        rate *= (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in d.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def _train_batch(net: Network, adam: _Adam, ids, buckets, owners, idx, y, weight, rate, rng) -> None:
    """One step over windows idx (B, T) into distinct words; -1 pads."""
    used, local = np.unique(idx, return_inverse=True)
    local = local.reshape(idx.shape)
    if used[0] < 0:
        used, local = used[1:], np.where(local == 0, len(used) - 1, local - 1)
    spot = np.full(len(ids), -1, np.int64)
    spot[used] = np.arange(len(used))
    mine = spot[owners] >= 0
    bk, ow = buckets[mine], spot[owners[mine]]
    wid = np.where(rng.random(len(used)) < 0.3, 0, ids[used])  # so that the characters learn too
    x = net.inputs(wid, bk, ow)
    g = net.gates(x)
    kept: list = []
    made = net.forward(g, local.T, kept)
    prob = 1 / (1 + np.exp(-made[0]))
    d, dg = net.backward(g, local.T, kept, made, ((prob - y) * weight / len(y)).astype(np.float32))
    d["wx"], d["bx"] = x.T @ dg, dg.sum(0)
    dx = dg @ net.p["wx"].T
    d["words"] = np.zeros_like(net.p["words"])
    np.add.at(d["words"], wid, dx[:, :WORD_DIM])
    share = dx[:, WORD_DIM:] / np.maximum(np.bincount(ow, minlength=len(used)), 1)[:, None].astype(np.float32)
    order = np.argsort(bk, kind="stable")
    d["grams"] = np.zeros_like(net.p["grams"])
    if len(bk):
        b, first = np.unique(bk[order], return_index=True)
        d["grams"][b] = np.add.reduceat(share[ow[order]], first, axis=0)
    norm = np.sqrt(sum(float((g * g).sum()) for g in d.values()))
    if norm > 5:
        d = {k: g * np.float32(5 / norm) for k, g in d.items()}
    adam.step(d, rate)


def train(texts: list[str], labels: list[int], seed: int = 0) -> dict[str, Any]:
    """A model from documents and their labels."""
    docs = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if len(set(labels)) < 2 or not any(docs):
        return {"share": share}
    seen = Counter(w for d in docs for w in set(d))
    vocabulary = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= MIN_DOCS][:MAX_WORDS]
    number = {w: k + 1 for k, w in enumerate(vocabulary)}
    distinct = list(seen)
    row = {w: k for k, w in enumerate(distinct)}
    ids = np.array([number.get(w, 0) for w in distinct], np.int64)
    buckets, owners = gram_buckets(distinct)
    idx, doc = [], []
    for k, d in enumerate(docs):
        rows = np.array([row[w] for w in d], np.int64)
        for s in window_starts(len(d)):
            w = rows[s : s + WINDOW]
            idx.append(np.pad(w, (0, WINDOW - len(w)), constant_values=-1))
            doc.append(k)
    idx, doc = np.array(idx), np.array(doc)
    target = y[doc]
    net, rng = Network(len(vocabulary), seed), np.random.default_rng(seed)
    adam = _Adam(net.p)

    def logits() -> np.ndarray:
        g = net.gates(net.inputs(ids, buckets, owners))
        where = np.where(idx < 0, len(ids), idx)
        return np.concatenate([net.forward(g, where[k : k + 2048].T) for k in range(0, len(idx), 2048)])

    def best(of: np.ndarray) -> np.ndarray:
        order = np.lexsort((-of, doc))
        return order[np.r_[True, doc[order][1:] != doc[order][:-1]]]

    positive = max(float(y.mean()), 1e-3)
    balance = np.where(y > 0, 0.5 / positive, 0.5 / max(1 - positive, 1e-3)).astype(np.float32)
    for epoch in range(EPOCHS_ALL + EPOCHS_BEST):
        if epoch < EPOCHS_ALL:
            pick = rng.permutation(len(idx))
        else:
            top = best(logits())
            # the highest window of each document, and two more windows of each clean one
            more = rng.permutation(np.flatnonzero(target == 0))[: 2 * len(docs)]
            pick = rng.permutation(np.unique(np.concatenate([top, more])))
        rate = 0.01 * 0.75**epoch
        for k in range(0, len(pick), 256):
            part = pick[k : k + 256]
            _train_batch(net, adam, ids, buckets, owners, idx[part], target[part], balance[doc[part]], rate, rng)
    final = logits()
    top = best(final)
    size = np.log(np.bincount(doc, minlength=len(docs))[doc[top]])
    truth = target[top]
    clean = truth == 0
    slope = max(0.0, float(np.polyfit(size[clean], final[top][clean], 1)[0])) if len(set(size[clean])) > 1 else 0.0
    score = final[top] - slope * size
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(truth[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + truth.sum())
    k = int(np.argmax(f1))
    low = score[order[k + 1]] if k + 1 < len(order) else score[order[k]] - 1
    return {"share": share, "vocabulary": vocabulary, "p": net.p, "shift": float((score[order[k]] + low) / 2), "slope": slope}


class Scorer:
    """Scores whole texts with a trained model."""

    def __init__(self, model: dict[str, Any]):
        self.share = model["share"]
        self.net = None
        if "p" in model:
            self.net = Network(0)
            self.net.p = model["p"]
            self.shift, self.slope = model["shift"], model["slope"]
            self.number = {w: k + 1 for k, w in enumerate(model["vocabulary"])}
            self.table = np.empty((1024, 6 * HIDDEN), np.float32)
            self.row: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        new = sorted(words)
        need = len(self.row) + len(new)
        if need > len(self.table):
            wider = np.empty((max(need, 2 * len(self.table)), self.table.shape[1]), np.float32)
            wider[: len(self.row)] = self.table[: len(self.row)]
            self.table = wider
        for k in range(0, len(new), 8192):
            part = new[k : k + 8192]
            ids = np.array([self.number.get(w, 0) for w in part], np.int64)
            g = self.net.gates(self.net.inputs(ids, *gram_buckets(part)))[:-1]
            at = len(self.row)
            self.table[at : at + len(part)] = g
            self.row.update(zip(part, range(at, at + len(part)), strict=True))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        docs = [words_of(t) for t in texts]
        if self.net is None:
            return np.array([self.share if d else 0.0 for d in docs])
        flat = [w for d in docs for w in d]
        new = set(flat) - self.row.keys()
        if new and len(self.row) + len(new) > TABLE:
            self.row.clear()
            new = set(flat)
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.row.__getitem__, flat), np.int64, len(flat))
        begin = np.cumsum([0, *map(len, docs)])
        starts, doc = [], []
        for k, d in enumerate(docs):
            s = window_starts(len(d))
            starts += [int(begin[k]) + x for x in s]
            doc += [k] * len(s)
        if not starts:
            return out
        doc, starts = np.array(doc), np.array(starts)
        place = starts[:, None] + np.arange(WINDOW)
        inside = place < begin[doc + 1][:, None]
        last = len(self.row)
        if last >= len(self.table):
            self.table = np.vstack([self.table, np.empty((1024, self.table.shape[1]), np.float32)])
        self.table[last] = self.net.gates(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))[0]
        g = self.table[: last + 1]
        idx = np.where(inside, rows[np.minimum(place, len(rows) - 1)], last)
        logit = np.concatenate([self.net.forward(g, idx[k : k + 1024].T) for k in range(0, len(idx), 1024)])
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        top = np.maximum.reduceat(logit, first) - self.slope * np.log(np.diff(np.r_[first, len(doc)]))
        out[doc[first]] = 1 / (1 + np.exp(-(top - self.shift)))
        return out


_scorers: dict[int, Scorer] = {}


def _scorer(shared: _Shared) -> Scorer:
    if shared.id not in _scorers:
        _scorers.clear()
        _scorers[shared.id] = Scorer(shared.value)
    return _scorers[shared.id]


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The bounded training sample ``text, y``: at most PER_CLASS documents a class, all with a text."""
    marked = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text") != "")
    marked = materialize(marked.join(texts.select("doc_id"), "doc_id", "left_semi"), "toxicity-labels")
    many = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row a label value
    chosen = smallest_draws(marked, "y", "doc_id", many, PER_CLASS)
    # the chosen ids are bounded by PER_CLASS, so the broadcast is; repeated ids leave one text each
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return found.select(F.col("t.text").alias("text"), "y")


def _packed(model: dict[str, Any]) -> bytes:
    out = io.BytesIO()
    arrays = {f"p_{k}": v for k, v in model.get("p", {}).items()}
    np.savez(out, share=model["share"], shift=model.get("shift", 0.0), slope=model.get("slope", 0.0), vocabulary=np.array(model.get("vocabulary", []), dtype=str), **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, Any]:
    with np.load(io.BytesIO(data)) as z:
        model: dict[str, Any] = {"share": float(z["share"])}
        if any(k.startswith("p_") for k in z.files):
            model |= {"shift": float(z["shift"]), "slope": float(z["slope"]), "vocabulary": z["vocabulary"].tolist(), "p": {k[2:]: z[k] for k in z.files if k.startswith("p_")}}
    return model


def score(docs: DataFrame, model: dict[str, Any], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row of docs."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    shared = _Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                s = scorer.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return picked.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, Any]:
    """A model from all rows of labels that may be learned from (see ``held_out``).

    The sample goes to one task, whose size the parameters bound; a lost executor repeats it, with
    the same result, as rows are sorted and seeds fixed.
    """
    allowed = labels.where(~held_out(F.col(f"`{id_col}`")))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([_packed(train([t for t, _ in rows], [y for _, y in rows]))], pa.binary())], names=["model"])

    model = sample(docs, allowed, id_col, text_col, label_col).repartition(1).mapInArrow(learn, "model binary").first()
    return _unpacked(model["model"]) if model else {"share": 0.0}
