import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, langid, packing, tokens, toxicity

WORD = bpe.tokenizer_path(None, "word_bpe_49k.json")
BYTE = bpe.tokenizer_path(None, "byte_bpe_50k.json")
PIECES = [
    "a", "b", " ", "'s", "'S", "'ll", "Σ", "ς", "İ", "ß", "\x1c", "\x85", " ", "é", "é", "漢", "1", "²", "Ⅷ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "!!", "\n", "\t",
    "\U0001f600", "ﬁ", "Ǆ", "K", "ͅ", "_", "x" * 40, "﻿", "　", "\x00", "ſ", "hello", "world", "ing", "tion",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(n)]


# --- operator 6 -----------------------------------------------------------------------------------


def test_counts_are_those_of_the_library(make, odd_texts):
    library = Tokenizer.from_file(WORD)
    texts = [*odd_texts, *random_texts(800, 1)]
    found = {r.doc_id: r for r in tokens.token_counts(make(texts, clash=True), limit=20).collect()}
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (found[k].n_bytes, found[k].n_tokens, found[k].over_limit) == (len((t or "").encode()), n, n > 20), repr(t)[:80]
    assert tokens.token_counts(make(["x"]).limit(0)).count() == 0


def test_table_of_known_words_is_bounded(monkeypatch):
    counter = bpe.MergeCounter(WORD)
    monkeypatch.setattr(bpe.MergeCounter, "CACHE", 10)
    text = " ".join(f"w{k}ord" for k in range(50))
    n = counter.count(text)
    assert counter.count(text) == n and counter.count("one more") > 0 and len(counter.known) < 60


# --- operator 2 -----------------------------------------------------------------------------------


def test_ids_are_those_of_the_library(odd_texts):
    library, mine = Tokenizer.from_file(BYTE), bpe.byte_bpe(BYTE)
    assert mine.fast is not None
    for t in [t for t in odd_texts if t is not None] + random_texts(800, 2):
        assert mine.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def best_fit_decreasing(lengths, capacity):
    """Plain best fit over single pieces, longest first."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


def supersteps(lengths, capacity):
    """The supersteps over one sorted list of slots and pieces, without ranges."""
    gaps, tops, alike = [], packing.class_tops(capacity), packing.together(capacity)
    for top, low in zip(tops, [*tops[1:], 0], strict=True):
        slots = [(-g, 0, s) for s, g in enumerate(gaps) for _ in range(g // top)]
        slots += [(-(g % top), 0, s) for s, g in enumerate(gaps) if g % top > low]
        stack, loose, tails = [], [], []
        for size, kind, s in sorted(slots + [(-n, 1, 0) for n in lengths if low < n <= top]):
            if kind == 0:
                stack.append(s)
            elif stack:
                gaps[stack.pop()] += size
            else:
                loose.append(-size)
        for each in sorted({alike[n] for n in loose}):
            same = [n for n in loose if alike[n] == each]
            full = len(same) // each * each
            gaps += [capacity - sum(same[k : k + each]) for k in range(0, full, each)]
            if full < len(same):
                need = (len(same) - full) * (capacity // each)
                fit = [t for t in tails if t[0] >= need]
                tail = min(fit) if fit else [capacity, 0]
                tails += [] if fit else [tail]
                tail[0] -= need
                tail[1] += sum(same[full:])
        gaps += [capacity - filled for _, filled in tails]
        assert all(g >= 0 for g in gaps)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(20))
def test_ranges_carry_as_one_list_does(seed):
    rng = random.Random(seed)
    events = [rng.choice("sp") for _ in range(rng.randint(0, 120))]
    cuts = sorted(rng.randint(0, len(events)) for _ in range(rng.randint(0, 9)))
    whole, stack, lost = {}, [], []
    for i, e in enumerate(events):
        if e == "s":
            stack.append(i)
        elif stack:
            whole[i] = stack.pop()
        else:
            lost.append(i)
    found, loose, open_ = {}, {}, {}
    for part, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(events)], strict=True)):
        stack = []
        for i in range(lo, hi):
            if events[i] == "s":
                stack.append(i)
            elif stack:
                found[i] = stack.pop()
            else:
                loose.setdefault(part, []).append(i)
        open_[part] = stack[::-1]
    split = {k: rng.randint(0, len(v)) for k, v in loose.items()}  # some of each range open sequences by threes, the rest by fours
    groups = {k: {each: n for each, n in ((3, split[k]), (4, len(v) - split[k])) if n} for k, v in loose.items()}
    runs, taken, alone, ranks = packing.carry(groups, {k: len(v) for k, v in open_.items()})
    for part, at, n, source, to in runs:
        for k in range(n):
            assert to + k < taken[source]
            found[loose[part][at + k]] = open_[source][to + k]
    left, seen = [], {}
    for part, at, n, each, rank in alone:
        assert rank == seen.get(each, 0) and all((at + k < split[part]) == (each == 3) for k in range(n))
        seen[each] = rank + n
        left += loose[part][at : at + n]
    assert found == whole and left == lost and seen == ranks


@pytest.mark.parametrize("capacity", [1, 7, 64, 1024])
def test_classes_cover_all_lengths(capacity):
    tops = packing.class_tops(capacity)
    assert tops[0] == capacity and all(tops) and tops == sorted(set(tops), reverse=True)
    assert all(n * each <= capacity for n, each in enumerate(packing.together(capacity)))
    assert all(packing.together(capacity)[1:])


@pytest.mark.parametrize("range_rows", [15, 1_000_000])
def test_supersteps_over_ranges(make, range_rows):
    """Many small ranges, or one: the gaps are those of the plain list, and as few as best-fit decreasing leaves."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "word", "x1"]) for _ in range(rng.choice([0, 1, 3, rng.randint(0, 30), rng.randint(0, 90)]))) for _ in range(400)]
    rows = packing.pack(make(texts).repartition(3), capacity=48, range_rows=range_rows).collect()
    n = check_packing(rows, texts, 48, Tokenizer.from_file(BYTE))
    filled, lengths = defaultdict(int), [r.length for r in rows]
    for r in rows:
        filled[r.sequence_id] += r.length
    assert sorted(48 - f for f in filled.values()) == supersteps(lengths, 48)
    assert n <= len(best_fit_decreasing(lengths, 48)) * 1.01 + 1


def check_packing(rows, texts, capacity, library):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= capacity
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(by_seq)


def test_packing_round_trip(make, odd_texts):
    texts = [*odd_texts, *random_texts(300, 3), *(["copy of a text"] * 50)]
    rows = packing.pack(make(texts, clash=True).repartition(5)).collect()
    n = check_packing(rows, texts, 1024, Tokenizer.from_file(BYTE))
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack(make(["x"]).limit(0)).count() == 0
    again = packing.pack(make(["a", "a", "b"], [1, 1, None])).collect()
    assert len(again) == 3 and sorted(r.offset for r in again) == [0, 2, 4]


# --- operator 4 -----------------------------------------------------------------------------------


def test_language_id_on_held_out_rows(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    assert {lang for lang, _ in model} == {"en", "fr", "de", "es"}
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.03 and all(0 <= r.score <= 1 for r in rows)
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == langid.predict(docs, model).where("not rejected").count()


def test_sizes_and_choice_by_definition(spark, data, odd_texts):
    """Every block by a compressor made anew, whole training texts in the dictionary."""
    import zstandard

    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 120")
    train = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(train)
    by = defaultdict(set)
    for r in train.collect():
        if r.lang and any(map(str.isalpha, r.text or "")):
            by[r.lang].add(r.text.lower())
    assert {k: sorted(v.decode().split("\n")) for k, v in model} == {k: sorted("\n".join(v).split("\n")) for k, v in by.items()}
    assert [k for k, _ in model] == sorted(by, key=lambda k: (-len(by[k]), k)) and max(map(len, by.values())) <= langid.PER_LANG

    def size(content, text):
        raw, out = text.lower().encode(), 0
        for k in range(0, len(raw), langid.BLOCK):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid.LEVEL)
            frame = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[k : k + langid.BLOCK])
            assert zstandard.ZstdDecompressor(dict_data=d).decompress(frame, max_output_size=langid.BLOCK) == raw[k : k + langid.BLOCK]
            out += len(frame)
        return out

    coder = langid.Coder(model)
    for text in [t for t in odd_texts if t and len(t) < 3000] + [r.text[:2500] for r in docs.limit(15).collect() if r.text]:
        lang, score, margin = coder.predict(text)
        if not any(map(str.isalpha, text)):
            assert (lang, score, margin) == ("und", 0, 0)
            continue
        sizes = [size(c, text) for _, c in model]
        low, second = sorted(sizes)[:2]
        if len(text) <= langid.BLOCK and (second - low) / second < langid.MIN_MARGIN:
            sizes = [sum(size(c, text[k:]) for k in range(min(langid.SHIFTS, len(text)))) for _, c in model]
            low, second = sorted(sizes)[:2]
        assert lang == model[sizes.index(low)][0] and margin == pytest.approx((second - low) / second)
        assert score == pytest.approx(1 / sum(2 ** ((low - s) / second / langid.SCORE_STEP) for s in sizes))


def test_held_out_rule(spark):
    rows = spark.range(200).select("id", langid.held_out(F.col("id")).alias("a"), toxicity.held_out(F.col("id")).alias("b")).collect()
    assert all(r.a == (zlib.crc32(str(r.id).encode()) % 4 == 2) and r.b == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_samples_are_bounded_and_nearly_full(spark):
    rows = spark.range(20_000).select((F.when(F.col("id") < 40, "small").when(F.col("id") < 400, "middle").otherwise("large")).alias("g"), "id")
    many = {r.g: r.n for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    for k in (1, 40, 300):
        found = {r.g: r.n for r in langid.smallest_draws(rows, "g", "id", many, k).groupBy("g").agg(F.count("*").alias("n")).collect()}
        assert all(n <= k for n in found.values())
        assert found.get("small", 0) == (40 if k >= 40 else found.get("small", 0))
        assert k < 300 or (found["large"] >= 0.95 * k and found["middle"] >= 0.95 * k)
    again = [sorted(r.id for r in langid.smallest_draws(rows.repartition(p), "g", "id", many, 300).collect()) for p in (1, 7)]
    assert again[0] == again[1]


def test_language_id_of_odd_rows(make, odd_texts):
    docs = make(["the cat and the dog are here", "le chat et le chien sont la", *odd_texts], langs=["en", "fr", None, *["en"] * (len(odd_texts) - 1)], clash=True)
    model = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for k, t in enumerate(["the cat", "le chat", *odd_texts]):
        if not t or not any(map(str.isalpha, t)):
            assert (rows[k].lang_pred, rows[k].score, rows[k].rejected) == ("und", 0.0, True)
        else:
            assert rows[k].lang_pred in ("en", "fr")
    assert langid.predict(docs.limit(0), model).count() == 0
    empty = langid.fit(docs.limit(0))
    assert empty == [] and {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.fit(docs.unionByName(docs)) == model  # copies teach once


# --- operator 7 -----------------------------------------------------------------------------------


def test_windows_cover_the_text():
    for n in (0, 1, 47, 48, 49, 80, 81, 1000):
        starts = toxicity.window_starts(n)
        covered = set().union(*(range(s, min(s + toxicity.WINDOW, n)) for s in starts)) if starts else set()
        assert covered == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(5, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    idx = np.array([[0, 1, 2, 3], [4, 4, 5, 5], [2, 5, 5, 5]]).T  # 5 pads
    w = rng.normal(size=3)

    def loss():
        return float(net.forward(net.gates(x), idx) @ w)

    kept = []
    g = net.gates(x)
    made = net.forward(g, idx, kept)
    d, dg = net.backward(g, idx, kept, made, w)
    d["wx"], d["bx"] = x.T @ dg, dg.sum(0)
    for name, grad in d.items():
        flat = net.p[name].reshape(-1)
        for k in rng.choice(flat.size, min(6, flat.size), replace=False):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-3 == pytest.approx(grad.reshape(-1)[k], rel=0.02, abs=2e-3), name


def test_scores_by_definition():
    """One number at a time: embeddings, both directions, attention, windows, the highest one."""
    model = toxicity.train([f"you moron {k} " + "so it goes " * (k % 25) for k in range(30)] + [f"good day {k} " + "so it goes " * (k % 40) for k in range(30)], [1] * 30 + [0] * 30)
    p, H = {k: v.astype(float) for k, v in model["p"].items()}, toxicity.HIDDEN
    number = {w: k + 1 for k, w in enumerate(model["vocabulary"])}
    sig = lambda x: 1 / (1 + math.exp(-x))

    def gates(word):
        buckets, _ = toxicity.gram_buckets([word])
        x = list(p["words"][number.get(word, 0)]) + [sum(p["grams"][b][k] for b in buckets) / len(buckets) for k in range(toxicity.CHAR_DIM)]
        return [sum(x[i] * p["wx"][i][k] for i in range(len(x))) + p["bx"][k] for k in range(6 * H)]

    def read(inputs, d):
        s, out = [0.0] * H, []
        for x in inputs:
            x = x[d * 3 * H :]
            rec = [sum(s[i] * p["u"][d][i][k] for i in range(H)) for k in range(3 * H)]
            z, r = ([sig(x[o + k] + rec[o + k]) for k in range(H)] for o in (0, H))
            n = [math.tanh(x[2 * H + k] + r[k] * rec[2 * H + k]) for k in range(H)]
            s = [z[k] * s[k] + (1 - z[k]) * n[k] for k in range(H)]
            out.append(s)
        return out

    def logit(window):
        inputs = [gates(w) for w in window]
        states = [a + b for a, b in zip(read(inputs, 0), read(inputs[::-1], 1)[::-1], strict=True)]
        e = [math.exp(sum(math.tanh(sum(s[i] * p["wa"][i][k] for i in range(2 * H)) + p["ba"][k]) * p["va"][k] for k in range(toxicity.ATTENTION))) for s in states]
        pooled = [sum(x * s[k] for x, s in zip(e, states, strict=True)) / sum(e) for k in range(2 * H)]
        return sum(pooled[k] * p["w"][k] for k in range(2 * H)) + p["b"][0]

    texts = ["you moron", "a", "Good DAY to you, unseen wörd", "so it goes " * 20 + "moron " + "nice day " * 15]
    want = []
    for t in texts:
        w = t.lower().replace(",", "").split()
        found = [logit(w[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(len(w))]
        want.append(sig(max(found) - model["slope"] * math.log(len(found)) - model["shift"]))
    assert np.allclose(toxicity.Scorer(model).scores(texts), want, atol=1e-4)


def test_training_sample_takes_whole_texts_of_documents_that_exist(spark, make, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_CLASS", 5)
    long_ = "word " * 20_000 + "end"
    docs = make([long_, "two", "three", "three again", None, "", "six", "six"], [1, 2, 3, 3, 4, 5, 6, 6], clash=True)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5000)], "doc_id long, toxic int")
    rows = sorted((r.text, r.y) for r in toxicity.sample(docs, labels).collect())
    assert (long_, 1) in rows and ("two", 0) in rows and ("six", 0) in rows and len(rows) == 4


def test_padding_changes_nothing():
    net = toxicity.Network(0)
    g = net.gates(np.random.default_rng(1).normal(size=(4, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32))
    short = net.forward(g, np.array([[0, 1, 2]]).T)
    padded = net.forward(g, np.array([[0, 1, 2, 4, 4, 4]]).T)
    assert np.allclose(short, padded, atol=1e-4)


def test_toxicity_on_held_out_rows(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    rows = toxicity.score(held, model).join(labels, "doc_id").collect()
    score, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.93
    flagged = np.array([r.predicted for r in rows])
    assert flagged[y == 1].mean() > 0.85 and flagged[y == 0].mean() < 0.05
    assert ((score >= 0.5) == (flagged == 1)).all()


def test_toxicity_of_odd_rows(spark, make, odd_texts):
    docs = make([*odd_texts, *(f"you are a moron number {k}" for k in range(20)), *(f"what a nice day number {k}" for k in range(20))], clash=True)
    n = len(odd_texts)
    labels = spark.createDataFrame([(n + k, int(k < 20)) for k in range(40)] + [(n, 1), (None, 1), (9999, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == n + 40 and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[0].score == rows[1].score == rows[2].score == 0
    assert rows[n].predicted == 1 and rows[n + 25].predicted == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    one = toxicity.fit(docs, labels.where("toxic = 1"))
    assert rows.keys() == {r.doc_id for r in toxicity.score(docs, one).collect()}


def test_scoring_in_batches_and_a_full_table(monkeypatch):
    texts = [f"word{k} moron {'filler ' * (k % 90)}" for k in range(60)] + [None, ""]
    model = toxicity.train([f"you moron {k}" for k in range(30)] + [f"good day {k}" for k in range(30)], [1] * 30 + [0] * 30)
    whole = toxicity.Scorer(model).scores(texts)
    monkeypatch.setattr(toxicity, "TABLE", 20)
    scorer = toxicity.Scorer(model)
    assert np.allclose(np.concatenate([scorer.scores(texts[k : k + 7]) for k in range(0, len(texts), 7)]), whole, atol=1e-5)
