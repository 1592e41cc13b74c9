import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import near, simhash, syncmers
from gridloom.llm.common import small_batches
from gridloom.llm.components import components


# --- operator 1 -----------------------------------------------------------------------------------


def brute_anchors(text):
    """Closed syncmers by definition, with the module's own hashes of windows."""
    c = syncmers.code_points(text).astype(object)
    mask = (1 << 64) - 1

    def window(i, n):
        h = sum((int(c[i + j]) + 1) * pow(syncmers._BASE, -j, 1 << 64) for j in range(n)) & mask
        return h

    def mix(x):
        return int(syncmers._mix(np.array([x], np.uint64))[0])

    out = []
    for i in range(len(c) - syncmers.K + 1):
        inner = [mix(window(i + j, syncmers.S)) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, mix(window(i, syncmers.K) ^ syncmers.K)))
    return out


def test_anchors_by_definition():
    for text in ("the quick brown fox jumps over the lazy dog, twice", "aaaaaaaaaaaaaaaaaaaaaaa", "漢字かな交じり文の長い文章です。もう少し。"):
        at, h = syncmers.anchors(text)
        assert list(zip(at.tolist(), h.tolist(), strict=True)) == brute_anchors(text)


def test_anchors_are_context_free():
    random.seed(0)
    passage = "".join(random.choice("abcde ") for _ in range(400))
    a, b = syncmers.anchors(passage), syncmers.anchors("zz" * 50 + passage + "yy")
    assert set(zip((a[0] + 100).tolist(), a[1].tolist(), strict=True)) <= set(zip(b[0].tolist(), b[1].tolist(), strict=True))
    offsets = syncmers.matched_offsets("zz" * 50 + passage, passage)
    assert max(offsets, key=offsets.get) == 100
    assert syncmers.matched_offsets("", passage) == {}


def check_fingerprints(rows, found):
    """rows: (id, text) in the order of the contract."""
    got = {r.doc_id: r for r in found}
    for k, (i, text) in enumerate(rows):
        text, nxt = text or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(text) // 2
        edited = text[: len(text) - m] + nxt[:m]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (syncmers.fingerprint(text), syncmers.fingerprint(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == nxt:
            assert r.near_next == 1 and r.fingerprint == got[rows[(k + 1) % len(rows)][0]].fingerprint


def test_fingerprints_of_odd_texts(make, odd_texts):
    docs = make(odd_texts, clash=True)
    rows = [(i, t) for i, t in enumerate(odd_texts)][::-1]
    found = syncmers.fingerprints(docs).collect()
    assert len(found) == len(odd_texts)
    check_fingerprints(rows, found)


@pytest.mark.parametrize("n", [1, 2, 3, 200])
def test_next_document_over_ranges(make, n):
    random.seed(n)
    ids = random.sample(range(-1000, 10**12), n)
    texts = ["".join(random.choice("abc d") for _ in range(random.randint(0, 120))) for _ in ids]
    check_fingerprints(sorted(zip(ids, texts, strict=True), reverse=True), syncmers.fingerprints(make(texts, ids).repartition(3)).collect())


def test_fingerprints_of_repeats_and_nothing(make):
    assert syncmers.fingerprints(make(["x"]).limit(0)).count() == 0
    found = syncmers.fingerprints(make(["a", "a", "b", "c"], [1, 1, 5, None])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in found) == [(False, 1, 1), (False, 1, 1), (False, 5, 1), (True, None, 1)]


def test_likeness_follows_the_share_of_text():
    random.seed(1)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(6))
    a = " ".join(word() for _ in range(400))
    b = a[: len(a) // 2] + " ".join(word() for _ in range(200))
    sketch = lambda t: syncmers._sketch(syncmers.anchors(t)[1], t)
    assert syncmers.likeness(sketch(a), sketch(a)) == 1
    assert 0.15 < syncmers.likeness(sketch(a), sketch(b)) < 0.55
    assert syncmers.likeness(sketch(a), sketch(" ".join(word() for _ in range(400)))) < 0.1


# --- operator 5 -----------------------------------------------------------------------------------


def brute_components(fps, ids, bits=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= bits:
                root[find(i)] = find(j)
    low = {}
    for k in range(len(fps)):
        low.setdefault(find(k), []).append(ids[k])
    return [min(low[find(k)]) for k in range(len(fps))]


def brute_fingerprint(text, size):
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_by_definition(odd_texts):
    for text in [*odd_texts[:15], "one two", "one two three", "a b c d e f g a b c"]:
        assert simhash.fingerprint(text, 3) == brute_fingerprint(text, 3)


@pytest.mark.parametrize("code", [simhash.GOLAY, simhash.HAMMING])
def test_codes_are_perfect(code):
    start, pats, _ = simhash._patterns(code, 0)
    assert len(pats) == 1 << code.checks and (np.diff(start) == 1).all()  # each word is within the radius of one code word
    words = np.random.default_rng(0).integers(0, 1 << code.length, 500)
    _, anchor, _ = simhash._block_anchors(code, words, 0)
    for other in range(code.length):
        row, reach, _ = simhash._block_anchors(code, words ^ (1 << other), 1)
        assert all(anchor[k] in reach[row == k] for k in range(0, 500, 50))


@pytest.mark.parametrize("codes", [(simhash.GOLAY, simhash.GOLAY), (simhash.GOLAY, simhash.GOLAY, simhash.HAMMING)])
def test_pairs_within_two_bits_meet_at_the_home_of_either(codes):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 200, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    (rx, ax, hx), (ry, ay, hy) = (simhash.anchors(v.view(np.int64), 2, codes) for v in (x, y))
    for k in range(200):
        assert hx[rx == k].sum() == hy[ry == k].sum() == 1
        assert set(ax[(rx == k) & hx]) <= set(ay[ry == k]) and set(ay[(ry == k) & hy]) <= set(ax[rx == k])


def test_near_duplicates_of_odd_texts(make, odd_texts):
    found = {r.doc_id: r for r in simhash.near_duplicates(make(odd_texts, clash=True)).collect()}
    fps = [brute_fingerprint(t, 3) for t in odd_texts[:15]] + [simhash.fingerprint(t, 3) for t in odd_texts[15:]]
    want = brute_components(fps, list(range(len(fps))))
    assert [found[k].component_id for k in range(len(fps))] == want
    assert [found[k].fingerprint for k in range(len(fps))] == [f"{f:016x}" for f in fps]
    assert found[0].fingerprint == "0" * 16


@pytest.mark.parametrize("codes", [(simhash.GOLAY, simhash.GOLAY), (simhash.GOLAY, simhash.GOLAY, simhash.HAMMING)])
def test_linking_against_all_pairs(spark, codes):
    rng = np.random.default_rng(3)
    fps = []
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64):
        x = base
        for _ in range(25):  # chains
            x ^= np.uint64(1 << int(rng.integers(64))) | np.uint64(1 << int(rng.integers(64)))
            fps.append(int(x))
    for _ in range(150):  # a ball around one fingerprint, larger than a pairwise group
        fps.append(int(np.uint64(fps[0]) ^ np.uint64(1 << int(rng.integers(20))) ^ np.uint64(1 << int(rng.integers(64)))))
    fps += fps[:30]
    fps += [0, 0, 1, 7]
    rows = [(k, int(np.array([f], np.uint64).view(np.int64)[0])) for k, f in enumerate(fps)]
    found = {r.doc_id: r.component_id for r in simhash.linked(spark.createDataFrame(rows, "doc_id long, fp long"), codes=codes).collect()}
    assert [found[k] for k in range(len(fps))] == brute_components(fps, list(range(len(fps))))


def test_dedup_of_nothing_and_null_ids(make):
    assert simhash.near_duplicates(make(["x"]).limit(0)).count() == 0
    found = simhash.near_duplicates(make(["a b c d", "a b c d", "other words in here"], [None, 9, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == [("9", "9"), ("None", "9"), ("None", "None")]


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near copies of the pipeline ------------------------------------------------------------------------


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_deduplicate_finds_edited_copies_and_keeps_the_rest(make):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(120, 300))) for _ in range(60)]
    copies = []
    for t in texts[:30]:
        w = t.split()
        w[rng.randrange(len(w))] = word()
        copies.append(" ".join(w))
    large = " ".join(word() for _ in range(200)).split()
    family = []
    for _ in range(90):  # a group larger than a pairwise one
        w = list(large)
        w[rng.randrange(len(w))] = word()
        family.append(" ".join(w))
    far = [" ".join(t.split()[:60] + [word() for _ in range(60)]) for t in texts[30:40]]  # similar, but not enough
    all_ = texts + copies + family + far + texts[:3] + ["", None, "Short One", "short  one"]
    kept = {r.doc_id for r in near.deduplicate(make(all_, clash=True)).collect()}
    assert kept == brute_kept(all_)
    out = near.deduplicate(make(all_, clash=True))
    assert out.columns == make(all_, clash=True).columns


def test_deduplicate_repeated_rows_and_ids(make):
    docs = make(["one text", "one text", "another", "third", "third"], [4, 4, 4, None, None])
    assert sorted(str((r.doc_id, r.text)) for r in near.deduplicate(docs).collect()) == ["(4, 'another')", "(4, 'one text')", "(None, 'third')"]
    assert near.deduplicate(docs.limit(0)).count() == 0


def brute_kept(texts, similarity=0.8):
    """Numbers of the texts that are the first of their component of links, by all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {k for k in range(len(texts)) if find(k) == k}


@pytest.mark.parametrize("n", [60, 200])
def test_deduplicate_loses_no_link_of_a_hot_group(make, n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(250)]
    texts = []
    for _ in range(n):  # at 0.80 to 0.86 to the original, well below 0.8 to each other
        w = list(base)
        while len(shingles(" ".join(w)) & shingles(" ".join(base))) / len(shingles(" ".join(w)) | shingles(" ".join(base))) > 0.85:
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts.insert(n // 2, " ".join(base))
    kept = {r.doc_id for r in near.deduplicate(make(texts)).collect()}
    assert kept == brute_kept(texts) == {0}


@pytest.mark.parametrize("hot", [near.HOT, 0])
def test_deduplicate_loses_no_link_among_many_variants(make, monkeypatch, hot):
    monkeypatch.setattr(near, "HOT", hot)  # 0: no list is dealt by token
    monkeypatch.setattr(near, "BLOCK", 64)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(300)], []
    for _ in range(250):  # variants of one text that are not linked to each other, each with a twin that is linked to it
        w = list(base)
        for k in rng.sample(range(300), 30):
            w[k] = word()
        texts.append(" ".join(w))
        w[rng.randrange(300)] = word()
        texts.append(" ".join(w))
    want = brute_kept(texts)
    assert len(want) == 250
    assert {r.doc_id for r in near.deduplicate(make(texts)).collect()} == want


def test_common_shingles_are_counted_over_all_texts(make, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    phrases = [" ".join(word() for _ in range(8)) for _ in range(6)]
    texts = [" ".join([*(p for j, p in enumerate(phrases) if k % (j + 2) == 0), *(word() for _ in range(20))]) for k in range(40)]
    texts += texts[:15]  # copies count once
    sets = {t: np.unique(simhash.shingle_hashes(t, 5)) for t in texts}
    hashes, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    want = {near._tokens(s, hashes[n > 1], n[n > 1])[: near.prefix_length(len(s), 0.8)].tobytes() for s in sets.values()}
    kept, store = {}, near.materialize

    def keep(df, name):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(near, "materialize", keep)
    near.near_copies(make(texts)).count()
    assert {np.array(r.p, np.int64).tobytes() for r in kept["near-prints"].collect()} == want


@pytest.mark.parametrize("most", [5, 40, 1 << 19])
def test_commonest_shingles_are_whole_counts(make, monkeypatch, most):
    monkeypatch.setattr(near, "COMMON", most)
    monkeypatch.setattr(near, "BATCH_SHINGLES", 50)  # many parts of a task
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None]
    hashes, n = np.unique(np.concatenate([np.unique(simhash.shingle_hashes(t, 3)) for t in texts]), return_counts=True)
    least = min(k for k in range(2, n.max() + 2) if (n >= k).sum() <= most)
    found = near.common_shingles(make(texts).select("text"), 3, 7)
    assert [x.tolist() for x in found] == [hashes[n >= least].tolist(), n[n >= least].tolist()]
    assert [len(x) for x in near.common_shingles(make(texts).select("text").limit(0), 3, 7)] == [0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_block_pairs_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(60, 25, replace=False) for _ in range(8)]
    sets = [np.unique(np.r_[rng.choice(base[k % 8], rng.integers(12, 25), replace=False), rng.choice(60, 3)]) for k in range(80)]
    g, label, block = np.arange(80) * 7, rng.integers(0, 6, 80), rng.integers(0, 2, 80)
    n = np.array([len(s) for s in sets])
    p = np.array([near.prefix_length(x, 0.5) for x in n])
    prefixes = [s[:k] for s, k in zip(sets, p, strict=True)]
    a, b = near.block_pairs(g, label, n, p, block, prefixes, 0.5)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    linked = 0
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if label[i] != label[j] and block[i] != block[j] and both >= 0.5 * (n[i] + n[j] - both):
                linked += 1
                assert (g[j], g[i]) in found
    assert linked and len(found) < 80 * 79 / 2


def test_minima_of_hubs(spark, monkeypatch):
    from gridloom.llm import common

    monkeypatch.setattr(common, "HUBS", 4)
    rows = [("hub", k) for k in range(500, 0, -1)] + [(f"k{k % 50}", k) for k in range(200)]
    table = common.materialize(spark.createDataFrame(rows, "key string, v long"), "test")
    found = sorted(map(tuple, common.with_least(table, "key", "v", "low").collect()))
    low = {}
    for k, v in rows:
        low[k] = min(v, low.get(k, v))
    assert found == sorted((k, v, low[k]) for k, v in rows)


def test_deduplicate_finds_cut_and_appended_copies(make):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, copies = [], []
    for share in (0.8, 0.85, 0.9, 0.95):
        for _ in range(10):
            w = [word() for _ in range(rng.randint(100, 400))]
            n = len(w) - 4
            texts += [" ".join(w), " ".join(w[: int(np.ceil(n * share)) + 4])]
            copies.append(len(texts) - 1)
            w = [word() for _ in range(rng.randint(100, 400))]
            n = len(w) - 4
            texts += [" ".join(w), " ".join(w + [word() for _ in range(int(n / share) - n)])]
            copies.append(len(texts) - 1)
    kept = {r.doc_id for r in near.deduplicate(make(texts)).collect()}
    assert kept == brute_kept(texts) == set(range(len(texts))) - set(copies)


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * near.BATCH_ROWS + 7))], names=["x"])
    empty = batch.slice(0, 0)
    cut = list(near.sliced(iter([empty, batch, batch.slice(0, 1)])))
    assert [len(b) for b in cut] == [near.BATCH_ROWS, near.BATCH_ROWS, 7, 1]
    assert pa.Table.from_batches(cut)["x"].to_pylist() == [*range(len(batch)), 0]


def test_small_batches_hold_inside_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def largest():
        def lengths(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        return max(r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(lengths, "n long").collect())

    with pytest.raises(ValueError), small_batches(spark):
        assert largest() <= 512
        raise ValueError
    assert spark.conf.get(key) == before
    with small_batches(spark), small_batches(spark, 10_000):
        assert largest() <= 512
    assert largest() > 512
