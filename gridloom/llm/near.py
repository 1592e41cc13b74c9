"""Near copies by similarity: SimHash anchors first, then a prefix join that loses no link.

Two documents are linked if the Jaccard similarity of their sets of word shingles is ``similarity``
or more; groups are the components of all links. At 0.8 in five-word shingles two 64-bit
fingerprints differ in about ten bits, cut or appended text moves up to 22, and no covering of 64
bits replicates that far. So the anchors of ``simhash`` find what is within their own radius plus
threshold, which settles most of a group of close copies, and an exact join finds the rest.

Tokens. Every shingle becomes a token that starts with how common it is, so tokens sorted as numbers
are in one order for all documents, rare ones first. Shingles are counted over all distinct texts;
the ``COMMON`` commonest are told apart, all others count as rare. Any order gives the same links; a
good one makes short lists.

Candidates. Two sets of n >= m shingles with similarity t or more have t n and 2 t m / (1 + t) or more
in common, so the first n - ceil(t n) + 1 tokens of the larger one (its prefix) and the first
m - ceil(2 t m / (1 + t)) + 1 of the smaller one (its index prefix) share a token. A token in the
prefixes of two documents or more, in one as index, is a list; every link is in some list.

Bound. With c tokens in common within their prefixes of p and q tokens, two sets have no more than
c + max(n - p, m - q) in all: beyond the prefix that ends first, one set has no more to give. Pairs
that can't reach t are dropped before any set is read, as are those whose sizes differ too much.

Rounds. (1) Pairs of anchors, and each list's leader (the document with the most common tokens, in a
group of edited copies the original) with all others of the list; the pairs that are left are
compared by their whole sets. (2) Lists whose other members are not of one component by then are
open: their members meet in blocks of bounded size, and all pairs within the bound that are not of
one component yet are compared by their whole sets. Nothing is thinned before it is compared.

Hot keys. Copies of one text are one node. Shingles are counted in every task before they are dealt
by ranges of their hash, so a common one is no more than a number a task. Lists of very common tokens
are never dealt by token: their counts and leaders are pre-aggregated and broadcast (at most ``COMMON``
rows). Blocks of an open list are tasks of their own.

Results for odd input: null and empty texts, and texts without words, are copies of each other; a
text of fewer words than a shingle is one shingle; very long texts are read whole; null ids come
last when a group's smallest id is chosen, ties go to the smaller hash of the text; rows that repeat
an id with the same text are one document; other columns, whatever their names, are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import brief_shuffles, materialize, parts, release, small_batches, with_least
from .components import components
from .simhash import SEED, fingerprint_of, links, shingle_hashes

COMMON = 1 << 19  #: common shingles that are known to all tasks, at most
RARITY_SHIFT = 57  #: bits of a token below its rarity
HOT = 11  #: rarity from which on lists are not dealt by token: seen in 2^10 texts or more
BLOCK = 2048  #: members of an open list that meet as one block
BROADCAST_ROWS = 200_000  #: keys (two numbers each) are broadcast up to so many
BATCH_ROWS = 512  #: texts whose sets a Python worker holds and hands on at once
BATCH_PAIRS = 1 << 18  #: pairs that it hands on at once
BATCH_SHINGLES = 1 << 20  #: shingles that it counts before it hands them on
BATCH_COUNTS = 1 << 16  #: about so many counts are handed on at once
ROUNDING = 1e-6


def _tokens(h: np.ndarray, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Sorted tokens of distinct shingles: rarity, then the hash."""
    n = np.zeros(len(h), np.int64)
    if len(common) and len(h):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        n = np.where(common[at] == h, seen[at], 0)
    rarity = np.ceil(np.log2(1 + n)).astype(np.uint64)
    return np.sort((rarity << np.uint64(RARITY_SHIFT) | h >> np.uint64(64 - RARITY_SHIFT)).view(np.int64))


def prefix_length(n: int, share: float) -> int:
    """Tokens of a prefix that must hold one of ceil(share * n) tokens or more."""
    return min(n, n - math.ceil(share * n - 1e-9) + 1)


def _bound_reached(c, n, m, p, q, similarity: float):
    """Whether two sets of sizes n, m with prefixes p, q may be linked, with c common prefix tokens."""
    return (c + np.maximum(n - p, m - q) >= similarity / (1 + similarity) * (n + m) - ROUNDING) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - ROUNDING)


def block_pairs(g: np.ndarray, label: np.ndarray, n: np.ndarray, p: np.ndarray, block: np.ndarray, toks: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one or two blocks of a list that may be linked and have different labels."""
    size = np.array([len(t) for t in toks], np.int64)
    owner = np.repeat(np.arange(len(toks)), size)
    _, word = np.unique(np.concatenate(toks), return_inverse=True)
    order = np.argsort(word, kind="stable")
    holders = owner[order]
    first = np.searchsorted(word[order], np.arange(word.max() + 2))
    start = np.r_[0, np.cumsum(size)]
    two = block[0] != block[-1] or (block != block[0]).any()
    a, b = [], []
    for x in range(len(toks)):
        w = word[start[x] : start[x + 1]]
        k = first[w + 1] - first[w]
        near = holders[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[w], k)]
        c = np.bincount(near, minlength=len(toks))
        ok = _bound_reached(c, n[x], n, p[x], p, similarity) & (label != label[x]) & (g > g[x])
        if two:
            ok &= block != block[x]
        hit = np.flatnonzero(ok)
        a.append(np.full(len(hit), g[x]))
        b.append(g[hit])
    return np.concatenate(a), np.concatenate(b)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``BATCH_ROWS`` rows."""
    for b in batches:
        for k in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(k, BATCH_ROWS)


def _open_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs to compare in the open lists of ``s, g, label, n, p, k, toks``."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the unit that may go on: two blocks at most
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            g, label, n, p, block, toks = zip(*held, strict=True)
            a, b = block_pairs(*map(np.array, (g, label, n, p, block)), list(toks), similarity)
            for k in range(0, len(a), BATCH_PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + BATCH_PAIRS]) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(8)]
            toks = batch.column(8)
            for k, (s, u, v, *row) in enumerate(zip(*cols, strict=True)):
                if held and (s, u, v) != last:
                    yield from done()
                    held.clear()
                last = (s, u, v)
                held.append((*row, np.array(toks[k].values)))
        if held:
            yield from done()

    blocks = F.ceil(F.col("k") / BLOCK)
    units = members.withColumn("block", F.pmod(F.xxhash64("g"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    units = units.select("s", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), "g", "label", *(F.col(c).cast("long").alias(c) for c in ("n", "p", "block")), "toks")
    return units.repartition("s", "u", "v").sortWithinPartitions("s", "u", "v").mapInArrow(meet, "a long, b long").distinct()


def counted(hashes: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct values and how often each is there, for ``BATCH_SHINGLES`` values or a few more at a time."""
    held, n = [], 0
    for h in hashes:
        held.append(h)
        n += len(h)
        if n >= BATCH_SHINGLES:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), return_counts=True)


def common_shingles(texts: DataFrame, size: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """``hashes, n``, sorted by hash: shingles seen in ``n`` rows of ``text``, all that are seen in so many rows
    or more, where that is the least number (2 or more) by which they are no more than ``COMMON``.

    All shingles of all rows are counted, in ``ranges`` ranges of their hash.
    """
    spark = texts.sparkSession
    low = np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n in counted(np.unique(shingle_hashes(t.as_py(), size)) for b in batches for t in b.column(0)):
            ends = np.append(np.searchsorted(h, low), len(h)).astype(np.int32)
            cols = [pa.array(np.arange(ranges, dtype=np.int32)), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h.view(np.int64), n.astype(np.int32)))]
            made = pa.RecordBatch.from_arrays(cols, names=["part", "s", "n"])
            rows = max(1, ranges * BATCH_COUNTS // len(h))
            for k in range(0, ranges, rows):
                yield made.slice(k, rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = [tuple(b.column(k).flatten().to_numpy() for k in (1, 2)) for b in batches]
        s, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*dealt, strict=True) if dealt else ((), ())))
        order = np.argsort(s, kind="stable")  # runs that are sorted already
        s, n = s[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first) if len(s) else n
        yield pa.RecordBatch.from_arrays([pa.array(x[total > 1]) for x in (s[first], total)], names=["s", "n"])

    with small_batches(spark, 64), brief_shuffles(spark):
        dealt = texts.mapInArrow(deal, "part int, s array<long>, n array<int>").repartitionById(ranges, "part")
        counts = materialize(dealt.mapInArrow(add, "s long, n long"), "near-counts")
    least, total = 2, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():  # few: one row a number
        total += r["k"]
        if total > COMMON:
            least = r["n"] + 1
            break
    found = counts.where(F.col("n") >= least).toArrow()  # at most COMMON rows
    release(counts)
    hashes = found.column("s").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """Per row: ``doc_id, h`` (hash of the text) and the document that stands for its group.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word shingles is
    at least ``similarity``; groups are the components of all such links. Word sequences that are
    equal but for case and white space are one node. ``rep_id, rep_h`` name the row with the
    smallest id of the group (null ids last). ``bits`` is the threshold of the anchors.
    """
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    room = 2 * similarity / (1 + similarity)

    repeated = materialize(picked.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "near-repeated")
    if repeated.count() <= BROADCAST_ROWS:  # else all texts are dealt by hash
        once = picked.join(F.broadcast(repeated), "h", "left_anti").select("text")
        copied = picked.join(F.broadcast(repeated), "h", "left_semi")
    else:
        once, copied = picked.select("text").limit(0), picked
    once = once.unionByName(copied.groupBy("h").agg(F.first("text").alias("text")).select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(once, size, parts(picked, 16.0)))
    release(repeated)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common, seen = shared.value
        for b in sliced(batches):
            g, pop, n, fp, p = [], [], [], [], []
            for t in b.column(2):
                text = t.as_py()
                g.append(xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()), SEED))
                hashes = shingle_hashes(text, size)
                fp.append(fingerprint_of(hashes))
                s = _tokens(np.unique(hashes), common, seen)
                pop.append(int(1000 * (s >> RARITY_SHIFT).mean()) if len(s) else 0)
                n.append(len(s))
                p.append(s[: prefix_length(len(s), similarity)])
            unsigned = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (g, fp))
            cols = [b.column(0), b.column(1), *unsigned, pa.array(pop, pa.int32()), pa.array(n, pa.int32()), pa.array(p, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "g", "fp", "pop", "n", "p"])

    printed = picked.select("doc_id", "h", "text").mapInArrow(prints, f"doc_id {kind}, h long, g long, fp long, pop int, n int, p array<long>")
    with small_batches(docs.sparkSession):
        rows = materialize(printed, "near-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("rep")
    nodes = materialize(rows.groupBy("g").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp")), "near-nodes")

    # lists of two documents or more, with their leaders (null where no member has the token as index)
    index = F.col("n") - F.ceil(room * F.col("n") - 1e-9) + 1
    posts = rows.groupBy("g").agg(F.first("pop").alias("pop"), F.first("n").alias("n"), F.first("p").alias("p"))
    posts = posts.select("g", "pop", "n", F.posexplode("p").alias("at", "s")).select("s", "g", "pop", (F.col("at") < index).alias("idx"))
    hot = F.col("s") >= F.lit(HOT << RARITY_SHIFT)
    told = [F.count("*"), F.max("idx"), F.max(F.struct("pop", "g"))]
    named = ["k", "has", "top"]
    each = Window.partitionBy("s")
    cold = posts.where(~hot).repartition(parts(rows, 2.0), "s").select("s", "g", *(f.over(each).alias(x) for f, x in zip(told, named, strict=True)))
    lists = posts.where(hot).groupBy("s").agg(*(f.alias(x) for f, x in zip(told, named, strict=True))).where("k > 1")
    warm = posts.where(hot).select("s", "g").join(F.broadcast(lists), "s")  # fewer lists than COMMON
    posts = cold.where("k > 1").unionByName(warm).select("s", "g", "k", F.when(F.col("has"), F.col("top")["g"]).alias("lead"))
    posts = materialize(posts, "near-posts")
    listed = posts.groupBy("g").agg(F.collect_list("s").alias("toks")).join(nodes, "g")  # no longer than the text's prefix
    listed = materialize(listed.select("g", "rep", "n", (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).alias("p"), "toks"), "near-listed")

    def may_link(pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that sizes and prefixes leave room for."""
        both = pairs
        for c in ("a", "b"):
            both = both.join(listed.select(F.col("g").alias(c), *(F.col(x).alias(x + c) for x in ("n", "p", "toks"))), c)
        alike = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - ROUNDING
        most = F.size(F.array_intersect("toksa", "toksb")) + F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        return both.where(alike).where(most >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - ROUNDING).select("a", "b")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = [np.unique(shingle_hashes(t.as_py(), size)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], names=["g", "s"])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` (a stored table) that are linked, by their whole sets."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct().join(listed.select("g", "rep"), "g")
        needed = materialize(needed.select("g", F.col("rep.doc_id").alias("i"), F.col("rep.h").alias("t")), "near-needed")
        many = needed.count()
        found = picked.join(few(needed, many), picked["doc_id"].eqNullSafe(needed["i"]) & (picked["h"] == needed["t"])).select("g", "text").mapInArrow(sets, "g long, s array<long>")
        # stored before they are joined: the joins then read plain tables, whose hot keys can be split
        with small_batches(docs.sparkSession):
            found = materialize(found, "near-sets")
        if found.count() > many:  # rows that repeat an id with the same text
            once = materialize(found.dropDuplicates(["g"]), "near-sets")
            release(found)
            found = once
        both = pairs.join(found.select(F.col("g").alias("a"), F.col("s").alias("sa")), "a").join(found.select(F.col("g").alias("b"), F.col("s").alias("sb")), "b")
        shared_n = F.size(F.array_intersect("sa", "sb"))
        out = materialize(both.where(shared_n >= similarity * (F.size("sa") + F.size("sb") - shared_n) - 1e-9).select("a", "b"), "near-links")
        for done in (found, needed, pairs):
            release(done)
        return out

    # round 1: what the anchors and the leaders of lists bring together
    prints_of = materialize(nodes.groupBy("fp").agg(F.min("g").alias("f")), "near-fingerprints")
    close = links(prints_of.select("fp"), bits)
    for c in ("a", "b"):
        close = close.join(prints_of.select(F.col("fp").alias(c), F.col("f").alias(f"f{c}")), c)
    same = nodes.join(prints_of, "fp").where("g != f").select(F.col("g").alias("a"), F.col("f").alias("b"))
    star = posts.where("g != lead").select(F.col("g").alias("a"), F.col("lead").alias("b"))
    tried = close.select(F.col("fa").alias("a"), F.col("fb").alias("b")).unionByName(same).unionByName(star).distinct()
    found_links = verified(materialize(may_link(tried), "near-pairs"))
    roots = materialize(components(found_links).select(F.col("node").alias("g"), "root"), "near-roots")

    # round 2: the other members of each list, where links have not made them one component
    left = posts.where("g != lead and k > 2").join(roots, "g", "left").select("s", "g", F.coalesce("root", "g").alias("label"))
    who = [F.bit_xor(F.xxhash64("g", F.lit(k))).alias(f"w{k}") for k in range(2)]
    lists = left.groupBy("s").agg(F.count("*").alias("k"), F.min("label").alias("low"), F.max("label").alias("high"), *who).where("low != high")
    lists = materialize(lists.groupBy("k", "w0", "w1").agg(F.min("s").alias("s")).select("s", "k"), "near-lists")  # lists of the same members are one
    if lists.limit(1).count():
        members = left.join(lists, "s").join(listed.select("g", "n", "p", "toks"), "g")
        late = verified(materialize(_open_pairs(members, similarity), "near-pairs"))
        done = roots
        roots = materialize(components(found_links.unionByName(late)).select(F.col("node").alias("g"), "root"), "near-roots")
        release(done)
    for done in (posts, listed, lists, prints_of):
        release(done)

    member = materialize(nodes.select("g", "rep").join(roots, "g", "left").select("g", "rep", F.coalesce("root", "g").alias("root")), "near-members")
    chief = with_least(member, "root", "rep", "chief").select("g", "chief")
    return rows.select("doc_id", "h", "g").join(chief, "g").select("doc_id", "h", F.col("chief.doc_id").alias("rep_id"), F.col("chief.h").alias("rep_h"))


def few(keys: DataFrame, many: int) -> DataFrame:
    """``keys``, broadcast if they are no more than ``BROADCAST_ROWS``."""
    return F.broadcast(keys) if many <= BROADCAST_ROWS else keys


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, with all its columns, without the rows that another one stands for.

    One row of each group stays, the one with the smallest id; rows that repeat an id with the
    same text are one document, of which one row stays.
    """
    found = materialize(near_copies(docs, id_col, text_col, size, similarity).groupBy("doc_id", "h", "rep_id", "rep_h").agg(F.count("*").alias("n")), "near-rows")
    stays = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("h") == F.col("rep_h"))
    text_hash: Column = F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit("")))

    def same(keys: DataFrame) -> Column:
        return docs[f"`{id_col}`"].eqNullSafe(keys["doc_id"]) & (text_hash == keys["h"])

    gone = found.where(~stays).select("doc_id", "h")
    repeated = found.where(stays & (F.col("n") > 1)).select("doc_id", "h")
    if not repeated.limit(1).count():
        return docs.join(few(gone, gone.count()), same(gone), "left_anti")
    other = gone.unionByName(repeated)
    key = [F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))]
    once = docs.join(repeated, same(repeated), "left_semi")
    once = once.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key[0].alias("i"), key[1].alias("t")).groupBy("i", "t").agg(F.first("row").alias("row")).select("row.*")
    return docs.join(other, same(other), "left_anti").unionByName(once)
