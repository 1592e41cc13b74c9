"""Benchmark decontamination: prefix-filtered set join on word shingles, DataFrame functions only.

Every benchmark item is covered by windows of ``window`` words (a shorter item is one window). A
window is the set of its three-word shingles (an item of one or two words is one shingle of its own
length). A document holds a window only if it holds all of its shingles, so one prefix token, the
window's rarest shingle, is all that has to be joined; neighbouring windows mostly share it.

Rarity is counted over all places of all texts; it only decides which shingle of a window is joined,
and any choice gives the same result. The prefix tokens are then joined with every word place of
every document, in rounds that broadcast at most ``BOOK_ROWS`` of them, so no word of the corpus is
ever shuffled, whatever the benchmark's size. A hit carries the words around it: the window's place
follows from the token's position in it (a hit too close to either end of the text can't hold the
window: the positional and the length bound), and all words of the window are then compared.

Hits are named by the hash and length of their text, so copies of a text are one document from
there on, and no row needs a number of its own.

Results for odd input: null or empty text has no words and is clean; null, empty or wordless items
have no window; very long texts are read whole; repeated items count by item id, null item ids
nowhere; ties in rarity go to the smaller hash and change nothing; repeated rows and repeated or
null document ids are rows of their own; extra columns, whatever their names, are left out (or kept,
by ``without_contaminated``); an empty table gives an empty result (documents) or all-clean rows
(benchmark).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_with_end

ORDER = 3  #: words of a shingle
#: Prefix tokens (a number each) that one round broadcasts.
BOOK_ROWS = 1_000_000
#: Texts that are left out are broadcast by hash and length up to so many.
BROADCAST_ROWS = 200_000


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(windows, owners): distinct windows ``wid, n, ws`` and their items ``wid, item_id``."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), words_with_end(F.col(f"`{text_col}`")).alias("ws"))
    length = F.size("ws") - 1
    n = F.least(F.lit(window), length)
    each = items.where(F.col("item_id").isNotNull() & (length > 0)).select("item_id", "ws", n.alias("n"), F.explode(F.sequence(F.lit(1), length - n + 1)).alias("at"))
    each = each.select("item_id", F.slice("ws", F.col("at"), F.col("n")).alias("ws"))
    each = materialize(each.select("item_id", F.xxhash64("ws").alias("wid"), "ws").distinct(), "decontam-windows")
    # two windows with one hash share it: their words are compared in the end
    return each.select("wid", F.size("ws").alias("n"), "ws").distinct(), each.select("wid", "ws", "item_id")


def _shingle(ws: Column, at: Column, order: int) -> Column:
    return F.xxhash64(*[F.get(ws, at + k) for k in range(order)])


def _places(docs: DataFrame, book: DataFrame, orders: list[int], window: int | None) -> DataFrame:
    """Word places whose shingle is in ``book`` (``sid, order``): ``th, tl, sid`` and, with a window,
    ``pos``, the words around it and where they start."""
    # outer: else Catalyst infers a filter on size(ws) below the generator and splits twice
    at = docs.select("th", "tl", "ws", F.posexplode_outer("ws").alias("pos", "word")).where(F.col("word") != "")
    tokens = F.array(*[F.struct(_shingle(F.col("ws"), F.col("pos"), n).alias("sid"), F.lit(n).alias("order")) for n in orders])
    at = at.select("th", "tl", "ws", "pos", F.explode(tokens).alias("t")) if len(orders) > 1 else at.select("th", "tl", "ws", "pos", tokens[0].alias("t"))
    hit = at.select("th", "tl", "ws", "pos", F.col("t.sid").alias("sid"), F.col("t.order").alias("order")).join(F.broadcast(book), ["sid", "order"])
    if window is None:
        return hit.select("th", "tl", "sid", "order")
    base = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    return hit.select("th", "tl", "sid", "order", "pos", base.alias("base"), F.slice("ws", base + 1, F.lit(2 * window - 1)).alias("around"))


def _rounds(docs: DataFrame, book: DataFrame, orders: list[int], window: int | None) -> DataFrame:
    """``_places`` for a stored book of any size, at most ``BOOK_ROWS`` rows of it at a time."""
    n = max(1, -(-book.count() * 5 // (4 * BOOK_ROWS)))  # parts by hash are not all of one size
    part = F.pmod(F.xxhash64("sid", "order"), F.lit(n))
    return reduce(DataFrame.unionByName, [_places(docs, book.where(part == k), orders, window) for k in range(n)])


def occurrences(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", window=10) -> tuple[DataFrame, DataFrame]:
    """(found, owners): ``th, tl, first, n, wid, ws`` for every place of every window, distinct by text."""
    windows, owners = benchmark_windows(benchmark, item_col, item_text_col, window)
    windows = materialize(windows, "decontam-distinct")
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).select(*text_key(F.col("text")), words_with_end(F.col("text")).alias("ws"))
    order = F.least(F.col("n"), F.lit(ORDER))
    sid = reduce(lambda other, k: F.when(F.col("order") == k, _shingle(F.col("ws"), F.col("at"), k)).otherwise(other), range(1, ORDER), _shingle(F.col("ws"), F.col("at"), ORDER))
    spread = windows.select("wid", "ws", order.alias("order"), F.explode(F.sequence(F.lit(0), F.col("n") - order)).alias("at"))
    tokens = materialize(spread.select("wid", "ws", "order", "at", sid.alias("sid")), "decontam-tokens")
    book = materialize(tokens.select("sid", "order").distinct(), "decontam-book")
    orders = sorted(r["order"] for r in book.select("order").distinct().collect()) or [ORDER]  # at most ORDER rows
    rarity = _rounds(texts, book, orders, None).groupBy("sid", "order").agg(F.count("*").alias("freq"))
    ranked = tokens.join(rarity, ["sid", "order"], "left").select("wid", "ws", "order", F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "sid", "at").alias("t"))
    prefix = materialize(ranked.groupBy("wid", "ws", "order").agg(F.min("t").alias("t")).select("wid", "ws", "order", F.col("t.sid").alias("sid"), F.col("t.at").alias("at")), "decontam-prefix")
    # copies of a text hit alike: one of them is enough
    hits = _rounds(texts, materialize(prefix.select("sid", "order").distinct(), "decontam-book"), orders, window)
    hits = materialize(hits.distinct(), "decontam-hits")
    start = F.col("pos") - F.col("at")
    both = hits.join(prefix, ["sid", "order"]).where((start >= 0) & (start - F.col("base") + F.size("ws") <= F.size("around")))
    found = both.where(F.slice("around", start - F.col("base") + 1, F.size("ws")) == F.col("ws"))
    return materialize(found.select("th", "tl", start.cast("long").alias("first"), F.size("ws").cast("long").alias("n"), "wid", "ws"), "decontam-found"), owners


def text_key(text: Column) -> list[Column]:
    """``th, tl``: hash and length that name a text; a null text is the empty one."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("th"), F.length(text).alias("tl")]


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", window=10) -> DataFrame:
    """Per text that holds a window: ``th, tl, n_hit, items`` (sorted item ids), as a stored table."""
    found, owners = occurrences(docs, benchmark, text_col, item_col, item_text_col, window)
    spans = found.groupBy("th", "tl", "first").agg(F.max(F.col("first") + F.col("n") - 1).alias("last"))
    before = Window.partitionBy("th", "tl").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0).cast("long"), F.col("last") - F.greatest("first", F.coalesce(F.max("last").over(before) + 1, F.lit(0).cast("long"))) + 1)
    hit = spans.withColumn("fresh", fresh).groupBy("th", "tl").agg(F.sum("fresh").alias("n_hit"))
    held = found.select("th", "tl", "wid", "ws").distinct().join(owners, ["wid", "ws"]).groupBy("th", "tl").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return materialize(hit.join(held, ["th", "tl"]), "decontam-texts")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window=10) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    hit = contaminated_texts(docs, benchmark, text_col, item_col, item_text_col, window)
    none = F.lit(0).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *text_key(F.col(f"`{text_col}`")), (F.size(words_with_end(F.col(f"`{text_col}`"))) - 1).cast("long").alias("n_words"))
    return rows.join(hit, ["th", "tl"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", window=10) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item.

    Contamination depends on the text alone, so rows with null or repeated ids are each decided by
    their own text.
    """
    bad = contaminated_texts(docs, benchmark, text_col, item_col, item_text_col, window).select("th", "tl")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    th, tl = (k for k in text_key(docs[f"`{text_col}`"]))
    return docs.join(bad, (th == bad["th"]) & (tl == bad["tl"]), "left_anti")
