"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous supersteps.

Documents longer than the capacity are cut (the first piece may be shorter); every other one is
one piece. Pieces are range-sorted by length, and a superstep takes those of one class of lengths
``(low, top]``, longest class first:

1. Gaps (what is free in the open sequences) are turned into slots: ``gap // top`` that hold any
   piece of the class, and what is left over if it may hold one too. Slots and pieces are
   range-sorted together by size, largest first, over as many ranges as their number asks for.
2. Successor sweep, range by range in parallel: each piece takes the smallest slot not yet taken
   that holds it, which is the last one met before it. Pieces that want the same slot are told
   apart by their rank in the range. A range ends with loose pieces (no slot was left when they
   came) and with open slots.
3. Ranges know of each other by two counts only, loose pieces and open slots. From these the
   driver tells each run of loose pieces which run of open slots of an earlier range it gets, and
   a join by (range, place) settles them: the whole is exactly the sweep of one sorted list.
4. What is still loose opens new sequences by rank: pieces of one narrow class of lengths (finer
   than those of the supersteps) together, as many as surely fit; what such classes leave over
   shares sequences. Gaps are updated, and the next superstep follows.

Pieces of over half the capacity have no choice: each opens a sequence, without a sweep.

The driver holds two counts a range of ``RANGE_ROWS`` rows and nothing of a piece or a gap; every
superstep ends in tables in the shared folder, so a lost executor costs part of one step. The
number of supersteps is bounded (nine sweeps).

Results for odd input: null and empty texts are one piece (the end id alone); very long texts are
cut, never shortened; pieces that tie on their length are told apart by partition and place in it;
repeated rows are packed each; ids may be null or repeat; extra columns, whatever their names, are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_bpe, tokenizer_path
from .common import materialize, parts, release

DEFAULT = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024
#: Slots and pieces that one task of a sweep is meant to hold.
RANGE_ROWS = 500_000
_MATCHED, _LOOSE, _OPEN = 0, 1, 2
_FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32", "pid"]


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, id_col="doc_id", text_col="text", path=None, capacity=CAPACITY, end_id=END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, pid``; pid: number of the piece, from its partition and place."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId() << 40
        bpe = byte_bpe(tokenizer_path(path, DEFAULT))
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                ids = np.append(bpe.ids(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(ids), capacity)):
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes()), pid))
                    pid += 1
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 4), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *arrays], names=_FIELDS)

    return picked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, pid long")


def class_tops(capacity: int) -> list[int]:
    """Largest lengths of the classes of the supersteps, descending, as shares of the capacity."""
    return sorted({capacity // j for j in (1, 2, 3, 4, 5, 6, 8, 16, 42, 128)} - {0}, reverse=True)


def opening_tops(capacity: int) -> list[int]:
    """Largest lengths of the classes that open sequences together: shares down to a sixteenth, then two an octave."""
    tops = [capacity // j for j in range(1, 17) if capacity >= j]
    while tops[-1] > 1:
        tops += [tops[-1] * 3 // 4, tops[-1] // 2]
    return sorted(set(tops) - {0}, reverse=True)


def together(capacity: int) -> list[int]:
    """By length: how many pieces of its class open a sequence together."""
    tops = opening_tops(capacity)
    return [0, *(capacity // min(t for t in tops if t >= n) for n in range(1, capacity + 1))]


def _sweep(events: DataFrame, capacity: int) -> DataFrame:
    """Match each piece of a range with the smallest slot that holds it.

    ``events``: ``size, kind, weight`` and the fields of a piece, sorted by size, largest first;
    kind 0 is a slot (``pid``: its sequence, ``weight``: how many alike). Result: the fields of a
    piece, ``sequence_id, state, part, at, weight, each``; ``at`` counts loose pieces in order and
    open slots from the smallest on; ``each``: how many loose pieces may open a sequence together.
    """
    kind_of_id = events.schema["doc_id"].dataType.simpleString()
    alike = np.array(together(capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        slots: list[list[int]] = []  # (sequence, how many), the smallest last
        loose, schema = 0, None

        def out(fields: list[pa.Array], sequence, state, at, weight, each) -> pa.RecordBatch:
            n = len(state)
            more = [pa.array(sequence, pa.int64()), pa.array(state, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(at, pa.int64()), pa.array(weight, pa.int64()), pa.array(each, pa.int64())]
            return pa.RecordBatch.from_arrays([*fields, *more], names=[*_FIELDS, "sequence_id", "state", "part", "at", "weight", "each"])

        for b in batches:
            schema = b.schema
            keep, sequence, state, at = [], [], [], []
            for i, (kind, weight, pid) in enumerate(zip(b.column("kind").to_pylist(), b.column("weight").to_pylist(), b.column("pid").to_pylist(), strict=True)):
                if kind == 0:
                    slots.append([pid, weight])
                    continue
                keep.append(i)
                if slots:
                    last = slots[-1]
                    sequence.append(last[0])
                    last[1] -= 1
                    if not last[1]:
                        slots.pop()
                    state.append(_MATCHED)
                    at.append(0)
                else:
                    sequence.append(None)
                    state.append(_LOOSE)
                    at.append(loose)
                    loose += 1
            pieces = b.take(pa.array(keep, pa.int64()))
            yield out([pieces.column(f) for f in _FIELDS], sequence, state, at, [1] * len(keep), alike[pieces.column("length").to_numpy(zero_copy_only=False)])
        first, step = 0, 10_000
        slots.reverse()
        for k in range(0, len(slots), step):
            some = slots[k : k + step]
            starts = np.cumsum([first, *(w for _, w in some)])
            first = int(starts[-1])
            nulls = [pa.nulls(len(some), schema.field(f).type) for f in _FIELDS]
            yield out(nulls, [s for s, _ in some], [_OPEN] * len(some), starts[:-1], [w for _, w in some], [0] * len(some))

    return events.mapInArrow(run, f"doc_id {kind_of_id}, piece int, start long, length long, ids_crc32 long, pid long, sequence_id long, state int, part int, at long, weight long, each long")


def carry(loose: dict[int, dict[int, int]], open_: dict[int, int]) -> tuple[list[tuple], dict[int, int], list[tuple], dict[int, int]]:
    """Which open slots of earlier ranges the loose pieces of each range get.

    ``loose``: pieces by range and by how many of them open a sequence together (which ascends
    within a range, as lengths descend). Result: runs ``(part, at, n, to_part, to_at)`` of loose
    pieces; how many open slots of each range are taken; runs ``(part, at, n, each, rank)`` of
    pieces for which no slot is left, rank among those of the same ``each``; and their numbers.
    """
    stack: list[tuple[int, int, int]] = []  # (range, open slots taken, open slots left), the smallest last
    runs, taken, alone, ranks = [], {}, [], {}
    for part in sorted(loose.keys() | open_.keys()):
        at, end = 0, 0
        for each, count in sorted(loose.get(part, {}).items()):
            end += count
            while at < end and stack:
                source, used, left = stack.pop()
                take = min(left, end - at)
                runs.append((part, at, take, source, used))
                taken[source] = used + take
                if left > take:
                    stack.append((source, used + take, left - take))
                at += take
            if at < end:
                alone.append((part, at, end - at, each, ranks.get(each, 0)))
                ranks[each] = ranks.get(each, 0) + end - at
                at = end
        if open_.get(part):
            stack.append((part, 0, open_[part]))
    return runs, taken, alone, ranks


def _superstep(todo: DataFrame, gaps: DataFrame, opened: int, top: int, low: int, capacity: int, ranges: int) -> tuple[DataFrame, DataFrame, int]:
    """Places for the pieces of one class: ``(pieces with sequence_id, gaps after, sequences opened so far)``."""
    spark = todo.sparkSession
    whole = F.struct(F.col("gap").alias("size"), F.expr(f"gap div {top}").alias("weight"))
    left = F.struct((F.col("gap") % top).alias("size"), F.lit(1).cast("long").alias("weight"))
    fits = lambda s: (s["weight"] > 0) & (s["size"] > low)
    slots = gaps.select("sequence_id", F.explode(F.filter(F.array(whole, left), fits)).alias("s")).select(
        F.col("s.size").alias("size"), F.lit(0).alias("kind"), F.col("s.weight").alias("weight"),
        *(F.col("sequence_id").alias(f) if f == "pid" else F.lit(None).cast(todo.schema[f].dataType).alias(f) for f in _FIELDS),
    )
    events = slots.unionByName(todo.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("weight"), *_FIELDS))
    order = [F.desc("size"), "kind", "pid"]
    swept = materialize(_sweep(events.repartitionByRange(ranges, *order).sortWithinPartitions(*order), capacity), "packing-sweep")
    loose_sums, open_sums = defaultdict(dict), {}
    for r in swept.where(F.col("state") != _MATCHED).groupBy("part", "state", "each").agg(F.sum("weight").alias("n")).collect():  # a few rows a range
        if r.state == _LOOSE:
            loose_sums[r.part][r.each] = r.n
        else:
            open_sums[r.part] = r.n
    runs, taken, alone, ranks = carry(loose_sums, open_sums)
    first, tails, new_from = {}, [], opened  # tails: (sequence, what is surely free), for the groups that are not full
    for each, n in sorted(ranks.items()):
        start, full, rest = opened, n // each, n % each * (capacity // each)
        opened += full
        tail = min((t for t in tails if t[1] >= rest), key=lambda t: t[1], default=None)
        if rest and tail is None:
            tail = [opened, capacity]
            tails.append(tail)
            opened += 1
        if rest:
            tail[1] -= rest
        first[each] = start, full * each, tail[0] if rest else None

    def dealt(rows: list[tuple], names: str) -> DataFrame:  # a few rows a range
        listed = F.broadcast(spark.createDataFrame(rows, f"part int, at0 long, n long, {names}"))
        return swept.where(F.col("state") == _LOOSE).drop("each").join(listed, "part").where((F.col("at") >= F.col("at0")) & (F.col("at") < F.col("at0") + F.col("n")))

    placed = swept.where(F.col("state") == _MATCHED).select(*_FIELDS, "sequence_id")
    if alone:
        rows = [(*run, *first[run[3]]) for run in alone]
        placed = placed.unionByName(dealt(rows, "each long, rank long, first long, whole long, tail long").withColumn("rank", F.expr("rank + at - at0")).select(*_FIELDS, F.expr("if(rank < whole, first + rank div each, tail)").alias("sequence_id")))
    if runs:
        loose = dealt(runs, "to_part int, to_at long").select(*_FIELDS, "to_part", (F.col("to_at") + F.col("at") - F.col("at0")).alias("unit"))
        used = F.broadcast(spark.createDataFrame(list(taken.items()), "part int, used long"))  # a row a range
        units = swept.where(F.col("state") == _OPEN).join(used, "part").where(F.col("at") < F.col("used"))
        units = units.select(F.col("part").alias("to_part"), F.explode(F.sequence("at", F.least(F.col("at") + F.col("weight"), "used") - 1)).alias("unit"), "sequence_id")
        placed = placed.unionByName(loose.join(units, ["to_part", "unit"]).select(*_FIELDS, "sequence_id"))
    placed = materialize(placed, "packing-placed")
    changes = placed.select("sequence_id", (-F.col("length")).alias("gap")).unionByName(spark.range(new_from, opened).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap")))
    after = materialize(gaps.unionByName(changes).groupBy("sequence_id").agg(F.sum("gap").alias("gap")).where("gap > 0"), "packing-gaps")
    release(swept)
    release(gaps)
    return placed, after, opened


def pack(docs: DataFrame, id_col="doc_id", text_col="text", path=None, capacity=CAPACITY, end_id=END_ID, range_rows=RANGE_ROWS) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    raw = materialize(tokenized_pieces(docs, id_col, text_col, path, capacity, end_id), "packing-tokenized")
    # sorted by length, so that a superstep reads only the row groups of its class
    pieces = materialize(raw.repartitionByRange(parts(raw), F.desc("length"), "pid").sortWithinPartitions(F.desc("length"), "pid"), "packing-pieces")
    release(raw)
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    gaps, opened, done = None, 0, []
    tops = class_tops(capacity)
    for top, low in zip(tops, [*tops[1:], 0], strict=True):
        n = sum(c for length, c in histogram.items() if low < length <= top)
        todo = pieces.where((F.col("length") > low) & (F.col("length") <= top))
        if top == capacity:  # no two of them fit together
            done.append(todo.select(*_FIELDS, (-1 - F.col("pid")).alias("sequence_id")))
            gaps = materialize(done[0].select("sequence_id", (capacity - F.col("length")).alias("gap")).where("gap > 0"), "packing-gaps")
            singles = n
        elif n:
            placed, gaps, opened = _superstep(todo, gaps, opened, top, low, capacity, -(-(n + singles + opened) // range_rows))
            done.append(placed)
    everything = reduce(DataFrame.unionByName, done)
    # a sequence holds at most `capacity` pieces
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "pid").rowsBetween(Window.unboundedPreceding, -1)
    dealt = everything.repartition(parts(everything), "sequence_id")
    return dealt.select(*_FIELDS[:-1], "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
