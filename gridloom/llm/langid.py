"""Language identification by compression with per-language dictionaries.

Each language has a raw-content zstandard dictionary made of whole training texts. A
text is lower-cased, cut into blocks, and every block is compressed with every dictionary; the
language with the smallest total is chosen, and a text whose two best totals are within
``MIN_MARGIN`` of each other is rejected. Blocks keep the dictionary in play over the whole of a
long text (else its own past would soon explain it as well as any dictionary).

Sizes are whole bytes, so short texts tie. A text of one block with a narrow margin is therefore
measured again from each of its first ``SHIFTS`` places on, and the sums decide.

Fitting reads a bounded sample, set by a parameter: at most ``PER_LANG`` distinct labelled texts of
a language (those of smallest salted hashes), each of them whole. The dictionaries, the only thing
shared with executors, are therefore bounded by the number of languages and by how long a text can
be. Prediction is a narrow pass over whole texts.

Results for odd input: a null text, or one without a letter, is ``und`` with score 0 and rejected;
rows with a null label are predicted but teach nothing; without any labelled text everything is
``und``; very long texts are read whole; texts that two languages tie on go to the one with more
distinct texts, then to the first name, and are rejected; repeated rows count once in training and
are predicted each, as are rows with null or repeated ids; extra columns, whatever their names, are
left out (``predict``) or kept (``keep_known``); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

PER_LANG = 80
BLOCK = 512
SHIFTS = 12
LEVEL = 9
#: The sample's keys are broadcast up to so many rows.
BROADCAST_ROWS = 200_000
#: Steps in which hashes are counted to find a sample's threshold.
STEPS = 1024
#: Rejected if (second - best) / second is below this.
MIN_MARGIN = 0.002
UND = "und"
#: Steepness of the score, per share of the second best size.
SCORE_STEP = 0.02


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def smallest_draws(keys: DataFrame, group: str, key: str, many: dict, k: int) -> DataFrame:
    """At most k rows of each group: those whose salted hash of ``key`` is below a threshold.

    ``many`` has the rows of each group. A group of k rows or less is taken whole. Of a larger one,
    hashes below about 4 k / n of their range are counted in ``STEPS`` steps, and the threshold is the
    last step up to which there are at most k rows. Only counts are shuffled; nothing is ranked.
    """
    size = 1 << 30
    rows = keys.withColumn("draw", F.pmod(F.xxhash64(key, F.lit("pick")), F.lit(size)))
    large = {v: min(1.0, 4 * k / n) * size for v, n in many.items() if n > k}

    def by_group(values: dict, otherwise: int):
        out = F.lit(otherwise)
        for v, x in values.items():
            out = F.when(F.col(group) == F.lit(v), F.lit(int(x))).otherwise(out)
        return out

    limit = dict.fromkeys(many, size)
    if large:
        step = F.floor(F.col("draw") * F.lit(STEPS) / by_group(large, 0)).cast("int")
        counts = rows.where(F.col("draw") < by_group(large, 0)).groupBy(group, step.alias("step")).agg(F.count("*").alias("n")).collect()  # at most STEPS rows a group
        for v, reach in large.items():
            held = {r["step"]: r["n"] for r in counts if r[group] == v}
            total, last = 0, 0
            while last < STEPS and total + held.get(last, 0) <= k:
                total += held.get(last, 0)
                last += 1
            # the first hash that belongs to the step after the last one taken
            limit[v] = -(-last * int(reach) // STEPS)
    return rows.where(F.col("draw") < by_group(limit, 0)).select(group, key)


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> list[tuple[str, bytes]]:
    """Dictionaries from the labelled rows given, the language with most distinct texts first.

    The order only matters for texts that no dictionary tells apart.
    """
    rows = train.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # copies teach once: only hashes are grouped
    keys = materialize(hashed.select("lang", "h").distinct(), "langid-keys")
    many = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    chosen = smallest_draws(keys, "lang", "h", many, PER_LANG)
    if PER_LANG * len(many) <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    texts = hashed.join(chosen, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    by: dict[str, list[tuple[int, str]]] = {}
    for r in texts.collect():  # at most PER_LANG texts a language
        by.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return [(lang, "\n".join(t.lower() for _, t in sorted(found)).encode("utf-8", "surrogatepass")) for lang, found in sorted(by.items(), key=lambda x: (-many[x[0]], x[0]))]


class Coder:
    """Compressed size of a text under each dictionary."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        import zstandard

        self.langs = [lang for lang, _ in dictionaries]
        self.coders = []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "surrogatepass")
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    @staticmethod
    def margin(sizes: list[int]) -> float:
        best, *others = sorted(sizes)
        return (others[0] - best) / others[0] if others else 1.0

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin)."""
        if not self.coders or not text or not any(map(str.isalpha, text)):
            return UND, 0.0, 0.0
        sizes = self.sizes(text)
        if len(text) <= BLOCK and self.margin(sizes) < MIN_MARGIN:
            sizes = [sum(x) for x in zip(*(self.sizes(text[k:]) for k in range(min(SHIFTS, len(text)))), strict=True)]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = order[0]
        if len(order) == 1:
            return self.langs[best], 1.0, 1.0
        second = sizes[order[1]]
        margin = (second - sizes[best]) / second
        share = sum(2.0 ** -((s - sizes[best]) / second / SCORE_STEP) for s in sizes)
        return self.langs[best], 1.0 / share, margin


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """One coder per worker and broadcast."""
    if shared.id not in _coders:
        _coders.clear()
        _coders[shared.id] = Coder(shared.value)
    return _coders[shared.id]


class _Shared:
    """A broadcast with a name of its own, which workers keep what they build from it under."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state


def predict(docs: DataFrame, dictionaries: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` for each row of docs."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    shared = _Shared(docs.sparkSession, dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for b in batches:
            found = [coder.predict(t.as_py()) for t in b.column(1)]
            lang, score, margin = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m < MIN_MARGIN for m in margin], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    return picked.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def keep_known(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language is not rejected."""
    shared = _Shared(docs.sparkSession, dictionaries)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for b in batches:
            yield b.filter(pa.array([coder.predict(t.as_py())[2] >= MIN_MARGIN for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
