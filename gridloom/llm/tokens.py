"""Token counts of whole texts by heap-and-linked-list byte-pair merging (see ``bpe``).

A narrow Arrow pass: no shuffle, one bounded table of word counts per worker. Null and empty
texts count zero; repeated rows, null ids and an empty table need nothing special.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import merge_counter, tokenizer_path

DEFAULT = "word_bpe_49k.json"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of docs."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(tokenizer_path(path, DEFAULT))
        for b in batches:
            sizes, counts = [], []
            for t in b.column(1):
                t = t.as_py()
                sizes.append(len(t.encode()) if t else 0)
                counts.append(counter.count(t))
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), n, pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
