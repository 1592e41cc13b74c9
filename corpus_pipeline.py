"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the
shared folder and read again as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, langid, near, packing, pii
from gridloom.llm.common import materialize, release, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier does not reject (operator 4).

    Null texts and texts without a letter go; so do ties between two languages, and everything
    where no text has a label. Very long texts are read whole; repeated rows and rows with null or
    repeated ids are each decided by their own text; extra columns stay; an empty table stays empty.
    """
    dictionaries = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.keep_known(docs, dictionaries)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 (operator 5).

    Texts without words (null, empty) are copies of each other; very long texts are read whole; the
    smallest id stays, null ids come last, ties go to the smaller hash of the text; rows that repeat
    an id with the same text are one document; extra columns stay; an empty table stays empty.
    """
    return near.deduplicate(docs, size=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window (operator 8).

    Null and empty texts stay, as does every document where the benchmark is empty; very long texts
    are read whole; repeated rows and rows with null or repeated ids are each decided by their own
    text; ties in rarity change nothing; extra columns stay; an empty table stays empty.
    """
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms of the same format (operator 9).

    The key is ``gridloom.pii.key`` of the session; without it the public default is used. Null
    texts stay null, empty ones empty; very long texts are read whole; where patterns tie the leftmost
    match wins; repeated rows, null and repeated ids and extra columns stay; an empty table stays empty.
    """
    return pii.pseudonymize(docs, key=pii.key_of(spark), counts_prefix=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences (operator 2).

    Null and empty texts are one piece (the end id alone); very long texts are cut, never shortened;
    pieces of equal length are told apart by partition and place in it; repeated rows and rows with
    null or repeated ids are packed each; extra columns are left out; an empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pseudonymize", pseudonymize),
    ("pack", pack),
]

#: The stages fit dictionaries, decode a covering code and run a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = done
    return docs
