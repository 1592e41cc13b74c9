"""Queries ``opN_<name>`` over the whole tables of a folder, and their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, packing, pii, secrets, simhash, syncmers, tokens, toxicity
from .common import table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, dictionaries).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, bits=2)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op7_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents")).drop("rid")


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_best_fit_packing,
        op3_secret_scan,
        op4_language_id,
        op5_simhash_near_dedup,
        op6_token_counts,
        op7_toxicity_scores,
        op8_benchmark_decontamination,
        op9_pii_pseudonyms,
        op10_license_scan,
    )
}

_WORDS = (
    r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)



def _license_sql() -> str:
    """The diagonal vote in SQL: templates and phrases as values, then joins and windows."""
    k = licenses.K
    rows = []
    for tid, (label, text) in enumerate(licenses.TEMPLATES):
        w = licenses.template_words(text)
        rows += [f"({tid}, '{label}', {len(w)}, {t}, '{' '.join(w[t : t + k])}')" for t in range(len(w) - k + 1)]
    phrases = ", ".join(f"('{label}', '{p}', {len(p.split())})" for p, label in licenses.PHRASES.items())
    gram = lambda n: f"array_to_string(w[i:i + {n - 1}], ' ')"
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i - 1 AS pos, {gram(2)} AS g2, {gram(3)} AS g3 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
t(tid, label, words, tpos, gram) AS (VALUES {", ".join(rows)}),
ph(label, phrase, n) AS (VALUES {phrases}),
base AS (SELECT doc_id, pos, label FROM dw JOIN ph ON phrase = CASE WHEN n = 2 THEN g2 ELSE g3 END),
v AS (SELECT doc_id, tid, label, words, pos, tpos, pos - tpos AS diag FROM dw JOIN t ON g3 = gram),
o AS (SELECT DISTINCT doc_id, tid, diag AS band, {licenses.DIAGONAL_GAP} + words // {licenses.DRIFT} AS reach FROM v),
m AS (SELECT v.doc_id, label, CAST(count(DISTINCT tpos) AS DOUBLE) / (words - {k - 1}) AS cover FROM o JOIN v ON v.doc_id = o.doc_id AND v.tid = o.tid AND diag BETWEEN band - reach AND band + reach GROUP BY v.doc_id, v.tid, band, label, words),
s AS (SELECT doc_id, label, cover FROM m WHERE cover >= {licenses.MIN_COVER}),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM base GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM s) GROUP BY doc_id),
sc AS (SELECT doc_id, max(c) AS score FROM (SELECT doc_id, CAST(1 AS DOUBLE) AS c FROM base UNION ALL SELECT doc_id, cover FROM s) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


#: The other operators learn, tokenise, hash with XXH64 or report places of regular expressions,
#: which DuckDB's SQL can't express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, s, n, item_id FROM dw JOIN iw USING (n, win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN held USING (doc_id)
""",
    "op10_license_scan": _license_sql(),
}
