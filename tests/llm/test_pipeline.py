import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import bpe, langid, near, pii
from gridloom.llm.common import materialize, table
from gridloom.llm.queries import ORACLE_SQL, QUERIES

from .test_fingerprints_and_dedup import shingles
from .test_models_and_tokens import check_packing
from .test_text_scans import brute_contamination


def test_stages_against_brute_force(spark, data):
    docs = table(spark, data, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, data), "test")
        steps[name] = before, docs
        if name != "pack":
            assert docs.columns == before.columns
    rows = lambda d: {r.doc_id: r for r in d.collect()}

    before, after = map(rows, steps["language_id"])
    coder = langid.Coder(langid.fit(steps["language_id"][0].where(~langid.held_out(F.col("doc_id")))))
    assert after.keys() == {i for i, r in before.items() if coder.predict(r.text)[2] >= langid.MIN_MARGIN}
    assert len(after) >= 0.95 * len(before)

    before, after = map(rows, steps["near_dedup"])
    sets, root = {i: shingles(r.text) for i, r in before.items()}, {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(before)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert after.keys() == {i for i in ids if find(i) == i}

    before, after = map(rows, steps["decontaminate"])
    items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    ids = sorted(before)
    dirty = {i for i, r in zip(ids, brute_contamination([before[i].text for i in ids], items), strict=True) if r[4]}
    assert after.keys() == before.keys() - dirty and dirty

    before, after = map(rows, steps["pseudonymize"])
    assert before.keys() == after.keys() and all(before[i].lang == after[i].lang for i in before)
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and len(changed) < len(before) / 2

    before = rows(steps["pack"][0])
    ids = sorted(before)
    number = {i: k for k, i in enumerate(ids)}
    packed = [type("P", (), {**r.asDict(), "doc_id": number[r.doc_id]}) for r in steps["pack"][1].collect()]
    check_packing(packed, [before[i].text for i in ids], 1024, Tokenizer.from_file(bpe.tokenizer_path(None, "byte_bpe_50k.json")))


def test_run_equals_the_stages(spark, data):
    docs = table(spark, data, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data), "test")
    key = lambda d: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in d.collect())
    assert key(corpus_pipeline.run(spark, data)) == key(docs)


def test_pipeline_of_odd_rows(spark, make, odd_texts, data):
    docs = make([*odd_texts, *odd_texts[3:10], None], [*range(len(odd_texts)), *[3] * 7, None])
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data), "test")
    assert docs.count() > 0
    empty = make(["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, data), "test")
    assert empty.count() == 0


def test_outcomes_of_each_stage_on_odd_rows(spark, make, data):
    """What the docstrings of the stages state, by rows; a clashing extra column stays until packing."""
    rows = [(None, None), (1, ""), (2, "a plain text here"), (2, "a plain text here"), (3, "12 34"), (5, "another one for training"), (6, "more of it, word by word")]
    docs = make([t for _, t in rows], [i for i, _ in rows], clash=True)
    stages = dict(corpus_pipeline.STAGES)

    def after(name):
        done = stages[name](spark, docs, data)
        assert done.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in done.collect()), key=repr)

    assert after("language_id") == sorted(((i, t) for i, t in rows if any(map(str.isalpha, t or ""))), key=repr)
    assert after("near_dedup") == sorted({(i, t) for i, t in rows if i is not None}, key=repr)
    assert after("decontaminate") == after("pseudonymize") == sorted(rows, key=repr)
    pieces = stages["pack"](spark, docs, data).collect()
    assert sorted((r.doc_id for r in pieces), key=repr) == sorted((i for i, _ in rows), key=repr)
    assert {r.length for r in pieces if r.doc_id in (None, 1)} == {1} and len({r.sequence_id for r in pieces}) == 1
    assert [r.offset for r in sorted(pieces, key=lambda r: r.offset)] == [sum(sorted((r.length for r in pieces), reverse=True)[:k]) for k in range(len(pieces))]


def test_queries_are_registered(spark, data):
    import __spark_entry__

    known = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)} and "pipeline" in known and QUERIES.keys() <= known.keys()
    assert ORACLE_SQL.keys() <= QUERIES.keys()
    n = table(spark, data, "documents").count()
    for name in ("op3_secret_scan", "op6_token_counts", "op9_pii_pseudonyms", "op10_license_scan"):
        assert known[name](spark, data).count() == n


def test_near_copies_names_a_member(spark, data):
    found = near.near_copies(table(spark, data, "documents")).collect()
    ids = {r.doc_id for r in found}
    assert all(r.rep_id in ids and r.rep_id <= r.doc_id for r in found)
    assert np.mean([r.rep_id == r.doc_id for r in found]) > 0.5
    assert pii.KINDS[0] == "email"
