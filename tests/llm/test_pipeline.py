"""The pipeline, stage by stage."""

import re

import corpus_pipeline
from sigloom.llm import blocks, pii, queries, simhash


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]


def test_each_stage_on_its_own_input(spark, corpus):
    folder, rows = corpus
    docs = blocks.documents(spark, folder)
    columns, kept = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = blocks.scratch(spark, name)
        out.write.parquet(path)
        docs, before = spark.read.parquet(path), kept
        kept = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"] or "") for r in kept)
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in kept} <= {1, 2, 3, 6, 7, 8, None}
        if name == "near_dedup":
            assert len([r for r in kept if r["doc_id"] and 100 <= r["doc_id"] < 125]) == 0
            assert {r["text"] for r in kept if r["doc_id"] == 11} <= {r["text"] for r in before if r["doc_id"] == 11}  # each of its texts once, below
            assert len({r["text"] for r in kept if r["doc_id"] is not None}) == len([r for r in kept if r["doc_id"] is not None])
        if name == "decontamination":
            assert 300 in {r["doc_id"] for r in before} and 300 not in {r["doc_id"] for r in kept}
        if name == "pii":
            assert len(kept) == len(before)
            text = next(r["text"] for r in kept if r["doc_id"] == 414)
            assert "[EMAIL]" in text and "example.com" not in text and "190.137.223.204" not in text
            plain = sorted(repr(r) for r in before if not re.search(r"[0-9@]", r["text"] or ""))
            assert set(plain) <= {repr(r) for r in kept}  # texts without a trigger stay as they are
        if name == "packing":
            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in before}


def test_redaction_covers_overlapping_spans():
    assert pii.redacted("ab 12345 cd", [(1, 3, 6), (2, 5, 8)]) == "ab [IP] cd"
    assert pii.redacted("x", []) == "x"


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_rows_that_share_an_id_are_told_apart_by_their_texts(spark):
    prose = " ".join(f"alpha{i}" for i in range(40))
    other = " ".join(f"completely{i}" for i in range(40))
    rows = [(1, prose, "x", 5), (1, other, "y", 6), (1, other, "a", 7), (2, prose + " end", "z", 8), (3, None, "n", 1), (3, "", "n", 2), (4, other, "w", 9), (None, prose, "q", 3)]
    want = None
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = simhash.survivors(spark.createDataFrame(order, "doc_id long, text string, lang string, n_chars long").repartition(3)).collect()
        found = sorted(map(repr, got))
        want = want or found
        assert found == want  # neither files' order nor tasks decide
        texts = sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] == 1)
        assert texts == sorted([(1, prose), (1, other)])  # no text that is no copy goes
        assert [r["lang"] for r in got if r["text"] == other] == ["a"] and 2 not in {r["doc_id"] for r in got} and 4 not in {r["doc_id"] for r in got}
        assert sum(r["doc_id"] is None for r in got) == 1 and sum(r["doc_id"] == 3 for r in got) == 1


def test_survivors_keep_the_smallest(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (2, text), (2, text), (9, "other words here"), (None, text)]
    got = simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"]) == [2, 9]
    assert queries.QUERIES
