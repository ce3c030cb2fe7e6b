"""Texts of a megabyte and more, with and without spaces, through every query over documents."""

import random
import time

import pytest

from sigloom.llm import divergence, queries, simhash

# what gives a row a document; the others' own tests have long texts, pages and vectors
NAMES = [n for n in queries.QUERIES if n not in ("op3_chat_preference", "op6_nearest_neighbours", "op11_warc", "op12_divergence", "op13_hard_negatives")]


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    prose = " ".join(rng.choice(words) for _ in range(250_000))
    solid = "".join(rng.choice("abcdefgh") for _ in range(600_000))
    digits = "".join(rng.choice("0123456789.- ") for _ in range(300_000))
    rows = [(1, prose), (2, prose + " end"), (3, solid), (4, digits), (5, "日本語" * 60_000), (6, "short text"), (7, None), (8, prose[:3000])]
    folder = str(tmp_path_factory.mktemp("long"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", None) for i, t in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, prose[2000:2400])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows)


@pytest.mark.parametrize("name", NAMES)
def test_long_texts(spark, long, name):
    folder, rows = long
    began = time.time()
    got = queries.QUERIES[name](spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(rows)
    assert time.time() - began < 120
    if name == "op1_substrings":
        gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got}
        assert gone[1] == (250_000, 0) and gone[2] == (250_001, 250_000) and gone[8][1] > 400
    if name == "op2_packing":
        assert max(r["length"] for r in got) == 2048
    if name == "op10_decontamination":
        hit = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in got}
        assert hit[1][0] == hit[2][0] > 50 and not hit[1][1] and hit[8][1] and hit[3][0] == 0


def test_near_copies_of_long_texts(spark, long):
    folder, _ = long
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r["doc_id"] for r in simhash.survivors(docs).select("doc_id").collect()} == {1, 3, 4, 5, 6, 7, 8}


def test_divergence_of_long_texts(spark, long):
    """No term is in 30 documents, so sources differ by nothing; every group is there."""
    folder, rows = long
    got = queries.op12_divergence(spark, folder).collect()
    assert got == []  # one source a language
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    many = divergence.audit(docs.withColumn("source", docs["doc_id"].cast("string")), least=2).collect()
    assert {(r["lang"], r["source"]) for r in many if r["part"] == "pair"} == {("en" if i % 2 else "fr", str(i)) for i in rows}
