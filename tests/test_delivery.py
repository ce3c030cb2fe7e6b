import json
import random

import pytest
from pyspark.sql import functions as F

from sigloom.operators import calibration, delivery, matching
from sigloom.sources import sinks, tables


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [0, 1, 2, 4])
def test_pairs_within_some_edits_are_those_of_all_pairs(spark, distance):
    rng = random.Random(distance)
    word = lambda: "".join(rng.choice("AC") for _ in range(rng.randint(0, 9)))
    texts, panel = [word() for _ in range(60)] + [None, "", "x" * 3000, "x" * 2998 + "yz"], [word() for _ in range(40)] + ["", None, "x" * 3000]
    got = matching.within(spark.createDataFrame([(t, 0) for t in texts], "text string, n int"), "text", spark.createDataFrame([(0, t) for t in panel], "d int, t string"), "t", distance)
    want = {(s, t, edits(s, t)) for s in set(texts) - {None} for t in set(panel) - {None} if abs(len(s) - len(t)) <= distance and (len(s) < 100 or s[:2998] == t[:2998])} if distance < 3 else None
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    short = {r for r in rows if len(r[0]) < 100}
    assert short == {(s, t, edits(s, t)) for s in set(texts) - {None} for t in set(panel) - {None} if len(s) < 100 and len(t) < 100 and edits(s, t) <= distance}
    assert {r[2] for r in rows if len(r[0]) == 3000} == ({0, 2} if distance >= 2 else {0})
    assert want is None or {w for w in want if w[2] <= distance} == set(rows)
    with pytest.raises(ValueError):
        matching.within(got, "text", got, "sequence", -1)


def test_nearest_within(spark):
    rows = spark.createDataFrame([(1, "ACGT", "x"), (2, "AAAA", "x"), (2, "AAAA", "x"), (3, None, "x"), (4, "TTTTTTTT", "x")], "id int, s string, piece string")
    panel = spark.createDataFrame([("b", "ACGA"), ("a", "ACGG"), ("c", "ACG"), ("c", "ACG"), ("d", "AAA"), ("e", "AAAACC"), (None, "AAAA")], "name string, q string")
    got = sorted((r["id"], r["call"], r["distance"], r["margin"]) for r in matching.nearest_within(rows, "s", panel, "name", "q", 2).collect())
    assert got == [(1, "a", 1, 0), (2, "d", 1, 1), (2, "d", 1, 1), (3, None, None, None), (4, None, None, None)]
    assert matching.nearest_within(rows, "s", panel.where("false"), "name", "q", 2).where("call is not null").count() == 0


def test_target_codes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(matching.encoded(F.lit("TACG"), "NACGT")) == [4, 1, 2, 3]
    assert one(matching.encoded(F.lit(""), "NACGT")) == [] and one(matching.encoded(F.lit(None).cast("string"), "NACGT")) is None
    assert one(matching.decoded(F.array(*map(F.lit, (0, 4, 0, 1))), "NACGT")) == "TA"
    for bad in (matching.encoded(F.lit("ANC"), "NACGT"), matching.decoded(F.array(F.lit(5)), "NACGT")):
        with pytest.raises(Exception, match="not in the alphabet"):
            one(bad)
    assert one(delivery.within_geometry(F.lit("ACGTACGT"), 40, 10.0)) and not one(delivery.within_geometry(F.lit("ACGTACGTA"), 40, 10.0))


def test_scores_go_to_their_chunks_or_nowhere(spark):
    chunks = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), (None, 0, 1), ("a", 1, 7)], "read_id string, place int, n_ int")
    kind = "read_id string, place int, prob double"
    good = [("a", 0, 0.5), ("a", 1, None), (None, 0, 0.25), ("a", 0, 0.5)]
    run = lambda rows, of=chunks: sorted(map(tuple, delivery.aligned_scores(of, spark.createDataFrame(rows, kind), ["read_id", "place"]).collect()), key=repr)
    assert run(good) == sorted([("a", 0, 1, 0.5), ("a", 1, 0, None), ("a", 1, 7, None), (None, 0, 1, 0.25)], key=repr)
    assert run([], chunks.where("false")) == []
    for rows, what in ((good[:2], "a chunk without a score"), ([*good, ("b", 0, 0.5)], "a score without a chunk"), ([*good, ("a", 0, 0.6)], "unlike scores"), ([*good, ("a", 0, None)], "unlike scores")):
        with pytest.raises(Exception, match=what):
            run(rows)
    with pytest.raises(ValueError, match="of their own"):
        delivery.aligned_scores(chunks.withColumn("prob", F.lit(1)), chunks.withColumn("prob", F.lit(1)), ["read_id"])


def test_window_corpus(spark, tmp_path):
    signals = spark.createDataFrame([("a", list(range(10))), ("b", [1, 2]), ("c", None), ("d", list(range(4)))], "read_id string, signal array<int>")
    plan = spark.createDataFrame([("a", 9, "train"), ("b", 9, "train"), ("c", 4, "val"), ("d", 4, "val"), ("d", 3, "val"), ("e", None, "val")], "read_id string, anchor_end int, split string")
    path = str(tmp_path / "w")
    with pytest.raises(ValueError, match="2 of 6"):
        delivery.build_corpus(plan, signals, 4, path)
    assert not (tmp_path / "w_meta").exists()
    assert delivery.build_corpus(plan, signals, 4, path + "2", allow_shortfall=True) == 2
    got = spark.read.parquet(path + "2")
    assert sorted((r["read_id"], r["split"], r["x"]) for r in got.collect()) == [("a", "train", [5.0, 6.0, 7.0, 8.0]), ("d", "val", [0.0, 1.0, 2.0, 3.0])]
    assert json.loads(spark.read.text(path + "2_meta").first()[0]) == {"chunk": 4, "state_len": 4, "planned": 6, "rows": 2}
    with pytest.raises(ValueError, match="0 of 1"):
        delivery.build_corpus(plan.where("read_id = 'b'"), signals, 4, path + "3", allow_shortfall=True)
    assert sinks.write_corpus(got, str(tmp_path / "c")) == {"train": 1, "val": 1}


def test_sidecar_manifest_and_digest(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        x = rng.gauss(0, 3)
        rows.append((x, int(rng.random() < 1 / (1 + 2.718281828 ** -(0.4 * x + 0.5)))))
    path = str(tmp_path / "platt.json")
    out = calibration.platt_document(spark.createDataFrame(rows, "logit double, label int"), path)
    assert out["improved"] and out["n_val_samples"] == 4000 and abs(out["platt_a"] - 0.4) < 0.05
    assert calibration.calibration_of(spark, path) == (out["platt_a"], out["platt_b"])
    sinks.write_json(spark, {"platt_a": 1}, str(tmp_path / "x.json"))
    with pytest.raises(ValueError, match="platt_b"):
        calibration.calibration_of(spark, str(tmp_path / "x.json"))
    text = "read_id\tpod5\tanchor_end\ttarget\nr\tp\t5\tACG\n"
    for name in ("m.txt", "m.TSV"):
        (tmp_path / name).write_text(text)
        assert tables.manifest(spark, str(tmp_path / name)).count() == 1
    with pytest.raises(ValueError, match="a manifest is"):
        tables.manifest(spark, str(tmp_path / "m.json"))
    import hashlib

    assert tables.sha256(spark, str(tmp_path / "m.txt")) == hashlib.sha256(text.encode()).hexdigest()
