"""Model inputs, the bounded hold on models, and the ways from scores to calls."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.operators import predicting
from sigloom.operators.predicting import Inputs


def plain_kmers(text, places, n, before, after):
    codes = ["ACGT".find(c.upper().replace("U", "T")) for c in text]
    out = np.zeros((4 * (before + 1 + after), n))
    for k in range(before + 1 + after):
        for i in range(len(places) - 1):
            if i + k < len(codes) and codes[i + k] >= 0:
                out[4 * k + codes[i + k], max(0, places[i]) : max(0, min(n, places[i + 1]))] = 1
    return out


def test_inputs_are_what_models_take():
    batch = pa.RecordBatch.from_pydict({
        "signal": [[1.0, 2.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [7.0, 8.0, 9.0, 1.0]], "signal_residual": [[0.5], [0.0] * 6, [1.0] * 4], "sequence": ["ACG", "NUt", "ccA"],
        "features": [[[1.0, 2.0, 3.0, 4.0, 5.0]] * 2] * 3, "sequence_with_kmer_context": ["NACGTA", "ACGTACG", "NNNNN"], "seq_to_sig": [[0, 1, 4], [0, 2, 3, 4], [0, 4]],
    })
    x = Inputs(4, 3, features=True, feature_start=-2, dwell_offset=1).of(batch)
    assert x["signal"].tolist() == [[[1, 2, 0, 0], [0.5, 0, 0, 0]], [[2, 3, 4, 5], [0, 0, 0, 0]], [[7, 8, 9, 1], [1, 1, 1, 1]]]
    assert x["sequence"][0].argmax(0).tolist() == [0, 1, 2] and x["sequence"][1].sum(0).tolist() == [0, 1, 1] and x["sequence"][1, 3].tolist() == [0, 1, 1]
    assert x["features"].shape == (3, 2, 3) and x["features"][0, 0].tolist() == [3, 4, 5]
    assert Inputs(4, 3, features=True, wide=True).of(batch)["features"].shape == (3, 2, 5)
    spread = Inputs(4, 3, signal_kmer=(2, 2)).of(batch)["sequence"]
    for row, text, places in zip(spread, batch.column("sequence_with_kmer_context").to_pylist(), batch.column("seq_to_sig").to_pylist(), strict=True):
        assert (row == plain_kmers(text, places, 4, 2, 2)).all()
    with pytest.raises(ValueError, match="outside"):
        Inputs(4, 3, features=True, feature_start=-2, dwell_offset=2).of(batch)
    with pytest.raises(ValueError, match="letters"):
        Inputs(4, 5).of(batch)


def test_a_worker_holds_few_models():
    loaded = []

    def load(where):
        loaded.append(where)
        return lambda x: np.zeros(1)

    held = predicting.Held()
    for where in ("a", "b", "a", "c", "a", "b"):
        held.get(load, where, 2)
    assert loaded == ["a", "b", "c", "b"] and len(held.models) == 2


def mean_times(where):
    return lambda x: x["signal"][:, 0].mean(1) * float(where)


def chunks(spark):
    rows = [("r", 3, [1.0, 1.0], "ACG"), ("r", 9, [2.0, 2.0], "ACG"), ("r", 12, [-1.0, -1.0], "ACG"), ("s", 5, [0.0, 0.0], "ACG"), ("t", 1, [3.0, 0.0], "ACG")]
    return spark.createDataFrame(rows, "read_id string, base_index int, signal array<double>, sequence string").repartition(3)


MODELS = [(1, "B_C", "2", None, None), (0, "A_B", "1", 2.0, 0.5), (2, "A_C", "-1", None, 1.0)]


def models(spark):
    return spark.createDataFrame(MODELS, "place int, pair string, location string, platt_a double, platt_b double")


def test_all_models_score_every_chunk_and_the_last_chunk_counts(spark):
    scores = predicting.scored(chunks(spark), models(spark), Inputs(2, 3), mean_times, held=1)
    got = {(r["read_id"], r["base_index"]): r["logits"] for r in scores.collect()}
    assert got[("r", 9)] == [2.0, 4.0, -2.0] and got[("t", 1)] == [1.5, 3.0, -1.5] and len(got) == 5
    probs = predicting.pair_probabilities(scores, models(spark))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    last = {r["read_id"]: r["probs"] for r in predicting.of_read(probs, "last", "probs").collect()}
    assert np.allclose(last["r"], [sigmoid(2 * -1 + 0.5), sigmoid(-2), sigmoid(1 + 1)])
    pairs = spark.createDataFrame([("A_B", "A", "B", 0), ("B_C", "B", "C", 1), ("A_C", "A", "C", 2)], "pair string, neg string, pos string, place int")
    for method in predicting.METHODS:
        calls = {r["read_id"]: r for r in predicting.tagged(predicting.called_by_bundle(probs, pairs, method), 1, 1).collect()}
        assert set(calls) == {"r", "s", "t"} and calls["r"]["call"] in "ABC" and calls["r"]["pp"] == [round(255 * p) for p in last["r"]]
    # A: (1 - 0.18) + (1 - 0.88), B: 0.18 + (1 - 0.12), C: 0.12 + 0.88
    naive = {r["read_id"]: r["call"] for r in predicting.called_by_bundle(probs, pairs).collect()}
    votes = {"A": 2 - last["r"][0] - last["r"][2], "B": last["r"][0] + 1 - last["r"][1], "C": last["r"][1] + last["r"][2]}
    assert naive["r"] == max(votes, key=votes.get)
    with pytest.raises(ValueError, match="method"):
        predicting.called_by_bundle(probs, pairs, "other")


def test_classes_binary_and_untouched_reads(spark):
    one = spark.createDataFrame([(0, "1", None, None)], "place int, location string, platt_a double, platt_b double")
    scores = predicting.scored(chunks(spark), one, Inputs(2, 3), mean_times)
    marks = {r["read_id"]: (r["mp"], r["ml"]) for r in predicting.marked(predicting.pair_probabilities(scores, one)).collect()}
    assert marks["r"] == ([3, 9, 12], [int(255 / (1 + np.exp(-x))) for x in (1, 2, -1)])
    every = spark.createDataFrame([("r",), ("u",)], "read_id string")
    assert {r["read_id"]: r["mp"] for r in predicting.on_alignments(every, predicting.marked(predicting.pair_probabilities(scores, one))).collect()} == {"r": [3, 9, 12], "u": None}
    three = spark.createDataFrame([(0, "1"), (1, "2"), (2, "-1")], "place int, location string")
    logits = predicting.scored(chunks(spark), three, Inputs(2, 3), mean_times)
    calls = {r["read_id"]: r for r in predicting.called_by_classes(logits, ["x", "y"]).collect()}
    assert calls["r"]["call"] == "y" and calls["r"]["base_index"] == 3 and abs(sum(calls["r"]["probs"]) - 1) < 1e-12
    assert calls["s"]["call"] == "x"  # a tie: the first; the third class has no label of its own
    with pytest.raises(Exception, match="3 scores"):
        predicting.pair_probabilities(logits, models(spark).where("place < 2")).collect()


def test_too_many_or_no_models_are_an_error(spark):
    with pytest.raises(ValueError, match="more than 2"):
        predicting.listed(models(spark), most=2)
    with pytest.raises(ValueError, match="no models"):
        predicting.listed(models(spark).where(F.lit(False)))


def test_no_chunks(spark):
    assert predicting.scored(chunks(spark).where(F.lit(False)), models(spark), Inputs(2, 3), mean_times).collect() == []
