"""Worked examples of the column functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import arrays, sequence, signal
from sigloom.plans import reads


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in inputs.items()])
    return row.select(column.alias("x")).first()["x"]


def test_move_map_and_dwells(spark):
    m = signal.move_map(F.col("mv"), F.lit(5), F.lit(0), F.lit(40))
    assert value(spark, m, mv=[1, 1, 0, 1, 0, 0, 0, 1]) == [0, 5, 15, 35, 40]
    assert value(spark, signal.dwells(m), mv=[1, 1, 0, 1, 0, 0, 0, 1]) == [5, 10, 20, 5]
    assert value(spark, signal.move_map(F.col("mv"), F.lit(5), F.lit(None).cast("int"), F.lit(35)), mv=[1, 0, 0, 1, 1, 0, 1]) == [0, 15, 20, 30, 35]


def test_dwell_window_repeats_the_edges(spark):
    got = value(spark, signal.dwell_features(F.col("d")), d=[5, 10, 8, 12, 6, 9])
    assert [round(x["dwell_mean"], 9) for x in got] == [6.6, 8.0, 8.2, 9.0, 8.8, 9.0]
    d = np.pad([5, 10, 8, 12, 6, 9], 2, mode="edge")
    assert [x["dwell_std"] for x in got] == pytest.approx([np.std(d[i : i + 5]) for i in range(6)])


def test_levels(spark):
    got = value(spark, signal.level_features(F.col("s"), F.col("m")), s=[1.0, 1.1, 0.9, 2.0, 2.1, 1.9, 3.0, 3.1, 2.9], m=[0, 3, 6, 9, 9])
    assert [round(x["level_mean"], 9) for x in got] == [1, 2, 3, 0]
    assert [x["level_median"] for x in got] == [1, 2, 3, 0]
    assert got[3]["level_std"] == 0 and got[3]["level_range"] == 0
    assert value(spark, signal.level_features(F.col("s"), F.col("m")), s=[4.0, 6.0], m=[-3, 2])[0]["level_mean"] == 5


def test_arrays_at_their_edges(spark):
    none = F.array().cast("array<double>")
    assert value(spark, arrays.indices(F.lit(0))) == []
    assert value(spark, arrays.indices(F.lit(-2))) == []
    assert value(spark, arrays.mean(none)) == 0 and value(spark, arrays.std(none)) == 0 and value(spark, arrays.median(none)) == 0
    assert value(spark, arrays.padded(F.col("v"), F.lit(-1), F.lit(4)), v=[1.0, 2.0]) == [0, 1, 2, 0, 0]
    assert value(spark, signal.centred(F.col("v"), 2), v=[1.0, 2.0, 3.0, 4.0]) == [2, 3]


def test_motifs_overlap_and_ignore_case(spark):
    assert value(spark, sequence.motif_hits(F.lit("ACACACA"), "aca")) == [0, 2, 4]
    assert value(spark, sequence.motif_hits(F.lit("acgtccaggcttccaggc"), "CCAGGC")) == [4, 12]
    assert value(spark, sequence.motif_hits(F.lit("AC"), "ACA")) == []
    assert value(spark, sequence.motif_hits(F.lit("ACACACA"), "ACA", F.lit(1), F.lit(6))) == [2]


def test_codes_and_contexts(spark):
    assert value(spark, sequence.base_codes(F.lit("ACgtuN"))) == [0, 1, 2, 3, 3, -1]
    assert value(spark, sequence.one_hot(F.lit("AU")))[3] == [0, 1]
    assert value(spark, sequence.context(F.lit("ACGTA"), F.lit(0), 2, 2)) == "NNACG"
    assert value(spark, sequence.context(F.lit("ACGTA"), F.lit(4), 2, 2)) == "GTANN"
    assert value(spark, sequence.one_side_masked(F.lit("ACGTA"), F.lit(2), "left")) == "NNGTA"
    assert value(spark, sequence.one_side_masked(F.lit("ACGTA"), F.lit(9), "right")) == "ACGTA"
    with pytest.raises(ValueError):
        sequence.one_side_masked(F.lit("A"), F.lit(0), "both")


def cigar(*steps):
    return F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in steps])


def test_cigar_coordinates(spark):
    c = cigar((4, 3), (0, 10), (1, 1), (0, 10))
    x = value(spark, sequence.query_interval(c, F.lit(100), F.lit(108), F.lit(114)))
    assert (x["q_start"], x["q_stop"]) == (11, 18)
    assert value(spark, sequence.query_interval(c, F.lit(100), F.lit(98), F.lit(104))) is None
    skip = cigar((0, 5), (3, 10), (0, 5))
    assert value(spark, sequence.query_interval(skip, F.lit(0), F.lit(15), F.lit(20)))["q_start"] == 5
    assert value(spark, sequence.query_interval(skip, F.lit(0), F.lit(5), F.lit(10), advance_skips=False))["q_start"] == 5
    k = value(spark, sequence.knots(cigar((0, 5), (2, 5), (0, 5))))
    assert (k["x"], k["y"]) == ([0, 4, 10, 14], [0, 4, 5, 9])
    y = signal.interpolated(F.lit(7.0), F.col("x"), F.col("y"))
    assert value(spark, y, x=[0, 4, 10, 14], y=[0, 4, 5, 9]) == pytest.approx(np.interp(7, [0, 4, 10, 14], [0, 4, 5, 9]))


def test_stretching_by_one_changes_nothing(spark):
    assert value(spark, signal.stretched(F.col("v"), F.lit(1.0), F.lit(2)), v=[1.0, 5.0, 2.0]) == [1, 5, 2]
    assert value(spark, signal.stretched_map(F.col("m"), F.lit(1.0), F.lit(2), 9), m=[0, 3, 9]) == [0, 3, 9]


def test_motif_hits_are_those_of_every_place(spark):
    import random

    from pyspark.sql import functions as F

    from sigloom.functions import arrays, sequence

    rng = random.Random(9)
    texts = ["", None, "a", "ana", "ananana", "xéana", "日ana日ANA", "an" * 2000, "na" * 1500 + "é" + "ana" * 900]
    texts += ["".join(rng.choice("anAN.é") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")

    def upper(s):
        return "".join(c.upper() if c.isascii() else c for c in s)

    for motif in ("ana", "a", "nan", "."):
        got = {r["i"]: (r["every"], r["some"]) for r in rows.select("i", sequence.motif_hits(F.col("s"), motif).alias("every"), sequence.motif_hits(F.col("s"), motif, F.lit(2), F.lit(9)).alias("some")).collect()}
        for i, t in enumerate(texts):
            want = [p for p in range(len(t) - len(motif) + 1) if upper(t)[p : p + len(motif)] == motif.upper()] if t else []  # a null text has no hit
            assert got[i][0] == want, (motif, t)
            assert got[i][1] == [p for p in want if p >= 2 and p + len(motif) <= 9]
    long = spark.range(1).select(arrays.running(F.sequence(F.lit(1), F.lit(2000))).alias("x")).first()["x"]
    assert long == [k * (k + 1) // 2 for k in range(2000)]


def test_one_hot_rows_are_the_rows_of_one_hot(spark):
    texts = ["ACGTUacgtuN", "", "A\x01C\nG", "a😀cgé T😀😀", None]
    rows = spark.createDataFrame([(s,) for s in texts], "s string")
    for r in rows.select("s", sequence.one_hot("s").alias("x"), sequence.one_hot_rows(F.col("s")).alias("rows")).collect():
        assert r["rows"] == (None if r["s"] is None else ["".join(map(str, x)) for x in r["x"]])
    same = rows.select(sequence.recoded(F.col("s"), "acgt", "tgca").eqNullSafe(F.translate("s", "acgt", "tgca")).alias("same"))
    assert all(r["same"] for r in same.collect())


def test_one_hot_query_takes_texts_alone_and_no_call_a_letter(spark, tmp_path):
    spark.createDataFrame([(1, "Ab c"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = reads.encodings(spark, str(tmp_path))
    assert [tuple(r)[:3] for r in out.orderBy("doc_id", "base").collect()] == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 3, 0), (3, 0, 0), (3, 1, 0), (3, 2, 0), (3, 3, 0)]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_kmers_are_cut_in_one_pass(spark):
    texts = ["ACgUNa", "", "A\r\nC\nG", "a😀cgé😀", "ac", None]
    rows = spark.createDataFrame([(s,) for s in texts], "s string")
    for k in (1, 3):
        out = rows.select("s", sequence.kmers(F.col("s"), k).alias("x"))
        for r in out.collect():
            upper = r["s"] and "".join(c.upper() if c.isascii() else c for c in r["s"]).replace("U", "T")
            assert r["x"] == (None if r["s"] is None else [upper[i : i + k] for i in range(len(upper) - k + 1)])
        assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
