"""Properties of the operators that a comparison on sample tables doesn't show."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import calibration, crf, matching, metrics, normalize, preparing, scoring, splits, votes


def test_splits_are_disjoint_whole_and_of_the_right_size(spark):
    rows = spark.range(997).select((F.col("id") % 331).alias("read"))
    got = splits.by_read(rows, "read", 0.29, 0.3).collect()
    assert len(got) == len({r["read"] for r in got}) == 331
    count = {s: sum(r["split"] == s for r in got) for s in ("train", "val", "test")}
    assert count["train"] == int(331 * 0.29) and count["val"] == int(331 * 0.3)
    with pytest.raises(ValueError):
        splits.by_read(rows, "read", 0.8, 0.3)


def test_folds_partition(spark):
    got = splits.folds(spark.range(23), "id", 5).collect()
    for f in range(5):
        own = [r for r in got if r["fold"] == f]
        assert len(own) == 23
        assert sum(r["split"] == "test" for r in own) == (5 if f < 3 else 4)
    assert sorted(r["id"] for r in got if r["split"] == "test") == list(range(23))
    with pytest.raises(ValueError):
        splits.folds(spark.range(5), "id", 2)


def test_groups_never_cross(spark):
    rows = spark.createDataFrame([(f"g{i}", "a") for i in range(7)] + [("x", "b"), ("y", "b"), ("z", "c"), ("g1", "d")], "g string, l string")
    got = {r["g"]: r["split"] for r in splits.by_group(rows, "g", "l").collect()}
    assert got["z"] == "train" and {got["x"], got["y"]} == {"train", "test"}
    assert got["g1"] == "train"  # alone in the last label
    assert {"val", "test", "train"} <= set(got.values())
    three = splits.by_group(spark.createDataFrame([(f"g{i}", "a") for i in range(3)], "g string, l string"), "g", "l").collect()
    assert sorted(r["split"] for r in three) == ["train", "train", "val"]


def test_merge_needs_equal_columns(spark):
    a, b = spark.range(1), spark.range(1).withColumn("x", F.lit(1))
    with pytest.raises(ValueError, match="extra"):
        splits.merged([a, b])
    with pytest.raises(ValueError):
        splits.relabelled([a], "id", ["p"], ["p"])


def test_votes_break_ties_by_first_appearance(spark):
    pairs = spark.createDataFrame([("a_b", "a", "b", 0), ("b_c", "b", "c", 1), ("a_c", "a", "c", 2)], "pair string, neg string, pos string, place int")
    rows = spark.createDataFrame([(1, p, 0.5) for p in ("a_b", "b_c", "a_c")], "read_id int, pair string, prob double")
    assert votes.pairwise(rows, pairs).first()["call"] == "a"
    weighted = votes.pairwise(rows, pairs, weighted=True).first()
    assert weighted["call"] == "a" and weighted["confidence"] == 0.0
    alone = votes.tournament(rows, pairs, top=1).first()
    assert (alone["call"], alone["confidence"]) == ("a", 0.0)
    x = spark.range(1).select(votes.pair_labels(F.lit("a_b_c")).alias("x")).first()["x"]
    assert (x["neg"], x["pos"]) == ("a", "b_c")


def test_metrics_with_one_class_and_no_rows(spark):
    one = spark.createDataFrame([(1, 0.4), (1, 0.9)], "label int, prob double")
    assert metrics.auroc_auprc(one).first()["auroc"] == 0.0
    assert metrics.sweep(one).count() == 0
    assert metrics.tpr_at_fpr(metrics.sweep(one), 0.1).first()["tpr"] == 0.0
    none = one.where("label = 5")
    assert metrics.confusion(none).first()["f1"] == 0.0
    assert metrics.calibration_error(one.withColumn("prob", F.lit(1.0)).withColumn("r", F.lit(False)), "prob", "r").first()["ece"] == 0.0


def test_areas_as_defined(spark):
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(300)]
    got = metrics.auroc_auprc(spark.createDataFrame(rows, "label int, prob double")).first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert got["auroc"] == pytest.approx(want)


def test_platt_and_linear_maps_lower_the_loss(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2.0 * x - 0.5)))).astype(int)
    a, b = calibration.platt(spark.createDataFrame([(float(v), int(w)) for v, w in zip(x, y, strict=True)], "logit double, label int"))
    assert a == pytest.approx(2.0, abs=0.3) and b == pytest.approx(-0.5, abs=0.2)
    z = rng.normal(size=(400, 3)) * 4
    label = [int(rng.choice(3, p=np.exp(r / 3) / np.exp(r / 3).sum())) for r in z]
    rows = spark.createDataFrame([(r.tolist(), v) for r, v in zip(z, label, strict=True)], "logits array<double>, label int")

    def nll(params):
        p = rows.select(F.get(metrics.softmax(calibration.applied(F.col("logits"), params)), F.col("label")).alias("p"))
        return p.agg(-F.avg(F.ln("p"))).first()[0]

    base = nll({"method": "temperature", "t": 1.0})
    for kind in ("matrix", "dirichlet"):
        w, c = calibration.linear_map(rows, kind, steps=12)
        assert nll({"method": kind, "w": w.tolist(), "b": c.tolist()}) < base
    with pytest.raises(ValueError):
        calibration.applied(F.col("x"), {"method": "none"})
    assert calibration.noise_rates("a=0.1, b=0") == {"a": 0.1, "b": 0.0}
    with pytest.raises(ValueError):
        calibration.noise_rates("a=1.0")
    with pytest.raises(ValueError):
        calibration.focal(F.lit(0.0), F.lit(1), -1.0)
    for logit, y, r, w in ((0.3, 1, 0.2, 1.0), (-40.0, 1, 0.0, 2.0), (40.0, 0, 0.1, 1.0), (0.0, 1, 1.0, 1.0), (2.0, 0, None, 3.0)):
        p, rate = 1 / (1 + math.exp(-logit)), r or 0.0
        q = (1 - rate) * p + rate * (1 - p)
        want = -(w * y * math.log(q) + (1 - y) * math.log(1 - q)) if 0 < q < 1 else 0.0
        got = spark.range(1).select(calibration.noisy_bce(F.lit(logit), F.lit(y), F.lit(r).cast("double"), w).alias("x")).first()["x"]
        assert got == pytest.approx(want, rel=1e-6)
    hot = calibration.temperature(spark.createDataFrame([([1.0, 0.0], 0)], "logits array<double>, label int")).first()
    assert hot["temperature"] == pytest.approx(0.1, abs=1e-5)


def test_nearest_reference_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "ACGT"), (2, "AAAA")], "id int, s string")
    panel = spark.createDataFrame([("b", "ACGA"), ("a", "ACGG"), ("c", "TTTT")], "name string, q string")
    monkeypatch.setattr(matching, "PANEL", 2)
    got = {r["id"]: r for r in matching.nearest(rows, "s", panel, "name", "q").collect()}
    assert (got[1]["call"], got[1]["distance"], got[1]["margin"]) == ("a", 1, 0)
    assert (got[2]["call"], got[2]["distance"], got[2]["margin"]) == ("b", 2, 1)
    assert matching.nearest(rows, "s", panel.where("name = 'c'"), "name", "q").first()["margin"] == 0
    with pytest.raises(ValueError):
        matching.nearest(rows, "s", panel.where("false"), "name", "q")


def paths(scores, n_base, state_len):
    """Every path of a short read: (score, emitted bases, first state)."""
    before = crf.predecessors(n_base, state_len)
    n = len(before)
    s = scores.reshape(len(scores), n, n_base + 1)
    for start in range(n):
        for edges in itertools.product(range(n), repeat=len(scores)):
            state, total, out, ok = start, 0.0, [], True
            choices = [(0.0, start, ())]
            for t, to in enumerate(edges):
                choices = [(v + s[t, to, e], to, o + ((to % n_base,) if e else ())) for v, at, o in choices for e in range(n_base + 1) if before[to, e] == at]
            yield from ((v, o, start) for v, _, o in choices)
            del state, total, out, ok


def test_crf_sums_and_best_paths(spark):
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(1, 3, 6))
    every = list(paths(scores[0], 2, 1))
    assert crf.log_partition(scores, 2, 1)[0] == pytest.approx(math.log(sum(math.exp(v) for v, _, _ in every)))
    before, s = crf.predecessors(2, 1), scores.reshape(3, 2, 3)
    steps = [(to, e) for to in range(2) for e in range(3)]
    whole = [p for p in itertools.product(steps, repeat=3) if all(before[b[0], b[1]] == a[0] for a, b in zip(p, p[1:], strict=False))]
    weight = {p: math.exp(sum(s[t, to, e] for t, (to, e) in enumerate(p))) for p in whole}
    total = sum(weight.values())
    posterior = crf.posteriors(scores, 2, 1)[0]
    for t, (to, e) in itertools.product(range(3), steps):
        assert posterior[t, to, e] == pytest.approx(sum(w for p, w in weight.items() if p[t] == (to, e)) / total)
    best = max(whole, key=lambda p: sum(math.log(posterior[t, to, e] + 1e-8) for t, (to, e) in enumerate(p)))
    assert crf.decoded(scores, 2, 1, "AC")[0] == "".join("AC"[to % 2] for to, e in best if e)
    target = np.array([1, 0, 1])
    want = math.log(sum(math.exp(v) for v, o, first in every if first == 1 and o == (0, 1)))
    assert crf.log_target(scores[0], target, 2, 1) == pytest.approx(want)
    assert crf.loss(scores, [target], 2, 1)[0] >= 0
    assert crf.tail(np.zeros((2, 4)), 2, 2).shape == (2, 6)
    with pytest.raises(ValueError):
        crf.log_partition(np.zeros((1, 2, 5)), 2, 1)


def test_scoring_loads_a_model_once_per_worker(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, x array<double>")
    got = {r["id"]: r["logits"] for r in scoring.scored(rows, "id", "x", "double", lambda _: lambda x: x * 2).collect()}
    assert got == {1: [2.0, 4.0], 2: [6.0, 8.0]}


def test_a_shard_does_not_change_the_plan(spark):
    rows = [(i, 700 + i, "g" if i % 3 else "h", f"b{i % 4}") for i in range(200)]
    m = spark.createDataFrame(rows, "read_id int, anchor_end int, group string, batch string")
    whole = {r["read_id"]: (r["rank"], r["split"]) for r in splits.planned(m, 500, 0.2).collect()}
    shard = {r["read_id"]: (r["rank"], r["split"]) for r in splits.planned(m, 500, 0.2, shard=["b1"]).collect()}
    assert shard and all(whole[k] == v for k, v in shard.items())
    assert 0 not in whole  # 700 is not above 500 + 200
    with pytest.raises(ValueError):
        splits.planned(m, 500, 0.2, shard=["b1", "none"])
    with pytest.raises(ValueError):
        splits.planned(m, 5000, 0.2)


def test_batches_take_turns_across_groups(spark):
    rows = [(i, 10_000, "g" if i % 5 else "h", "big" if i < 90 else "small") for i in range(100)]
    m = spark.createDataFrame(rows, "read_id int, anchor_end int, group string, batch string")
    import hashlib

    turn = {}
    for b in ("big", "small"):
        for k, i in enumerate(sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, _, _, x in rows if x == b)):
            turn[i[1]] = (k, b, i[1])
    for g in "gh":
        want = sorted(turn[i] for i, _, x, _ in rows if x == g)
        got = {r["rank"]: r["read_id"] for r in splits.planned(m, 500, 0.2, per_group=1000).collect() if r["group"] == g}
        assert [got[k] for k in range(len(want))] == [w[2] for w in want]


def test_checkpoints(spark):
    from sigloom.sources import sinks

    h = spark.createDataFrame([(1, 1.0), (2, 1.2)], "epoch int, loss double")
    assert sinks.best_checkpoint(h).first()["epoch"] == 2
    assert sinks.best_checkpoint(h, 0.05).first()["epoch"] == 1
    assert sinks.best_checkpoint(h, 0.05, always_final=True).first()["epoch"] == 2
    with pytest.raises(ValueError):
        sinks.best_checkpoint(h.where("epoch > 5"))


def test_motifs_on_the_reference(spark):
    from sigloom.operators import preparing

    refs = spark.createDataFrame([("r", "AACCAACCAA"), ("none", "TTTT")], "reference_name string, sequence string")
    block = "array<struct<op: int, len: int>>"
    reads = spark.createDataFrame(
        [(1, "r", 0, [(0, 10)]), (2, "r", 0, [(0, 3), (1, 1), (2, 1), (0, 6)]), (3, "r", 2, [(4, 5), (0, 2)]), (4, "x", 0, [(0, 10)]), (5, "r", 0, [(0, 2), (2, 8)])],
        f"read_id int, reference_name string, reference_start int, cigar {block}",
    )

    def found(**options):
        return sorted(tuple(r) for r in preparing.reference_motifs(reads, refs, "CC", **options).collect())

    assert found() == [(1, 2, 0, True), (1, 6, 0, True), (2, 6, 0, True), (3, 5, 0, True)]
    assert found(anchor="reference", require_mapping=False) == [(1, 2, 0, True), (1, 6, 0, True), (2, 2, 0, False), (2, 6, 0, True), (3, 0, 0, True), (5, 2, 0, False), (5, 6, 0, False)]
    paired = reads.where("read_id = 2").withColumn("cigar", F.expr(f"cast(array(struct(0, 3), struct(1, 1), struct(0, 1), struct(2, 1), struct(0, 5)) as {block})"))
    assert [tuple(r) for r in preparing.reference_motifs(paired, refs, "ACC").collect()] == [(2, 1, 1, True), (2, 5, 0, True)]
    assert [tuple(r) for r in preparing.reference_motifs(paired, refs, "ACC", skip_indels=True).collect()] == [(2, 5, 0, True)]
    for wrong in ({"anchor": "other"}, {"require_mapping": False}):
        with pytest.raises(ValueError):
            preparing.reference_motifs(reads, refs, "CC", **wrong)


def test_move_tables_and_missing_signals(spark):
    from sigloom.operators import preparing

    rows = spark.createDataFrame([(1, "5,1,0,1", 20, 2), (2, None, 20, None), (3, "5,x", 20, 0), (4, "5,1", None, 0), (5, "2,1,1", 6, None)], "read_id int, mv string, ns int, ts int")
    t = {r["read_id"]: r["t"] for r in rows.select("read_id", preparing.move_table(preparing.parsed_moves(F.col("mv")), F.col("ns"), F.col("ts")).alias("t")).collect()}
    assert (t[1]["stride"], t[1]["moves"], t[1]["trim"]) == (5, [1, 0, 1], 2) and t[5]["trim"] == 0
    assert t[2] is None and t[3] is None and t[4] is None
    joined = preparing.with_signals(rows, spark.createDataFrame([(1, [1.0])], "read_id int, v array<double>")).collect()
    assert sorted(r["read_id"] for r in joined if r["missing"]) == [2, 3, 4, 5]


def test_parametric_metrics_and_codes(spark):
    rows = spark.createDataFrame([(i, i % 2, (i % 7) / 7) for i in range(40)], "id int, label int, prob double")
    assert 0 <= metrics.parametric(rows, "tpr_at_fpr", 0.1, "id") <= 1 and 0 <= metrics.parametric(rows, "callable_at_precision", 0.5, "id") <= 1
    with pytest.raises(ValueError):
        metrics.parametric(rows, "none", 0.1, "id")
    got = {r["v"]: r["code"] for r in splits.first_codes(spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (0, None)], "id int, v string"), "v", "id").collect()}
    assert got == {"b": 0, "a": 1}
    rated = calibration.with_rates(spark.createDataFrame([("a",), ("",), (None,), ("z",)], "g string"), "g", {"a": 0.1, "unknown": 0.3}).collect()
    assert sorted((r["g"], r["noise_rate"]) for r in rated) == [("a", 0.1), ("unknown", 0.3), ("unknown", 0.3), ("z", 0.0)]


def test_checks_of_shapes_and_windows(spark):
    from sigloom.operators import preparing

    rows = spark.createDataFrame([([1.0, 2.0], [[1.0], [2.0]])], "chunk_signal array<double>, chunk_features array<array<double>>")
    assert preparing.check_shapes(rows, 2, 2).count() == 1
    for options in ((3, 2), (2, 5)):
        with pytest.raises(Exception, match="a chunk has"):
            preparing.check_shapes(rows, *options).collect()
    two = rows.select(F.array("chunk_signal", "chunk_signal").alias("chunk_signal"), "chunk_features")
    assert preparing.check_shapes(two, 2, channels=2).count() == 1
    preparing.check_window(100, 10, 9.0)
    for wrong in ((80, 10, 9.0), (1000, 4, 9.0)):
        with pytest.raises(ValueError):
            preparing.check_window(*wrong)
    chunks_ = spark.createDataFrame([(0, 3), (0, 3)], "feature_start int, feature_end int")
    assert preparing.feature_window({}, chunks_) == (0, 3) and preparing.feature_window({"feature_start": 0}) == (0, None)
    assert preparing.feature_window({}, rows) == (None, None)
    with pytest.raises(ValueError):
        preparing.feature_window({}, chunks_.union(spark.createDataFrame([(1, 3)], chunks_.schema)))


def test_confound_classes_and_grid_summary(spark, tmp_path):
    from sigloom.sources import sinks

    labels = spark.createDataFrame([("x", 4), ("y", 5), ("z", 6)], "name string, label_int int")
    got = calibration.confound_classes(labels, spark.createDataFrame([("x", "T"), ("y", None)], "name string, base string")).collect()
    assert [tuple(r) for r in got] == [(4, 3)]
    with pytest.raises(Exception, match="no base"):
        calibration.confound_classes(labels, spark.createDataFrame([("x", "N")], "name string, base string")).collect()
    points = spark.createDataFrame([(5, 9, 0, 0.5), (7, 9, 0, None), (6, 9, 0, 0.9)], "left_context int, right_context int, dwell_offset int, best_val_selection double")
    sinks.write_grid_summary(points, f"{tmp_path}/grid")
    back = spark.read.csv(f"{tmp_path}/grid", header=True)
    assert tuple(back.columns) == sinks.GRID_COLUMNS and [r["left_context"] for r in back.collect()] == ["6", "5", "7"]
    sinks.write_grid_summary(points.where("false"), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()


def test_motifs_are_joined_by_bins(spark, monkeypatch):
    rng = random.Random(8)
    texts = {"a": "".join(rng.choices("ACGT", k=700)), "b": "".join(rng.choices("ACé", k=300)), "c": "AC", "d": "", "e": "ACAC" * 40}
    references = spark.createDataFrame(list(texts.items()), "reference_name string, sequence string")
    for size in (1, 2, 7, 64, 1 << 14):
        got = {(r["reference_name"], p) for r in preparing.motif_places(references, "ACA", size).collect() for p in r["places"]}
        assert got == {(n, i) for n, t in texts.items() for i in range(len(t)) if t.startswith("ACA", i)}
    rows = [(i, rng.choice([*texts, "none"]), rng.randint(0, 400), [(0, rng.randint(1, 90)), (rng.choice([1, 2, 3]), rng.randint(1, 4)), (0, rng.randint(1, 250))]) for i in range(120)]
    alignments = spark.createDataFrame(rows, "read_id int, reference_name string, reference_start int, cigar array<struct<op:int,len:int>>").repartition(3)
    found = []
    for size in (16, 1 << 14):
        monkeypatch.setattr(preparing, "BIN", size)
        found.append(sorted(map(tuple, preparing.reference_motifs(alignments, references, "AC").collect())))
    assert found[0] == found[1] and len(found[0]) > 500


def test_class_weights_of_few_classes(spark):
    of = lambda labels: {r["y"]: r["weight"] for r in metrics.class_weights(spark.createDataFrame([(x,) for x in labels], "y int"), "y").collect()}
    assert of([0, 0, 0, 1]) == {1: 3.0} and of([1, 1]) == {} and of([0, 2]) == {} and of([]) == {} and of([1, 3]) == {1: 0.0}
    assert of([0, 1, None, 3]) == {0: math.sqrt(3 / 4), 1: math.sqrt(3 / 4), 2: 1.0, 3: math.sqrt(3 / 4)}


def test_standardisation_far_from_zero(spark):
    x = [1e9 + v for v in (0.0, 1.0, 2.0, 3.0)]
    got = metrics.standardisation(spark.createDataFrame([([5.0, *x[:2]],), (x[2:],), ([],), (None,)], "s array<double>"), "s", 2).first()
    assert got["n"] == 4 and got["mean"] == 1e9 + 1.5 and got["std"] == pytest.approx(math.sqrt(1.25))


def test_merged_columns_take_the_type_that_holds_all(spark):
    wide = lambda a, b: splits.output_types([spark.createDataFrame([], f"x {t}").schema for t in (a, b)], ["a", "b"])["x"].simpleString()
    cases = {
        ("tinyint", "int"): "int", ("boolean", "smallint"): "smallint", ("smallint", "float"): "float", ("int", "float"): "double", ("bigint", "double"): "double", ("float", "double"): "double",
        ("string", "int"): "string", ("array<int>", "array<float>"): "array<double>", ("array<array<float>>", "array<array<double>>"): "array<array<double>>", ("string", "string"): "string",
    }
    for (a, b), want in cases.items():
        assert wide(a, b) == wide(b, a) == want
    for a, b in (("array<int>", "int"), ("array<array<int>>", "array<int>"), ("binary", "string"), ("map<string,int>", "string"), ("date", "int")):
        with pytest.raises(ValueError, match="b: column x"):
            wide(a, b)
    one = spark.createDataFrame([(1, [1.5, 2.5], "a")], "k smallint, s array<float>, t string")
    two = spark.createDataFrame([("b", [3], 2**40)], "t string, s array<int>, k bigint")
    got = splits.merged([one, two], ["one.npz", "two.npz"])
    assert dict(got.dtypes) == {"k": "bigint", "s": "array<double>", "t": "string"} and sorted(map(tuple, got.collect())) == [(1, [1.5, 2.5], "a"), (2**40, [3.0], "b")]
    with pytest.raises(ValueError, match="two.npz: missing \\['s'\\]"):
        splits.merged([one, two.drop("s")], ["one.npz", "two.npz"])
    with pytest.raises(Exception, match="two.npz: column s has 1 entries"):
        splits.merged([one, two], ["one.npz", "two.npz"], {"s": (2,)}).collect()
    deep = spark.createDataFrame([([[1.0, 2.0]],), (None,)], "f array<array<double>>")
    assert splits.merged([deep, deep], widths={"f": (1, 2)}).count() == 4
    with pytest.raises(Exception, match="input 1"):
        splits.merged([deep, spark.createDataFrame([([[1.0]],)], "f array<array<double>>")], widths={"f": (1, 2)}).collect()


def test_normalised_samples_keep_their_rows(spark):
    rows = [(1, k, v, "x") for k, v in enumerate((5.0, 1.0, None, 9.0, 2.0))] + [(2, 0, 4.0, "y"), (2, 1, 4.0, "z"), (3, 0, None, "n"), (None, 0, 1.0, "q")]
    samples = spark.createDataFrame(rows, "read_id int, sample int, x double, other string")
    for method in normalize.METHODS:
        got = {(r["read_id"], r["sample"]): r for r in normalize.normalised(samples, method).collect()}
        assert len(got) == len(rows) and all(r["other"] for r in got.values())
        assert got[(1, 2)]["y"] is None and got[(3, 0)]["y"] is None
        if method != "pa_scaling":
            assert got[(2, 0)]["y"] == got[(2, 1)]["y"] == got[(None, 0)]["y"] == 0.0
    got = {(r["read_id"], r["sample"]): r["y"] for r in normalize.normalised(samples, "median_mad").collect()}
    assert got[(1, 3)] == pytest.approx((9 - 3.5) / (1.4826 * 2))
    with pytest.raises(ValueError):
        normalize.normalised(samples, "other")


def test_nearest_measures_a_distinct_text_once(spark):
    """Rows of one text share one measurement; nulls stay rows."""
    decodes = spark.createDataFrame([(i, (None, "ab", "ac")[i % 3]) for i in range(30)], "id int, s string")
    panel = spark.createDataFrame([("x", "ab"), ("y", "acd")], "name string, sequence string")
    out = matching.nearest(decodes, "s", panel, "name", "sequence")
    got = {tuple(r)[1:] for r in out.collect()}
    assert out.count() == 30 and got == {(None, "x", None, 0), ("ab", "x", 0, 2), ("ac", "x", 1, 0)}
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()


def test_motifs_by_rule_walk_an_alignment_once(spark):
    cigar = "array(named_struct('op', 0, 'len', 3), named_struct('op', 2, 'len', 2), named_struct('op', 0, 'len', 9))"
    reads = spark.range(3).selectExpr("id as read_id", "0L as reference_name", "int(id) as reference_start", f"{cigar} as cigar")
    refs = spark.createDataFrame([(0, "ACACGACCACACACGACA")], "reference_name long, sequence string")
    rules = {"lenient": {}, "strict": {"skip_indels": True}, "reference": {"anchor": "reference", "require_mapping": False}}
    out = preparing.motifs_by_rule(reads, refs, "CA", rules)
    for rule, options in rules.items():
        one = sorted(map(tuple, preparing.reference_motifs(reads, refs, "CA", **options).collect()))
        assert one and one == sorted(tuple(r)[:4] for r in out.where(F.col("rule") == rule).collect())
