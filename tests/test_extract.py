"""Reads to chunks against a plain program, read by read; the failure budget; coordinate walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import sequence, signal
from sigloom.operators import extract
from sigloom.operators.extract import Plan

SCHEMA = (
    "read_id long, sequence string, v array<int>, table struct<stride:int,moves:array<int>,samples:int,trim:int>, reference_sequence string, cigar array<struct<op:int,len:int>>,"
    " cal_offset double, cal_scale double, levels array<double>, label_int int, anchor_sample int, reference_name string"
)
MATCHING, ON_REFERENCE, ON_QUERY = (0, 7, 8), (0, 2, 3, 7, 8), (0, 1, 4, 7, 8)


def reads(n=40, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        stride, trim, bases = rng.choice([1, 2, 5]), rng.randint(0, 4), rng.randint(12, 30)
        moves = []
        for _ in range(bases):
            moves += [1] + [0] * rng.randint(0, 3)
        samples = trim + stride * len(moves)
        v = [rng.randint(0, 900) for _ in range(samples + rng.randint(-2, 6))]
        text = "".join(rng.choice("ACGT") for _ in range(bases))
        cigar, left = [], bases
        if rng.random() < 0.5:
            k = rng.randint(1, 3)
            cigar, left = [(4, k)], left - k
        while left > 0:
            k = rng.randint(1, left)
            cigar.append((rng.choice([0, 7, 8, 0]), k))
            left -= k
            if left and rng.random() < 0.8:
                op = rng.choice([1, 2, 3])
                k = rng.randint(1, min(3, left)) if op == 1 else rng.randint(1, 3)
                cigar.append((op, k))
                left -= k if op == 1 else 0
        if rng.random() < 0.3:
            cigar += [(2, 2), (4, 0)]
        length = sum(k for op, k in cigar if op in ON_REFERENCE)
        reference = "".join(rng.choice("ACGT") for _ in range(length))
        levels = [rng.choice([0.0, rng.uniform(-2, 2)]) for _ in range(max(bases, length) - rng.randint(0, 3))]
        out.append((i, text, v, (stride, moves, samples, trim), reference, [(op, k) for op, k in cigar], 3.5, 0.25, levels, i % 2, rng.randint(-3, samples + 3) if i % 5 else None, "r"))
    return out


BROKEN = [
    (100, "ACGTACGTACGTACG", None, (1, [1] * 15, 15, 0), None, None, None, None, [], 0, 3, "r"),
    (101, "ACGTACGTACGTACG", [1] * 15, None, None, None, None, None, [], 0, 3, "r"),
    (102, None, [1] * 15, (1, [1] * 15, 15, 0), None, None, 1.0, 1.0, [], 0, 3, "r"),
    (103, "ACGTACGTACGTACG", [1] * 15, (1, [1] * 15, 15, 15), None, None, 1.0, 1.0, [], 0, 3, "r"),
    (104, "ACGTACGTACGTACG", [1] * 15, (1, [1] * 15, 15, 0), "ACG", [(4, 15)], None, None, None, 0, None, None),
    (105, "GGGGGGG", [5] * 7, (1, [1] * 7, 7, 0), None, None, 1.0, 1.0, [], 0, 3, "r"),
]


def plain_reference_map(m, cigar):
    while cigar and cigar[-1][0] not in MATCHING:
        cigar = cigar[:-1]
    x, y, r, q = [0], [0], 0, 0
    for op, n in cigar:
        if op in MATCHING:
            x += [r, r + n - 1]
            y += [q, q + n - 1]
        r += n if op in ON_REFERENCE else 0
        q += n if op in ON_QUERY else 0
    x.append(r)
    y.append(q)
    places = np.interp(np.arange(r + 1), x, y)
    return np.floor(np.interp(places, np.arange(len(m)), m)).astype(int)


def plain(row, plan, motif, focus, levels):
    """One read as the rules say, with numpy; the chunks as dicts, None if it fails."""
    _, text, v, (stride, moves, samples, trim), reference, cigar, offset, scale, expected, label, anchor, _ = row
    x = np.array(v[trim:samples], float)
    m = np.array([i * stride for i, one in enumerate(moves) if one == 1] + [samples - trim])
    if plan.reverse:
        x, m = x[::-1], len(x) - m[::-1]
    if plan.norm == "pa_scaling":
        x = ((x + offset) * scale - plan.pa_mean) / plan.pa_stdev
    elif plan.norm == "zscore":
        x = (x - x.mean()) / x.std()
    else:
        of = np.clip(x, *np.quantile(x, [0.01, 0.99])) if plan.norm == "quantile" else x
        centre = np.median(of)
        x = (x - centre) / (1.4826 * np.median(np.abs(of - centre)))
    whole, shift = x, 0
    if plan.anchor == "reference":
        m = plain_reference_map(m, cigar)
        if m[0] < 0:
            return None
        shift = m[0]
        x, m, text = x[m[0] : m[-1]], m - m[0], reference
    d = np.diff(m).astype(float)
    pad = np.pad(d, 2, mode="edge")
    around = np.array([pad[i : i + 5] for i in range(len(d))])
    spans = [x[max(a, 0) : max(0, b)] for a, b in zip(m, m[1:], strict=False)]
    of = lambda f: np.array([f(s) if len(s) else 0.0 for s in spans])
    rows = [d, np.log(d + 1e-6), around.mean(1), around.std(1), d / (around.mean(1) + 1e-6), of(np.mean), of(np.median), of(np.std), of(np.ptp)]
    residual = None
    if levels:
        e = np.zeros(len(d))
        e[: min(len(d), len(expected))] = expected[: len(d)]
        rows += [e, rows[5] - e, np.abs(rows[5] - e)]
        base = np.searchsorted(m, np.arange(len(x)), side="right") - 1
        level = np.array([e[b] if 0 <= b < len(e) else 0.0 for b in base])
        residual = np.where(level != 0, x - level, 0.0)
    if focus == "sample":
        if anchor is None:
            return []
        places = [int(np.clip(np.searchsorted(m, anchor, side="right") - 1, 5, len(text) - 6))]
    elif motif:
        places = [i + 1 for i in range(len(text)) if text.startswith(motif, i)]
    else:
        places = list(range(5, max(5, len(text) - 5)))
    out = []
    for b in places:
        if not 0 <= b < len(m) - 1:
            continue
        at = {"start": m[b], "end": m[b + 1], "center": (m[b] + m[b + 1]) // 2}[plan.justify]
        n = plan.samples
        if plan.context_bases:
            last = len(m) - 2
            start, end = m[max(0, min(last, b - plan.context_bases[0]))], m[max(0, min(last, b + plan.context_bases[1])) + 1]
            if end - start > n:
                start += (end - start - n) // 2
                end = start + n
            low, high = start, end
        else:
            start, end = at - plan.left, at + plan.right
            low, high = max(0, start), min(len(x), end)
        cut = lambda y: [y[start + i] if 0 <= start + i < min(end, len(y)) else 0.0 for i in range(n)]
        sig = cut(x)
        if plan.recover_clipped and not plan.context_bases:
            sig = [x[start + i] if 0 <= start + i < len(x) else whole[start + i + shift] if 0 <= start + i + shift < len(whole) else 0.0 for i in range(n)]
        first = max(0, int(np.searchsorted(m, low, side="right")) - 1)
        past = min(len(text), int(np.searchsorted(m, high, side="left")))
        part = list(m[first : past + 1] - start)
        if not part:
            return None
        part[0] = 0
        part[-1] = n
        letters = lambda a, z: "".join(text[i] if 0 <= i < len(text) else "N" for i in range(a, z))
        kmer, context, at_focus = letters(b - plan.kmer, b + plan.kmer + 1), letters(first - 4, past + 4), b - first + 4
        if plan.mask:
            hide = lambda s, f: "N" * f + s[f:] if plan.mask == "left" else s[: f + 1] + "N" * (len(s) - f - 1)
            kmer, context = hide(kmer, plan.kmer), hide(context, max(0, min(at_focus, len(context) - 1)))
        a, z = plan.window
        windowed = lambda y: [y[i] if 0 <= i < len(y) else 0.0 for i in range(b + a, b + z + 1)]
        one = {"base_index": b, "signal": sig, "sequence": kmer, "dwells": windowed(d), "features": [windowed(r) for r in rows], "seq_to_sig": part, "sequence_with_kmer_context": context}
        one["focus_signal_pos"] = at - start if plan.context_bases else plan.left
        if levels:
            one["signal_residual"] = cut(residual)
        out.append(one)
    return out


PLANS = {
    "plain": (Plan(left=12, right=15, kmer=3), "AC", None, False),
    "every base": (Plan(left=20, right=9, kmer=2, justify="start", feature_start=0, feature_end=4, norm="zscore"), None, None, False),
    "turned": (Plan(left=12, right=15, reverse=True, justify="end", norm="quantile", mask="left"), "G", None, True),
    "bases": (Plan(context_bases=(3, 4), signal_len=24, kmer=4, norm="pa_scaling", pa_mean=90.0, pa_stdev=12.0, mask="right"), "T", None, True),
    "reference": (Plan(left=18, right=25, anchor="reference", reverse=True), "A", None, True),
    "reference, clipped": (Plan(left=60, right=60, anchor="reference", recover_clipped=True, feature_start=-9, feature_end=-1), "C", None, False),
    "reference bases": (Plan(context_bases=(2, 2), signal_len=10, anchor="reference", justify="start"), "C", None, False),
    "sample": (Plan(left=12, right=15, reverse=True), None, "sample", False),
}


@pytest.mark.parametrize("name", PLANS)
def test_chunks_are_those_of_a_plain_program(spark, name):
    plan, motif, focus, levels = PLANS[name]
    data = reads()
    rows = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = extract.extract(rows, plan, motif, offset=1 if motif else 0, focus=focus, levels=levels)
    got = {r["read_id"]: r for r in found.collect()}
    assert len(got) == len(data)
    n = 0
    for row in data:
        want, own = plain(row, plan, motif, focus, levels), got[row[0]]
        if want is None:
            assert own["outcome"] == "failed" and own["error"] in ("a chunk covers no base", "the aligned part starts before the signal")
            continue
        assert own["outcome"] == ("chunks" if want else "no chunks") and own["error"] is None and own["reference_name"] == "r"
        assert [c["base_index"] for c in own["chunks"] or []] == [c["base_index"] for c in want]
        for have, must in zip(own["chunks"] or [], want, strict=True):
            for field, value in must.items():
                if isinstance(value, list) and field != "seq_to_sig":
                    assert np.allclose(np.array(have[field], float), np.array(value, float), atol=1e-9), (row[0], field)
                else:
                    assert have[field] == value, (row[0], field)
            assert have["label_int"] == (row[9] if focus else None)
            n += 1
    assert n > 20


def test_broken_reads_are_told_apart(spark):
    rows = spark.createDataFrame(BROKEN, SCHEMA)
    of = {r["read_id"]: (r["outcome"], r["error"], r["chunks"]) for r in extract.extract(rows, Plan(anchor="reference"), "AC").collect()}
    assert of[100] == ("missing", None, None) and of[101] == ("failed", "no move table", None) and of[102] == ("failed", "no sequence", None)
    assert of[103] == ("failed", "no samples", None) and of[104] == ("failed", "no mapped base", None) and of[105] == ("no chunks", None, None)
    scaled = Plan(norm="pa_scaling", pa_mean=1.0, pa_stdev=1.0)
    assert {r["read_id"]: r["error"] for r in extract.extract(rows, scaled).collect()}[104] == "no calibration"
    n = {(r["outcome"], r["error"]): r["reads"] for r in extract.yields(extract.extract(rows, Plan(), "AC")).collect()}
    assert n[("missing", None)] == 1 and sum(n.values()) == len(BROKEN)
    assert extract.extract(rows.limit(0), Plan(), "AC").collect() == []


def test_a_run_counts_and_keeps_its_budget(spark, tmp_path):
    good = spark.createDataFrame(reads(), SCHEMA)
    some = good.unionByName(spark.createDataFrame(BROKEN, SCHEMA))
    stats = extract.prepare(some, f"{tmp_path}/a", Plan(left=12, right=15), motif="AC")
    written = spark.read.parquet(f"{tmp_path}/a")
    assert stats["total_reads"] == 46 == written.count() and stats["reads_missing"] == 1 and stats["failed_reads"] == 3
    assert stats["total_chunks"] == extract.chunk_rows(written).count() and stats["reads_with_chunks"] == written.where("outcome = 'chunks'").count()
    with pytest.raises(RuntimeError, match="3 of 5 attempted"):
        extract.prepare(spark.createDataFrame(BROKEN, SCHEMA), f"{tmp_path}/b", Plan(left=12, right=15), motif="AC")
    assert not (tmp_path / "b").exists()
    # absent signals aren't attempted: they hide no failure and are none
    absent = good.withColumn("v", F.when(F.col("read_id") == 0, F.col("v")))
    assert extract.prepare(absent, f"{tmp_path}/c", Plan(left=12, right=15))["reads_missing"] == 39
    with pytest.raises(ValueError, match="no chunks"):
        extract.prepare(good, f"{tmp_path}/d", Plan(left=12, right=15), motif="ACGTACGTACGTACGT")


def test_maps_on_the_reference(spark):
    data = reads(200, seed=9)
    rows = spark.createDataFrame(data, SCHEMA)
    t = F.col("table")
    m = signal.move_map(t["moves"], t["stride"], F.lit(0), t["samples"] - t["trim"])
    for r in rows.select("read_id", m.alias("m"), signal.reference_map(m, F.col("cigar")).alias("x")).collect():
        assert r["x"] == plain_reference_map(r["m"], data[r["read_id"]][5]).tolist()


def test_places_of_awkward_cigars(spark):
    cases = [([(4, 3)], [0.0]), ([], [0.0]), ([(0, 2)], [0.0, 1.0, 2.0]), ([(4, 2), (0, 1), (2, 1), (0, 1)], [2.0, 2.5, 3.0, 4.0]), ([(0, 1), (1, 2), (7, 2)], [0.0, 3.0, 4.0, 5.0]), ([(5, 9), (0, 1), (3, 2), (8, 1), (4, 2)], [0.0, 1 / 3, 2 / 3, 1.0, 2.0])]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<struct<op:int,len:int>>")
    for r in rows.select("i", sequence.reference_places(F.col("c")).alias("x")).collect():
        assert np.allclose(r["x"], cases[r["i"]][1])


def test_letters_between(spark):
    cases = [(0, 3, "ACG"), (-2, 2, "NNAC"), (3, 7, "TNNN"), (-3, -1, "NN"), (6, 8, "NN"), (-1, 6, "NACGTNN"), (2, 2, ""), (3, 1, "")]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a int, b int").select("a", "b", sequence.between(F.lit("ACGT"), F.col("a"), F.col("b")).alias("s"))
    assert {(r["a"], r["b"]): r["s"] for r in rows.collect()} == {(a, b): s for a, b, s in cases}


def test_wrong_plans():
    for wrong in ({"context_bases": (1, 2)}, {"justify": "middle"}, {"anchor": "x"}, {"norm": "pa_scaling"}, {"mask": "both"}):
        with pytest.raises(ValueError):
            Plan(**wrong)
    with pytest.raises(ValueError):
        signal.normalised(F.col("v"), "other")
