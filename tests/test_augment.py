"""Augmentation against a plain program with the same digests; the draws' spread; independence of partitions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import augment
from sigloom.operators.augment import Augment

rng = np.random.default_rng(6)
ROWS = [
    (i, rng.normal(size=40).tolist(), rng.normal(size=40).tolist(), rng.uniform(1, 9, (6, 5)).tolist(), "".join(rng.choice(list("ACGT"), 5)), [0, 7, 7, 19, 31, 40], 15 + i % 9)
    for i in range(60)
]
SCHEMA = "id long, signal array<double>, signal_residual array<double>, features array<array<double>>, sequence string, seq_to_sig array<int>, focus_signal_pos int"


def fractions(seed, key, stream, i):
    h = hashlib.md5(f"{seed}:{key}:{stream}:{i}".encode()).hexdigest()
    return [(int(h[a : a + 13], 16) + 0.5) / 2**52 for a in (0, 13)]


def draw(seed, key, stream, low, high, i=0):
    return low + (high - low) * fractions(seed, key, stream, i)[0]


def normals(seed, key, stream, n):
    out = []
    for i in range(math.ceil(n / 2)):
        u, v = fractions(seed, key, stream, i)
        out += [math.sqrt(-2 * math.log(u)) * f(2 * math.pi * v) for f in (math.cos, math.sin)]
    return np.array(out[:n])


def roll(x, by, none=0.0):
    out = np.full(len(x), none, dtype=object if none == "N" else float)
    for i in range(len(x)):
        if 0 <= i - by < len(x):
            out[i] = x[i - by]
    return out


def plain(row, plan, epoch=0):
    i, s, r, f, text, m, focus = row
    s, r, f, text, m, key = np.array(s), np.array(r), np.array(f), list(text), list(m), f"{i}/{epoch}"
    if plan.stretch != (1.0, 1.0):
        factor = draw(plan.seed, key, "stretch", *plan.stretch)
        at = np.clip(focus + (np.arange(40) - focus) / factor, 0, 39)
        s, r = np.interp(at, np.arange(40), s), np.interp(at, np.arange(40), r)
        m = [v if v == 40 else min(40, max(0, round(focus + (v - focus) * factor))) for v in m]
        f[0] *= factor
        f[2] *= factor
        f[1] += math.log(factor)
    if plan.shift_bases:
        by = draw(plan.seed, key, "shift", -plan.shift_bases, plan.shift_bases)
        s, r = (roll(x, round(by * plan.samples_per_base)) for x in (s, r))
        f, text = np.array([roll(x, round(by)) for x in f]), list(roll(text, round(by), "N"))
    for k in range(plan.mask_count):
        width = int(draw(plan.seed, key, "width", 0, 1, k) * plan.mask_bases) + 1
        start = int(draw(plan.seed, key, "start", 0, 1, k) * max(1, 5 - width + 1))
        stop = min(5, start + width)
        f[:, start:stop] = 0
        text[start:stop] = "N" * (stop - start)
        a, z = round(start * plan.samples_per_base), min(40, round(stop * plan.samples_per_base))
        s[a:z] = r[a:z] = 0
    if plan.feature_noise:
        for c, std in enumerate(plan.feature_stds):
            f[c] += normals(plan.seed, f"{key}/{c}", "feature", 5) * std * plan.feature_noise
    one = lambda x, c, none: x.get(c, none) if isinstance(x, dict) else x
    out = []
    for c, x in (("signal", s), ("signal_residual", r)):
        x = x + normals(plan.seed, key, c, 40) * one(plan.jitter, c, 0.0)
        out.append(x * draw(plan.seed, key, f"scale-{c}" if isinstance(plan.scale, dict) else "scale", *one(plan.scale, c, (1.0, 1.0))))
    return *out, f, "".join(text), m


PLANS = {
    "all": Augment(3, (0.8, 1.3), 2.4, 7.5, 2, 3, (0.5, 0.2, 0.0), 2.0, 0.3, (0.9, 1.2)),
    "by channel": Augment(4, jitter={"signal": 0.5}, scale={"signal_residual": (0.5, 2.0)}),
    "shift": Augment(5, shift_bases=6.0, samples_per_base=8),
    "nothing": Augment(),
}


@pytest.mark.parametrize("name", PLANS)
def test_rows_are_those_of_a_plain_program(spark, name):
    plan = PLANS[name]
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = [augment.augmented(rows.repartition(n), plan, F.col("id"), epoch=2).orderBy("id").collect() for n in (1, 7)]
    assert got[0] == got[1] and got[0][0].asDict().keys() == set(rows.columns)
    for r, row in zip(got[0], ROWS, strict=True):
        s, residual, f, text, m = plain(row, plan, 2)
        assert np.allclose(r["signal"], s) and np.allclose(r["signal_residual"], residual) and np.allclose(r["features"], f)
        assert (r["sequence"], r["seq_to_sig"], r["focus_signal_pos"]) == (text, m, row[6])


def test_draws_are_spread_as_they_should_be(spark):
    rows = spark.range(4000).select("id", augment.normals(1, F.col("id"), "a", F.lit(3)).alias("z"), augment.uniform(1, F.col("id"), "b", 2.0, 4.0).alias("u"), augment.integer(1, F.col("id"), "c", F.lit(5), F.lit(0)).alias("k")).collect()
    z, u = np.array([r["z"] for r in rows]), np.sort([r["u"] for r in rows])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and np.abs(np.corrcoef(z.T) - np.eye(3)).max() < 0.06
    assert np.abs((u - 2) / 2 - (np.arange(4000) + 0.5) / 4000).max() < 0.03
    assert np.bincount([r["k"] for r in rows], minlength=5).min() > 700 and {r["k"] for r in rows} == set(range(5))
    one, other = (augment.augmented(spark.createDataFrame(ROWS, SCHEMA), PLANS["all"], F.col("id"), epoch=e).first()["signal"] for e in (0, 1))
    assert one != other


def test_missing_values(spark):
    rows = spark.createDataFrame([(None, None, None, None, None, None, 3), (2, [], [], [], "", [], 0)], SCHEMA)
    got = {r["id"]: r for r in augment.augmented(rows, PLANS["all"], F.col("id")).collect()}
    assert got[None]["signal"] is None and got[None]["sequence"] is None and got[2]["signal"] == [] and got[2]["sequence"] == ""
    few = spark.createDataFrame([(1, [1.0, 2.0])], "id long, signal array<double>")
    assert augment.augmented(few, Augment(jitter=0.1, scale=(0.5, 2.0)), F.col("id")).columns == ["id", "signal"]
