"""Refinement against all boundaries of short reads."""

import itertools

import numpy as np
import pytest

from sigloom.operators import refine


def cost(signal, cuts, levels):
    """A dwell of 1, 2 or 3 samples costs 8, 4.5 or 2."""
    short = {1: 8.0, 2: 4.5, 3: 2.0}
    return sum(((signal[a:b] - level) ** 2).sum() + short.get(b - a, 0.0) for a, b, level in zip(cuts[:-1], cuts[1:], levels, strict=True))


def plain_band(base_map, half, step):
    """Sample by sample: the bases that a sample may belong to; then the samples of each base; then the steps."""
    n, first = len(base_map) - 1, base_map[0]
    of = np.repeat(np.arange(n), np.diff(base_map))
    low = [next((s for s in range(len(of)) if min(of[s] + half + 1, n) > b), 0) for b in range(n)]
    high = [next((s for s in range(len(of)) if max(of[s] - half, 0) > b), len(of)) for b in range(n)]
    top, bottom = high[-1], low[0]
    for i in range(n - 2, -1, -1):
        low[i] = min(low[i], low[i + 1] - step)
    low[0] = bottom
    for i in range(1, n):
        if low[i] > low[i - 1]:
            break
        low[i] = low[i - 1] + 1
    for i in range(1, n):
        high[i] = max(high[i], high[i - 1] + step)
    high[-1] = top
    for i in range(n - 2, -1, -1):
        if high[i] < high[i + 1]:
            break
        high[i] = high[i + 1] - 1
    return [x + first for x in low], [x + first for x in high]


@pytest.mark.parametrize("seed", range(60))
def test_boundaries_are_the_best_of_all_in_the_band(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6))
    base_map = np.concatenate(([0], np.cumsum(rng.integers(0 if seed % 3 == 0 else 1, 7, n)))) + int(rng.integers(0, 3))
    if base_map[0] == base_map[-1]:
        base_map[-1] += 3
    levels, half, step = rng.normal(size=n) * 3, int(rng.integers(1, 4)), int(rng.integers(1, 3))
    signal = rng.normal(size=base_map[-1] + 2) * 2
    low, high = plain_band(base_map, half, step)
    wide = all(a < z for a, z in zip(low, high, strict=True)) and low == sorted(low) and high == sorted(high)
    got = refine.boundaries(signal, base_map, levels, half, step=step)
    if not wide:
        assert refine.band(base_map, half, step) is None and got is base_map
        return
    inner = [range(low[b], high[b - 1] + 1) for b in range(1, n)]
    every = [(base_map[0], *c, base_map[-1]) for c in itertools.product(*inner) if all(x < y for x, y in itertools.pairwise((base_map[0], *c, base_map[-1])))]
    assert cost(signal, got, levels) == pytest.approx(min(cost(signal, c, levels) for c in every))
    assert got[0] == base_map[0] and got[-1] == base_map[-1] and (np.diff(got) > 0).all()


def test_theil_sen_lines():
    x = np.arange(50.0)
    y = 3 * x - 7
    y[::5] += 1000  # a fifth is far off
    slope, shift = refine.theil_sen(x, y)
    assert abs(slope - 3) < 0.3 and abs(shift + 7) < 9
    assert refine.theil_sen(np.ones(4), np.arange(4.0)) == (1.0, 0.0)
    rng = np.random.default_rng(0)
    x = rng.normal(size=5000)
    assert refine.theil_sen(x, 2 * x + 1, seed=3) == refine.theil_sen(x, 2 * x + 1, seed=3) and np.allclose(refine.theil_sen(x, 2 * x + 1, seed=3), (2, 1))


def test_passes_put_a_wrong_scale_right():
    """Levels of which a third is far off spoil the line through quantiles; the bases' means mend it from pass to pass."""
    rng = np.random.default_rng(4)
    levels = rng.normal(size=120) * 2
    true = np.concatenate(([0], np.cumsum(rng.integers(6, 14, 120))))
    signal = np.repeat(levels, np.diff(true)) * 0.4 + 1.5 + rng.normal(size=true[-1]) * 0.05
    moved = true.copy()
    moved[1:-1] += rng.integers(-3, 4, 119)
    right = [(refine.refined(signal, moved, levels, passes=k) == true).mean() for k in (0, 2)]
    assert right[1] >= right[0] and right[1] > 0.9
    assert (refine.refined(signal, moved, levels, passes=-1) == moved).all()
    again = refine.refined(signal, moved, levels)
    assert (again == refine.refined(signal, moved, levels)).all()


def test_a_missing_level_is_zero():
    signal = np.concatenate((np.full(6, 3.0), np.zeros(6), np.full(6, -3.0)))
    moved = np.array([0, 8, 11, 18])
    none, zero = np.array([3.0, np.nan, -3.0]), np.array([3.0, 0.0, -3.0])
    assert (refine.refined(signal, moved, none) == refine.boundaries(refine.rescaled(signal, moved, none), moved, zero)).all()
    assert refine.boundaries(signal, moved, zero).tolist() == [0, 6, 12, 18]


def test_a_shifted_map_is_put_right():
    rng = np.random.default_rng(1)
    levels = rng.permutation(np.arange(60.0))
    true = np.concatenate(([0], np.cumsum(rng.integers(5, 12, 60))))
    signal = (np.repeat(levels, np.diff(true)) + rng.normal(size=true[-1]) * 0.2 - 30) / 17  # on another scale
    moved = true.copy()
    moved[1:-1] += rng.integers(-2, 3, 59)
    got = refine.refined(signal, moved, levels)
    assert np.abs(got - true).max() <= 1 and (got == true).mean() > 0.95


def test_what_cannot_be_refined_stays():
    x, m = np.zeros(9), np.array([0, 3, 9])
    for signal, base_map, levels in ((x, m, np.zeros(3)), (x, np.array([0, 3, 12]), np.zeros(2)), (x, np.array([0, 0, 0]), np.zeros(2)), (x, np.array([0, 5, 3]), np.zeros(2)), (np.full(9, np.nan), m, np.zeros(2)), (x, m[:1], np.zeros(0))):
        assert (refine.refined(signal, base_map, levels) == base_map).all()
    assert (refine.refined(x, m, np.full(2, np.nan)) >= 0).all()


def test_rows(spark):
    rows = [(1, [0.0, 0.1, 5.0, 5.1, 5.0, 5.2], [0, 3, 6], [0.0, 5.0]), (2, None, [0, 1], [1.0]), (3, [1.0, 2.0], [0, 1, 2], [None, 2.0]), (4, [1.0], [0, 1], [1.0, 2.0]), (5, [], [], [])]
    df = spark.createDataFrame(rows, "id int, signal array<double>, map array<int>, levels array<double>")
    got = {r["id"]: r["map"] for r in refine.refine(df, "id", half=1).collect()}
    assert got[1][0] == 0 and got[1][-1] == 6 and got[2] == [0, 1] and got[3] == [0, 1, 2] and got[4] == [0, 1] and got[5] == []


def test_a_band_of_many_samples_takes_few_calls(monkeypatch):
    """Dwells take slices of the band: no clipping of indices and no choice over whole bands for each."""
    signal, base_map, levels = np.sin(np.arange(90.0)), np.arange(0, 91, 3), np.arange(30) % 5 * 1.0
    want = refine.boundaries(signal, base_map, levels)

    def refused(*_, **__):
        raise AssertionError("indices are clipped")

    monkeypatch.setattr(refine.np, "clip", refused)
    assert (refine.boundaries(signal, base_map, levels) == want).all() and (want != base_map).any()
