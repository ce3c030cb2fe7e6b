"""The loss against all paths of short reads, its gradient against differences."""

import itertools
import math

import numpy as np
import pytest

from sigloom.operators import crf, crf_loss

rng = np.random.default_rng(12)


def all_paths(scores, target, n_base, state_len):
    """(log of the sum over all paths, the same over those that spell the target), by walking every one of them."""
    steps = len(scores)
    n = n_base**state_len
    s = scores.reshape(steps, n, n_base + 1)
    every, own = [], []
    letters = lambda state: [state // n_base**k % n_base for k in range(state_len - 1, -1, -1)]
    for start in range(n):
        for edges in itertools.product(range(n_base + 1), repeat=steps):  # 0 stays, 1 + b adds the base b
            state, total, text = start, 0.0, letters(start)
            for t, e in enumerate(edges):
                dropped, before = letters(state)[0], state
                state = state if e == 0 else (before * n_base + e - 1) % n
                total += s[t, state, 0 if e == 0 else 1 + dropped]
                text = text if e == 0 else [*text, e - 1]
            every.append(total)
            if text == list(target):
                own.append(total)
    both = [math.log(sum(math.exp(x) for x in v)) if v else -math.inf for v in (every, own)]
    return both[0], both[1]


@pytest.mark.parametrize("n_base,state_len,steps", [(2, 1, 6), (2, 2, 5), (3, 1, 4)])
def test_losses_are_those_of_all_paths(n_base, state_len, steps):
    width = n_base**state_len * (n_base + 1)
    targets = [rng.integers(0, n_base, k) for k in (state_len, state_len + 1, state_len + 3, state_len, state_len + steps + 1)]
    scores = rng.normal(size=(len(targets), steps, width))
    total, own, loss, slope = crf_loss.losses_of(scores, targets, n_base, state_len)
    for i, t in enumerate(targets):
        z, z_target = all_paths(scores[i], t, n_base, state_len)
        assert total[i] == pytest.approx(z) and (own[i] == pytest.approx(z_target) or own[i] == z_target == -math.inf)
        assert own[i] == pytest.approx(crf.log_target(scores[i], t, n_base, state_len)) or own[i] == -math.inf
        assert loss[i] == pytest.approx((z - z_target) / len(t)) or loss[i] == math.inf
    assert own[-1] == -math.inf  # more bases than steps
    for i in range(len(targets) - 1):
        for at in [(int(rng.integers(steps)), int(rng.integers(width))) for _ in range(8)]:
            ends = []
            for h in (1e-5, -1e-5):
                x = scores[[i]].copy()
                x[0][at] += h
                ends.append(crf_loss.losses_of(x, [targets[i]], n_base, state_len, False)[2][0])
            assert slope[i][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-7)
    assert np.allclose(slope[:-1].sum((1, 2)), 0)  # both posteriors sum to one a step


def test_rows(spark):
    width = 4 * 5
    scores = {i: rng.normal(size=6 * width if i % 2 else 3 * width).tolist() for i in range(20)}
    rows = [(i, scores[i], "ACGT"[: 1 + i % 3] + "A") for i in range(20)] + [(100, None, "AC"), (101, scores[0], None), (102, scores[0], ""), (103, scores[0], "AXC"), (104, [], "AC"), (105, scores[0], "ACGTACGT")]
    df = spark.createDataFrame(rows, "id int, scores array<double>, target string").repartition(3)
    got = {r["id"]: r for r in crf_loss.losses(df, "id", "scores", "target", gradients=True, batch=3).collect()}
    for i in range(20):
        x = np.array(scores[i]).reshape(1, -1, width)
        total, own, loss, slope = crf_loss.losses_of(x, [np.array(["ACGT".index(c) for c in rows[i][2]])], 4, 1)
        assert np.allclose((got[i]["log_z"], got[i]["log_target"], got[i]["loss"]), (total[0], own[0], loss[0])) and np.allclose(got[i]["gradient"], slope.ravel())
    assert all(got[i]["loss"] is None and got[i]["gradient"] is None for i in range(100, 105))
    assert got[105]["loss"] == math.inf and got[105]["log_target"] == -math.inf and got[105]["gradient"] is None
    with pytest.raises(Exception, match="multiple"):
        crf_loss.losses(spark.createDataFrame([(1, [1.0] * 7, "AC")], "id int, scores array<double>, target string"), "id", "scores", "target").collect()
