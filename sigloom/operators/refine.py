"""Refinement of a read's base boundaries: the boundaries in a band around the given map that fit the expected levels best.

The signal is rescaled to the levels first (only for the search: the signal itself stays as it is): roughly, by a line through
quantiles, and between passes by a Theil-Sen line through the bases' means and levels. A pass chooses the path that has the
least sum of squared differences of samples from their base's level and of penalties for short dwells. A base's samples lie
between the given map's starts of the base `half` before and of the one `half` + 1 after, and from base to base either end of
that band moves by MIN_STEP samples at least. The first and the last boundary stay. A base without a level has level 0.

A read's cost is linear in its bases times the band: a base's best start for each end is a running minimum, but for the few
dwells that are penalised. What a Theil-Sen line looks at is bounded, and drawn by the read's own numbers, so neither
partitions nor retries change it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The penalty of a dwell is WEIGHT * (dwell - 1 - TARGET)**2 up to a dwell of LIMIT.
TARGET, LIMIT, WEIGHT = 4, 3, 0.5
HALF, ENDS = 5, 10  # bases of the band to either side; bases at either end that the rescaling leaves out
MIN_STEP, PASSES = 2, 2
POINTS, LEAST_POINTS, LEAST_LEVEL, DWELLS = 1000, 10, 0.2, (10, 90)  # of a Theil-Sen line: bases at most and at least, their levels and dwells (per cent)
QUANTILES = np.linspace(0.05, 0.95, 19)


def penalties(limit: int = LIMIT, target: float = TARGET, weight: float = WEIGHT) -> np.ndarray:
    """Of dwells 0 .. limit; a base has one sample at least, and no dwell above the target is penalised."""
    out = weight * (np.arange(min(limit, int(target)) + 1) - 1 - target) ** 2.0
    out[0] = np.inf
    return out


def rescaled(signal: np.ndarray, base_map: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The signal on the levels' scale, by a line through quantiles of the bases' centre samples and of their levels."""
    centre = signal[(base_map[:-1] + base_map[1:]) // 2]
    if len(levels) > 2 * ENDS:
        centre, levels = centre[ENDS:-ENDS], levels[ENDS:-ENDS]
    known = np.isfinite(levels)
    if known.sum() < 2:
        return signal
    x, y = np.quantile(centre[known], QUANTILES), np.quantile(levels[known], QUANTILES)
    if np.ptp(x) == 0:
        return signal
    scale, shift = np.polyfit(x, y, 1)
    return signal if abs(scale) < 1e-10 else scale * signal + shift


def theil_sen(x: np.ndarray, y: np.ndarray, seed: int = 0, most: int = POINTS) -> tuple[float, float]:
    """Slope and intercept: the median slope of all pairs of points with different x, of `most` points drawn by the seed if
    there are more, and the median of what is left."""
    if len(x) > most:
        some = np.random.default_rng(seed).choice(len(x), most, replace=False)
        x, y = x[some], y[some]
    i, j = np.triu_indices(len(x), 1)
    apart = x[i] != x[j]
    if not apart.any():
        return 1.0, 0.0
    slope = float(np.median((y[j] - y[i])[apart] / (x[j] - x[i])[apart]))
    return slope, float(np.median(y - slope * x))


def rescaled_by_bases(signal: np.ndarray, base_map: np.ndarray, levels: np.ndarray, seed: int = 0) -> np.ndarray:
    """The signal on the levels' scale, by a Theil-Sen line through the bases' means; as it is where fewer than LEAST_POINTS
    bases have a usual dwell and a level apart from 0, or the line doesn't ascend."""
    dwell = np.diff(base_map)
    total = np.concatenate(([0.0], np.cumsum(signal)))
    mean = (total[base_map[1:]] - total[base_map[:-1]]) / np.maximum(dwell, 1)
    low, high = np.percentile(dwell, DWELLS)
    use = (dwell > 0) & (dwell >= low) & (dwell <= high) & (np.abs(levels) > LEAST_LEVEL)
    if len(levels) > 2 * ENDS:
        use[:ENDS] = use[-ENDS:] = False
    if use.sum() < LEAST_POINTS:
        return signal
    slope, shift = theil_sen(mean[use], levels[use], seed)
    return slope * signal + shift if slope > 0 else signal


def ascending(low: np.ndarray, step: int) -> np.ndarray:
    """Starts of the band moved down so that each is `step` below the next, the first staying; where that leaves the ones
    after it no room they go up one by one."""
    n = len(low)
    at = step * np.arange(n)
    out = np.minimum.accumulate((low - at)[::-1])[::-1] + at
    out[0] = low[0]
    i = 1
    while i < n and out[i] <= out[i - 1]:
        out[i] = out[i - 1] + 1
        i += 1
    return out


def band(base_map: np.ndarray, half: int, step: int = MIN_STEP) -> tuple[np.ndarray, np.ndarray] | None:
    """The first and last place of each boundary; None if the band has no room for a path."""
    n = len(base_map) - 1
    at = np.arange(n)
    starts = ascending(base_map[np.maximum(at - half, 0)], step)
    ends = -ascending(-base_map[np.minimum(at + half + 1, n)][::-1], step)[::-1]
    if starts[0] != base_map[0] or ends[-1] != base_map[n] or (ends <= starts).any() or (np.diff(starts) < 0).any() or (np.diff(ends) < 0).any():
        return None
    return np.append(starts, base_map[n]), np.insert(ends, 0, base_map[0])


def boundaries(signal: np.ndarray, base_map: np.ndarray, levels: np.ndarray, half: int = HALF, penalty: np.ndarray | None = None, step: int = MIN_STEP) -> np.ndarray:
    """The best boundaries of a read whose map lies in the signal; the map itself if its band has no room."""
    penalty = penalties() if penalty is None else penalty
    n = len(levels)
    limits = band(base_map, half, step)
    if limits is None:
        return base_map
    low, high = limits
    best, back = np.zeros(1), []
    for b in range(n):
        level = levels[b]
        first, last = int(low[b]), int(high[b + 1])
        cost = (signal[first:last] - level) ** 2
        total = np.concatenate(([0.0], np.cumsum(cost)))  # of samples first .. place
        # starts and ends are runs of places, so a dwell's starts are a slice of the ones there are
        n_starts, n_ends, apart = int(high[b]) - first + 1, int(high[b + 1] - low[b + 1]) + 1, int(low[b + 1]) - first
        left = best - total[:n_starts]
        # long dwells: the least over all starts up to end - limit
        least = np.minimum.accumulate(left)
        fell = np.arange(n_starts)
        fell[1:][left[1:] >= least[:-1]] = 0
        where = np.maximum.accumulate(fell)
        value, choice = np.full(n_ends, np.inf), np.zeros(n_ends, np.int64)
        off = apart - len(penalty)
        i, j = min(n_ends, max(0, -off)), min(n_ends, max(0, n_starts - off))
        value[i:j], choice[i:j] = least[i + off : j + off], where[i + off : j + off]
        j = max(i, j)
        value[j:], choice[j:] = least[-1], where[-1]
        for d in range(1, len(penalty)):
            off = apart - d
            i, j = max(0, -off), min(n_ends, n_starts - off)
            if i < j:
                short = left[i + off : j + off] + penalty[d]
                better = short < value[i:j]
                np.copyto(value[i:j], short, where=better)
                np.copyto(choice[i:j], np.arange(i + off, j + off), where=better)
        best = value + total[apart : apart + n_ends]
        back.append(first + choice)
    out = np.zeros(n + 1, np.int64)
    out[n] = base_map[n]
    for b in range(n - 1, -1, -1):
        out[b] = back[b][out[b + 1] - low[b + 1]]
    return out


def refined(signal: np.ndarray, base_map: np.ndarray, levels: np.ndarray, half: int = HALF, passes: int = PASSES) -> np.ndarray:
    """The refined map after one pass and `passes` more, each on the signal as the one before rescales it; the given map if
    passes is negative or where it can't be refined: another number of levels than bases, a map that leaves the signal or
    has no samples, samples that are no numbers, no base."""
    n = len(levels)
    fits = n > 0 and len(base_map) == n + 1 and 0 <= base_map[0] < base_map[-1] <= len(signal) and (np.diff(base_map) >= 0).all()
    if passes < 0 or not fits or not np.isfinite(signal).all():
        return base_map
    known = np.where(np.isfinite(levels), levels, 0.0)
    x, out = rescaled(signal, base_map, levels), base_map
    for k in range(passes + 1):
        if k:
            x = rescaled_by_bases(x, out, known, seed=n + k)
        out = boundaries(x, base_map, known, half)
        if out is base_map:
            return base_map
    return out


def refine(rows: DataFrame, key: str, signal: str = "signal", base_map: str = "map", levels: str = "levels", half: int = HALF, passes: int = PASSES) -> DataFrame:
    """key, map: the refined map of every read. Without a signal or levels, or with a null sample, it is the given map; a
    null level is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, m, e in zip(*(batch.column(c) for c in (signal, base_map, levels)), strict=True):
                if not (x.is_valid and m.is_valid and e.is_valid) or x.values.null_count or m.values.null_count:
                    out.append(m.as_py())
                    continue
                level = e.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                out.append(refined(x.values.cast(pa.float64()).to_numpy(), m.values.cast(pa.int64()).to_numpy(), level, half, passes))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.int64()))], names=[key, "map"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, signal, base_map, levels).mapInArrow(run, f"{key} {kind}, map array<long>")
