"""The CTC-CRF loss of reads and targets, and its gradient, in Arrow batches.

A target's chain has a state for each of its bases but the first state_len - 1, and each step stays or goes on by one. Chains of
different lengths are worked through together: places behind a chain's end can't be reached. The gradient of a read's loss is
the posterior of each edge over all paths less that over the target's paths, over the target's length, so it costs one walk
there and one back and needs no differentiation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf

NONE = -np.inf


def _plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):  # none and none is none
        return np.logaddexp(x, y)


def chains(targets: list[np.ndarray], n_base: int, state_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States and dropped bases of padded chains, and the chains' lengths."""
    sizes = np.array([len(t) for t in targets])
    codes = np.zeros((len(targets), max(int(sizes.max(initial=0)), state_len)), np.int64)
    for row, t in zip(codes, targets, strict=True):
        row[: len(t)] = t
    n = codes.shape[1] + 1 - state_len
    states = sum(codes[:, i : n + i] * n_base ** (state_len - i - 1) for i in range(state_len))
    return states, codes[:, : n - 1], sizes + 1 - state_len


def target_posteriors(scores: np.ndarray, states: np.ndarray, dropped: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """scores: reads x steps x states x edges -> log of the sum over each target's paths, and the posterior of every edge
    over them (0 where a target has no path)."""
    reads, steps = scores.shape[:2]
    row = np.arange(reads)[:, None]
    stay, move = scores[row, :, states, 0].transpose(0, 2, 1), scores[row, :, states[:, 1:], 1 + dropped].transpose(0, 2, 1)
    n = states.shape[1]
    alpha = np.full((reads, steps + 1, n), NONE)
    alpha[:, 0, 0] = 0.0
    for t in range(steps):
        alpha[:, t + 1] = alpha[:, t] + stay[:, t]
        alpha[:, t + 1, 1:] = _plus(alpha[:, t + 1, 1:], alpha[:, t, :-1] + move[:, t])
    last = lengths - 1
    total = alpha[np.arange(reads), -1, last]
    beta = np.full((reads, n), NONE)
    beta[np.arange(reads), last] = 0.0
    out = np.zeros(scores.shape)
    known = np.where(np.isfinite(total), total, np.inf)[:, None]
    for t in range(steps - 1, -1, -1):
        stays, moves = stay[:, t] + beta, move[:, t] + beta[:, 1:]
        np.add.at(out, (row, t, states, 0), np.exp(alpha[:, t] + stays - known))
        np.add.at(out, (row, t, states[:, 1:], 1 + dropped), np.exp(alpha[:, t, :-1] + moves - known))
        beta = stays
        beta[:, :-1] = _plus(stays[:, :-1], moves)
    return total, out


def losses_of(scores: np.ndarray, targets: list[np.ndarray], n_base: int, state_len: int, gradients: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """log Z, log Z of the targets, losses, and the losses' gradients by the scores (reads x steps x width)."""
    n = crf.checked(scores.shape[2], n_base, state_len)
    split = scores.reshape(*scores.shape[:2], n, n_base + 1)
    total = crf.log_partition(scores, n_base, state_len)
    own, part = target_posteriors(split, *chains(targets, n_base, state_len))
    size = np.array([len(t) for t in targets], float)
    slope = ((crf.posteriors(scores, n_base, state_len) - part) / size[:, None, None, None]).reshape(scores.shape) if gradients else None
    return total, own, (total - own) / size, slope


def losses(rows: DataFrame, key: str, scores: str, target: str, n_base: int = 4, state_len: int = 1, alphabet: str = "ACGT", gradients: bool = False, batch: int = 64) -> DataFrame:
    """key, log_z, log_target, loss (per base of the target) and, if asked for, gradient (flat, as the scores).

    Scores are flat (steps x width) of any length, targets texts over the alphabet. Nulls, a target shorter than state_len or
    with another letter have null figures. A target that the steps can't hold has a log_target of minus infinity, an
    infinite loss and no gradient."""
    width = crf.checked(n_base**state_len * (n_base + 1), n_base, state_len) * (n_base + 1)
    code = {c: i for i, c in enumerate(alphabet[:n_base])}

    def usable(x: list | None, t: str | None) -> bool:
        return x is not None and t is not None and len(t) >= state_len and all(c in code for c in t) and len(x) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            x, texts = one.column(scores).to_pylist(), one.column(target).to_pylist()
            figures: list[list] = [[None] * len(x) for _ in range(4)]
            by_size: dict[int, list[int]] = {}
            for i, (values, text) in enumerate(zip(x, texts, strict=True)):
                if usable(values, text):
                    if len(values) % width:
                        raise ValueError(f"scores are no multiple of {width}")
                    by_size.setdefault(len(values), []).append(i)
            for size, same in by_size.items():
                for k in range(0, len(same), batch):
                    some = same[k : k + batch]
                    found = losses_of(np.array([x[i] for i in some], float).reshape(len(some), size // width, width), [np.array([code[c] for c in texts[i]]) for i in some], n_base, state_len, gradients)
                    for j, i in enumerate(some):
                        for out, values in zip(figures[:3], found, strict=False):
                            out[i] = float(values[j])
                        if gradients and np.isfinite(found[1][j]):
                            figures[3][i] = found[3][j].ravel().tolist()
            columns = [one.column(key), *[pa.array(f, pa.float64()) for f in figures[:3]]]
            names = [key, "log_z", "log_target", "loss"]
            if gradients:
                columns.append(pa.array(figures[3], pa.list_(pa.float64())))
                names.append("gradient")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, scores, target).mapInArrow(run, f"{key} {kind}, log_z double, log_target double, loss double" + (", gradient array<double>" if gradients else ""))
