"""CTC-CRF scores: partition functions, best paths and decoding, on arrays of scores in Arrow batches.

A state is the last `state_len` bases as a number in base n_base. A row of scores has, for each state, a blank that
stays and one entry for every base that may have been dropped to reach it. Times are worked through for a whole batch
at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def predecessors(n_base: int, state_len: int) -> np.ndarray:
    """states x (1 + n_base): the state itself, then the states from which a move leads to it."""
    n = n_base**state_len
    state = np.arange(n)
    return np.stack([state, *(state // n_base + b * (n // n_base) for b in range(n_base))], 1)


def checked(width: int, n_base: int, state_len: int) -> int:
    n = n_base**state_len
    if width != n * (n_base + 1):
        raise ValueError(f"scores have {width} entries a step, not {n * (n_base + 1)}")
    return n


def tail(linear: np.ndarray, n_states: int, n_base: int, scale: float = 5.0, blank: float = 2.0) -> np.ndarray:
    """Move scores scaled by tanh, with the fixed blank score spliced in before every state's moves."""
    moves = (np.tanh(linear) * scale).reshape(*linear.shape[:-1], n_states, n_base)
    return np.concatenate((np.full((*moves.shape[:-1], 1), blank), moves), -1).reshape(*linear.shape[:-1], -1)


def _add(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def log_partition(scores: np.ndarray, n_base: int, state_len: int) -> np.ndarray:
    """scores: reads x steps x width -> log of the sum over all paths from and to any state."""
    n = checked(scores.shape[2], n_base, state_len)
    before, s = predecessors(n_base, state_len), scores.reshape(*scores.shape[:2], n, n_base + 1)
    alpha = np.zeros((len(scores), n))
    for t in range(s.shape[1]):
        alpha = _add(alpha[:, before] + s[:, t], 2)
    return _add(alpha, 1)


def log_target(scores: np.ndarray, bases: np.ndarray, n_base: int, state_len: int) -> float:
    """The same over the paths that emit one target. scores: one read's steps x width; bases: the target's codes, the
    first state_len of which are the state before the first step."""
    n = checked(scores.shape[1], n_base, state_len)
    s = scores.reshape(len(scores), n, n_base + 1)
    power = n_base ** np.arange(state_len - 1, -1, -1)
    chain = np.array([int((bases[i : i + state_len] * power).sum()) for i in range(len(bases) - state_len + 1)])
    dropped = bases[: len(chain) - 1]  # what each move of the chain drops
    alpha = np.full(len(chain), -np.inf)
    alpha[0] = 0.0
    for t in range(len(s)):
        stay = alpha + s[t, chain, 0]
        move = np.concatenate(([-np.inf], alpha[:-1] + s[t, chain[1:], 1 + dropped]))
        alpha = np.logaddexp(stay, move)
    return float(alpha[-1])


def loss(scores: np.ndarray, targets: list[np.ndarray], n_base: int, state_len: int) -> np.ndarray:
    """Negative log likelihood per base of the target."""
    z = log_partition(scores, n_base, state_len)
    return np.array([(z[i] - log_target(scores[i], t, n_base, state_len)) / len(t) for i, t in enumerate(targets)])


FLOOR = 1e-8  # a fixed value: posteriors are raised by it before their logarithm


def posteriors(scores: np.ndarray, n_base: int, state_len: int) -> np.ndarray:
    """reads x steps x states x edges: the probability of each edge at each step, over all paths."""
    n = checked(scores.shape[2], n_base, state_len)
    before, s = predecessors(n_base, state_len), scores.reshape(*scores.shape[:2], n, n_base + 1)
    after = np.argsort(before.ravel(), kind="stable").reshape(n, n_base + 1)  # of each state, the edges that leave it
    reads, steps = scores.shape[:2]
    alpha, beta = np.zeros((reads, steps + 1, n)), np.zeros((reads, steps + 1, n))
    for t in range(steps):
        alpha[:, t + 1] = _add(alpha[:, t][:, before] + s[:, t], 2)
    for t in range(steps - 1, -1, -1):
        joint = s[:, t] + beta[:, t + 1, :, None]
        beta[:, t] = _add(joint.reshape(reads, -1)[:, after], 2)
    total = _add(alpha[:, -1], 1)
    return np.exp(alpha[:, :-1][:, :, before] + s + beta[:, 1:, :, None] - total[:, None, None, None])


def best_moves(scores: np.ndarray, n_base: int, state_len: int) -> tuple[np.ndarray, np.ndarray]:
    """The path of each read whose edges have the largest sum of log posteriors: the state after every step, and whether
    the step was a move."""
    before, s = predecessors(n_base, state_len), np.log(posteriors(scores, n_base, state_len) + FLOOR)
    n, (reads, steps) = len(before), scores.shape[:2]
    best, back = np.zeros((reads, n)), np.zeros((reads, steps, n), np.int64)
    for t in range(steps):
        way = best[:, before] + s[:, t]
        back[:, t] = way.argmax(2)
        best = way.max(2)
    state = best.argmax(1)
    states, moved = np.zeros((reads, steps), np.int64), np.zeros((reads, steps), bool)
    row = np.arange(reads)
    for t in range(steps - 1, -1, -1):
        states[:, t] = state
        edge = back[row, t, state]
        moved[:, t] = edge > 0
        state = before[state, edge]
    return states, moved


def decoded(scores: np.ndarray, n_base: int, state_len: int, alphabet: str) -> list[str]:
    """The base that every move adds."""
    states, moved = best_moves(scores, n_base, state_len)
    return ["".join(alphabet[b] for b in s[m] % n_base) for s, m in zip(states, moved, strict=True)]


def decode(rows: DataFrame, key: str, scores: str, n_base: int = 4, state_len: int = 1, alphabet: str = "ACGT", batch: int = 256) -> DataFrame:
    """key, log_z, sequence from flat scores (steps x width) of any length."""
    width = n_base**state_len * (n_base + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            by_size = frame.groupby(frame[scores].str.len())
            for _, same in by_size:
                for k in range(0, len(same), batch):
                    part = same.iloc[k : k + batch]
                    x = np.stack(part[scores].to_numpy()).astype(float)
                    if x.shape[1] % width:
                        raise ValueError(f"scores are no multiple of {width}")
                    x = x.reshape(len(part), -1, width)
                    yield pd.DataFrame({key: part[key], "log_z": log_partition(x, n_base, state_len), "sequence": decoded(x, n_base, state_len, alphabet)})

    return rows.select(key, scores).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, log_z double, sequence string")
