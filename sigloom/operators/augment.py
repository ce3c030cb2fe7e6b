"""Random augmentation of chunks whose draws depend on nothing but seed, row and place: every draw is a digest of these, so
partitions, retries and the order of rows don't change it, and any engine with MD5 can repeat it.

A digest gives two numbers of 52 bits, which make two uniform draws in (0, 1), or by Box and Muller two normal ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from ..functions.arrays import at, indices, let
from .extract import settled

HEX, RANGE = 13, float(1 << 52)


def digest(seed: int, key: Column, stream: str, i: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(stream), i.cast("string")))


def fraction(hexed: Column, first: int) -> Column:
    """A uniform number in (0, 1) of 13 hexadecimal digits."""
    return (F.conv(F.substring(hexed, first, HEX), 16, 10).cast("long").cast("double") + 0.5) / RANGE


def uniform(seed: int, key: Column, stream: str, low: float, high: float, i: Column | None = None) -> Column:
    return low + (high - low) * fraction(digest(seed, key, stream, F.lit(0) if i is None else i), 1)


def integer(seed: int, key: Column, stream: str, n: Column, i: Column) -> Column:
    """One of 0 .. n - 1."""
    return F.floor(uniform(seed, key, stream, 0.0, 1.0, i) * n).cast("int")


def normals(seed: int, key: Column, stream: str, n: Column) -> Column:
    """n standard normal numbers, two a digest."""

    def two(h: Column) -> Column:
        return let(F.sqrt(-2 * F.ln(fraction(h, 1))), 2 * math.pi * fraction(h, HEX + 1), lambda r, a: F.array(r * F.cos(a), r * F.sin(a)))

    pairs = lambda k: F.transform(indices(F.ceil(n / 2)), lambda i: let(digest(seed, k, stream, i), two))
    return F.slice(F.flatten(let(key, pairs)), F.lit(1), n)


def jittered(values: Column, std: float, seed: int, key: Column, stream: str) -> Column:
    return let(values, key, lambda v, k: F.zip_with(v, normals(seed, k, stream, F.size(v)), lambda x, z: x + std * z))


def noised(features: Column, stds: list[float], scale: float, seed: int, key: Column) -> Column:
    """Every channel with noise of its own spread times scale; channels beyond the spreads stay."""
    spread = F.array(*[F.lit(float(s) * scale) for s in stds])

    def channel(k: Column, row: Column, c: Column) -> Column:
        # the channels' draws follow one another in one stream
        noise = normals(seed, F.concat_ws("/", k.cast("string"), c.cast("string")), "feature", F.size(row))
        return F.when(c < len(stds), F.zip_with(row, noise, lambda x, z: x + z * at(spread, c))).otherwise(row)

    return let(features, key, lambda f, k: F.transform(f, lambda row, c: channel(k, row, c)))


def moved(text: Column, by: Column) -> Column:
    """A text shifted by letters, N where nothing is left."""
    n = F.length(text)
    size = F.least(F.abs(by), n)
    kept = F.when(by >= 0, F.substring(text, F.lit(1), n - size)).otherwise(F.substring(text, size + 1, n - size))
    return F.when(by >= 0, F.concat(F.repeat(F.lit("N"), size), kept)).otherwise(F.concat(kept, F.repeat(F.lit("N"), size)))


def blanked(text: Column, start: Column, stop: Column) -> Column:
    n = F.length(text)
    a, z = F.least(start, n), F.least(stop, n)
    return F.concat(F.substring(text, F.lit(1), a), F.repeat(F.lit("N"), z - a), F.substring(text, z + 1, n - z))


@dataclass(frozen=True)
class Augment:
    """What is done, in this order: stretch, shift, mask, feature noise, jitter, scale. A range of (1, 1), a width, count or
    spread of 0 is nothing. jitter and scale are one figure for both channels, or one by channel (signal, signal_residual)."""

    seed: int = 0
    stretch: tuple[float, float] = (1.0, 1.0)
    shift_bases: float = 0.0
    samples_per_base: float = 10.0
    mask_count: int = 0
    mask_bases: int = 1
    feature_stds: tuple[float, ...] = ()
    feature_noise: float = 0.0
    jitter: float | dict[str, float] = 0.0
    scale: tuple[float, float] | dict[str, tuple[float, float]] = field(default=(1.0, 1.0))


def stretched(rows: DataFrame, plan: Augment, channels: list[str]) -> DataFrame:
    """One factor a chunk for signal, map and the dwell channels, about its own focus sample. Dwells and their mean go with
    the factor, their logarithm moves by its; spread and ratio stay, as does a matrix without the five dwell channels."""
    rows = settled(rows, factor_=uniform(plan.seed, F.col("key_"), "stretch", *plan.stretch))
    factor, focus = F.col("factor_"), F.col("focus_signal_pos")
    made = {c: let(F.col(c), factor, focus, signal.stretched) for c in channels}
    if "seq_to_sig" in rows.columns:
        length = F.size("signal")
        made["seq_to_sig"] = let(F.col("seq_to_sig"), factor, focus, length, lambda m, f, c, n: F.transform(m, lambda v: F.when(v == n, v).otherwise(F.least(n, F.greatest(F.lit(0), F.rint(c + (v - c) * f).cast("int"))))))
    if "features" in rows.columns:
        def channel(row: Column, c: Column, f: Column) -> Column:
            return F.when((c == 0) | (c == 2), F.transform(row, lambda x: x * f)).when(c == 1, F.transform(row, lambda x: x + F.ln(f))).otherwise(row)

        full = F.size("features") >= len(signal.DWELL_CHANNELS)
        made["features"] = F.when(full, let(F.col("features"), factor, lambda m, f: F.transform(m, lambda row, c: channel(row, c, f)))).otherwise(F.col("features"))
    return settled(rows, **made).drop("factor_")


def shifted(rows: DataFrame, plan: Augment, channels: list[str]) -> DataFrame:
    """One shift a chunk, in bases: samples by the nearest sample, features and letters by the nearest base, halves to even."""
    draw = uniform(plan.seed, F.col("key_"), "shift", -plan.shift_bases, plan.shift_bases)
    rows = settled(rows, shift_=F.when(F.abs(draw) < 1e-6, 0.0).otherwise(draw))
    samples, bases = F.rint(F.col("shift_") * plan.samples_per_base).cast("int"), F.rint("shift_").cast("int")
    made = {c: F.when(F.col(c).isNotNull(), let(F.col(c), samples, signal.shifted)) for c in channels}
    if "features" in rows.columns:
        made["features"] = let(F.col("features"), bases, lambda m, b: F.transform(m, lambda row: signal.shifted(row, b)))
    if "sequence" in rows.columns:
        made["sequence"] = let(F.col("sequence"), bases, moved)
    return settled(rows, **made).drop("shift_")


def masked(rows: DataFrame, plan: Augment, channels: list[str], number: int) -> DataFrame:
    """One block of bases, of 1 to mask_bases, empty in signal, features and letters."""
    i = F.lit(number)
    width = integer(plan.seed, F.col("key_"), "width", F.lit(plan.mask_bases), i) + 1
    rows = settled(rows, width_=width, letters_=F.length("sequence"))
    rows = settled(rows, start_=integer(plan.seed, F.col("key_"), "start", F.greatest(F.lit(1), F.col("letters_") - F.col("width_") + 1), i))
    rows = settled(rows, stop_=F.least(F.col("start_") + F.col("width_"), F.col("letters_")))
    edge = lambda c: F.rint(F.col(c) * plan.samples_per_base).cast("int")
    empty = lambda v, a, z: F.transform(v, lambda x, j: F.when((j >= a) & (j < z), 0.0).otherwise(x))
    made = {c: let(F.col(c), edge("start_"), edge("stop_"), empty) for c in channels}
    if "features" in rows.columns:
        made["features"] = let(F.col("features"), F.col("start_"), F.col("stop_"), lambda m, a, z: F.transform(m, lambda row: empty(row, a, z)))
    made["sequence"] = let(F.col("sequence"), F.col("start_"), F.col("stop_"), blanked)
    return settled(rows, **made).drop("width_", "letters_", "start_", "stop_")


def augmented(chunks: DataFrame, plan: Augment, key: Column, epoch: int = 0) -> DataFrame:
    """The chunks with their signal (and signal_residual, features, sequence, seq_to_sig where there are any) augmented. key
    tells rows apart: rows of one key get the same draws, a null key counts as one; an epoch has draws of its own. A null
    array or text stays null."""
    columns = chunks.columns
    channels = [c for c in ("signal", "signal_residual") if c in columns]
    each = lambda x, c, none: x.get(c, none) if isinstance(x, dict) else x
    rows = settled(chunks, key_=F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(epoch))))
    if plan.stretch != (1.0, 1.0):
        rows = stretched(rows, plan, channels)
    if plan.shift_bases:
        rows = shifted(rows, plan, channels)
    for number in range(plan.mask_count):
        rows = masked(rows, plan, channels, number)
    if plan.feature_noise and plan.feature_stds and "features" in columns:
        rows = settled(rows, features=noised(F.col("features"), list(plan.feature_stds), plan.feature_noise, plan.seed, F.col("key_")))
    made = {c: jittered(F.col(c), std, plan.seed, F.col("key_"), c) for c in channels if (std := each(plan.jitter, c, 0.0))}
    rows = settled(rows, **made) if made else rows
    ranges = {c: r for c in channels if (r := each(plan.scale, c, (1.0, 1.0))) != (1.0, 1.0)}
    # one range for both channels is one factor for both; a range by channel is a factor each
    stream = lambda c: f"scale-{c}" if isinstance(plan.scale, dict) else "scale"
    made = {c: let(F.col(c), uniform(plan.seed, F.col("key_"), stream(c), *r), lambda v, f: F.transform(v, lambda x: x * f)) for c, r in ranges.items()}
    return (settled(rows, **made) if made else rows).select(*columns)
