"""Signal arithmetic of one read: base-to-sample maps, dwell times, levels, residuals, resampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import at, clamped, indices, let, mean, median, padded, std
from .sequence import reference_places

EPSILON = 1e-6
DWELL_CHANNELS = ("dwell", "dwell_log", "dwell_mean", "dwell_std", "dwell_ratio")
LEVEL_CHANNELS = ("level_mean", "level_median", "level_std", "level_range")
RESIDUAL_CHANNELS = ("kmer_expected", "kmer_residual", "kmer_abs_residual")
#: The channel order of a feature matrix is part of a model's contract.
CHANNELS = DWELL_CHANNELS + LEVEL_CHANNELS + RESIDUAL_CHANNELS


def move_map(moves: Column, stride: Column, trim: Column, samples: Column) -> Column:
    """First sample of every base, and the number of samples: bases + 1 entries."""
    starts = let(moves, lambda m: F.filter(indices(F.size(m)), lambda i: at(m, i) == 1))
    return F.concat(F.transform(starts, lambda i: i * stride + F.coalesce(trim, F.lit(0))), F.array(samples.cast("int")))


def reversed_map(base_map: Column, samples: Column) -> Column:
    return F.transform(F.reverse(base_map), lambda x: samples - x)


def dwells(base_map: Column) -> Column:
    return let(base_map, lambda m: F.transform(indices(F.size(m) - 1), lambda i: at(m, i + 1) - at(m, i)))


def dwell_features(values: Column, window: int = 5) -> Column:
    """One struct of DWELL_CHANNELS a base; the window is centred and repeats the first and last value at the edges."""
    half = window // 2

    def one(v: Column, i: Column) -> Column:
        around = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda j: clamped(v, i + j).cast("double"))

        def of(d: Column, m: Column, s: Column) -> Column:
            return F.struct(d.alias("dwell"), F.ln(d + EPSILON).alias("dwell_log"), m.alias("dwell_mean"), s.alias("dwell_std"), (d / (m + EPSILON)).alias("dwell_ratio"))

        return let(around, lambda x: let(at(v, i).cast("double"), mean(x), std(x), of))

    return let(values, lambda v: F.transform(indices(F.size(v)), lambda i: one(v, i)))


def span(signal: Column, base_map: Column, i: Column) -> Column:
    """The samples of base i; a map that starts before the signal or ends after it is clamped."""
    start, stop = F.greatest(at(base_map, i), F.lit(0)), F.least(at(base_map, i + 1), F.size(signal))
    return F.slice(signal, start + 1, F.greatest(stop - start, F.lit(0)))


def level_features(signal: Column, base_map: Column) -> Column:
    """One struct of LEVEL_CHANNELS a base; 0 for a base without samples."""

    def one(x: Column) -> Column:
        spread = F.coalesce(F.array_max(x) - F.array_min(x), F.lit(0.0))
        return F.struct(mean(x).alias("level_mean"), median(x).alias("level_median"), std(x).alias("level_std"), spread.alias("level_range"))

    return let(signal, base_map, lambda x, m: F.transform(indices(F.size(m) - 1), lambda i: let(span(x, m, i), one)))


def fitted_levels(levels: Column, bases: Column) -> Column:
    """Levels cut to the number of bases, or filled up with 0."""
    return let(levels, lambda v: F.transform(indices(bases), lambda i: F.coalesce(at(v, i), F.lit(0.0))))


def residual_features(means: Column, expected: Column) -> Column:
    """One struct of RESIDUAL_CHANNELS a base; a base without an expected level has 0 for it."""
    return let(expected, lambda e: F.transform(means, lambda m, i: F.struct(at(e, i).alias("kmer_expected"), (m - at(e, i)).alias("kmer_residual"), F.abs(m - at(e, i)).alias("kmer_abs_residual"))))


def merged_channels(dwell: Column, level: Column, residual: Column) -> Column:
    """One struct of CHANNELS a base, in that order, from the three groups' structs; as many bases as the first has."""

    def of(d: Column, v: Column, r: Column) -> Column:
        parts = ((d, DWELL_CHANNELS), (v, LEVEL_CHANNELS), (r, RESIDUAL_CHANNELS))
        return F.transform(indices(F.size(d)), lambda i: F.struct(*[at(x, i)[c].alias(c) for x, names in parts for c in names]))

    return let(dwell, level, residual, of)


def base_of_sample(base_map: Column, sample: Column) -> Column:
    """The last base that starts at or before a sample; -1 before the first."""
    return F.size(F.filter(base_map, lambda x: x <= sample)) - 1


def signal_residual(signal: Column, base_map: Column, expected: Column) -> Column:
    """Sample less its base's expected level; 0 where there is no level or no base."""

    def one(x: Column, m: Column, e: Column, i: Column) -> Column:
        level = let(base_of_sample(m, i), lambda b: F.when((b >= 0) & (b < F.size(m) - 1), at(e, b)))
        return let(F.coalesce(level, F.lit(0.0)), lambda v: F.when(v != 0, x - v).otherwise(F.lit(0.0)))

    return let(base_map, expected, lambda m, e: F.transform(signal, lambda x, i: one(x, m, e, i)))


def cropped_map(base_map: Column, crop: Column, length: int) -> Column:
    return F.transform(base_map, lambda v: F.least(F.lit(length), F.greatest(F.lit(0), v - crop)))


def centred(signal: Column, length: int) -> Column:
    """Filled with 0 on the right, or cut around the middle."""
    start = lambda s: F.greatest(F.lit(0), F.floor((F.size(s) - length) / 2)).cast("int")
    return let(signal, lambda s: padded(s, start(s), start(s) + length))


def stretched(signal: Column, factor: Column, focus: Column) -> Column:
    """Linear resampling about a focus sample: entry i reads at focus + (i - focus) / factor, edges held."""

    def one(s: Column, i: Column) -> Column:
        x = F.greatest(F.lit(0.0), F.least((F.size(s) - 1).cast("double"), focus + (i - focus) / factor))
        return let(x, F.floor(x), lambda x, low: at(s, low) * (1 - (x - low)) + clamped(s, low + 1) * (x - low))

    return let(signal, lambda s: F.transform(s, lambda _, i: one(s, i)))


def stretched_map(base_map: Column, factor: Column, focus: Column, length: int) -> Column:
    """The map of a stretched signal; entries at `length` mark the end and stay."""
    moved = lambda v: F.least(F.lit(length), F.greatest(F.lit(0), F.rint(focus + (v - focus) * factor).cast("int")))
    return F.transform(base_map, lambda v: F.when(v == length, v).otherwise(moved(v)))


def shifted(values: Column, by: Column) -> Column:
    """Entry i takes entry i - by; 0 where that is outside."""
    return padded(values, -by, F.size(values) - by)


def interpolated(x: Column, knots_x: Column, knots_y: Column) -> Column:
    """Piecewise linear through the knots, the end values outside."""
    def inside(x: Column, kx: Column, ky: Column, k: Column) -> Column:
        x0, x1, y0, y1 = at(kx, k), at(kx, k + 1), at(ky, k), at(ky, k + 1)
        return y0 + (y1 - y0) * (x - x0) / F.greatest((x1 - x0).cast("double"), F.lit(1e-12))

    def of(x: Column, kx: Column, ky: Column) -> Column:
        k = F.greatest(F.lit(0), F.least(F.size(kx) - 2, F.size(F.filter(kx, lambda v: v <= x)) - 1))
        first, last = at(ky, F.lit(0)).cast("double"), F.element_at(ky, -1).cast("double")
        return F.when(x <= at(kx, F.lit(0)), first).when(x >= F.element_at(kx, -1), last).otherwise(let(k, lambda k: inside(x, kx, ky, k)))

    return let(x, knots_x, knots_y, of)


def quantile(ordered: Column, q: float) -> Column:
    """Of an ascending array, linear between its elements."""
    def of(s: Column, x: Column) -> Column:
        low = F.floor(x)
        return at(s, low) + (clamped(s, low + 1) - at(s, low)) * (x - low)

    return let(ordered, (F.size(ordered) - 1) * F.lit(q), of)


def normalised(values: Column, method: str, pa_mean: float | None = None, pa_stdev: float | None = None, cal_offset: Column | None = None, cal_scale: Column | None = None, low: float = 0.01, high: float = 0.99) -> Column:
    """A read's samples less a centre, over a spread; 0 where the spread is 0. median_mad, zscore, quantile (centre and
    spread of the samples clipped to their quantiles low and high) or pa_scaling. A null sample stays null and is left out of
    centre and spread."""
    over = lambda v, m, s: F.transform(v, lambda x: F.when(x.isNull(), x).when(s > 0, (x - m) / s).otherwise(F.lit(0.0)))
    spread = lambda v, m: 1.4826 * median(F.transform(v, lambda x: F.abs(x - m)))
    values = F.transform(values, lambda x: x.cast("double"))
    known = lambda v: F.filter(v, F.isnotnull)
    if method == "median_mad":
        return let(values, lambda v: let(known(v), lambda k: let(median(k), lambda m: let(spread(k, m), lambda s: over(v, m, s)))))
    if method == "zscore":
        return let(values, lambda v: let(known(v), lambda k: let(mean(k), std(k), lambda m, s: over(v, m, s))))
    if method == "quantile":
        clip = lambda v: let(F.array_sort(v), lambda s: let(quantile(s, low), quantile(s, high), lambda a, b: F.transform(v, lambda x: F.greatest(a, F.least(b, x)))))
        return let(values, lambda v: let(clip(known(v)), lambda c: let(median(c), lambda m: let(spread(c, m), lambda s: over(v, m, s)))))
    if method == "pa_scaling":
        return let(values, cal_offset, cal_scale, lambda v, a, b: F.transform(v, lambda x: ((x + a) * b - pa_mean) / pa_stdev))
    raise ValueError(f"unknown normalisation {method!r}")


def bases_of_samples(base_map: Column) -> Column:
    """The base of every sample from the map's first entry to its last, in one walk over the bases."""
    return let(base_map, lambda m: F.flatten(F.transform(indices(F.size(m) - 1), lambda i: F.array_repeat(i, F.greatest(F.lit(0), at(m, i + 1) - at(m, i)).cast("int")))))


def base_at(bases: Column, base_map: Column, sample: Column) -> Column:
    """base_of_sample by looking it up in bases_of_samples."""
    first = at(base_map, F.lit(0))
    return F.when(sample < first, -1).when(sample >= F.element_at(base_map, -1), F.size(base_map) - 1).otherwise(at(bases, sample - first))


def spread_residual(signal: Column, base_map: Column, bases: Column, expected: Column) -> Column:
    """signal_residual with the bases of samples at hand: a look-up a sample."""
    def of(x: Column, m: Column, b: Column, e: Column) -> Column:
        level = lambda i: F.coalesce(at(e, at(b, i - at(m, F.lit(0)))), F.lit(0.0))
        return F.transform(x, lambda v, i: F.when(i < at(m, F.lit(0)), 0.0).otherwise(let(level(i), lambda y: F.when(y != 0, v - y).otherwise(F.lit(0.0)))))

    return let(signal, base_map, bases, expected, of)


def reference_map(query_map: Column, cigar: Column, stride: int = 0) -> Column:
    """First sample of every reference base of an alignment, and the end: the places of the reference's bases in the read
    (sequence.reference_places), each taken through the read's map by linear interpolation and rounded down. One walk. A
    map may be given as what it is beyond `stride` samples a base; then the even part is added before the rest, and a
    place that is whole but for rounding may go the other way than by the sum of both."""
    def sample(m: Column, q: Column) -> Column:
        last = F.size(m) - 1
        low = F.least(F.floor(q).cast("int"), last - 1)
        inside = (at(m, low + 1) - at(m, low) + stride) * (q - low) + low * stride + at(m, low)
        return F.floor(F.when(q >= last, (F.element_at(m, -1) + last * stride).cast("double")).otherwise(inside))

    return let(query_map, reference_places(cigar), lambda m, p: F.transform(p, lambda q: sample(m, q)))
