"""Normalisation of signals held as samples (read_id, x and others): a read's samples are brought together once and treated as
an array, so any number of methods costs one shuffle and no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal

METHODS = ("median_mad", "zscore", "quantile", "pa_scaling")


def of(values: Column, method: str, low: float = 0.2, high: float = 0.9, mean: float = 90.0, std: float = 12.0, offset: float = 10.0, scale: float = 0.2) -> Column:
    """A read's samples by a method. quantile: centre and spread of the clipped signal, applied to the signal as it is.
    pa_scaling: counts to picoamperes, then by fixed mean and deviation."""
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; there are {', '.join(METHODS)}")
    return signal.normalised(values, method, mean, std, F.lit(offset), F.lit(scale), low, high)


def normalised(samples: DataFrame, method: str, **figures: float) -> DataFrame:
    """The samples with y. One read's samples make one list."""
    reads = samples.groupBy("read_id").agg(F.collect_list(F.struct(*samples.columns)).alias("rows_"))
    both = reads.select(F.arrays_zip("rows_", of(F.col("rows_").getField("x"), method, **figures).alias("y_")).alias("z_"))
    return both.select(F.explode("z_").alias("z_")).select("z_.rows_.*", F.col("z_.y_").alias("y"))


def by_method(signals: DataFrame, methods: tuple[str, ...] = METHODS, values: str = "v", **figures: float) -> DataFrame:
    """A row a read and method: the signals' columns but the values, method and y (the normalised values)."""
    kept = [c for c in signals.columns if c != values]
    each = F.array(*[F.struct(F.lit(m).alias("method"), of(F.col(values), m, **figures).alias("y")) for m in methods])
    return signals.select(*kept, F.inline(each))
