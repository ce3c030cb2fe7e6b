"""What leaves a run: scores by their chunks, windows of planned reads as a corpus, both with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import sinks


def aligned_scores(chunks: DataFrame, scores: DataFrame, key: list[str], value: str = "prob") -> DataFrame:
    """The chunks with the value of their key. A chunk without a score, a score without a chunk and a key with unlike
    scores are errors of the run that reads the rows, so no score is ever given to another chunk and no pass is spent on
    looking first. Equal scores of one key count once; chunks that share a key each get its score. A null in a key is a
    value like any other."""
    if {value, "here_"} & set(chunks.columns):
        raise ValueError(f"the chunks have a column {value} or here_ of their own")
    mismatch = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.to_json(F.struct(*[F.coalesce(F.col(f"c.{k}"), F.col(f"s.{k}")).alias(k) for k in key]))))
    one = scores.groupBy(*key).agg(F.min(value).alias("low_"), F.max(value).alias("high_"), F.count(value).alias("n_"), F.count("*").alias("all_"))
    c, s = chunks.withColumn("here_", F.lit(True)).alias("c"), one.withColumn("there_", F.lit(True)).alias("s")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    on = same[0]
    for x in same[1:]:
        on &= x
    kind = scores.schema[value].dataType
    unlike = (F.col("s.n_") > 0) & ((F.col("s.low_") != F.col("s.high_")) | (F.col("s.n_") < F.col("s.all_")))
    checked = (
        F.when(F.col("c.here_").isNull(), mismatch("a score without a chunk").cast(kind))
        .when(F.col("s.there_").isNull(), mismatch("a chunk without a score").cast(kind))
        .when(unlike, mismatch("unlike scores of one chunk").cast(kind))
        .otherwise(F.col("s.low_"))
    )
    return c.join(s, on, "full").select(*[F.col(f"c.`{x}`") for x in chunks.columns], checked.alias(value))


def trailing_windows(plan: DataFrame, signals: DataFrame, chunk: int, source: str = "pod5", signal: str = "signal") -> DataFrame:
    """The planned reads' last `chunk` samples before anchor_end, as floats: the plan's columns and x. Reads that are not
    there, or whose window does not lie inside their signal, are left out. Signals are cut after the join, and a signal
    of a read that is not planned never leaves its task where the plan is small enough to be sent."""
    if chunk < 1:
        raise ValueError("a window has at least one sample")
    keys = ["read_id"] + ([source] if source in signals.columns else [])
    rows = plan.join(signals.select(*keys, F.col(signal).alias("raw_")), keys)
    end = F.col("anchor_end")
    inside = (end >= chunk) & (end <= F.size("raw_"))
    return rows.where(inside).withColumn("x", F.transform(F.slice("raw_", end - chunk + 1, F.lit(chunk)), lambda v: v.cast("float"))).drop("raw_")


def build_corpus(plan: DataFrame, signals: DataFrame, chunk: int, path: str, state_len: int = 4, allow_shortfall: bool = False, by: str = "split") -> int:
    """Writes the windows of a plan as a corpus, a folder a split, beside its settings (path + "_meta"); gives back how
    many there are. Rows are counted as they are written. No rows, or fewer than half of the plan's unless allowed, is an
    error: then no settings are written, which marks the corpus as one not to be used."""
    planned, seen = plan.count(), Observation()
    windows = trailing_windows(plan, signals, chunk).observe(seen, F.count("*").alias("n"))
    windows.write.partitionBy(by).parquet(path)
    n = seen.get["n"]
    sinks.checked(n, planned, allow_shortfall)
    sinks.write_json(plan.sparkSession, {"chunk": chunk, "state_len": state_len, "planned": planned, "rows": n}, path + "_meta")
    return n


def within_geometry(target: Column, chunk: int, samples_per_base: float, state_len: int = 4) -> Column:
    """Whether a window of `chunk` samples holds what a decoder of that state length can emit of a target."""
    return F.greatest(F.lit(0), F.length(target) - state_len) * F.lit(samples_per_base) <= chunk
