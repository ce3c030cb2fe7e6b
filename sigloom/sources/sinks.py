"""Writers: corpora by split, prediction tables, bundles of model parameters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_corpus(chunks: DataFrame, path: str, by: str = "split", compression: str = "zstd") -> dict:
    """A corpus as Parquet, one folder a split; no rows is an error. Gives back the rows of each split. They are counted as
    they are written and again from the files, by their footers; a difference is an error. There are few splits."""
    if chunks.isEmpty():
        raise ValueError("there are no chunks to write")
    seen = Observation()
    chunks.observe(seen, F.count("*").alias("n")).write.partitionBy(by).option("compression", compression).parquet(path)
    there = chunks.sparkSession.read.schema(chunks.schema).parquet(path).groupBy(by).count()
    found = {r[0]: r[1] for r in there.collect()}
    if sum(found.values()) != seen.get["n"]:
        raise ValueError(f"{path} holds {sum(found.values())} of {seen.get['n']} rows")
    return found


def write_predictions(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header, compressed."""
    rows.write.csv(path, sep="\t", header=True, compression="gzip")


def write_json(spark: SparkSession, values: dict, path: str) -> None:
    """A small document, such as metrics or settings."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.text(path)


#: The columns of a grid summary, in order.
GRID_COLUMNS = (
    "left_context", "right_context", "dwell_offset", "signal_len", "best_val_acc", "best_val_f1", "best_val_auc", "best_val_selection", "best_val_loss",
    "best_epoch", "final_train_acc", "final_train_loss", "train_time_sec", "model_path", "selection_metric", "status",
)


def write_grid_summary(points: DataFrame, path: str) -> None:
    """A grid's points as one CSV with fixed columns, those without a figure empty, the best selection figure first; no
    points write nothing. A grid is small, so one file holds it."""
    if points.isEmpty():
        return
    columns = [F.col(c) if c in points.columns else F.lit(None).cast("string").alias(c) for c in GRID_COLUMNS]
    out = points.select(*columns)
    order = [F.desc_nulls_last("best_val_selection"), F.col("left_context"), F.col("right_context"), F.col("dwell_offset")]
    out.orderBy(*order).coalesce(1).write.csv(path, header=True)


def checked_yield(extracted: DataFrame, planned: int, allow_shortfall: bool = False) -> int:
    """Rows there are; see `checked`."""
    n = extracted.count()
    checked(n, planned, allow_shortfall)
    return n


def checked(n: int, planned: int, allow_shortfall: bool = False) -> None:
    """No rows of those planned is an error; fewer than half is one unless allowed."""
    if n == 0 or (not allow_shortfall and n < 0.5 * planned):
        raise ValueError(f"{n} of {planned} planned rows")


def bundle(models: DataFrame) -> DataFrame:
    """pair, neg, pos, platt_a, platt_b of models that must share an architecture; unknown scalings are 1 and 0."""
    kinds = models.select("architecture").distinct().limit(2).collect()
    if len(kinds) != 1:
        raise ValueError("a bundle holds models of one architecture")
    return models.select("pair", "neg", "pos", F.coalesce("platt_a", F.lit(1.0)).alias("platt_a"), F.coalesce("platt_b", F.lit(0.0)).alias("platt_b"))


def best_fold(folds: DataFrame) -> DataFrame:
    """The fold of the least loss, then the most f1; a missing loss counts as infinite."""
    return folds.orderBy(F.coalesce("final_val_loss", F.lit(float("inf"))), F.desc("best_val_f1"), "fold").limit(1)


def best_checkpoint(history: DataFrame, tolerance: float = 0.25, always_final: bool = False) -> DataFrame:
    """The last epoch, unless its loss is above the best by more than the tolerance: then the best epoch. No epoch is an
    error."""
    if history.isEmpty():
        raise ValueError("there are no epochs")
    if always_final:
        return history.agg(F.max("epoch").alias("epoch"))
    ends = history.agg(F.max(F.struct("epoch", "loss")).alias("last"), F.min(F.struct("loss", "epoch")).alias("best"))
    return ends.select(F.when(F.col("last.loss") > F.col("best.loss") * (1 + tolerance), F.col("best.epoch")).otherwise(F.col("last.epoch")).alias("epoch"))
