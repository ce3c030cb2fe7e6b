"""Classification metrics as aggregates. Rows are (label 0/1, prob) or (label, probs); ties are explicit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKETS = 4096


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, label: str = "label", prob: str = "prob", threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn with a call of 1 strictly above the threshold, and what follows from them."""
    one, called = F.col(label) == 1, F.col(prob) > threshold
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    sums = rows.groupBy(*(by or [])).agg(count(one & called).alias("tp"), count(~one & called).alias("fp"), count(~one & ~called).alias("tn"), count(one & ~called).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return sums.select("*", (tp + fp + tn + fn).alias("n"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def curve(rows: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """One row a distinct score, highest first: tp and fp at or above it, and the totals. Scores are counted, then summed up
    in buckets of the score: what lies above a bucket is a running sum over buckets, the rest one inside it."""
    scores = rows.groupBy(F.col(prob).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("q"))
    bucket = F.greatest(F.lit(-1), F.least(F.lit(BUCKETS), F.floor(F.col("score") * BUCKETS)))
    scores = scores.withColumn("b", bucket)
    sizes = scores.groupBy("b").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq"))  # BUCKETS + 2 rows at most
    above, every = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    bases = sizes.select("b", before("bp").alias("p0"), before("bq").alias("q0"), F.sum("bp").over(every).alias("pos"), F.sum("bq").over(every).alias("neg"))
    inside = Window.partitionBy("b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ran = scores.withColumn("tp", F.sum("p").over(inside)).withColumn("fp", F.sum("q").over(inside)).join(F.broadcast(bases), "b")
    return ran.select("score", (F.col("p0") + F.col("tp")).alias("tp"), (F.col("q0") + F.col("fp")).alias("fp"), "pos", "neg", "p", "q")


def auroc_auprc(rows: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Area under the ROC curve by trapezoids, and average precision; both 0 if there is one class only."""
    tp, fp, p, q = (F.col(c).cast("double") for c in ("tp", "fp", "p", "q"))
    out = curve(rows, label, prob).agg(F.sum(q * (tp - p / 2)).alias("area"), F.sum(p * tp / (tp + fp)).alias("ap"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    both = (F.coalesce("pos", F.lit(0)) > 0) & (F.coalesce("neg", F.lit(0)) > 0)
    return out.select(F.when(both, F.col("area") / (F.col("pos") * F.col("neg"))).otherwise(0.0).alias("auroc"), F.when(both, F.col("ap") / F.col("pos")).otherwise(0.0).alias("auprc"))


def sweep(rows: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Per threshold: tpr, fpr, mcc, f1, youden and the share called 1. No rows if there is one class only."""
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    fn, tn = F.col("pos") - tp, F.col("neg") - fp
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(0.0)
    two = curve(rows, label, prob).where("pos > 0 and neg > 0")
    tpr, fpr = tp / F.col("pos"), fp / F.col("neg")
    return two.select("score", tpr.alias("tpr"), fpr.alias("fpr"), mcc.alias("mcc"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tpr - fpr).alias("youden"), ((tp + fp) / (F.col("pos") + F.col("neg"))).alias("called"))


def best_thresholds(swept: DataFrame) -> DataFrame:
    """criterion, threshold, value; of equal values the highest threshold."""
    best = swept.agg(*[F.max(F.struct(F.round(c, 9).alias("v"), "score")).alias(c) for c in ("mcc", "f1", "youden")])
    each = [best.select(F.lit(c).alias("criterion"), F.col(f"{c}.score").alias("threshold"), F.col(f"{c}.v").alias("value")) for c in ("mcc", "f1", "youden")]
    return reduce(DataFrame.unionByName, each).where("threshold is not null")


def tpr_at_fpr(swept: DataFrame, fpr: float) -> DataFrame:
    """Linear interpolation of the ROC curve, which starts at (0, 0)."""
    at = lambda c, w: F.col(f"{w}.{c}")
    ends = swept.agg(F.max(F.when(F.col("fpr") <= fpr, F.struct("fpr", "tpr"))).alias("a"), F.min(F.when(F.col("fpr") > fpr, F.struct("fpr", "tpr"))).alias("b"))
    f0, t0 = F.coalesce(at("fpr", "a"), F.lit(0.0)), F.coalesce(at("tpr", "a"), F.lit(0.0))
    return ends.select(F.when(F.col("b").isNull(), t0).otherwise(t0 + (at("tpr", "b") - t0) * (fpr - f0) / (at("fpr", "b") - f0)).alias("tpr"))


def callable_at_precision(rows: DataFrame, precision: float, key: str, label: str = "label", prob: str = "prob") -> DataFrame:
    """The largest share of rows, most confident first (ties by key), whose calls have the precision.

    Rows are ranked in buckets of confidence: counts before a bucket are summed, ranks run inside it."""
    sure = F.abs(F.col(prob) - 0.5)
    right = ((F.col(prob) > 0.5).cast("int") == F.col(label)).cast("long")
    rows = rows.select(sure.alias("s"), F.col(key).alias("k"), right.alias("ok")).withColumn("b", F.floor(F.col("s") * 512))
    sizes = rows.groupBy("b").agg(F.count("*").alias("n"), F.sum("ok").alias("m"))
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("b", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("m0"))
    inside = Window.partitionBy("b").orderBy(F.desc("s"), "k").rowsBetween(Window.unboundedPreceding, 0)
    ran = rows.withColumn("n", F.count("*").over(inside)).withColumn("m", F.sum("ok").over(inside)).join(F.broadcast(bases), "b")
    n, m = F.col("n0") + F.col("n"), F.col("m0") + F.col("m")
    return ran.agg(F.coalesce(F.max(F.when(m / n >= precision, n)), F.lit(0)).alias("k"), F.count("*").alias("n")).select("k", ratio(F.col("k"), F.col("n")).alias("share"))


def calibration_error(rows: DataFrame, confidence: str, right: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins [lo, hi); a confidence of exactly 1 is in none of them."""
    bin_ = F.size(F.filter(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.col(confidence) >= i / F.lit(float(bins))))
    rows = rows.withColumn("bin", bin_)
    by = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(right).cast("double")).alias("r"))
    return by.agg(F.coalesce(F.sum(F.when(F.col("bin") < bins, F.col("n") * F.abs(F.col("c") - F.col("r")))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def softmax(logits: Column) -> Column:
    high = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - high))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def in_top(values: Column, label: Column, k: int) -> Column:
    """Whether fewer than k elements are larger than the label's."""
    return F.size(F.filter(values, lambda x: x > F.get(values, label))) < F.least(F.lit(k), F.size(values))


def per_class(rows: DataFrame, label: str, call: str) -> DataFrame:
    """class, support, precision, recall, f1: one row for every class that is a label or a call."""
    truth = rows.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("support"), F.sum((F.col(label) == F.col(call)).cast("long")).alias("tp"))
    calls = rows.groupBy(F.col(call).alias("class")).agg(F.count("*").alias("called"))
    both = truth.join(calls, "class", "full").na.fill(0)
    return both.select("class", "support", ratio(F.col("tp"), F.col("called")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("called")).alias("f1"))


def averages(classes: DataFrame) -> DataFrame:
    """Macro and weighted f1."""
    return classes.agg(F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"))


def by_stratum(rows: DataFrame, label: str, call: str, stratum: str) -> DataFrame:
    """stratum, n, accuracy, macro_f1: over the classes that are a label or a call in the stratum."""
    truth = rows.groupBy(stratum, F.col(label).alias("class")).agg(F.count("*").alias("support"), F.sum((F.col(label) == F.col(call)).cast("long")).alias("tp"))
    calls = rows.groupBy(stratum, F.col(call).alias("class")).agg(F.count("*").alias("called"))
    both = truth.join(calls, [stratum, "class"], "full").na.fill(0, ["support", "tp", "called"])
    f1 = ratio(2 * F.col("tp"), F.col("support") + F.col("called"))
    return both.groupBy(stratum).agg(F.sum("support").alias("n"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def parametric(rows: DataFrame, kind: str, value: float, key: str, label: str = "label", prob: str = "prob") -> float:
    """A metric with a parameter, by its name."""
    if kind == "tpr_at_fpr":
        return tpr_at_fpr(sweep(rows, label, prob), value).first()["tpr"]
    if kind == "callable_at_precision":
        return callable_at_precision(rows, value, key, label, prob).first()["share"]
    raise ValueError(f"no metric {kind!r}")


def compared(rows: DataFrame, model: str, figures: list[str]) -> DataFrame:
    """A row a model: mean and sample deviation of every figure to four places, and its place by the first figure's mean,
    the smaller name first among equal ones."""
    each = [x for c in figures for x in (F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 4).alias(f"{c}_std"))]
    place = F.row_number().over(Window.orderBy(F.desc(f"{figures[0]}_mean"), model))  # one row a model
    return rows.groupBy(model).agg(*each).withColumn("place", place)


def ranked_grid(points: DataFrame, figure: str, axes: list[str]) -> DataFrame:
    """A grid's points with place: the highest figure first, missing ones last, equal ones by the axes in order."""
    order = Window.orderBy(F.desc_nulls_last(figure), *axes)  # a grid is small
    return points.withColumn("place", F.row_number().over(order))


def balanced_recall(rows: DataFrame, group: str, truth: str, call: str) -> DataFrame:
    """Per group the mean of its classes' recalls, and over all groups (group null) the mean of those."""
    recalls = rows.groupBy(group, truth).agg(F.avg((F.col(truth) == F.col(call)).cast("double")).alias("recall"))
    groups = recalls.groupBy(group).agg(F.avg("recall").alias("recall"))
    return groups.unionByName(groups.agg(F.avg("recall").alias("recall")).withColumn(group, F.lit(None).cast(rows.schema[group].dataType)))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, weight. Of three labels or more: sqrt(n / (classes * count)), classes being the largest label + 1; a label
    without rows has 1. Of two: label 1 alone, weighing the zeros over the ones, or no row if there are no ones. Of fewer: no
    row, as there is nothing to weigh. Null labels don't count."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count()
    number = lambda value: F.sum(F.when(F.col(label) == value, F.col("count")).otherwise(0))
    totals = counts.agg(F.sum("count").alias("n"), (F.max(label) + 1).alias("k"), F.count("*").alias("d"), number(0).alias("zeros"), number(1).alias("ones"))
    every = totals.where("d > 2").select("n", "k", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias(label))
    weight = F.when(F.col("count") > 0, F.sqrt(F.col("n") / (F.col("k") * F.col("count")))).otherwise(1.0)
    many = every.join(counts, label, "left").select(label, weight.alias("weight"))
    two = totals.where("d = 2 and ones > 0").select(F.lit(1).alias(label), (F.col("zeros") / F.col("ones")).alias("weight"))
    return many.unionByName(two)


def standardisation(rows: DataFrame, signal: str, last: int) -> DataFrame:
    """n, mean, std: population mean and deviation of the last samples of all signals, by moments that are merged and not by
    sums of squares, which cancel out for signals far from 0."""
    x = F.slice(F.col(signal), F.greatest(F.lit(1), F.size(signal) - last + 1), F.lit(last))
    return rows.select(F.explode(x).alias("x")).select(F.col("x").cast("double").alias("x")).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
