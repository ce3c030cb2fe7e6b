"""Evaluation queries: binary and multiclass metrics, calibration error, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from . import inputs as I


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.logits(spark, sf_dir).withColumn("probs", metrics.softmax(F.col("logits")))
    return rows.withColumn("call", metrics.argmax(F.col("logits"))).withColumn("confidence", F.array_max("probs"))


MULTI = f"{I.LOGITS}, {I.PROBS}, calls AS (SELECT id, label, logits, list_position(logits, list_max(logits)) - 1 AS call, list_max(probs) AS confidence, probs FROM logits JOIN probs USING (id, label))"


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(I.scores(spark, sf_dir)))


def by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of reads with an exact and a disrupted junction; a stratum without rows is there with n = 0."""
    rows = I.scores(spark, sf_dir).withColumn("stratum", F.when(F.col("grp") == 0, "exact").otherwise("disrupted"))
    both = spark.createDataFrame([("exact",), ("disrupted",), ("none",)], "stratum string")
    found = metrics.confusion(rows, by=["stratum"])
    return rounded(both.join(found, "stratum", "left").na.fill(0)).select("stratum", "n", "accuracy", "f1")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auroc_auprc(I.scores(spark, sf_dir)))


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.sweep(I.scores(spark, sf_dir)))


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_thresholds(metrics.sweep(I.scores(spark, sf_dir))))


def at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.tpr_at_fpr(metrics.sweep(I.scores(spark, sf_dir)), 0.05))


def at_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.callable_at_precision(I.scores(spark, sf_dir), 0.8, "id"))


def binary_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_error(I.scores(spark, sf_dir).withColumn("right", F.col("label") == 1), "prob", "right"))


def multi_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_error(multiclass(spark, sf_dir).withColumn("right", F.col("label") == F.col("call")), "confidence", "right"))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multiclass(spark, sf_dir)
    return rounded(rows.agg(F.count("*").alias("n"), *[F.avg(metrics.in_top(F.col("logits"), F.col("label"), k).cast("double")).alias(f"top{k}") for k in (1, 3, 5)]))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiclass(spark, sf_dir).groupBy("label", "call").agg(F.count("*").alias("n"))


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.per_class(multiclass(spark, sf_dir), "label", "call"))


def class_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.averages(metrics.per_class(multiclass(spark, sf_dir), "label", "call")))


def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multiclass(spark, sf_dir).withColumn("grp", (F.col("id") % 7).cast("int"))
    return rounded(metrics.balanced_recall(rows, "grp", "label", "call"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubled labels, so that every other class has no rows."""
    rows = I.table(spark, sf_dir, "embeddings").select((F.col("label") * 2).alias("label"))
    return rounded(metrics.class_weights(rows, "label"))


def standardisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.standardisation(I.event_signals(spark, sf_dir), "v", 30))


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample mean and deviation of every channel over a corpus."""
    x = I.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("channel", "x")).select("channel", F.col("x").cast("double").alias("x"))
    return rounded(x.groupBy("channel").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("*").alias("n")))


def summary_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of segment and priority, with the figures of those that have orders."""
    o = I.table(spark, sf_dir, "orders").join(I.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = o.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("std"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    grid = I.table(spark, sf_dir, "customer").select("c_mktsegment").distinct().join(F.broadcast(I.table(spark, sf_dir, "orders").select("o_orderpriority").distinct()))  # two handfuls of values
    return rounded(grid.join(found, ["c_mktsegment", "o_orderpriority"], "left"), 6)


def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best brand of every part type by mean price, the smaller name of equal ones; and how many brands it beat."""
    means = I.table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"))
    best = means.groupBy("p_type").agg(F.max("mean").alias("mean"), F.count("*").alias("models"))
    return means.join(best, ["p_type", "mean"]).groupBy("p_type", "mean", "models").agg(F.min("p_brand").alias("p_brand"))


def modal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language the most frequent letter before the first `th`, the first seen of equal ones."""
    d = I.table(spark, sf_dir, "documents").select("doc_id", "lang", F.lower("text").alias("t"))
    hit = d.select("doc_id", "lang", "t", F.instr("t", "th").alias("p")).where("p > 1").select("lang", "doc_id", F.expr("substring(t, p - 1, 1)").alias("base"))
    counts = hit.groupBy("lang", "base").agg(F.count("*").alias("n"), (-F.min("doc_id")).alias("first"))
    return counts.groupBy("lang").agg(F.max(F.struct("n", "first", "base")).alias("x")).select("lang", F.col("x.base").alias("base"), F.col("x.n").alias("n"))


def inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a table with a text column that should be a number: sums over what parses."""
    e = I.table(spark, sf_dir, "events").select("event_type", F.regexp_extract("props", r'"k": (\d+)', 1).alias("k"))
    x = F.expr("try_cast(k AS double)")
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("files"), F.count(x).alias("ok"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.min(x).alias("low"), F.max(x).alias("high")))


QUERIES = {
    "a1_binary_metrics": binary, "a11_stratified_metrics": by_stratum, "a1_areas": areas, "a2_threshold_sweep": swept, "a2_best_thresholds": best,
    "a3_tpr_at_fpr": at_fpr, "a4_callable_at_precision": at_precision, "a10_binary_ece": binary_ece, "a9_multiclass_ece": multi_ece,
    "a8_top_k": top_k, "a7_confusion_matrix": confusion_matrix, "a7_class_report": class_report, "a7_class_averages": class_averages,
    "a18_balanced_recall": recalls, "a20_class_weights": class_weights, "a19_standardisation": standardisation, "a32_channel_stats": channel_stats,
    "j15_summary_grid": summary_grid, "a36_best_model": best_model, "a28_modal_base": modal_base, "a37_inspection": inspection,
}

CONF = "SELECT {by} sum(CAST(label = 1 AND prob > 0.5 AS INT)) AS tp, sum(CAST(label = 0 AND prob > 0.5 AS INT)) AS fp, sum(CAST(label = 0 AND prob <= 0.5 AS INT)) AS tn, sum(CAST(label = 1 AND prob <= 0.5 AS INT)) AS fn FROM scores"
SWEEP = (
    "sweep AS (SELECT score, tp / pos AS tpr, fp / neg AS fpr, CASE WHEN (tp + fp) * pos * neg * (pos + neg - tp - fp) > 0 THEN (tp * (neg - fp) - fp * (pos - tp)) / sqrt((tp + fp) * pos * neg * (pos + neg - tp - fp)) ELSE 0 END AS mcc,"
    " 2 * tp / (tp + pos + fp) AS f1, tp / pos - fp / neg AS youden, (tp + fp) / (pos + neg) AS called FROM (SELECT score, tp::DOUBLE AS tp, fp::DOUBLE AS fp, pos::DOUBLE AS pos, neg::DOUBLE AS neg FROM curve))"
)
REPORT = (
    "t AS (SELECT label AS class, count(*) AS support, sum(CAST(label = call AS INT)) AS tp FROM calls GROUP BY 1), c AS (SELECT call AS class, count(*) AS called FROM calls GROUP BY 1),"
    " report AS (SELECT CAST(class AS INT) AS class, coalesce(support, 0) AS support, CASE WHEN coalesce(called, 0) > 0 THEN coalesce(tp, 0) / called ELSE 0.0 END AS precision, CASE WHEN coalesce(support, 0) > 0 THEN tp / support ELSE 0.0 END AS recall,"
    " 2 * coalesce(tp, 0) / (coalesce(support, 0) + coalesce(called, 0)) AS f1 FROM t FULL JOIN c USING (class))"
)
ECE = "SELECT round(coalesce(sum(CASE WHEN bin < 15 THEN n * abs(c - r) END) / sum(n), 0), 6) AS ece FROM (SELECT len(list_filter(range(1, 16), lambda i: {x} >= i / 15.0::DOUBLE)) AS bin, count(*) AS n, avg({x}) AS c, avg(CAST({r} AS INT)) AS r FROM {t} GROUP BY 1)"

ORACLE = {
    "a1_binary_metrics": f"""
WITH {I.SCORES}, c AS ({CONF.format(by='')})
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, CAST(tp + fp + tn + fn AS BIGINT) AS n, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""",
    "a11_stratified_metrics": f"""
WITH {I.SCORES}, c AS ({CONF.format(by="CASE WHEN grp = 0 THEN 'exact' ELSE 'disrupted' END AS stratum,")} GROUP BY 1)
SELECT stratum, CAST(tp + fp + tn + fn AS BIGINT) AS n, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c
UNION ALL SELECT 'none', 0, 0.0::DOUBLE, 0.0::DOUBLE""",
    "a1_areas": f"WITH {I.SCORES}, {I.CURVE} SELECT round(sum(q * (tp - p / 2.0::DOUBLE)) / (max(pos) * max(neg)), 6) AS auroc, round(sum(p * (tp / (tp + fp))) / max(pos), 6) AS auprc FROM curve",
    "a2_threshold_sweep": f"WITH {I.SCORES}, {I.CURVE}, {SWEEP} SELECT round(score, 6) AS score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(mcc, 6) AS mcc, round(f1, 6) AS f1, round(youden, 6) AS youden, round(called, 6) AS called FROM sweep",
    "a2_best_thresholds": f"WITH {I.SCORES}, {I.CURVE}, {SWEEP} " + " UNION ALL ".join(f"(SELECT '{c}' AS criterion, round(score, 6) AS threshold, round(round({c}, 9), 6) AS value FROM sweep ORDER BY round({c}, 9) DESC, score DESC LIMIT 1)" for c in ("mcc", "f1", "youden")),
    "a3_tpr_at_fpr": f"""
WITH {I.SCORES}, {I.CURVE}, {SWEEP}, a AS (SELECT fpr, tpr FROM (SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT fpr, tpr FROM sweep) WHERE fpr <= 0.05 ORDER BY fpr DESC, tpr DESC LIMIT 1),
b AS (SELECT fpr, tpr FROM sweep WHERE fpr > 0.05 ORDER BY fpr, tpr LIMIT 1)
SELECT round(a.tpr + (b.tpr - a.tpr) * (0.05 - a.fpr) / (b.fpr - a.fpr), 6) AS tpr FROM a, b""",
    "a4_callable_at_precision": f"""
WITH {I.SCORES}, r AS (SELECT row_number() OVER w AS k, sum(CAST(CAST(prob > 0.5 AS INT) = label AS INT)) OVER w AS m, count(*) OVER () AS n FROM scores WINDOW w AS (ORDER BY abs(prob - 0.5::DOUBLE) DESC, id ROWS UNBOUNDED PRECEDING))
SELECT coalesce(max(k) FILTER (m / k >= 0.8::DOUBLE), 0) AS k, round(coalesce(max(k) FILTER (m / k >= 0.8::DOUBLE), 0) / max(n), 6) AS share FROM r""",
    "a10_binary_ece": f"WITH {I.SCORES} " + ECE.format(x="prob", r="label = 1", t="scores"),
    "a9_multiclass_ece": f"WITH {MULTI} " + ECE.format(x="confidence", r="label = call", t="calls"),
    "a8_top_k": f"WITH {MULTI} SELECT count(*) AS n, " + ", ".join(f"round(avg(CAST(len(list_filter(logits, lambda x: x > logits[label + 1])) < {k} AS INT)), 6) AS top{k}" for k in (1, 3, 5)) + " FROM calls",
    "a7_confusion_matrix": f"WITH {MULTI} SELECT label, CAST(call AS INT) AS call, count(*) AS n FROM calls GROUP BY 1, 2",
    "a7_class_report": f"WITH {MULTI}, {REPORT} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report",
    "a7_class_averages": f"WITH {MULTI}, {REPORT} SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM report",
    "a18_balanced_recall": f"""
WITH {MULTI}, g AS (SELECT grp, avg(r) AS r FROM (SELECT CAST(id % 7 AS INT) AS grp, label, avg(CAST(label = call AS INT)) AS r FROM calls GROUP BY 1, 2) GROUP BY 1)
SELECT grp, round(r, 6) AS recall FROM g UNION ALL SELECT NULL, round(avg(r), 6) FROM g""",
    "a20_class_weights": """
WITH c AS (SELECT label * 2 AS label, count(*) AS c FROM embeddings GROUP BY 1), t AS (SELECT sum(c) AS n, max(label) + 1 AS k FROM c)
SELECT CAST(i AS INT) AS label, round(CASE WHEN c > 0 THEN sqrt(n / (k * c)) ELSE 1 END, 6) AS weight FROM t, unnest(range(k)) u(i) LEFT JOIN c ON c.label = i""",
    "a19_standardisation": f"WITH {I.EVENT_SIGNALS}, x AS (SELECT unnest(v[greatest(1, len(v) - 29):]) AS x FROM signals) SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x",
    "a32_channel_stats": "SELECT CAST(i AS INT) AS channel, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(embedding[i + 1] AS DOUBLE)), 6) AS std, count(*) AS n FROM embeddings, range(64) t(i) GROUP BY 1",
    "j15_summary_grid": """
WITH f AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_mktsegment, o_orderpriority, n, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high
FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) LEFT JOIN f USING (c_mktsegment, o_orderpriority)""",
    "a36_best_model": """
WITH m AS (SELECT p_type, p_brand, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1, 2)
SELECT p_type, mean, models, p_brand FROM (SELECT *, count(*) OVER (PARTITION BY p_type) AS models, row_number() OVER (PARTITION BY p_type ORDER BY mean DESC, p_brand) AS r FROM m) WHERE r = 1""",
    "a28_modal_base": """
WITH d AS (SELECT doc_id, lang, lower(text) AS t FROM documents), h AS (SELECT lang, doc_id, substring(t, instr(t, 'th') - 1, 1) AS base FROM d WHERE instr(t, 'th') > 1)
SELECT lang, base, n FROM (SELECT lang, base, count(*) AS n, min(doc_id) AS first FROM h GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) = 1""",
    "a37_inspection": """
WITH e AS (SELECT event_type, TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) AS x FROM events)
SELECT event_type, count(*) AS files, count(x) AS ok, sum(x) AS total, round(avg(x), 6) AS mean, median(x) AS median, min(x) AS low, max(x) AS high FROM e GROUP BY 1""",
}
