"""Queries of tables around the reads: templates, source groups, windows, masks, folds, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, grammar, signal
from ..sources import sinks, tables
from . import inputs as I
from .evaluation import rounded


def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aa, position, dwell_mean with gaps and values at or below 0."""
    l = I.table(spark, sf_dir, "lineitem")
    mean = F.round(F.avg("l_quantity"), 6)
    rows = l.groupBy(F.col("l_returnflag").alias("aa"), (F.col("l_linenumber") + F.length("l_linestatus") * 0).alias("position")).agg(mean.alias("m"), F.count("*").alias("n"))
    return rows.where("not (aa = 'A' and position = 2)").select("aa", "position", F.when((F.col("aa") == "R") & (F.col("position") == 3), 0.0).otherwise(F.col("m")).alias("dwell_mean"))


TEMPLATE = (
    "rows AS (SELECT l_returnflag AS aa, l_linenumber AS position, CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN 0 ELSE round(avg(l_quantity), 6) END AS dwell_mean FROM lineitem GROUP BY 1, 2 HAVING NOT (l_returnflag = 'A' AND l_linenumber = 2)),"
    " cells AS (SELECT aa, position, coalesce(dwell_mean, 1.0::DOUBLE) AS v FROM (SELECT DISTINCT aa FROM rows) CROSS JOIN (SELECT DISTINCT position FROM rows) LEFT JOIN rows USING (aa, position)),"
    " dense AS (SELECT aa, position, CASE WHEN v <= 0 THEN avg(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY position) ELSE v END AS dwell_mean FROM cells)"
)


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = template_rows(spark, sf_dir)
    return rounded(tables.dwell_templates(rows, rows))


def template_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = template_rows(spark, sf_dir)
    l = I.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_returnflag").alias("aa"), (F.col("l_linenumber") + 1).alias("position"), (F.col("l_quantity") - 3).alias("dwell"))
    out = tables.template_ratios(l, tables.dwell_templates(rows, rows))
    return rounded(out.groupBy("aa", "position").agg(F.count("*").alias("n"), F.avg("ratio").alias("ratio")))


def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's source group: its folder, or the one above if that only says charged or uncharged."""
    p = I.table(spark, sf_dir, "part").select(F.concat_ws("/", F.lit("runs"), "p_brand", F.when(F.col("p_size") % 3 == 0, "charged").when(F.col("p_size") % 3 == 1, "uncharged").otherwise("all"), "p_name").alias("path"))
    folder = lambda i: F.element_at(F.split("path", "/"), i)
    group = F.when(folder(-2).isin("charged", "uncharged"), folder(-3)).otherwise(folder(-2))
    return p.groupBy(group.alias("source_group")).agg(F.count("*").alias("files"))


def feature_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a wide feature window that a k-mer of five takes, shifted by one base."""
    low, high = grammar.kmer_slice(2, -10, 1, 5, 21)
    window = F.slice("embedding", 1, 21)
    return rounded(I.table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(F.slice(window, low + 1, high - low), F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")), 5)


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with a block of zeros whose place comes from the read, and a jitter that any engine can repeat."""
    rows = I.event_signals(spark, sf_dir)
    start = F.col("read_id") % 11
    out = F.transform("v", lambda x, i: F.when((i >= start) & (i < start + 5), 0.0).otherwise(x + ((i * 7 + F.col("read_id")) % 13 - 6) / 100.0))
    return rounded(rows.select("read_id", arrays.total(out).alias("total"), F.size(F.filter(out, lambda x: x == 0)).alias("zeros")))


def dwell_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dwell channels of a signal stretched by 1.25: dwell and mean are scaled, the logarithm moves, others stay."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    times = I.ordered(I.table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), micros)
    f = signal.dwell_features(F.transform(signal.dwells(F.col("v")), lambda x: x / 1e6))
    rows = times.select("user_id", F.explode(f).alias("f")).select("user_id", (F.col("f.dwell") * 1.25).alias("dwell"), (F.col("f.dwell_log") + F.ln(F.lit(1.25))).alias("dwell_log"))
    return rounded(rows.groupBy("user_id").agg(F.avg("dwell").alias("dwell"), F.avg("dwell_log").alias("dwell_log")), 4)


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("fold")).agg(F.round(F.avg("o_totalprice"), 4).alias("loss"), F.round(F.max("o_totalprice"), 4).alias("best_val_f1"))
    return o.select("fold", F.when(~F.col("fold").startswith("1"), F.col("loss")).alias("final_val_loss"), "best_val_f1")


def best_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.best_fold(folds(spark, sf_dir)).select("fold")


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("epoch"), F.col("p_retailprice").alias("loss"))
    return sinks.best_checkpoint(history)


def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores kept beside the read that they belong to, counted in tenths."""
    return I.scores(spark, sf_dir).groupBy("label", F.least(F.floor(F.col("prob") * 10), F.lit(9)).alias("tenth")).agg(F.count("*").alias("n"))


QUERIES = {
    "s13_dwell_templates": templates, "p22_template_ratios": template_ratios, "r13_source_groups": source_groups, "p27_feature_slices": feature_slices, "g3_masked_signals": masked,
    "g7_stretched_dwells": dwell_stretch, "a33_best_fold": best_fold, "a34_checkpoint": best_checkpoint, "k8_score_histogram": confidence_histogram,
}

ORACLE = {
    "s13_dwell_templates": f"WITH {TEMPLATE} SELECT aa, position, round(dwell_mean, 6) AS dwell_mean FROM dense",
    "p22_template_ratios": f"""
WITH {TEMPLATE} SELECT l_returnflag AS aa, l_linenumber + 1 AS position, count(*) AS n, round(avg(CASE WHEN l_quantity - 3 > 0 AND coalesce(dwell_mean, 0) > 0 THEN (l_quantity - 3) / dwell_mean ELSE 1 END), 6) AS ratio
FROM lineitem LEFT JOIN dense ON aa = l_returnflag AND position = l_linenumber + 1 GROUP BY 1, 2""",
    "r13_source_groups": "SELECT CASE WHEN p_size % 3 = 2 THEN 'all' ELSE p_brand END AS source_group, count(*) AS files FROM part GROUP BY 1",
    "p27_feature_slices": "SELECT vec_id, round(list_sum(list_transform(embedding[10:14], lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings",
    "g3_masked_signals": f"""
WITH {I.EVENT_SIGNALS}, y AS (SELECT read_id, CASE WHEN i >= read_id % 11 AND i < read_id % 11 + 5 THEN 0 ELSE v[i + 1] + ((i * 7 + read_id) % 13 - 6) / 100.0::DOUBLE END AS y FROM signals, LATERAL unnest(range(len(v))) u(i))
SELECT read_id, round(sum(y), 6) AS total, CAST(count(*) FILTER (y = 0) AS INT) AS zeros FROM y GROUP BY 1""",
    "g7_stretched_dwells": """
WITH d AS (SELECT user_id, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1e6::DOUBLE AS d FROM events)
SELECT user_id, round(avg(d * 1.25::DOUBLE), 4) AS dwell, round(avg(ln(d + 1e-6) + ln(1.25::DOUBLE)), 4) AS dwell_log FROM d WHERE d IS NOT NULL GROUP BY 1""",
    "a33_best_fold": """
WITH f AS (SELECT o_orderpriority AS fold, CASE WHEN starts_with(o_orderpriority, '1') THEN NULL ELSE round(avg(o_totalprice), 4) END AS loss, round(max(o_totalprice), 4) AS f1 FROM orders GROUP BY 1)
SELECT fold FROM f ORDER BY coalesce(loss, 'inf'::DOUBLE), f1 DESC, fold LIMIT 1""",
    "a34_checkpoint": """
WITH h AS (SELECT p_partkey AS epoch, p_retailprice AS loss FROM part), l AS (SELECT * FROM h ORDER BY epoch DESC LIMIT 1), b AS (SELECT * FROM h ORDER BY loss, epoch LIMIT 1)
SELECT CASE WHEN l.loss > b.loss * 1.25::DOUBLE THEN b.epoch ELSE l.epoch END AS epoch FROM l, b""",
    "k8_score_histogram": f"WITH {I.SCORES} SELECT label, CAST(least(floor(prob * 10), 9) AS BIGINT) AS tenth, count(*) AS n FROM scores GROUP BY 1, 2",
}
