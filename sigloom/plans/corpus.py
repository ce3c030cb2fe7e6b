"""Corpus queries: splits, folds, merges, weights, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from . import inputs as I

RANKED = "ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents))"
SPLIT = "CASE WHEN rank < floor(n * 0.8::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END"


def split_by_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.by_read(I.table(spark, sf_dir, "documents"), "doc_id")


def split_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = splits.routed(docs, splits.by_read(docs, "doc_id"), "doc_id")
    return rows.groupBy("split", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def split_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds(I.table(spark, sf_dir, "documents"), "doc_id", 7)


def split_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.by_group(I.table(spark, sf_dir, "documents"), "source", "lang")


def files(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two overlapping groups of languages and all documents, as the files of a corpus."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), F.col("source").alias("source_group"), "n_chars")
    return [docs.where(docs.label.isin("de", "en")), docs.where(docs.label.isin("en", "fr")), docs.withColumn("label", F.lit("mixed"))]


FILES = (
    "files AS (SELECT 0 AS file, doc_id, lang AS label, source AS source_group, n_chars FROM documents WHERE lang IN ('de', 'en')"
    " UNION ALL SELECT 1, doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'fr')"
    " UNION ALL SELECT 2, doc_id, 'mixed', source, n_chars FROM documents)"
)


def merge_last_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.last_label(files(spark, sf_dir), "doc_id", "label")


def merge_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files relabelled by their first label, merged, split and counted."""
    rows = splits.merged(splits.relabelled(files(spark, sf_dir), "label", ["de"], ["mixed"]))
    rows = splits.routed(rows, splits.by_read(rows, "doc_id", 0.6, 0.2), "doc_id")
    return rows.groupBy("split", "label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("reads"))


def merge_multiclass_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents")
    rows = docs.join(splits.label_codes(docs, "lang"), "lang").join(splits.folds(docs, "doc_id", 5), "doc_id")
    return rows.groupBy("fold", "split", "code").agg(F.count("*").alias("n"))


def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.label_codes(I.table(spark, sf_dir, "documents"), "source")


def comparison_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under every comparison whose label lists have their language: label 0 or 1 by the list."""
    spec = spark.createDataFrame([("romance", ["fr", "es"], "germanic", ["de", "en"]), ("french", ["fr"], "rest", ["de", "es"])], "meta1 string, labels1 array<string>, meta2 string, labels2 array<string>")
    sides = spec.select(F.concat_ws("_vs_", "meta1", "meta2").alias("comparison"), F.explode(F.concat(F.transform("labels1", lambda x: F.struct(x.alias("lang"), F.lit(0).alias("label"))), F.transform("labels2", lambda x: F.struct(x.alias("lang"), F.lit(1).alias("label"))))).alias("x")).select("comparison", "x.*")
    return I.table(spark, sf_dir, "documents").join(F.broadcast(sides), "lang").groupBy("comparison", "label").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def union_distinct_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of any file, in how many files, and whether in all."""
    parts = [f.select("doc_id").distinct() for f in files(spark, sf_dir)]
    everywhere = parts[0].intersect(parts[2])
    only = parts[2].subtract(parts[0])
    rows = parts[0].union(parts[1]).union(parts[2]).groupBy("doc_id").agg(F.count("*").alias("files"))
    return rows.join(everywhere.withColumn("both", F.lit(True)), "doc_id", "left").join(only.withColumn("only", F.lit(True)), "doc_id", "left").na.fill(False)


def sampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("source"))
    return splits.sampling_weights(docs, "source").select("doc_id", "sampling_group", F.round("weight", 9).alias("weight"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.gated(I.manifest(spark, sf_dir), "quality_score", "quality_margin", 20000.0, 500.0).select("read_id", "batch")


def quality_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.manifest(spark, sf_dir).withColumn("quality_score", F.when(F.col("read_id") % 3 > 0, F.col("quality_score")))
    return splits.coverage(rows, "quality_score").select(F.round("coverage", 9).alias("coverage"))


def corpus_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.planned(I.manifest(spark, sf_dir), 300, 0.1).select("read_id", F.col("group").alias("grp"), "rank", "split")


def corpus_plan_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard of a plan: the ranks are those of the whole plan."""
    return splits.planned(I.manifest(spark, sf_dir), 300, 0.1, per_group=150, shard=["O"]).select("read_id", "rank", "split")


PLAN = (
    "long AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY md5(concat('42:', read_id)), read_id) AS turn, count(*) OVER (PARTITION BY grp) AS n FROM manifest WHERE anchor_end > 300 + 200),"
    " placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY turn, batch, read_id) - 1 AS rank, greatest(1, floor(n * 0.1::DOUBLE)) AS n_test FROM long)"
)


def holdout_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.manifest(spark, sf_dir)
    held = splits.resolved(m, "read_id", "batch", "F", None, 0.1).groupBy("split").count().withColumn("rule", F.lit("batch"))
    drawn = splits.resolved(m, "read_id", "batch", None, None, 0.1).groupBy("split").count().withColumn("rule", F.lit("drawn"))
    return held.unionByName(drawn).withColumnRenamed("count", "n")


def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.manifest(spark, sf_dir)
    return m.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("anchor_end").alias("lengths"), F.min("anchor_end").alias("low"), F.max("anchor_end").alias("high"))


QUERIES = {
    "r1_split_by_read": split_by_read,
    "r7_split_routed": split_routed,
    "r4_kfold": split_folds,
    "r5_split_by_group": split_by_group,
    "r6_last_label": merge_last_label,
    "r14_merge_relabelled": merge_relabelled,
    "r17_multiclass_folds": merge_multiclass_folds,
    "r11_label_codes": label_codes,
    "r18_comparison_spec": comparison_spec,
    "u1_read_sets": union_distinct_reads,
    "r22_sampling_weights": sampling_weights,
    "r21_quality_gate": quality_gate,
    "a25_quality_coverage": quality_coverage,
    "w4_corpus_plan": corpus_plan,
    "o9_corpus_plan_shard": corpus_plan_shard,
    "r20_resolved_split": holdout_batches,
    "a27_manifest_batches": manifest_summary,
}

FOLDS = "parts AS (SELECT doc_id, CAST(CASE WHEN rank < (n % {k}) * (n // {k} + 1) THEN rank // (n // {k} + 1) ELSE n % {k} + (rank - (n % {k}) * (n // {k} + 1)) // greatest(n // {k}, 1) END AS INT) AS part FROM ranked), folds AS (SELECT doc_id, CAST(fold AS INT) AS fold, CASE WHEN part = fold THEN 'test' WHEN part = (fold + 1) % {k} THEN 'val' ELSE 'train' END AS split FROM parts, range({k}) t(fold))"

ORACLE = {
    "r1_split_by_read": f"WITH {RANKED} SELECT doc_id, {SPLIT} AS split FROM ranked",
    "r7_split_routed": f"WITH {RANKED} SELECT {SPLIT} AS split, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN ranked USING (doc_id) GROUP BY 1, 2",
    "r4_kfold": f"WITH {RANKED}, {FOLDS.format(k=7)} SELECT doc_id, fold, split FROM folds",
    "r5_split_by_group": """
WITH p AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42:', source)), source) - 1 AS rank FROM (SELECT DISTINCT source, lang FROM documents)),
q AS (SELECT *, greatest(1, floor(n * 0.1::DOUBLE)) AS nv FROM p),
t AS (SELECT *, greatest(1, floor(n * 0.8::DOUBLE)) AS nt FROM q),
v AS (SELECT * REPLACE (CASE WHEN nt + nv >= n THEN greatest(1, n - nt - 1) ELSE nv END AS nv) FROM t),
s AS (SELECT source, lang, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN rank = 0 THEN 'train' ELSE 'test' END WHEN rank < nt THEN 'train' WHEN rank < nt + nv THEN 'val' ELSE 'test' END AS split FROM v)
SELECT source, split FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY lang DESC) = 1""",
    "r6_last_label": f"WITH {FILES} SELECT doc_id, label FROM files QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY file DESC, label DESC) = 1",
    "r14_merge_relabelled": f"""
WITH {FILES}, named AS (SELECT doc_id, CASE min(label) OVER (PARTITION BY file) WHEN 'de' THEN '0' WHEN 'mixed' THEN '1' ELSE label END AS label FROM files),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM files))
SELECT CASE WHEN rank < floor(n * 0.6::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split, label, count(*) AS n, count(DISTINCT doc_id) AS reads
FROM named JOIN ranked USING (doc_id) GROUP BY 1, 2""",
    "r17_multiclass_folds": f"""
WITH {RANKED}, {FOLDS.format(k=5)}, codes AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INT) AS code FROM (SELECT DISTINCT lang FROM documents))
SELECT fold, split, code, count(*) AS n FROM documents JOIN codes USING (lang) JOIN folds USING (doc_id) GROUP BY 1, 2, 3""",
    "r11_label_codes": "SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS code FROM (SELECT DISTINCT source FROM documents)",
    "r18_comparison_spec": """
WITH sides AS (SELECT * FROM (VALUES ('romance_vs_germanic', 'fr', 0), ('romance_vs_germanic', 'es', 0), ('romance_vs_germanic', 'de', 1), ('romance_vs_germanic', 'en', 1),
  ('french_vs_rest', 'fr', 0), ('french_vs_rest', 'de', 1), ('french_vs_rest', 'es', 1)) t(comparison, lang, label))
SELECT comparison, label, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN sides USING (lang) GROUP BY 1, 2""",
    "u1_read_sets": f"""
WITH {FILES} SELECT doc_id, count(*) AS files, count(*) FILTER (file IN (0, 2)) = 2 AS both, count(*) FILTER (file = 2) = 1 AND count(*) FILTER (file = 0) = 0 AS "only" FROM files GROUP BY 1""",
    "r22_sampling_weights": """
WITH d AS (SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END, ''), 'unknown') AS sampling_group FROM documents)
SELECT doc_id, sampling_group, round(1.0::DOUBLE / count(*) OVER (PARTITION BY sampling_group), 9) AS weight FROM d""",
    "r21_quality_gate": f"WITH {I.MANIFEST} SELECT read_id, batch FROM manifest WHERE quality_margin > 500 AND quality_score >= 20000",
    "a25_quality_coverage": f"WITH {I.MANIFEST} SELECT round(avg(CAST(read_id % 3 > 0 AS INT)), 9) AS coverage FROM manifest",
    "w4_corpus_plan": f"""
WITH {I.MANIFEST}, {PLAN}, cap AS (SELECT min(floor(n * 0.9::DOUBLE)) AS cap FROM placed)
SELECT read_id, grp, CAST(rank AS INT) AS rank, CASE WHEN rank < n_test THEN 'test' ELSE 'train' END AS split FROM placed, cap WHERE rank < n_test + cap""",
    "o9_corpus_plan_shard": f"WITH {I.MANIFEST}, {PLAN} SELECT read_id, CAST(rank AS INT) AS rank, CASE WHEN rank < n_test THEN 'test' ELSE 'train' END AS split FROM placed WHERE rank < n_test + 150 AND batch = 'O'",
    "r20_resolved_split": f"""
WITH {I.MANIFEST}, r AS (SELECT row_number() OVER (ORDER BY md5(concat('42:', read_id)), read_id) - 1 AS rank, count(*) OVER () AS n FROM manifest)
SELECT CASE WHEN starts_with(batch, 'F') THEN 'test' ELSE 'train' END AS split, count(*) AS n, 'batch' AS rule FROM manifest GROUP BY 1
UNION ALL SELECT CASE WHEN rank < greatest(1, floor(n * 0.1::DOUBLE)) THEN 'test' ELSE 'train' END, count(*), 'drawn' FROM r GROUP BY 1""",
    "a27_manifest_batches": f"WITH {I.MANIFEST} SELECT batch, count(*) AS n, count(DISTINCT anchor_end) AS lengths, min(anchor_end) AS low, max(anchor_end) AS high FROM manifest GROUP BY 1",
}
