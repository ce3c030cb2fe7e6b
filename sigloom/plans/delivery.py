"""Queries of what leaves a run: aligned scores, window corpora, target codes, sequences within a few edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery, matching
from ..sources import shared
from . import inputs as I

CHUNK, EDITS = 8, 3
ALPHABET = "-Brand#0123456789"


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's score beside its label, by its key."""
    chunks = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return delivery.aligned_scores(chunks, I.scores(spark, sf_dir).select("id", "prob"), ["id"])


def window_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last CHUNK values before every user's anchor, written as a corpus by the user's first event type and read again."""
    e = I.table(spark, sf_dir, "events")
    plan = e.groupBy(F.col("user_id").alias("read_id")).agg((F.count("*") - F.pmod(F.first("user_id"), F.lit(3))).cast("int").alias("anchor_end"), F.min("event_type").alias("split"))
    signals = I.event_signals(spark, sf_dir).withColumnRenamed("v", "signal")
    path = shared.scratch(spark, "windows")
    delivery.build_corpus(plan, signals, CHUNK, path)
    return spark.read.parquet(path).select("read_id", "split", F.transform("x", lambda v: F.round(v.cast("double"), 3)).alias("x"))


def target_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as codes of an alphabet, and back."""
    p = I.table(spark, sf_dir, "part").select("p_partkey", matching.encoded(F.col("p_brand"), ALPHABET).alias("codes"))
    return p.withColumn("back", matching.decoded(F.col("codes"), ALPHABET))


def codes(rows: DataFrame, text: str, name: str) -> DataFrame:
    return rows.select(F.col(text).alias(name), F.substring(F.md5(F.col(text)), 1, 8).alias(f"{name}_code"))


def codes_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight-letter codes of all customers, the nearest of all suppliers' codes within EDITS edits."""
    reads = codes(I.table(spark, sf_dir, "customer"), "c_name", "read")
    panel = codes(I.table(spark, sf_dir, "supplier"), "s_name", "name")
    return matching.nearest_within(reads, "read_code", panel, "name", "name_code", EDITS)


QUERIES = {"k8_aligned_scores": aligned, "k10_window_corpus": window_corpus, "f5_target_codes": target_codes, "j13_codes_within": codes_within}

ORACLE = {
    "k8_aligned_scores": f"WITH {I.SCORES} SELECT vec_id AS id, e.label, prob FROM embeddings e JOIN scores s ON s.id = e.vec_id",
    "k10_window_corpus": f"""
WITH {I.EVENT_SIGNALS}, p AS (SELECT user_id AS read_id, count(*) - user_id % 3 AS ends, min(event_type) AS split FROM events GROUP BY 1, user_id)
SELECT read_id, split, list_transform(v[ends - {CHUNK - 1}:ends], lambda x: round(CAST(CAST(x AS FLOAT) AS DOUBLE), 3)) AS x FROM p JOIN signals USING (read_id) WHERE ends >= {CHUNK}""",
    "f5_target_codes": f"SELECT p_partkey, list_transform(string_split(p_brand, ''), lambda x: CAST(instr('{ALPHABET[1:]}', x) AS INT)) AS codes, p_brand AS back FROM part",
    "j13_codes_within": f"""
WITH d AS (SELECT c_name AS read, substring(md5(c_name), 1, 8) AS read_code FROM customer), p AS (SELECT DISTINCT s_name AS name, substring(md5(s_name), 1, 8) AS code FROM supplier),
m AS (SELECT DISTINCT read_code, name, levenshtein(read_code, code) AS d FROM d, p), r AS (SELECT *, row_number() OVER w AS r, lead(d) OVER w AS next FROM m WHERE d <= {EDITS} WINDOW w AS (PARTITION BY read_code ORDER BY d, name))
SELECT read, read_code, name AS call, CAST(r.d AS INT) AS distance, CAST(next - r.d AS INT) AS margin FROM d LEFT JOIN r ON d.read_code = r.read_code AND r.r = 1""".replace("SELECT read, read_code,", "SELECT read, d.read_code,"),
}
