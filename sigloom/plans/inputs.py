"""The sample tables as the library's inputs: reads, signals, corpora, scores, votes; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered(rows: DataFrame, key: str, order: tuple[str, ...], value: Column) -> DataFrame:
    """key -> v: its values in order. One read's values make one list."""
    items = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, value.alias("v_")))).alias("x"))
    return items.select(key, F.transform("x", lambda t: t["v_"]).alias("v"))


def line_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, v: an order's quantities as a read's values."""
    return ordered(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE_ORDER, F.col("l_quantity")).withColumnRenamed("l_orderkey", "read_id")


LINE_READS = f"reads AS (SELECT l_orderkey AS read_id, list(l_quantity ORDER BY {', '.join(LINE_ORDER)}) AS v FROM lineitem GROUP BY 1)"


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, v: a user's event values by time as a signal."""
    return ordered(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), F.col("value")).withColumnRenamed("user_id", "read_id")


EVENT_SIGNALS = "signals AS (SELECT user_id AS read_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1)"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label (0..9), logits: ten coordinates of an embedding, times 20."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 20).alias("logits"))


LOGITS = "logits AS (SELECT vec_id AS id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 20) AS logits FROM embeddings)"
PROBS = (
    "probs AS (SELECT id, label, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM"
    " (SELECT id, label, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM logits))"
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label (0/1), prob rounded to three places (so that scores tie), grp."""
    p = F.round(1 / (1 + F.exp(-12 * F.get("embedding", F.lit(0)).cast("double") - 0.3 * (F.col("label") - 4.5))), 3)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("label"), p.alias("prob"), (F.col("vec_id") % 4).cast("int").alias("grp"))


SCORES = (
    "scores AS (SELECT vec_id AS id, CAST(label >= 5 AS INT) AS label,"
    " round(1 / (1 + exp(-12 * CAST(embedding[1] AS DOUBLE) - 0.3::DOUBLE * (label - 4.5::DOUBLE))), 3) AS prob, CAST(vec_id % 4 AS INT) AS grp FROM embeddings)"
)
CURVE = (
    "curve AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg, p, q FROM"
    " (SELECT prob AS score, sum(label) AS p, sum(1 - label) AS q FROM scores GROUP BY 1) WINDOW w AS (ORDER BY score DESC))"
)

CLASSES = ("Ala", "Arg", "Asn", "Asp", "Cys")
PAIRS = [(f"{a}_{b}", a, b) for i, a in enumerate(CLASSES) for b in CLASSES[i + 1 :]]


def pairs(spark: SparkSession) -> DataFrame:
    rows = [(p, a, b, i) for i, (p, a, b) in enumerate(PAIRS)]
    return spark.createDataFrame(rows, "pair string, neg string, pos string, place int")


PAIRS_SQL = "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{a}', '{b}', {i})" for i, (p, a, b) in enumerate(PAIRS)) + ") t(pair, neg, pos, place))"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, pair, prob: coordinates 11 to 20 of an embedding as the ten pair models' probabilities."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("read_id"), F.posexplode(F.slice("embedding", 11, 10)).alias("place", "x"))
    pair = F.get(F.array(*[F.lit(p) for p, _, _ in PAIRS]), F.col("place"))
    return rows.select("read_id", pair.alias("pair"), F.round(1 / (1 + F.exp(-10 * F.col("x").cast("double"))), 6).alias("prob"))


VOTES = (
    PAIRS_SQL + ", votes AS (SELECT vec_id AS read_id, pair, neg, pos, place, round(1 / (1 + exp(-10 * CAST(embedding[11 + place] AS DOUBLE))), 6) AS prob FROM embeddings, pairs),"
    " cast_votes AS (SELECT read_id, pair, neg AS class, 1 - prob AS vote, abs(2 * prob - 1) AS weight, 2 * place AS place FROM votes"
    " UNION ALL SELECT read_id, pair, pos, prob, abs(2 * prob - 1), 2 * place + 1 FROM votes)"
)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("read_id"), F.floor(F.col("o_totalprice") / 100).cast("int").alias("anchor_end"), F.col("o_orderpriority").alias("group"), F.col("o_orderstatus").alias("batch"), F.col("o_totalprice").alias("quality_score"), (F.col("o_totalprice") % 1000).alias("quality_margin"))


MANIFEST = (
    "manifest AS (SELECT o_orderkey AS read_id, CAST(floor(o_totalprice / 100) AS INT) AS anchor_end, o_orderpriority AS grp, o_orderstatus AS batch,"
    " o_totalprice AS quality_score, o_totalprice % 1000 AS quality_margin FROM orders)"
)


LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 2 * "ACGTACGTACGTACGTACGTACGTAC"


def bases(text: Column) -> Column:
    """A text's letters as bases; what is no ASCII letter stays as it is."""
    return F.translate(text, LETTERS, AS_BASES)


def bases_sql(text: str) -> str:
    """The same as a list of letters."""
    return f"string_split(translate({text}, '{LETTERS}', '{AS_BASES}'), '')"
