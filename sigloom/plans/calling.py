"""Calling queries: votes, accepted calls, sinks' rows, nearest references, calibration, losses, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, crf, matching, metrics, votes
from . import inputs as I
from .evaluation import rounded


def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.pairwise(I.votes(spark, sf_dir), I.pairs(spark))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.pairwise(I.votes(spark, sf_dir), I.pairs(spark), weighted=True)


def tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.tournament(I.votes(spark, sf_dir), I.pairs(spark), top=3)


def one_vs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of the models as one-against-all models of their first class."""
    firsts = {}
    for p, a, _, in I.PAIRS:
        firsts.setdefault(a, p)
    pairs = I.pairs(spark).where(F.col("pair").isin(*firsts.values()))
    return votes.one_vs_all(I.votes(spark, sf_dir).where(F.col("pair").isin(*firsts.values())), pairs)


def pair_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names split at the first underscore."""
    n = I.table(spark, sf_dir, "part").select(F.regexp_replace("p_type", " ", "_").alias("pair")).distinct()
    return n.select("pair", votes.pair_labels(F.col("pair")).alias("x")).select("pair", "x.*")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.logits(spark, sf_dir).withColumn("probs", F.transform(metrics.softmax(F.col("logits")), lambda p: F.round(p, 6)))
    return rows.select(F.col("id").alias("read_id"), F.format_string("class%d", metrics.argmax(F.col("probs"))).alias("call"), "probs", F.when(F.col("id") % 5 > 0, (F.col("id") % 7 - 3).cast("int")).alias("junction_indel"), (F.col("id") % 11 > 0).alias("junction_mapped"))


PREDICTIONS = (
    f"{I.LOGITS}, {I.PROBS}, r AS (SELECT id, list_transform(probs, lambda p: round(p, 6)) AS probs FROM probs),"
    " predictions AS (SELECT id AS read_id, 'class' || (list_position(probs, list_max(probs)) - 1) AS call, probs, CASE WHEN id % 5 > 0 THEN id % 7 - 3 END AS junction_indel, id % 11 > 0 AS junction_mapped,"
    " list_reverse_sort(probs)[1] AS p1, list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2] AS p2 FROM r)"
)


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for abstain in (False, True):
        one = votes.accepted(predictions(spark, sf_dir), 90, 30, abstain).select("read_id", "aa", "ac", "am", F.lit(abstain).alias("abstain"))
        out = one if out is None else out.unionByName(one)
    return out


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the tab-separated sink."""
    p = votes.accepted(predictions(spark, sf_dir), 0, 40, True)
    return p.select(F.col("read_id").alias("read_name"), F.format_string("%.6f", F.get("probs", F.lit(0))).alias("prob_0"), F.col("aa").alias("predicted_aa"), F.format_string("%.6f", F.array_max("probs")).alias("confidence"), F.coalesce(F.col("junction_indel").cast("string"), F.lit("")).alias("junction_indel"), F.col("junction_mapped").cast("int").alias("junction_mapped"))


def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = I.table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("base_idx")).agg(F.round(F.max("l_discount") * 9, 6).alias("prob"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alignments with the tags of those that have predictions."""
    first = votes.tags(chunk_scores(spark, sf_dir), "first")
    last = votes.tags(chunk_scores(spark, sf_dir), "last").select("read_id", F.col("prob").alias("last_prob"))
    reads = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"))
    return reads.join(first, "read_id", "left").join(last, "read_id", "left")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest and next nearest of the reference panel by edit distance: parts against the distinct names."""
    p = I.table(spark, sf_dir, "part")
    decodes = p.select(F.col("p_partkey").alias("read_id"), F.concat_ws(" ", "p_name", "p_type").alias("s"))
    panel = p.select(F.col("p_name").alias("name"), F.col("p_name").alias("sequence")).distinct()
    return matching.nearest(decodes, "s", panel, "name", "sequence").drop("s")


def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.temperature(I.logits(spark, sf_dir))


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and mean confidence under three fixed calibrations."""
    rows, out = I.logits(spark, sf_dir), None
    w = [[(1.1 if i == j else 0.02) for j in range(10)] for i in range(10)]
    params = [{"method": "temperature", "t": 2.5}, {"method": "matrix", "w": w, "b": [0.1 * i for i in range(10)]}, {"method": "dirichlet", "w": [0.5 + 0.05 * i for i in range(10)], "b": [0.0] * 10}]
    for p in params:
        z = rows.select("label", calibration.applied(F.col("logits"), p).alias("z")).select("label", metrics.softmax(F.col("z")).alias("p"))
        one = z.agg(F.avg((metrics.argmax(F.col("p")) == F.col("label")).cast("double")).alias("accuracy"), F.avg(F.array_max("p")).alias("confidence")).withColumn("method", F.lit(p["method"]))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.scores(spark, sf_dir).select(F.ln((F.col("prob") + 1e-3) / (1 - F.col("prob") + 1e-3)).alias("logit"), "label")
    a, b = calibration.platt(rows)
    return spark.createDataFrame([(round(a, 4), round(b, 4))], "a double, b double")


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.scores(spark, sf_dir).withColumn("x", F.ln((F.col("prob") + 1e-3) / (1 - F.col("prob") + 1e-3)))
    rate = F.when(F.col("grp") == 0, 0.2).when(F.col("grp") == 1, 0.05).otherwise(0.0)
    return rounded(rows.groupBy("grp").agg(F.avg(calibration.noisy_bce(F.col("x"), F.col("label"), rate)).alias("noisy"), F.avg(calibration.focal(F.col("x"), F.col("label"), 2.0, 1.0)).alias("focal")))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"))
    return rounded(steps.select("step", calibration.warmup_cosine(F.col("step"), 15_000, 2_000, 0.1).alias("factor")))


def confounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a confounder by lookup; -1 where it is missing."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 6 > 0, F.col("source")).alias("value"))
    return docs.join(calibration.codes(docs, "value"), "value", "left").select("doc_id", F.coalesce("code", F.lit(-1)).alias("code"))


def context_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid 200:1000:200 x 100,300 with a figure for every point, ranked; equal figures go to the smaller contexts."""
    left = spark.range(1).select(F.explode(F.sequence(F.lit(200), F.lit(1000), F.lit(200))).alias("left_ctx"))
    points = left.select("left_ctx", F.explode(F.array(F.lit(100), F.lit(300))).alias("right_ctx"))
    total = I.table(spark, sf_dir, "orders").count()
    return points.withColumn("score", (F.col("left_ctx") * 7 + F.col("right_ctx") * 3 + total) % 13).orderBy(F.desc("score"), "left_ctx", "right_ctx").limit(5)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences read from scores of three steps."""
    rows = I.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 60), lambda x: x.cast("double") * 10).alias("scores"))
    return rounded(crf.decode(rows, "vec_id", "scores"))


QUERIES = {
    "a13_pairwise_votes": pairwise, "a14_weighted_votes": weighted, "a15_tournament": tournament, "a16_one_vs_all": one_vs_all, "a17_pair_labels": pair_names,
    "v5_accepted_calls": accepted, "k6_prediction_rows": prediction_rows, "k5_tagged_alignments": tagged, "j13_nearest_reference": nearest,
    "l2_temperature": temperature, "l5_calibrated": calibrated, "l1_platt": platt, "l8_losses": losses, "w9_schedule": schedule, "l10_confound_codes": confounds,
    "m8_context_grid": context_grid, "f8_crf_decode": decoded,
}

TALLY = "tally AS (SELECT read_id, class, round(sum({}), 9) AS votes, min(place) AS place FROM cast_votes{} GROUP BY 1, 2)"
CALL = "SELECT read_id, class AS call, round(CASE WHEN total > 0 THEN votes / total ELSE 0 END, 9) AS confidence FROM (SELECT *, sum(votes) OVER (PARTITION BY read_id) AS total, row_number() OVER (PARTITION BY read_id ORDER BY votes DESC, place) AS r FROM {}) WHERE r = 1"
FIRSTS = "(SELECT min(place) FROM pairs GROUP BY neg)"
BYTE = "CAST(least(255, greatest(0, round_even({} * 255, 0))) AS INT)"
W10 = "(CASE WHEN i = j THEN 1.1::DOUBLE ELSE 0.02::DOUBLE END)"
Z = {
    "temperature": "list_transform(logits, lambda x: x / 2.5::DOUBLE)",
    "matrix": f"list_transform(range(10), lambda i: 0.1::DOUBLE * i + list_sum(list_transform(range(10), lambda j: {W10} * logits[j + 1])))",
    "dirichlet": "list_transform(range(10), lambda i: ln(probs[i + 1]) * (0.5::DOUBLE + 0.05::DOUBLE * i))",
}

# The slope of the mean loss over the inverse temperature b ascends; STEPS halvings of 0.1..10 find where it is 0.
STEPS = 44
SLOPE = "(SELECT avg(list_sum(list_transform(e, lambda y: y[1] * y[2])) / list_sum(list_transform(e, lambda y: y[2])) - truth) FROM (SELECT list_transform(logits, lambda x: [x, exp((x - list_max(logits)) * (lo + hi) / 2)]) AS e, logits[label + 1] AS truth FROM logits))"
BISECTED = "s0 AS (SELECT 0.1::DOUBLE AS lo, 10.0::DOUBLE AS hi), " + ", ".join(
    f"s{k + 1} AS MATERIALIZED (SELECT CASE WHEN slope < 0 THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN slope < 0 THEN hi ELSE (lo + hi) / 2 END AS hi FROM (SELECT lo, hi, {SLOPE} AS slope FROM s{k}))" for k in range(STEPS)
)

ORACLE = {
    "a13_pairwise_votes": f"WITH {I.VOTES}, {TALLY.format('vote', '')} " + CALL.format("tally"),
    "a14_weighted_votes": f"WITH {I.VOTES}, {TALLY.format('vote * weight', '')} " + CALL.format("tally"),
    "a15_tournament": f"""
WITH {I.VOTES}, {TALLY.format('vote', '')}, stay AS (SELECT read_id, class, row_number() OVER (PARTITION BY read_id ORDER BY votes DESC, place) AS rank FROM tally QUALIFY rank <= 3),
kept AS (SELECT c.read_id, c.class, c.vote FROM cast_votes c JOIN (SELECT v.read_id, v.pair FROM votes v JOIN stay a ON a.read_id = v.read_id AND a.class = v.neg JOIN stay b ON b.read_id = v.read_id AND b.class = v.pos) k USING (read_id, pair)),
again AS (SELECT s.read_id, s.class, round(coalesce(sum(vote), 0), 9) AS votes, min(s.rank) AS place FROM stay s LEFT JOIN kept k ON k.read_id = s.read_id AND k.class = s.class GROUP BY 1, 2)
""" + CALL.format("again"),
    "a16_one_vs_all": f"WITH {I.VOTES} SELECT read_id, neg AS call, round(round(1 - prob, 9), 6) AS confidence FROM votes WHERE place IN {FIRSTS} QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY round(1 - prob, 9) DESC, place) = 1",
    "a17_pair_labels": "WITH n AS (SELECT DISTINCT replace(p_type, ' ', '_') AS pair FROM part) SELECT pair, split_part(pair, '_', 1) AS neg, substring(pair, len(split_part(pair, '_', 1)) + 2) AS pos FROM n",
    "v5_accepted_calls": f"""
WITH {PREDICTIONS}, b AS (SELECT *, {BYTE.format('p1')} AS ac, {BYTE.format('p2')} AS am, NOT junction_mapped OR coalesce(junction_indel != 0, false) AS disrupted FROM predictions)
SELECT read_id, CASE WHEN ac >= 90 AND (am >= 30 OR (abstain AND NOT disrupted)) THEN call ELSE 'unc' END AS aa, ac, am, abstain FROM b, (VALUES (true), (false)) t(abstain)""",
    "k6_prediction_rows": f"""
WITH {PREDICTIONS}, b AS (SELECT *, {BYTE.format('p2')} AS am, NOT junction_mapped OR coalesce(junction_indel != 0, false) AS disrupted FROM predictions)
SELECT read_id AS read_name, format('{{:.6f}}', probs[1]) AS prob_0, CASE WHEN am >= 40 OR NOT disrupted THEN call ELSE 'unc' END AS predicted_aa, format('{{:.6f}}', p1) AS confidence, coalesce(CAST(junction_indel AS VARCHAR), '') AS junction_indel, CAST(junction_mapped AS INT) AS junction_mapped FROM b""",
    "k5_tagged_alignments": """
WITH c AS (SELECT l_orderkey AS read_id, l_linenumber AS base_idx, round(max(l_discount) * 9, 6) AS prob FROM lineitem GROUP BY 1, 2),
t AS (SELECT read_id, arg_min(prob, base_idx) AS prob, arg_max(prob, base_idx) AS last_prob, string_agg(CAST(CAST(floor(prob * 255) AS INT) AS VARCHAR), ',' ORDER BY base_idx) AS ml FROM c GROUP BY 1)
SELECT o_orderkey AS read_id, prob, ml, last_prob FROM orders LEFT JOIN t ON read_id = o_orderkey""",
    "j13_nearest_reference": f"""
WITH d AS (SELECT p_partkey AS read_id, concat(p_name, ' ', p_type) AS s FROM part), p AS (SELECT DISTINCT p_name AS name FROM part),
m AS (SELECT read_id, name, levenshtein(s, name) AS d FROM d, p), r AS (SELECT *, row_number() OVER w AS r, lead(d) OVER w AS next FROM m WINDOW w AS (PARTITION BY read_id ORDER BY d, name))
SELECT read_id, name AS call, CAST(d AS INT) AS distance, CAST(coalesce(next - d, 0) AS INT) AS margin FROM r WHERE r = 1""",
    "l2_temperature": f"WITH {I.LOGITS}, {BISECTED} SELECT round(1 / b, 6) AS temperature, round(avg(list_max(logits) * b + ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) * b)))) - logits[label + 1] * b), 6) AS nll FROM logits, (SELECT (lo + hi) / 2 AS b FROM s{STEPS}) GROUP BY b",
    "l5_calibrated": f"WITH {I.LOGITS}, {I.PROBS}, b AS (SELECT id, label, logits, probs FROM logits JOIN probs USING (id, label)), z AS ("
    + " UNION ALL ".join(f"SELECT label, '{k}' AS method, {v} AS z FROM b" for k, v in Z.items())
    + "), s AS (SELECT label, method, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z)"
    " SELECT method, round(avg(CAST(list_position(e, list_max(e)) - 1 = label AS INT)), 6) AS accuracy, round(avg(list_max(e) / list_sum(e)), 6) AS confidence FROM s GROUP BY 1",
    "l8_losses": f"""
WITH {I.SCORES}, x AS (SELECT grp, label, 1 / (1 + exp(-ln((prob + 1e-3) / (1 - prob + 1e-3)))) AS p, CASE grp WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS r FROM scores),
y AS (SELECT *, greatest(1e-7, least(1 - 1e-7, p * (1 - r) + (1 - p) * r)) AS q, greatest(1e-7, CASE WHEN label = 1 THEN p ELSE 1 - p END) AS hit FROM x)
SELECT grp, round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 6) AS noisy, round(avg(-pow(1 - hit, CASE WHEN label = 1 THEN 2.0 ELSE 1.0 END) * ln(hit)), 6) AS focal FROM y GROUP BY 1""",
    "w9_schedule": """
SELECT o_orderkey AS step, round(CASE WHEN o_orderkey < 2000 THEN (o_orderkey + 1) / 2000.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (o_orderkey - 2000) / 13000.0::DOUBLE))) END, 6) AS factor FROM orders""",
    "l10_confound_codes": """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN source END AS value FROM documents), c AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM (SELECT DISTINCT value FROM d WHERE coalesce(value, '') != ''))
SELECT doc_id, coalesce(code, -1) AS code FROM d LEFT JOIN c USING (value)""",
    "m8_context_grid": """
WITH p AS (SELECT CAST(l AS INT) AS left_ctx, r AS right_ctx, CAST((l * 7 + r * 3 + (SELECT count(*) FROM orders)) % 13 AS BIGINT) AS score FROM range(200, 1001, 200) a(l), (VALUES (100), (300)) b(r))
SELECT left_ctx, right_ctx, score FROM p ORDER BY score DESC, left_ctx, right_ctx LIMIT 5""",
}
