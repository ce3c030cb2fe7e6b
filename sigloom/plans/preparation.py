"""Queries of read preparation and of what follows prediction: move tables, signals, reference motifs, strata, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, signal
from ..operators import calibration, metrics, preparing, refine, splits
from . import inputs as I
from .calling import BISECTED, STEPS, predictions
from .corpus import FILES, FOLDS, files
from .evaluation import ECE, MULTI, multiclass, rounded
from .reads import AROUND, OPS, SPANS, alignments, with_moves, with_spans


def move_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as text, parsed; a read without a number of samples has no table."""
    reads = with_moves(I.line_reads(spark, sf_dir))
    text = F.concat_ws(",", F.lit("5"), F.array_join(F.transform("moves", lambda x: x.cast("string")), ","))
    tags = reads.select("read_id", text.alias("mv"), F.when(F.col("read_id") % 9 > 0, F.col("samples")).alias("ns"), "trim")
    t = tags.select("read_id", preparing.move_table(preparing.parsed_moves(F.col("mv")), F.col("ns"), F.col("trim")).alias("t"))
    return t.select("read_id", F.col("t.stride").alias("stride"), F.size("t.moves").alias("steps"), F.col("t.samples").alias("samples"), F.col("t.trim").alias("trim"), F.when(F.col("t").isNotNull(), F.md5(F.array_join(F.col("t.moves").cast("array<string>"), ""))).alias("digest"))


def customer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, table: a move table for every customer, with a trim of 0 to 2 samples and a stride of 2."""
    moves = F.transform(F.sequence(F.lit(0), F.col("c_nationkey").cast("int")), lambda i: F.when(i % 3 == 1, 0).otherwise(1))
    trim = (F.col("c_custkey") % 3).cast("int")
    table = preparing.move_table(F.concat(F.array(F.lit(2)), moves), trim + 2 * F.size(moves), trim)
    return I.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("read_id"), table.alias("table"))


def prepared_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals joined to alignments, trimmed, scaled and turned round; reads without a signal are counted, not dropped."""
    signals = I.event_signals(spark, sf_dir).select(F.col("read_id").cast("long").alias("read_id"), "v")
    rows = preparing.prepared(preparing.with_signals(customer_tables(spark, sf_dir), signals), reverse=True)
    weighted = F.aggregate(F.transform("signal", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(rows.select("read_id", "missing", F.when(~F.col("missing"), F.size("signal")).alias("n"), weighted.alias("weighted"), F.array_join(F.col("map").cast("array<string>"), ",").alias("map")), 4)


def refined_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of three samples moved to fit levels that repeat every five bases; every seventh base has none."""
    rows = with_spans(I.event_signals(spark, sf_dir)).withColumn("map", F.slice("map", F.lit(1), F.size("map") - 1))
    levels = F.transform(arrays.indices(F.size("map") - 1), lambda i: F.when(i % 7 > 0, (i % 5).cast("double")))
    out = refine.refine(rows.withColumn("levels", levels), "read_id", "v")
    return out.select("read_id", F.array_join(F.col("map").cast("array<string>"), ",").alias("map"))


def feature_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All channels of every base, in their order."""
    rows = with_spans(I.event_signals(spark, sf_dir)).withColumn("levels", signal.level_features(F.col("v"), F.col("map")))
    expected = F.transform("levels", lambda _, i: (i % 4).cast("double"))
    residual = signal.residual_features(F.transform("levels", lambda t: t["level_mean"]), expected)
    merged = signal.merged_channels(signal.dwell_features(signal.dwells(F.col("map"))), F.col("levels"), residual)
    return rounded(rows.select("read_id", F.posexplode(merged).alias("base_idx", "f")).select("read_id", "base_idx", "f.*"))


def calibration_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calibration.calibrate(I.logits(spark, sf_dir))
    row = (found["method"], found["t"], round(found["ece_before"], 5), round(found["ece_after"], 5), found["improved"], found["n"], found["classes"])
    return spark.createDataFrame([row], "method string, temperature double, ece_before double, ece_after double, improved boolean, n long, classes int")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a grid with a figure each, ranked; a point without a figure is last."""
    o = I.table(spark, sf_dir, "orders")
    points = o.groupBy((F.length("o_orderpriority") * 10).alias("left_context"), F.col("o_orderstatus").alias("right_context")).agg(F.round(F.avg(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))), 2).alias("figure"))
    return metrics.ranked_grid(points, "figure", ["left_context", "right_context"])


def confound_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as labels, by the base that stands for the region's name, where there is one."""
    n, r = I.table(spark, sf_dir, "nation"), I.table(spark, sf_dir, "region")
    bases = r.select("r_regionkey", F.get(F.array(*[F.lit(x) for x in ("A", None, "G", "T")]), F.col("r_regionkey").cast("int")).alias("base"))
    named = n.join(bases, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), "base")
    return calibration.confound_classes(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("label_int")), named)


def named_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).withColumn("reference_name", F.col("read_id") % 6)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("reference_name"), F.repeat("r_name", F.lit(60)).alias("sequence"))


def reference_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs of the reference in every read, by lenient and strict rules, and by the reference's own coordinate."""
    return preparing.motifs_by_rule(named_alignments(spark, sf_dir), references(spark, sf_dir), "CA", RULES)


RULES = {"lenient": {}, "strict": {"skip_indels": True}, "reference": {"anchor": "reference", "require_mapping": False}}


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multiclass(spark, sf_dir).withColumn("stratum", F.when(F.col("id") % 3 == 0, "disrupted").otherwise("exact"))
    return rounded(metrics.by_stratum(rows, "label", "call", "stratum"))


def first_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.first_codes(docs, "source", "doc_id")


RATES = "s1=0.1,s2=0.25,unknown=0.05"


def noise_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the noise rate of their source group; groups without a rate have 0."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), F.col("doc_id") % 4).alias("source_group"))
    docs = docs.withColumn("source_group", F.when(F.col("source_group") != "s3", F.col("source_group")))
    return calibration.with_rates(docs, "source_group", calibration.noise_rates(RATES)).groupBy("source_group", "noise_rate").agg(F.count("*").alias("n"))


def merged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files merged, cut into five folds by read, and counted."""
    rows = splits.merged(files(spark, sf_dir))
    return splits.routed(rows, splits.folds(rows, "doc_id", 5), "doc_id").groupBy("fold", "split", "label").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multiclass merge whose groups never cross splits."""
    docs = I.table(spark, sf_dir, "documents")
    rows = docs.join(splits.label_codes(docs, "lang"), "lang").join(splits.by_group(docs, "source", "lang"), "source")
    return rows.groupBy("split", "code").agg(F.count("*").alias("n"), F.countDistinct("source").alias("groups"))


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by mean and deviation of their figures."""
    p = I.table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), (F.col("p_size") / 50.0).alias("f1"), (F.col("p_retailprice") / 2000.0).alias("accuracy"))
    return metrics.compared(p, "model", ["f1", "accuracy"])


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions beside their alignments; reads without either are left out."""
    calls = predictions(spark, sf_dir).select("read_id", "call", F.array_max("probs").alias("confidence"))
    return alignments(spark, sf_dir).select("read_id", "reference_start", F.size("cigar").alias("blocks")).join(calls, "read_id")


def config_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a region's nations differ in a setting from the first region's."""
    n = I.table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_regionkey").cast("long").alias("input"), F.concat(F.lit("k"), F.col("n_nationkey") % 4).alias("key"), F.substring("n_name", 1, 1).alias("value"))
    return preparing.disagreeing(rows, ["k0", "k1", "k2"])


QUERIES = {
    "p1_move_tables": move_tables, "j1_prepared_reads": prepared_reads, "c4_reference_motifs": reference_motifs, "a12_stratified_multiclass": stratified, "a23_first_codes": first_codes,
    "j8_noise_rates": noise_rates, "r15_merged_folds": merged_folds, "r16_merged_groups": merged_groups, "a30_comparison": comparison, "j10_prediction_table": prediction_table, "a35_config_keys": config_keys, "p25_refined_maps": refined_maps,
    "p23_feature_channels": feature_channels, "l7_calibration_run": calibration_run, "m8_ranked_grid": grid, "l11_confound_classes": confound_classes,
}

ORDER = ", ".join(I.LINE_ORDER)
BLOCKS = (
    f"blocks AS (SELECT l_orderkey AS read_id, [{', '.join(map(str, OPS))}][(l_linenumber - 1) % {len(OPS)} + 1] AS op, CAST(l_quantity AS INT) AS n, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {ORDER})),"
    " placed AS (SELECT *, 100 + coalesce(sum(CASE WHEN op IN (0, 2, 7, 8) THEN n ELSE 0 END) OVER w, 0) AS r, coalesce(sum(CASE WHEN op IN (0, 1, 4, 7, 8) THEN n ELSE 0 END) OVER w, 0) AS q FROM blocks WINDOW w AS (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),"
    " ends AS (SELECT read_id, 100 + sum(CASE WHEN op IN (0, 2, 3, 7, 8) THEN n ELSE 0 END) AS stop FROM blocks GROUP BY 1),"
    " motifs AS (SELECT name, unnest(list_filter(range(len(s) - 1), lambda p: s[p + 1:p + 2] = 'CA')) AS p FROM (SELECT r_regionkey AS name, repeat(r_name, 60) AS s FROM region)),"
    " hits AS (SELECT read_id, p FROM ends JOIN motifs ON name = read_id % 6 WHERE p >= 100 AND p + 2 <= stop),"
    " mapped AS (SELECT h.read_id, p, min(CASE WHEN op IN (0, 7, 8) AND r <= p AND p < r + n THEN q + p - r END) AS a, min(CASE WHEN op IN (0, 7, 8) AND r <= p + 1 AND p + 1 < r + n THEN q + p + 2 - r END) AS z,"
    "  min(CASE WHEN op IN (0, 7, 8) AND r <= p AND p < r + n THEN k END) AS ka, min(CASE WHEN op IN (0, 7, 8) AND r <= p + 1 AND p + 1 < r + n THEN k END) AS kz FROM hits h JOIN placed USING (read_id) GROUP BY 1, 2),"
    " broken AS (SELECT m.read_id, m.p, coalesce(bool_or(k < greatest(ka, kz) AND ((op = 1 AND r >= m.p AND r < m.p + 2) OR (op = 2 AND n > 0 AND r >= m.p))), false) AS indel FROM mapped m JOIN placed USING (read_id) GROUP BY 1, 2)"
)

ORACLE = {
    "p1_move_tables": f"""
WITH {I.LINE_READS}, m AS (SELECT read_id, flatten(list_transform(v, lambda x: list_concat([1], list_transform(range(CAST(x AS BIGINT) % 5), lambda z: 0)))) AS moves, CASE WHEN read_id % 7 != 3 THEN read_id % 7 ELSE 0 END AS trim FROM reads)
SELECT read_id, CASE WHEN read_id % 9 > 0 THEN 5 END AS stride, CASE WHEN read_id % 9 > 0 THEN CAST(len(moves) AS INT) END AS steps, CASE WHEN read_id % 9 > 0 THEN CAST(trim + 5 * len(moves) AS INT) END AS samples, CASE WHEN read_id % 9 > 0 THEN CAST(trim AS INT) END AS trim, CASE WHEN read_id % 9 > 0 THEN md5(array_to_string(moves, '')) END AS digest FROM m""",
    "j1_prepared_reads": f"""
WITH {I.EVENT_SIGNALS}, c AS (SELECT c_custkey AS read_id, c_custkey % 3 AS trim, list_transform(range(0, c_nationkey + 1), lambda i: CASE WHEN i % 3 = 1 THEN 0 ELSE 1 END) AS moves FROM customer),
j AS (SELECT c.*, v, v IS NULL AS missing, 2 * len(moves) AS total FROM c LEFT JOIN signals USING (read_id)),
k AS (SELECT *, v[trim + 1:least(trim + total, len(v))] AS x FROM j),
s AS (SELECT *, coalesce(list_median(x), 0) AS med, coalesce(list_median(list_transform(x, lambda y: abs(y - list_median(x)))), 0) AS mad FROM k),
w AS (SELECT *, list_reverse(list_transform(x, lambda y: CASE WHEN mad > 0 THEN (y - med) / (1.4826::DOUBLE * mad) ELSE 0 END)) AS z, list_concat(list_transform(list_filter(range(len(moves)), lambda i: moves[i + 1] = 1), lambda i: i * 2), [total]) AS map FROM s)
SELECT read_id, missing, CASE WHEN NOT missing THEN CAST(len(z) AS INT) END AS n, round(CASE WHEN NOT missing THEN coalesce(list_sum(list_transform(z, lambda y, i: y * i)), 0) END, 4) AS weighted, array_to_string(list_reverse(list_transform(map, lambda m: total - m)), ',') AS map FROM w""",
    "c4_reference_motifs": f"""
WITH {BLOCKS}, m AS (SELECT mapped.*, indel FROM mapped JOIN broken USING (read_id, p))
SELECT read_id, CAST(a AS BIGINT) AS position, CAST(z - a - 2 AS BIGINT) AS junction_indel, true AS junction_mapped, 'lenient' AS rule FROM m WHERE a IS NOT NULL AND z IS NOT NULL AND abs(z - a - 2) <= 3
UNION ALL SELECT read_id, CAST(a AS BIGINT), CAST(z - a - 2 AS BIGINT), true, 'strict' FROM m WHERE z - a = 2 AND NOT indel
UNION ALL SELECT read_id, CAST(p - 100 AS BIGINT), CAST(coalesce(z - a - 2, 0) AS BIGINT), a IS NOT NULL AND z IS NOT NULL, 'reference' FROM m""",
    "a12_stratified_multiclass": f"""
WITH {MULTI}, x AS (SELECT CASE WHEN id % 3 = 0 THEN 'disrupted' ELSE 'exact' END AS stratum, label, call FROM calls),
t AS (SELECT stratum, label AS class, count(*) AS support, sum(CAST(label = call AS INT)) AS tp FROM x GROUP BY 1, 2), c AS (SELECT stratum, call AS class, count(*) AS called FROM x GROUP BY 1, 2),
r AS (SELECT stratum, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(called, 0) AS called FROM t FULL JOIN c USING (stratum, class))
SELECT stratum, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(2 * tp / (support + called)), 6) AS macro_f1 FROM r GROUP BY 1""",
    "p23_feature_channels": f"""
WITH {I.EVENT_SIGNALS}, {SPANS}, s AS (SELECT *, list_transform(range(len(map) - 1), lambda i: map[i + 2] - map[i + 1]) AS d FROM spans),
b AS (SELECT read_id, i, d, v[map[i + 1] + 1:map[i + 2]] AS x, list_avg({AROUND}) AS m, list_stddev_pop({AROUND}) AS s FROM s, LATERAL unnest(range(len(d))) u(i)),
l AS (SELECT *, coalesce(list_avg(x), 0) AS mean, CAST(i % 4 AS DOUBLE) AS e FROM b)
SELECT read_id, CAST(i AS INT) AS base_idx, round(CAST(d[i + 1] AS DOUBLE), 6) AS dwell, round(ln(d[i + 1] + 1e-6), 6) AS dwell_log, round(m, 6) AS dwell_mean, round(s, 6) AS dwell_std, round(d[i + 1] / (m + 1e-6), 6) AS dwell_ratio,
  round(mean, 6) AS level_mean, round(coalesce(list_median(x), 0), 6) AS level_median, round(coalesce(list_stddev_pop(x), 0), 6) AS level_std, round(coalesce(list_max(x) - list_min(x), 0), 6) AS level_range,
  round(e, 6) AS kmer_expected, round(mean - e, 6) AS kmer_residual, round(abs(mean - e), 6) AS kmer_abs_residual FROM l""",
    "l7_calibration_run": f"""
WITH {I.LOGITS}, {BISECTED}, t AS (SELECT round(2 / (lo + hi), 6) AS t FROM s{STEPS}),
z AS (SELECT label, k, list_transform(logits, lambda x: exp((x - list_max(logits)) / CASE k WHEN 0 THEN 1.0::DOUBLE ELSE t END)) AS e FROM logits, t, range(2) r(k)),
c AS (SELECT k, list_max(e) / list_sum(e) AS c, list_position(e, list_max(e)) - 1 = label AS hit FROM z),
before AS ({ECE.format(x="c", r="hit", t="(SELECT * FROM c WHERE k = 0)")}), after AS ({ECE.format(x="c", r="hit", t="(SELECT * FROM c WHERE k = 1)")})
SELECT 'temperature' AS method, t AS temperature, round(before.ece, 5) AS ece_before, round(after.ece, 5) AS ece_after, after.ece < before.ece AS improved, (SELECT count(*) FROM logits) AS n, 10 AS classes FROM t, before, after""",
    "m8_ranked_grid": """
WITH p AS (SELECT CAST(len(o_orderpriority) * 10 AS INT) AS left_context, o_orderstatus AS right_context, round(avg(CASE WHEN o_orderpriority != '5-LOW' THEN o_totalprice END), 2) AS figure FROM orders GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (ORDER BY figure DESC NULLS LAST, left_context, right_context) AS INT) AS place FROM p""",
    "l11_confound_classes": "SELECT CAST(n_nationkey AS INT) AS label_int, CASE n_regionkey WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 3 END AS confound FROM nation WHERE n_regionkey IN (0, 2, 3)",
    "a23_first_codes": "SELECT source, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INT) AS code FROM documents GROUP BY 1",
    "j8_noise_rates": """
WITH d AS (SELECT CASE WHEN doc_id % 4 = 3 THEN 'unknown' ELSE concat('s', doc_id % 4) END AS source_group FROM documents)
SELECT source_group, CASE source_group WHEN 's1' THEN 0.1::DOUBLE WHEN 's2' THEN 0.25::DOUBLE WHEN 'unknown' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS noise_rate, count(*) AS n FROM d GROUP BY 1, 2""",
    "r15_merged_folds": f"""
WITH {FILES}, ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM files)), {FOLDS.format(k=5)}
SELECT fold, split, label, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM files JOIN folds USING (doc_id) GROUP BY 1, 2, 3""",
    "r16_merged_groups": """
WITH p AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42:', source)), source) - 1 AS rank FROM (SELECT DISTINCT source, lang FROM documents)),
s AS (SELECT source, lang, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN rank = 0 THEN 'train' ELSE 'test' END WHEN rank < greatest(1, floor(n * 0.8::DOUBLE)) THEN 'train'
  WHEN rank < greatest(1, floor(n * 0.8::DOUBLE)) + CASE WHEN greatest(1, floor(n * 0.8::DOUBLE)) + greatest(1, floor(n * 0.1::DOUBLE)) >= n THEN greatest(1, n - greatest(1, floor(n * 0.8::DOUBLE)) - 1) ELSE greatest(1, floor(n * 0.1::DOUBLE)) END THEN 'val' ELSE 'test' END AS split FROM p),
g AS (SELECT source, split FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY lang DESC) = 1), c AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INT) AS code FROM (SELECT DISTINCT lang FROM documents))
SELECT split, code, count(*) AS n, count(DISTINCT source) AS "groups" FROM documents JOIN c USING (lang) JOIN g USING (source) GROUP BY 1, 2""",
    "a30_comparison": """
WITH m AS (SELECT p_brand AS model, round(avg(p_size / 50.0::DOUBLE), 4) AS f1_mean, round(stddev_samp(p_size / 50.0::DOUBLE), 4) AS f1_std, round(avg(p_retailprice / 2000.0::DOUBLE), 4) AS accuracy_mean, round(stddev_samp(p_retailprice / 2000.0::DOUBLE), 4) AS accuracy_std FROM part GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY f1_mean DESC, model) AS INT) AS place FROM m""",
    "j10_prediction_table": f"""
WITH {I.LOGITS}, {I.PROBS}, p AS (SELECT id, 'class' || (list_position(list_transform(probs, lambda x: round(x, 6)), list_max(list_transform(probs, lambda x: round(x, 6)))) - 1) AS call, list_max(list_transform(probs, lambda x: round(x, 6))) AS confidence FROM probs),
a AS (SELECT l_orderkey AS read_id, CAST(count(*) AS INT) AS blocks FROM lineitem GROUP BY 1)
SELECT read_id, 100 AS reference_start, blocks, call, confidence FROM a JOIN p ON id = read_id""",
    "a35_config_keys": """
WITH r AS (SELECT n_regionkey AS input, 'k' || (n_nationkey % 4) AS key, min(n_name[1:1]) AS value FROM nation GROUP BY 1, 2), e AS (SELECT input, key FROM (SELECT DISTINCT n_regionkey AS input FROM nation), (VALUES ('k0'), ('k1'), ('k2')) k(key)),
v AS (SELECT e.input, e.key, value FROM e LEFT JOIN r ON r.input = e.input AND r.key = e.key), f AS (SELECT key, value FROM v WHERE input = (SELECT min(input) FROM v))
SELECT v.key, f.value, v.input, v.value AS other FROM v JOIN f ON f.key = v.key WHERE v.value IS DISTINCT FROM f.value""",
}
