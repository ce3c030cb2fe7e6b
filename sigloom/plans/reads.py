"""Read queries: move tables, dwell and level features, normalisation, coordinates, motifs, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, sequence, signal
from ..operators import chunks, normalize
from . import inputs as I
from .evaluation import rounded


def exploded(rows: DataFrame, features: Column, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode(features).alias("base_idx", "f")).select(*keys, "base_idx", "f.*")


def dwell_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between a user's events as dwell times, and their windowed features."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    times = I.ordered(I.table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), micros)
    dwell = F.transform(signal.dwells(F.col("v")), lambda x: x / 1e6)
    return rounded(exploded(times.withColumn("d", dwell), signal.dwell_features(F.col("d")), "user_id"))


def with_moves(reads: DataFrame) -> DataFrame:
    """Every value x as a move and x % 5 stays; stride 5, a trim of read_id % 7 samples (null where that is 3)."""
    moves = F.flatten(F.transform("v", lambda x: F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), (x.cast("long") % 5).cast("int")))))
    trim = (F.col("read_id") % 7).cast("int")
    rows = reads.withColumn("moves", moves).withColumn("trim", F.when(trim != 3, trim))
    return rows.withColumn("samples", F.coalesce("trim", F.lit(0)) + 5 * F.size("moves")).withColumn("map", signal.move_map(F.col("moves"), F.lit(5), F.col("trim"), F.col("samples")))


MOVES = (
    "moved AS (SELECT read_id, v, flatten(list_transform(v, lambda x: list_concat([1], list_transform(range(CAST(x AS BIGINT) % 5), lambda z: 0)))) AS moves, CASE WHEN read_id % 7 != 3 THEN read_id % 7 ELSE 0 END AS trim FROM reads),"
    " mapped AS (SELECT read_id, v, moves, list_concat(list_transform(list_filter(range(len(moves)), lambda i: moves[i + 1] = 1), lambda i: i * 5 + trim), [trim + 5 * len(moves)]) AS map FROM moved)"
)


def move_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_moves(I.line_reads(spark, sf_dir))
    x = F.arrays_zip(F.slice("map", F.lit(1), F.size("map") - 1).alias("start"), signal.dwells(F.col("map")).alias("dwell"))
    return exploded(rows, x, "read_id")


def with_spans(reads: DataFrame) -> DataFrame:
    """Spans of three samples; the last is cut, and an empty one stands at the end."""
    n = F.size("v")
    return reads.withColumn("map", F.concat(F.transform(arrays.indices(F.ceil(n / 3).cast("int")), lambda i: i * 3), F.array(n, n)))


SPANS = "spans AS (SELECT read_id, v, list_concat(range(0, len(v), 3), [len(v), len(v)]) AS map FROM signals)"


def level_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exploded(with_spans(I.event_signals(spark, sf_dir)), signal.level_features(F.col("v"), F.col("map")), "read_id"))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method's mean, lowest and highest sample of every read."""
    rows = normalize.by_method(I.event_signals(spark, sf_dir))
    return rounded(rows.select("read_id", arrays.mean(F.col("y")).alias("mean"), F.array_min("y").alias("low"), F.array_max("y").alias("high"), "method"))


def kmer_levels(spark: SparkSession) -> DataFrame:
    """A level for 60 of the 64 3-mers."""
    letter = lambda shift: F.substring(F.lit("ACGT"), (F.shiftright("id", shift) % 4).cast("int") + 1, F.lit(1))
    return spark.range(60).select(F.concat(letter(4), letter(2), letter(0)).alias("kmer"), (F.col("id") * 7 % 31 + 60.5).alias("level"))


LEVELS = "levels AS (SELECT concat(substring('ACGT', ((i >> 4) % 4) + 1, 1), substring('ACGT', ((i >> 2) % 4) + 1, 1), substring('ACGT', (i % 4) + 1, 1)) AS kmer, i * 7 % 31 + 60.5::DOUBLE AS level FROM range(60) t(i))"


def expected_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected level of every base of a document: that of the k-mer around it, 0 for unknown ones."""
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), sequence.recoded(F.col("text"), I.LETTERS, I.AS_BASES).alias("s"))
    return chunks.expected_levels(docs, "read_id", "s", kmer_levels(spark), 3)


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected level, residual and its size for spans whose expected level is 0 for every third base."""
    rows = with_spans(I.event_signals(spark, sf_dir)).withColumn("means", F.transform(signal.level_features(F.col("v"), F.col("map")), lambda t: t["level_mean"]))
    levels = signal.fitted_levels(F.transform(arrays.indices(F.size("means") - 1), lambda i: F.when(i % 3 == 0, 0.0).otherwise(i.cast("double"))), F.size("means"))
    return rounded(exploded(rows.withColumn("e", levels), signal.residual_features(F.col("means"), F.col("e")), "read_id"))


def sample_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(I.event_signals(spark, sf_dir))
    levels = F.transform(arrays.indices(F.size("map") - 1), lambda i: F.when(i % 3 == 0, 0.0).otherwise(i.cast("double")))
    x = signal.signal_residual(F.col("v"), F.col("map"), levels)
    return rounded(rows.select("read_id", F.size(x).alias("n"), arrays.total(x).alias("total"), arrays.total(x, F.abs).alias("size")))


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals fitted to 60 samples, shifted by 7 and stretched by 1.25 about sample 20, and maps likewise."""
    rows = with_spans(I.event_signals(spark, sf_dir))
    checksum = lambda x: F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    parts = {"fitted": signal.centred(F.col("v"), 60), "shifted": signal.shifted(F.col("v"), F.lit(7)), "stretched": signal.stretched(F.col("v"), F.lit(1.25), F.lit(20)), "cropped": signal.cropped_map(F.col("map"), F.lit(9), 50), "mapped": signal.stretched_map(F.col("map"), F.lit(1.25), F.lit(20), 60)}
    return rounded(rows.select("read_id", *[checksum(x).alias(k) for k, x in parts.items()]))


OPS = (0, 1, 2, 4, 7, 0, 3)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, reference_start and a CIGAR from an order's lines."""
    o = I.table(spark, sf_dir, "lineitem")
    op = F.get(F.array(*[F.lit(x) for x in OPS]), (F.col("l_linenumber") - 1) % len(OPS))
    rows = I.ordered(o, "l_orderkey", I.LINE_ORDER, F.struct(op.alias("op"), F.col("l_quantity").cast("int").alias("len")))
    return rows.select(F.col("l_orderkey").alias("read_id"), F.lit(100).alias("reference_start"), F.col("v").alias("cigar"))


STEPS = (
    f"steps AS (SELECT *, 100 + coalesce(sum(CASE WHEN op IN (0, 2, 3, 7, 8) THEN n ELSE 0 END) OVER w, 0) AS r, coalesce(sum(CASE WHEN op IN (0, 1, 4, 7, 8) THEN n ELSE 0 END) OVER w, 0) AS q, row_number() OVER (PARTITION BY read_id ORDER BY {', '.join(I.LINE_ORDER)}) AS k FROM"
    f" (SELECT l_orderkey AS read_id, [{', '.join(map(str, OPS))}][(l_linenumber - 1) % {len(OPS)} + 1] AS op, CAST(l_quantity AS INT) AS n, * FROM lineitem) WINDOW w AS (PARTITION BY read_id ORDER BY {', '.join(I.LINE_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
)


def query_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the reference's bases 105 to 125 are in every read that matches both edges, and how much longer they are there."""
    rows = alignments(spark, sf_dir).select("read_id", sequence.query_interval(F.col("cigar"), F.col("reference_start"), F.lit(105), F.lit(125)).alias("x")).where("x is not null")
    return rows.select("read_id", "x.q_start", "x.q_stop", (F.col("x.q_stop") - F.col("x.q_start") - 20).alias("junction_indel"))


def reference_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query place of a reference base between matching blocks, by interpolation, and its sample at 10 a base."""
    rows = alignments(spark, sf_dir).withColumn("k", sequence.knots(F.col("cigar"))).where("size(k.x) > 2")
    place = signal.interpolated(F.lit(17.0), F.col("k.x"), F.col("k.y"))
    return rounded(rows.select("read_id", place.alias("q"), F.floor(place * 10).alias("sample")))


def motif_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places, overlapping ones too, of two motifs in whole texts."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.lower(F.translate("text", "éèêàùç", "eeeauc")).alias("s"))
    return chunks.motif_counts(docs, "doc_id", "s", ["anan", "ere"])


def focus_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), I.bases(F.col("text")).alias("s"))
    return chunks.focus_bases(docs, "read_id", "s", "ATC", 1)


def kmer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters around every focus base, with N outside the read and with one side masked."""
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), I.bases(F.col("text")).alias("s"))
    rows = chunks.focus_bases(docs, "read_id", "s", "ATC", 1, keep=("s",))
    k = sequence.context(F.col("s"), F.col("base_idx"), 5, 5)
    return rows.select("read_id", "base_idx", k.alias("kmer"), sequence.one_side_masked(k, F.lit(5), "left").alias("left"), sequence.one_side_masked(k, F.lit(5), "right").alias("right"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks around every tenth base: the signal window, filled with 0, and the window of dwell features."""
    reads = with_moves(I.line_reads(spark, sf_dir)).withColumn("signal", F.transform(arrays.indices(F.col("samples")), lambda i: (i % 17).cast("double")))
    focus = reads.withColumn("base_idx", F.explode(F.filter(arrays.indices(F.size("map") - 1), lambda i: i % 3 == 0)))
    cut = chunks.cut(focus, F.col("signal"), F.col("map"), F.col("base_idx"), left=20, right=25, feature_start=-2, feature_end=3)
    x = F.aggregate(F.transform("chunk_signal", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    d = F.aggregate(F.transform("chunk_dwells", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(cut.select("read_id", "base_idx", "focus_sample", F.size("chunk_signal").alias("n"), x.alias("signal"), d.alias("dwells")))


def anchored_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One focus base a read, by a sample, with the label that the focus table gives."""
    reads = with_spans(I.event_signals(spark, sf_dir)).select(F.col("read_id").cast("long").alias("read_id"), F.slice("map", F.lit(1), F.size("map") - 1).alias("map"))
    focus = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("read_id"), (F.col("c_nationkey") % 2).cast("int").alias("label_int"), (F.col("c_custkey") % 90).cast("int").alias("anchor"))
    return chunks.anchored(reads, focus, "read_id", "map").select("read_id", "label_int", "anchor", "base_idx")


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the one-hot encoding: how many ones each has, and a digest of the row, by document."""
    docs = I.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", sequence.one_hot_rows(sequence.recoded(F.col("text"), I.LETTERS, I.AS_BASES)).alias("x"))
    return docs.select("doc_id", F.posexplode("x").alias("base", "row")).select("doc_id", "base", F.length(F.replace("row", F.lit("0"))).alias("ones"), F.md5("row").alias("digest"))


def signal_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal's k-mer encoding as spans of ones: row 4 * place + base from sample start to stop."""
    reads = with_moves(I.line_reads(spark, sf_dir)).withColumn("codes", F.transform("v", lambda x: (x % 5).cast("int") - 1))
    return chunks.signal_kmer_spans(reads, "read_id", F.col("codes"), F.col("map"), 1, 1)


def sample_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by the base that they lie in. A read's map is at hand, so no join is needed."""
    reads = with_moves(I.line_reads(spark, sf_dir))
    base = signal.base_of_sample(F.col("map"), F.col("sample"))
    samples = reads.select("read_id", "map", F.explode(arrays.indices(F.col("samples"))).alias("sample")).select("read_id", base.alias("base_idx"))
    return samples.where("base_idx >= 0").groupBy("read_id", "base_idx").agg(F.count("*").alias("n"))


QUERIES = {
    "p9_dwell_features": dwell_features, "p2_move_maps": move_maps, "p7_level_features": level_features, "p4_normalised": normalised,
    "p11_expected_levels": expected_levels, "p12_residual_features": residuals, "p13_signal_residual": sample_residuals, "p29_shaped_signals": shaped,
    "c2_query_intervals": query_intervals, "p14_reference_knots": reference_knots, "c1_motif_hits": motif_hits, "c6_focus_bases": focus_bases,
    "c12_kmer_contexts": kmer_contexts, "c11_chunks": chunk_table, "c13_anchored_bases": anchored_bases, "p20_one_hot": encodings,
    "p17_signal_kmers": signal_kmers, "j14_sample_bases": sample_bases,
}

HITS = "list_filter(range(greatest(len(s) - 2, 0)), lambda p: s[p + 1] = 'A' AND s[p + 2] = 'T' AND s[p + 3] = 'C')"
AROUND = "list_transform(range(-2, 3), lambda j: CAST(d[greatest(1, least(len(d), i + j + 1))] AS DOUBLE))"

ORACLE = {
    "p9_dwell_features": f"""
WITH t AS (SELECT user_id, list(epoch_us(ts) ORDER BY ts, event_id) AS v FROM events GROUP BY 1),
d AS (SELECT user_id, list_transform(range(1, len(v)), lambda i: (v[i + 1] - v[i]) / 1e6::DOUBLE) AS d FROM t),
b AS (SELECT user_id, d, i, list_avg({AROUND}) AS m, list_stddev_pop({AROUND}) AS s FROM d, LATERAL unnest(range(len(d))) u(i))
SELECT user_id, CAST(i AS INT) AS base_idx, round(d[i + 1], 6) AS dwell, round(ln(d[i + 1] + 1e-6), 6) AS dwell_log, round(m, 6) AS dwell_mean, round(s, 6) AS dwell_std, round(d[i + 1] / (m + 1e-6), 6) AS dwell_ratio FROM b""",
    "p2_move_maps": f"WITH {I.LINE_READS}, {MOVES} SELECT read_id, CAST(i AS INT) AS base_idx, CAST(map[i + 1] AS INT) AS start, CAST(map[i + 2] - map[i + 1] AS INT) AS dwell FROM mapped, LATERAL unnest(range(len(map) - 1)) u(i)",
    "p7_level_features": f"""
WITH {I.EVENT_SIGNALS}, {SPANS}, x AS (SELECT read_id, i, v[map[i + 1] + 1:map[i + 2]] AS x FROM spans, LATERAL unnest(range(len(map) - 1)) u(i))
SELECT read_id, CAST(i AS INT) AS base_idx, round(coalesce(list_avg(x), 0), 6) AS level_mean, round(coalesce(list_median(x), 0), 6) AS level_median, round(coalesce(list_stddev_pop(x), 0), 6) AS level_std, round(coalesce(list_max(x) - list_min(x), 0), 6) AS level_range FROM x""",
    "p4_normalised": """
WITH s AS (SELECT user_id AS read_id, value AS x FROM events),
q AS (SELECT *, quantile_cont(x, 0.2) OVER w AS lo, quantile_cont(x, 0.9) OVER w AS hi, median(x) OVER w AS med, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd FROM s WINDOW w AS (PARTITION BY read_id)),
c AS (SELECT *, abs(x - med) AS dev, greatest(lo, least(hi, x)) AS cx FROM q),
d AS (SELECT *, median(dev) OVER w AS mad, median(cx) OVER w AS cmed FROM c WINDOW w AS (PARTITION BY read_id)),
e AS (SELECT *, median(abs(cx - cmed)) OVER (PARTITION BY read_id) AS cmad FROM d),
y AS (SELECT read_id, 'median_mad' AS method, CASE WHEN mad > 0 THEN (x - med) / (1.4826::DOUBLE * mad) ELSE 0 END AS y FROM e
  UNION ALL SELECT read_id, 'zscore', CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0 END FROM e
  UNION ALL SELECT read_id, 'quantile', CASE WHEN cmad > 0 THEN (x - cmed) / (1.4826::DOUBLE * cmad) ELSE 0 END FROM e
  UNION ALL SELECT read_id, 'pa_scaling', ((x + 10.0::DOUBLE) * 0.2::DOUBLE - 90.0::DOUBLE) / 12.0::DOUBLE FROM e)
SELECT read_id, method, round(avg(y), 6) + 0 AS mean, round(min(y), 6) AS low, round(max(y), 6) AS high FROM y GROUP BY 1, 2""",
    "p11_expected_levels": f"""
WITH {LEVELS}, d AS (SELECT doc_id AS read_id, {I.bases_sql('text')} AS s FROM documents WHERE text IS NOT NULL AND text != ''),
k AS (SELECT read_id, unnest(range(greatest(len(s) - 2, 0))) AS i, unnest(list_transform(range(greatest(len(s) - 2, 0)), lambda i: concat(s[i + 1], s[i + 2], s[i + 3]))) AS kmer FROM d)
SELECT read_id, CAST(i + 1 AS INT) AS base_idx, coalesce(level, 0) AS level FROM k LEFT JOIN levels USING (kmer)""",
    "p12_residual_features": f"""
WITH {I.EVENT_SIGNALS}, {SPANS}, x AS (SELECT read_id, i, coalesce(list_avg(v[map[i + 1] + 1:map[i + 2]]), 0) AS m, CASE WHEN i % 3 = 0 OR i >= len(map) - 2 THEN 0 ELSE CAST(i AS DOUBLE) END AS e FROM spans, LATERAL unnest(range(len(map) - 1)) u(i))
SELECT read_id, CAST(i AS INT) AS base_idx, round(e, 6) AS kmer_expected, round(m - e, 6) AS kmer_residual, round(abs(m - e), 6) AS kmer_abs_residual FROM x""",
    "p13_signal_residual": f"""
WITH {I.EVENT_SIGNALS}, y AS (SELECT read_id, CASE WHEN (i // 3) % 3 = 0 THEN 0 ELSE v[i + 1] - (i // 3) END AS y FROM signals, LATERAL unnest(range(len(v))) u(i))
SELECT read_id, CAST(count(*) AS INT) AS n, round(sum(y), 6) AS total, round(sum(abs(y)), 6) AS size FROM y GROUP BY 1""",
    "p29_shaped_signals": f"""
WITH {I.EVENT_SIGNALS}, {SPANS},
a AS (SELECT read_id, sum((i + 1) * CASE WHEN i + greatest(0, floor((len(v) - 60) / 2)) < len(v) THEN v[CAST(i + greatest(0, floor((len(v) - 60) / 2)) AS INT) + 1] ELSE 0 END) AS fitted FROM spans, range(60) t(i) GROUP BY 1),
b AS (SELECT read_id, sum((i + 1) * CASE WHEN i >= 7 THEN v[i - 6] ELSE 0 END) AS shifted, sum((i + 1) * (v[CAST(floor(x) AS INT) + 1] * (1 - (x - floor(x))) + v[CAST(least(len(v) - 1, floor(x) + 1) AS INT) + 1] * (x - floor(x)))) AS stretched
  FROM (SELECT read_id, v, i, greatest(0.0::DOUBLE, least(len(v) - 1.0::DOUBLE, 20 + (i - 20) / 1.25::DOUBLE)) AS x FROM spans, LATERAL unnest(range(len(v))) u(i)) GROUP BY 1),
c AS (SELECT read_id, sum((i + 1) * least(50, greatest(0, map[i + 1] - 9))) AS cropped, sum((i + 1) * CASE WHEN map[i + 1] = 60 THEN 60 ELSE least(60, greatest(0, round_even(20 + (map[i + 1] - 20) * 1.25::DOUBLE, 0))) END) AS mapped FROM spans, LATERAL unnest(range(len(map))) u(i) GROUP BY 1)
SELECT read_id, round(fitted, 6) AS fitted, round(shifted, 6) AS shifted, round(stretched, 6) AS stretched, round(CAST(cropped AS DOUBLE), 6) AS cropped, round(CAST(mapped AS DOUBLE), 6) AS mapped FROM a JOIN b USING (read_id) JOIN c USING (read_id)""",
    "c2_query_intervals": f"""
WITH {STEPS}, x AS (SELECT read_id, min(CASE WHEN op IN (0, 7, 8) AND r <= 105 AND 105 < r + n THEN q + 105 - r END) AS a, min(CASE WHEN op IN (0, 7, 8) AND r <= 124 AND 124 < r + n THEN q + 125 - r END) AS b FROM steps GROUP BY 1)
SELECT read_id, CAST(a AS BIGINT) AS q_start, CAST(b AS BIGINT) AS q_stop, CAST(b - a - 20 AS BIGINT) AS junction_indel FROM x WHERE a IS NOT NULL AND b IS NOT NULL""",
    "p14_reference_knots": f"""
WITH {STEPS}, p AS (SELECT read_id, 2 * k AS o, r - 100 AS x, q AS y FROM steps WHERE op IN (0, 7, 8) AND n > 0 UNION ALL SELECT read_id, 2 * k + 1, r - 100 + n - 1, q + n - 1 FROM steps WHERE op IN (0, 7, 8) AND n > 0),
l AS (SELECT read_id, list(x ORDER BY o) AS x, list(y ORDER BY o) AS y FROM p GROUP BY 1 HAVING count(*) > 2),
k AS (SELECT *, greatest(0, least(len(x) - 2, len(list_filter(x, lambda v: v <= 17)) - 1)) + 1 AS k FROM l),
r AS (SELECT read_id, CASE WHEN 17 <= x[1] THEN CAST(y[1] AS DOUBLE) WHEN 17 >= x[len(x)] THEN CAST(y[len(y)] AS DOUBLE) ELSE y[k] + (y[k + 1] - y[k]) * (17.0::DOUBLE - x[k]) / greatest(CAST(x[k + 1] - x[k] AS DOUBLE), 1e-12) END AS q FROM k)
SELECT read_id, round(q, 6) AS q, CAST(floor(q * 10) AS BIGINT) AS sample FROM r""",
    "c1_motif_hits": """
WITH d AS (SELECT doc_id, lower(translate(text, 'éèêàùç', 'eeeauc')) AS s FROM documents), m AS (SELECT unnest(['anan', 'ere']) AS motif),
h AS (SELECT doc_id, motif, list_filter(range(greatest(len(s) - len(motif) + 1, 0)), lambda p: substring(s, p + 1, len(motif)) = motif) AS p FROM d, m)
SELECT doc_id, motif, len(p) AS n, p[1] AS first, p[len(p)] AS last FROM h WHERE len(p) > 0""",
    "c6_focus_bases": f"""
WITH d AS (SELECT doc_id AS read_id, {I.bases_sql('text')} AS s FROM documents)
SELECT read_id, CAST(p + 1 AS INT) AS base_idx FROM (SELECT read_id, unnest({HITS}) AS p FROM d)""",
    "c12_kmer_contexts": f"""
WITH d AS (SELECT doc_id AS read_id, {I.bases_sql('text')} AS s FROM documents),
h AS (SELECT read_id, unnest({HITS}) AS p, unnest(list_transform({HITS}, lambda p: list_transform(range(-4, 7), lambda j: CASE WHEN p + j >= 0 AND p + j < len(s) THEN s[p + j + 1] ELSE 'N' END))) AS l FROM d),
f AS (SELECT read_id, p + 1 AS b, array_to_string(l, '') AS k FROM h)
SELECT read_id, CAST(b AS INT) AS base_idx, k AS kmer, concat('NNNNN', k[6:11]) AS "left", concat(k[1:6], 'NNNNN') AS "right" FROM f""",
    "c11_chunks": f"""
WITH {I.LINE_READS}, {MOVES}, f AS (SELECT read_id, map, i AS b, (map[i + 1] + map[i + 2]) // 2 AS s, map[len(map)] AS n FROM mapped, LATERAL unnest(range(0, len(map) - 1, 3)) u(i))
SELECT read_id, CAST(b AS INT) AS base_idx, CAST(s AS INT) AS focus_sample, 45 AS n,
  round(CAST(list_sum(list_transform(range(45), lambda j: (j + 1) * CASE WHEN s - 20 + j >= 0 AND s - 20 + j < n THEN (s - 20 + j) % 17 ELSE 0 END)) AS DOUBLE), 6) AS signal,
  round(CAST(list_sum(list_transform(range(6), lambda j: (j + 1) * CASE WHEN b - 2 + j >= 0 AND b - 2 + j < len(map) - 1 THEN map[b + j] - map[b - 1 + j] ELSE 0 END)) AS DOUBLE), 6) AS dwells FROM f""",
    "c13_anchored_bases": f"""
WITH {I.EVENT_SIGNALS}, m AS (SELECT read_id, list_concat(range(0, len(v), 3), [len(v)]) AS map FROM signals),
f AS (SELECT c_custkey AS read_id, c_nationkey % 2 AS label_int, c_custkey % 90 AS anchor FROM customer),
b AS (SELECT read_id, label_int, anchor, least(len(map) - 7, greatest(5, len(list_filter(map, lambda x: x <= anchor)) - 1)) AS base_idx FROM m JOIN f USING (read_id))
SELECT read_id, CAST(label_int AS INT) AS label_int, CAST(anchor AS INT) AS anchor, CAST(base_idx AS INT) AS base_idx FROM b WHERE base_idx >= 0""",
    "p20_one_hot": f"""
WITH d AS (SELECT doc_id, {I.bases_sql('text')} AS s FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, b, list_transform(s, lambda x: CASE WHEN x = substring('ACGT', b + 1, 1) THEN '1' ELSE '0' END) AS r FROM d, range(4) t(b))
SELECT doc_id, CAST(b AS INT) AS base, CAST(len(list_filter(r, lambda x: x = '1')) AS INT) AS ones, md5(array_to_string(r, '')) AS digest FROM r""",
    "p17_signal_kmers": f"""
WITH {I.LINE_READS}, {MOVES}, s AS (SELECT read_id, p, i, CAST(v[i + p] AS BIGINT) % 5 - 1 AS c, map[i + 1] AS a, map[i + 2] AS z FROM mapped, LATERAL unnest(range(len(map) - 1)) u(i), range(3) t(p) WHERE i + p >= 1 AND i + p <= len(v))
SELECT read_id, CAST(4 * p + c AS INT) AS "row", CAST(a AS INT) AS start, CAST(z AS INT) AS stop FROM s WHERE c >= 0 AND z > a""",
    "j14_sample_bases": f"""
WITH {I.LINE_READS}, {MOVES}, b AS (SELECT read_id, i, map[i + 1] AS a, map[i + 2] AS z FROM mapped, LATERAL unnest(range(len(map) - 1)) u(i)),
x AS (SELECT read_id, i, z - a AS n FROM b)
SELECT read_id, CAST(i AS INT) AS base_idx, CAST(n AS BIGINT) AS n FROM x WHERE n > 0""",
}
