"""Queries of extraction and prediction: reads to chunks with what became of each read, coordinates on the reference, calls by
a bundle of pair models, by one model of several classes, and by a binary one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, sequence, signal
from ..operators import augment, crf_loss, extract, predicting, preparing
from ..sources import bam, npz, shared
from . import inputs as I
from .evaluation import rounded
from .reads import STEPS, alignments

PLAN = extract.Plan(left=12, right=15, kmer=3, feature_start=-2, feature_end=3, reverse=True)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read a customer: a user's events as its raw samples, three a base, letters from every third, a level a base, and as
    focus bases the hits of AC plus one. One read in thirteen has a trim beyond its samples; most have no signal."""
    c = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("read_id"))
    signals = I.event_signals(spark, sf_dir).select(F.col("read_id").cast("long").alias("read_id"), "v")
    rows = preparing.with_signals(c, signals).drop("missing")
    trim = F.when(F.col("read_id") % 13 == 5, 10_000).otherwise((F.col("read_id") % 3).cast("int"))
    n = F.coalesce(F.size("v"), F.lit(0))
    rows = rows.withColumn("trim", trim).withColumn("n", n)
    moves = F.transform(arrays.indices(F.col("n") - F.col("trim")), lambda i: F.when(i % 3 == 0, 1).otherwise(0))
    table = F.struct(F.lit(1).alias("stride"), moves.alias("moves"), F.col("n").alias("samples"), F.col("trim").alias("trim"))
    letter = lambda x: F.substring(F.lit("ACGT"), (F.floor(x) % 4).cast("int") + 1, F.lit(1))
    bases = F.ceil((F.col("n") - F.col("trim")) / 3).cast("int")
    text = F.when(bases > 0, F.array_join(F.transform(arrays.indices(bases), lambda i: letter(arrays.at(F.col("v"), F.col("trim") + 3 * i))), "")).otherwise("N")
    level = F.transform(arrays.indices(bases), lambda i: F.when(i % 4 == 0, 0.0).otherwise((i % 5 - 2) * 0.4))
    rows = rows.withColumn("table", table).withColumn("sequence", text).withColumn("levels", level)
    indel, mapped = F.col("read_id") % 3 - 1, F.col("read_id") % 4 > 0
    focus = F.transform(sequence.motif_hits(F.col("sequence"), "AC"), lambda p: extract.focus_of(p + 1, F.col("read_id") % 2, indel, mapped))
    return rows.withColumn("focus", focus).select("read_id", "v", "table", "sequence", "levels", "focus")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(reads(spark, sf_dir), PLAN, focus="column", levels=True)


def digits(values: Column) -> Column:
    """An array of numbers as text, in ten thousandths."""
    return F.array_join(F.transform(values, lambda x: F.round(x * 10_000).cast("long").cast("string")), ",")


def prepared_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every chunk."""
    c = extract.chunk_rows(extracted(spark, sf_dir))
    return c.select(
        "read_id", "base_index", "label_int", "junction_indel", "junction_mapped", "focus_signal_pos", F.col("sequence").alias("kmer"), F.col("sequence_with_kmer_context").alias("context"),
        F.array_join(F.col("seq_to_sig").cast("array<string>"), ",").alias("seq_to_sig"), digits(F.col("signal")).alias("samples"), digits(F.col("signal_residual")).alias("residual"), digits(F.col("dwells")).alias("dwells"),
        F.array_join(F.transform("features", digits), ";").alias("features"),
    )


def prepare_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.yields(extracted(spark, sf_dir))


def reference_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sample of every reference base of every alignment, ten samples a read base and some uneven ones."""
    rows = alignments(spark, sf_dir)
    bases = F.aggregate("cigar", F.lit(0), lambda n, c: n + F.when(c["op"].isin(*sequence.ON_QUERY), c["len"]).otherwise(0))
    uneven = F.transform(arrays.indices(bases + 1), lambda i: i % 7)
    out = rows.select("read_id", F.posexplode(signal.reference_map(uneven, F.col("cigar"), stride=10)).alias("base", "sample"))
    return out.groupBy("read_id").agg(F.count("*").alias("n"), F.sum(F.col("base").cast("long") * F.col("sample")).alias("weighted"), F.max("sample").alias("end"))


CLASSES = ("Ala", "Arg", "Asn", "Asp", "Cys")
SAMPLES, KMER = 27, 5


def linear(where: str) -> predicting.Model:
    """A linear model of its number: weights for the samples, for the dwell channel and for the middle base."""
    m = int(where)
    signal_weights = ((7 * m + 3 * np.arange(SAMPLES)) % 11 - 5) / 10
    dwell_weights = ((5 * m + 2 * np.arange(KMER)) % 7 - 3) / 20
    base_weights = (np.arange(4) + m) % 4 / 10
    return lambda x: x["signal"][:, 0] @ signal_weights + x["features"][:, 0] @ dwell_weights + x["sequence"][:, :, KMER // 2] @ base_weights


def linear_classes(where: str) -> predicting.Model:
    """Five linear models as one of five classes."""
    parts = [linear(str(int(where) + k)) for k in range(len(CLASSES))]
    return lambda x: np.stack([p(x) for p in parts], 1)


INPUTS = predicting.Inputs(SAMPLES, KMER, features=True, feature_start=-2)


def bundle(spark: SparkSession) -> DataFrame:
    """The ten pair models, every other one with a scaling of its own."""
    p = I.pairs(spark)
    return p.withColumn("location", F.col("place").cast("string")).withColumn("platt_a", F.when(F.col("place") % 2 == 0, 1 + F.col("place") / 10)).withColumn("platt_b", F.when(F.col("place") % 2 == 0, -F.col("place") / 20))


def model_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the k-mer and features of five bases that the models take."""
    rows = extract.extract(reads(spark, sf_dir).drop("levels"), PLAN.of(kmer=KMER // 2), focus="column")
    return extract.chunk_rows(rows)


def bundle_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pair models on every chunk, the last chunk's votes, thresholds and tags, by each way of voting."""
    models = bundle(spark)
    scores = predicting.scored(model_chunks(spark, sf_dir), models, INPUTS, linear)
    probs = predicting.pair_probabilities(scores, models).withColumn("probs", F.transform("probs", lambda p: F.round(p, 6)))
    out = None
    for method in ("naive", "weighted"):
        one = predicting.tagged(predicting.called_by_bundle(probs, I.pairs(spark), method), 80, 2).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("read_id", "method", "call", "aa", "ac", "am", F.array_join(F.col("pp").cast("array<string>"), ",").alias("pp"), "confidence"))


def class_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model of five classes, at a temperature, on every chunk; the first chunk's call, with and without the rule that the
    margin binds only at disrupted junctions."""
    models = spark.createDataFrame([(0, "20")], "place int, location string")
    keep = ("junction_indel", "junction_mapped")
    scores = predicting.scored(model_chunks(spark, sf_dir), models, INPUTS, linear_classes, keep=("read_id", "base_index", *keep))
    calls = predicting.called_by_classes(scores, list(CLASSES), 1.7, keep)
    calls = calls.withColumn("probs", F.transform("probs", lambda p: F.round(p, 6))).withColumn("confidence", F.round("confidence", 6))
    out = None
    for abstain in (False, True):
        one = predicting.tagged(calls, 90, 60, abstain).withColumn("abstain", F.lit(abstain))
        out = one if out is None else out.unionByName(one)
    return out.select("read_id", "abstain", "base_index", "call", "aa", "ac", "am", "junction_indel", "junction_mapped", F.array_join(F.col("pp").cast("array<string>"), ",").alias("pp"))


def binary_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary model's probabilities on every chunk of a read, as places and bytes; every alignment stays."""
    models = bundle(spark).where("place = 3")
    probs = predicting.pair_probabilities(predicting.scored(model_chunks(spark, sf_dir), models, INPUTS, linear), models)
    rounded_probs = probs.withColumn("probs", F.transform("probs", lambda p: F.round(p, 6)))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    rows = predicting.marked(rounded_probs).select("read_id", text("mp"), text("ml"))
    every = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("read_id"))
    return predicting.on_alignments(every, rows)


def bam_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's alignment as a BAM record: some are secondary or unmapped, some lack the tag ns."""
    rows = alignments(spark, sf_dir).withColumn("k", F.col("read_id"))
    n = F.aggregate("cigar", F.lit(0), lambda n, c: n + F.when(c["op"].isin(*sequence.ON_QUERY), c["len"]).otherwise(0))
    tags = F.when(F.col("k") % 4 == 0, F.create_map(F.lit("mv"), F.lit("5,1,0,1"))).otherwise(F.create_map(F.lit("mv"), F.lit("5,1,0,1"), F.lit("ns"), F.col("k").cast("string")))
    kinds = F.create_map(F.lit("mv"), F.lit("Bc"), F.lit("ns"), F.lit("i"))
    text = F.substring(F.repeat(F.lit("ACGTN"), F.ceil(n / 5).cast("int")), F.lit(1), n)
    return rows.select(
        F.concat(F.lit("read-"), "k").alias("read_id"), F.when(F.col("k") % 7 == 0, 256).when(F.col("k") % 11 == 0, 4).otherwise(16).alias("flag"), F.lit("chr1").alias("reference_name"), "reference_start",
        (F.col("k") % 61).cast("int").alias("mapping_quality"), "cigar", text.alias("sequence"), tags.alias("tags"), kinds.alias("tag_types"),
    )


def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as BAM files, read back in parts of 64 KiB: the mapped primary alignments of some quality with both tags."""
    folder = shared.scratch(spark, "bam")
    bam.write(bam_rows(spark, sf_dir), folder, [("chr1", 1_000_000)])
    rows = bam.read(spark, folder, min_mapq=20, split_bytes=1 << 16)
    cigar = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), F.lit("."), c["op"].cast("string"))), " ")
    return rows.select("read_id", "flag", "reference_name", "reference_start", "mapping_quality", cigar.alias("cigar"), F.length("sequence").alias("n"), F.col("tags")["mv"].alias("mv"), F.col("tags")["ns"].alias("ns"), "reverse")


AUGMENT = augment.Augment(seed=11, shift_bases=2.5, samples_per_base=3.0, feature_stds=(0.5, 0.25), feature_noise=2.0, jitter=0.05, scale=(0.8, 1.25))


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty coordinates of a vector as a signal and ten as two channels of five bases: shifted, with feature noise, jitter
    and a scale, all drawn by seed, vector and place."""
    e = I.table(spark, sf_dir, "embeddings")
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    rows = e.select(F.col("vec_id").alias("read_id"), part(1, 40).alias("signal"), F.array(part(41, 5), part(46, 5)).alias("features"))
    out = augment.augmented(rows, AUGMENT, F.col("read_id"), epoch=3)
    return out.select("read_id", digits(F.col("signal")).alias("samples"), F.array_join(F.transform("features", digits), ";").alias("features"))


def crf_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty coordinates of a vector as ten steps of a model of two bases, and a target of four bases by the vector's number."""
    scores = F.transform(F.slice("embedding", 1, 60), lambda x: x.cast("double") * 4)
    letter = lambda k: F.substring(F.lit("AC"), (F.floor(F.col("vec_id") / k) % 2 + 1).cast("int"), F.lit(1))
    rows = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("read_id"), scores.alias("scores"), F.concat(letter(1), letter(2), letter(4), letter(8)).alias("target"))
    out = crf_loss.losses(rows, "read_id", "scores", "target", n_base=2, state_len=1, alphabet="AC", gradients=True)
    # the gradient sums to nothing; its size is one figure of it
    return rounded(out.select("read_id", "log_z", "log_target", "loss", F.abs(F.aggregate("gradient", F.lit(0.0), lambda a, x: a + x)).alias("left_over")))


def npz_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and the ragged lists of their first coordinates above 0.1, written as archives of 200 rows and read back in
    ranges and blocks."""
    folder = shared.scratch(spark, "npz")
    e = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("read_id"), F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.when(F.col("vec_id") % 5 > 0, F.col("label")).alias("labels_int"), "embedding", F.filter("embedding", lambda x: x > 0.1).alias("large"))
    npz.write(e, folder, ragged=("large",), file_rows=200).collect()  # a row a task
    rows = npz.with_nulls(npz.read(spark, folder, split_bytes=1 << 14, block_bytes=1 << 12))
    return rounded(rows.select("read_id", "name", "labels_int", F.size("large").alias("n"), arrays.total(F.col("large")).alias("large"), arrays.total(F.col("embedding")).alias("total")), 5)


QUERIES = {
    "s15_npz_rows": npz_rows,
    "f6_crf_losses": crf_losses,
    "g1_augmented": augmented,
    "s1_bam_round_trip": bam_round_trip,
    "c16_prepared_chunks": prepared_chunks, "c15_prepare_yields": prepare_yields, "p15_reference_maps": reference_maps,
    "m1_bundle_calls": bundle_calls, "m2_class_calls": class_calls, "m3_binary_marks": binary_marks,
}

READS = (
    f"{I.EVENT_SIGNALS}, every_read AS (SELECT c_custkey AS read_id, v, CASE WHEN c_custkey % 13 = 5 THEN 10000 ELSE c_custkey % 3 END AS trim FROM customer LEFT JOIN signals ON signals.read_id = c_custkey),"
    " kept AS (SELECT read_id, v[trim + 1:] AS k FROM every_read WHERE len(v) > trim),"
    " centred AS (SELECT read_id, k, list_median(k) AS med FROM kept), spread AS (SELECT *, 1.4826::DOUBLE * list_median(list_transform(k, lambda x: abs(x - med))) AS mad FROM centred),"
    " ready AS (SELECT read_id, len(k) AS n, list_reverse(list_transform(k, lambda x: CASE WHEN mad > 0 THEN (x - med) / mad ELSE 0 END)) AS sig,"
    " list_reverse(list_transform(list_concat(range(0, len(k), 3), [len(k)]), lambda x: len(k) - x)) AS map, list_transform(range(0, len(k), 3), lambda i: substring('ACGT', CAST(floor(k[i + 1]) AS BIGINT) % 4 + 1, 1)) AS letters FROM spread),"
    " spans AS (SELECT read_id, i, map[i + 2] - map[i + 1] AS d, sig[map[i + 1] + 1:map[i + 2]] AS x, list_transform(range(-2, 3), lambda j: CAST(map[greatest(1, least(len(map) - 1, i + j + 1)) + 1] - map[greatest(1, least(len(map) - 1, i + j + 1))] AS DOUBLE)) AS w,"
    " CASE WHEN i % 4 = 0 THEN 0 ELSE (i % 5 - 2) * 0.4::DOUBLE END AS e FROM ready, LATERAL unnest(range(len(map) - 1)) u(i)),"
    " figures AS (SELECT read_id, i, e, [d::DOUBLE, ln(d + 1e-6), list_avg(w), list_stddev_pop(w), d / (list_avg(w) + 1e-6), list_avg(x), list_median(x), list_stddev_pop(x), list_max(x) - list_min(x), e, list_avg(x) - e, abs(list_avg(x) - e)] AS f FROM spans),"
    " bases AS (SELECT read_id, list(f ORDER BY i) AS f, list(e ORDER BY i) AS e FROM figures GROUP BY 1),"
    " hits AS (SELECT r.*, b.f, b.e, p + 1 AS b, (map[p + 2] + map[p + 3]) // 2 - 12 AS s FROM ready r JOIN bases b USING (read_id), LATERAL unnest(list_filter(range(len(letters) - 1), lambda p: letters[p + 1] = 'A' AND letters[p + 2] = 'C')) u(p)),"
    " cut AS (SELECT *, len(list_filter(map, lambda x: x <= greatest(0, s))) - 1 AS first, least(len(letters), len(list_filter(map, lambda x: x < least(n, s + 27)))) AS past,"
    " list_transform(range(27), lambda j: CASE WHEN s + j >= 0 AND s + j < n THEN sig[s + j + 1] ELSE 0 END) AS samples FROM hits)"
)
TEN_THOUSANDTHS = "array_to_string(list_transform({}, lambda y: CAST(round(y * 10000) AS BIGINT)::VARCHAR), ',')"
WINDOW = "list_transform(range(-2, 4), lambda j: CASE WHEN b + j >= 0 AND b + j < len(f) THEN f[b + j + 1][{}] ELSE 0 END)"
LETTERS = "array_to_string(list_transform(range({}, {}), lambda j: CASE WHEN j >= 0 AND j < len(letters) THEN letters[j + 1] ELSE 'N' END), '')"
RESIDUAL = (
    "list_transform(range(27), lambda j: CASE WHEN s + j < 0 OR s + j >= n THEN 0 WHEN e[len(list_filter(map, lambda x: x <= s + j))] = 0 THEN 0"
    " ELSE sig[s + j + 1] - e[len(list_filter(map, lambda x: x <= s + j))] END)"
)


def linear_sql(m: str) -> str:
    """linear(m) of a row of cut."""
    return (
        f"(list_sum(list_transform(range(27), lambda j: samples[j + 1] * ((7 * {m} + 3 * j) % 11 - 5) / 10.0::DOUBLE))"
        f" + list_sum(list_transform(range(5), lambda j: (CASE WHEN b - 2 + j >= 0 AND b - 2 + j < len(f) THEN f[b - 1 + j][1] ELSE 0 END) * ((5 * {m} + 2 * j) % 7 - 3) / 20.0::DOUBLE))"
        f" + (strpos('ACGT', letters[b + 1]) - 1 + {m}) % 4 / 10.0::DOUBLE)"
    )


BUNDLE = (
    f"{I.PAIRS_SQL}, {READS}, last AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY b DESC) = 1),"
    f" logit AS (SELECT read_id, pair, neg, pos, place, {linear_sql('place')} AS x FROM last, pairs),"
    " votes AS (SELECT read_id, pair, neg, pos, place, round(1 / (1 + exp(-CASE WHEN place % 2 = 0 THEN (1 + place / 10.0::DOUBLE) * x - place / 20.0::DOUBLE ELSE x END)), 6) AS prob FROM logit),"
    " sides AS (SELECT read_id, neg AS class, 1 - prob AS vote, abs(2 * prob - 1) AS weight, 2 * place AS place FROM votes UNION ALL SELECT read_id, pos, prob, abs(2 * prob - 1), 2 * place + 1 FROM votes),"
    " tally AS (SELECT read_id, method, class, round(sum(CASE WHEN method = 'naive' THEN vote ELSE vote * weight END), 9) AS votes, min(place) AS place FROM sides, (SELECT unnest(['naive', 'weighted']) AS method) GROUP BY ALL),"
    " called AS (SELECT read_id, method, class AS call, round(CASE WHEN sum(votes) OVER w > 0 THEN votes / sum(votes) OVER w ELSE 0 END, 9) AS confidence, row_number() OVER (PARTITION BY read_id, method ORDER BY votes DESC, place) AS k FROM tally WINDOW w AS (PARTITION BY read_id, method)),"
    " listed AS (SELECT read_id, list(prob ORDER BY place) AS probs, list(prob ORDER BY prob DESC) AS o FROM votes GROUP BY 1)"
)
BYTE = "CAST(greatest(0, least(255, round_even({} * 255, 0))) AS INT)"

FRACTION = "((('0x' || substring({}, {}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def normal_sql(stream: str, i: str) -> str:
    """The normal number of a place i of a stream."""
    h = f"md5('11:' || {stream} || ':' || ({i}) // 2)"
    u, v = FRACTION.format(h, 1), FRACTION.format(h, 14)
    return f"(sqrt(-2 * ln({u})) * CASE WHEN ({i}) % 2 = 0 THEN cos(2 * pi() * {v}) ELSE sin(2 * pi() * {v}) END)"


def uniform_sql(stream: str, low: float, high: float) -> str:
    place = FRACTION.format(f"md5('11:' || read_id || '/3:{stream}:0')", 1)
    return f"({low}::DOUBLE + {high - low}::DOUBLE * {place})"


def added(*terms: str) -> str:
    """The log of a sum of exponentials; terms may be minus infinity, but not all."""
    top = f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'exp(({t}) - {top})' for t in terms)}))"


NEVER = "-1e30::DOUBLE"
ORACLE = {
    "s15_npz_rows": """
SELECT vec_id AS read_id, 'v' || vec_id AS name, CASE WHEN vec_id % 5 > 0 THEN label END AS labels_int, CAST(len(list_filter(embedding, lambda x: x > 0.1::DOUBLE)) AS INT) AS n,
  round(coalesce(list_sum(list_transform(list_filter(embedding, lambda x: x > 0.1::DOUBLE), lambda x: CAST(x AS DOUBLE))), 0), 5) AS large, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings""",
    "f6_crf_losses": f"""
WITH RECURSIVE e AS (SELECT vec_id AS read_id, list_transform(embedding[1:60], lambda x: CAST(x AS DOUBLE) * 4) AS x, [vec_id % 2, vec_id // 2 % 2, vec_id // 4 % 2, vec_id // 8 % 2] AS c FROM embeddings),
r AS (SELECT read_id, x, c, 0 AS t, 0::DOUBLE AS a, 0::DOUBLE AS b, [0::DOUBLE, {NEVER}, {NEVER}, {NEVER}] AS w FROM e
  UNION ALL SELECT read_id, x, c, t + 1, {added('a + x[6 * t + 1]', 'a + x[6 * t + 2]', 'b + x[6 * t + 3]')}, {added('b + x[6 * t + 4]', 'a + x[6 * t + 5]', 'b + x[6 * t + 6]')},
    [w[1] + x[6 * t + 3 * c[1] + 1], {', '.join(added(f'w[{i}] + x[6 * t + 3 * c[{i}] + 1]', f'w[{i - 1}] + x[6 * t + 3 * c[{i}] + 2 + c[{i - 1}]]') for i in (2, 3, 4))}] FROM r WHERE t < 10)
SELECT read_id, round({added('a', 'b')}, 6) AS log_z, round(w[4], 6) AS log_target, round(({added('a', 'b')} - w[4]) / 4, 6) AS loss, 0::DOUBLE AS left_over FROM r WHERE t = 10""",
    "g1_augmented": f"""
WITH e AS (SELECT vec_id AS read_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
d AS (SELECT *, CAST(round_even({uniform_sql('shift', -2.5, 2.5)} * 3, 0) AS INT) AS a, CAST(round_even({uniform_sql('shift', -2.5, 2.5)}, 0) AS INT) AS b, {uniform_sql('scale', 0.8, 1.25)} AS f FROM e),
s AS (SELECT read_id, list((CASE WHEN i - a >= 0 AND i - a < 40 THEN x[i - a + 1] ELSE 0 END + 0.05::DOUBLE * {normal_sql("read_id || '/3:signal'", 'i')}) * f ORDER BY i) AS s FROM d, range(40) t(i) GROUP BY 1),
c AS (SELECT read_id, c, list(CASE WHEN i - b >= 0 AND i - b < 5 THEN x[41 + 5 * c + i - b] ELSE 0 END + {normal_sql("read_id || '/3/' || c || ':feature'", 'i')} * (CASE WHEN c = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) * 2 ORDER BY i) AS v FROM d, range(5) t(i), range(2) w(c) GROUP BY 1, 2),
g AS (SELECT read_id, string_agg({TEN_THOUSANDTHS.format('v')}, ';' ORDER BY c) AS features FROM c GROUP BY 1)
SELECT read_id, {TEN_THOUSANDTHS.format('s')} AS samples, features FROM s JOIN g USING (read_id)""",
    "s1_bam_round_trip": f"""
WITH {STEPS}, a AS (SELECT read_id AS k, string_agg(n || '.' || op, ' ' ORDER BY k) AS cigar, CAST(sum(CASE WHEN op IN (0, 1, 4, 7, 8) THEN n ELSE 0 END) AS INT) AS n FROM steps GROUP BY 1)
SELECT 'read-' || k AS read_id, 16 AS flag, 'chr1' AS reference_name, 100 AS reference_start, CAST(k % 61 AS INT) AS mapping_quality, cigar, n, '5,1,0,1' AS mv, k::VARCHAR AS ns, true AS reverse
FROM a WHERE k % 7 > 0 AND k % 11 > 0 AND k % 4 > 0 AND k % 61 >= 20 AND n > 0""",
    "c16_prepared_chunks": f"""
WITH {READS} SELECT read_id, CAST(b AS INT) AS base_index, CAST(read_id % 2 AS INT) AS label_int, CAST(read_id % 3 - 1 AS INT) AS junction_indel, read_id % 4 > 0 AS junction_mapped, 12 AS focus_signal_pos,
  {LETTERS.format('b - 3', 'b + 4')} AS kmer, {LETTERS.format('first - 4', 'past + 4')} AS context,
  array_to_string(list_transform(range(first, past + 1), lambda j: CASE WHEN j = past THEN 27 WHEN j = first THEN 0 ELSE map[j + 1] - s END), ',') AS seq_to_sig,
  {TEN_THOUSANDTHS.format('samples')} AS samples, {TEN_THOUSANDTHS.format(RESIDUAL)} AS residual, {TEN_THOUSANDTHS.format(WINDOW.format(1))} AS dwells,
  array_to_string(list_transform(range(1, 13), lambda c: {TEN_THOUSANDTHS.format(WINDOW.format('c'))}), ';') AS features FROM cut""",
    "c15_prepare_yields": f"""
WITH {READS}, c AS (SELECT read_id, count(*) AS n FROM cut GROUP BY 1),
o AS (SELECT CASE WHEN v IS NULL THEN 'missing' WHEN len(v) <= trim THEN 'failed' WHEN n > 0 THEN 'chunks' ELSE 'no chunks' END AS outcome, CASE WHEN len(v) <= trim THEN 'no samples' END AS error, coalesce(n, 0) AS n FROM every_read LEFT JOIN c USING (read_id))
SELECT outcome, error, count(*) AS reads, CAST(sum(n) AS BIGINT) AS chunks FROM o GROUP BY ALL""",
    "p15_reference_maps": f"""
WITH {STEPS}, t AS (SELECT read_id, max(k) AS last FROM steps WHERE op IN (0, 7, 8) GROUP BY 1), m AS (SELECT steps.* FROM steps JOIN t USING (read_id) WHERE k <= last),
knots AS (SELECT read_id, 0 AS o, 0 AS x, 0 AS y FROM t UNION ALL SELECT read_id, 2 * k, r - 100, q FROM m WHERE op IN (0, 7, 8) UNION ALL SELECT read_id, 2 * k + 1, r - 100 + n - 1, q + n - 1 FROM m WHERE op IN (0, 7, 8)
  UNION ALL SELECT read_id, 1000000, r - 100 + n, q + n FROM m JOIN t USING (read_id) WHERE k = last),
pieces AS (SELECT read_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM knots WINDOW w AS (PARTITION BY read_id ORDER BY o)),
places AS (SELECT read_id, p AS base, (y2 - y) / CAST(x2 - x AS DOUBLE) * (p - x) + y AS q FROM pieces, LATERAL unnest(range(CAST(x AS BIGINT), CAST(x2 AS BIGINT))) u(p) WHERE x2 > x UNION ALL SELECT read_id, x, CAST(y AS DOUBLE) FROM pieces WHERE x2 IS NULL),
total AS (SELECT read_id, sum(CASE WHEN op IN (0, 1, 4, 7, 8) THEN n ELSE 0 END) AS n FROM steps GROUP BY 1),
low AS (SELECT read_id, base, q, CAST(least(floor(q), n - 1) AS BIGINT) AS j, n FROM places JOIN total USING (read_id)),
sampled AS (SELECT read_id, base, CAST(floor(CASE WHEN q >= n THEN n * 10 + n % 7 ELSE (10 + (j + 1) % 7 - j % 7) * (q - j) + j * 10 + j % 7 END) AS BIGINT) AS s FROM low)
SELECT read_id, count(*) AS n, CAST(sum(base * s) AS BIGINT) AS weighted, max(s) AS "end" FROM sampled GROUP BY 1 UNION ALL SELECT DISTINCT read_id, 1, 0, 0 FROM steps WHERE read_id NOT IN (SELECT read_id FROM t)""",
    "m1_bundle_calls": f"""
WITH {BUNDLE} SELECT read_id, method, call, CASE WHEN round_even(confidence * 255, 0) >= 80 AND round_even((o[1] - o[2]) * 255, 0) >= 2 THEN call ELSE 'unc' END AS aa, {BYTE.format('confidence')} AS ac, {BYTE.format('(o[1] - o[2])')} AS am,
  array_to_string(list_transform(probs, lambda p: {BYTE.format('p')}), ',') AS pp, round(confidence, 6) AS confidence FROM called JOIN listed USING (read_id) WHERE k = 1""",
    "m2_class_calls": f"""
WITH {READS}, head AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY b) = 1),
e AS (SELECT read_id, b, m, exp({linear_sql('(20 + m)')} / 1.7::DOUBLE) AS x FROM head, range(5) t(m)),
p AS (SELECT read_id, b, m, round(x / sum(x) OVER (PARTITION BY read_id), 6) AS p FROM e),
l AS (SELECT read_id, b, list(p ORDER BY m) AS p, list(p ORDER BY p DESC) AS o FROM p GROUP BY 1, 2)
SELECT read_id, abstain, CAST(b AS INT) AS base_index, ['Ala', 'Arg', 'Asn', 'Asp', 'Cys'][list_position(p, o[1])] AS call,
  CASE WHEN round_even(o[1] * 255, 0) >= 90 AND (round_even((o[1] - o[2]) * 255, 0) >= 60 OR (abstain AND read_id % 4 > 0 AND read_id % 3 = 1)) THEN ['Ala', 'Arg', 'Asn', 'Asp', 'Cys'][list_position(p, o[1])] ELSE 'unc' END AS aa,
  {BYTE.format('o[1]')} AS ac, {BYTE.format('(o[1] - o[2])')} AS am, CAST(read_id % 3 - 1 AS INT) AS junction_indel, read_id % 4 > 0 AS junction_mapped, array_to_string(list_transform(p, lambda x: {BYTE.format('x')}), ',') AS pp
FROM l, (SELECT unnest([false, true]) AS abstain)""",
    "m3_binary_marks": f"""
WITH {READS}, p AS (SELECT read_id, b, CAST(floor(round(1 / (1 + exp(-{linear_sql('3')})), 6) * 255) AS INT) AS ml FROM cut),
l AS (SELECT read_id, array_to_string(list(b ORDER BY b), ',') AS mp, array_to_string(list(ml ORDER BY b), ',') AS ml FROM p GROUP BY 1)
SELECT c_custkey AS read_id, mp, ml FROM customer LEFT JOIN l ON read_id = c_custkey""",
}
