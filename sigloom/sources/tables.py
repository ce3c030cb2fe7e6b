"""Tab-separated inputs with their checks. The small ones become broadcastable tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments, with their place in the file."""
    rows = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    return rows.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))


def _last(rows: DataFrame, key: str) -> DataFrame:
    """Of rows that share a key, the last in the file."""
    others = [c for c in rows.columns if c not in (key, "place")]
    return rows.groupBy(key).agg(F.max(F.struct("place", *others)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in others])


def kmer_levels(spark: SparkSession, path: str) -> DataFrame:
    """kmer (upper case), level. Lines whose level is no number are left out; the last of repeated k-mers counts."""
    parts = F.split("value", r"\s+")
    rows = _lines(spark, path).select("place", F.upper(parts[0]).alias("kmer"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("level"))
    return _last(rows.where("level is not null"), "kmer")


def focus_table(spark: SparkSession, path: str) -> DataFrame:
    """read_id, label_int, anchor_sample from a table with that header; blank reads are left out, the last row of a
    repeated read counts."""
    rows = spark.read.csv(path, sep="\t", header=True)
    if missing := {"read_id", "label_int", "anchor_sample"} - set(rows.columns):
        raise ValueError(f"{path}: missing columns {sorted(missing)}")
    rows = rows.where(F.trim(F.coalesce("read_id", F.lit(""))) != "").withColumn("place", F.monotonically_increasing_id())
    return _last(rows.select("place", "read_id", F.col("label_int").cast("int"), F.col("anchor_sample").cast("int")), "read_id")


def comparisons(spark: SparkSession, path: str) -> DataFrame:
    """meta1, labels1, meta2, labels2 from four columns without a header; any other number of columns is an error."""
    parts = F.split("value", "\t")
    rows = _lines(spark, path)
    bad = rows.where(F.size(parts) != 4).limit(1).collect()
    if bad:
        raise ValueError(f"{path}: not four columns: {bad[0]['value']!r}")
    labels = lambda i: F.transform(F.split(parts[i], ","), lambda x: F.trim(x))
    return rows.select(F.trim(parts[0]).alias("meta1"), labels(1).alias("labels1"), F.trim(parts[2]).alias("meta2"), labels(3).alias("labels2"))


def dwell_templates(rows: DataFrame, aas: DataFrame) -> DataFrame:
    """aa, position, dwell_mean for every aa and position: a missing cell is 1, one at or below 0 is its position's mean
    over the aas. Both axes are small tables."""
    grid = aas.select("aa").distinct().select("aa", F.lit(1).alias("one")).join(F.broadcast(rows.select("position").distinct().withColumn("one", F.lit(1))), "one").drop("one")
    cells = grid.join(rows, ["aa", "position"], "left").withColumn("v", F.coalesce("dwell_mean", F.lit(1.0)))
    mean = F.avg(F.when(F.col("v") > 0, F.col("v"))).over(Window.partitionBy("position"))
    return cells.select("aa", "position", F.when(F.col("v") <= 0, mean).otherwise(F.col("v")).alias("dwell_mean"))


def template_ratios(bases: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds ratio: dwell over the template's at the position; 1 for a dwell at or below 0, where there is no template
    or where that is not above 0."""
    joined = bases.join(F.broadcast(templates), ["aa", "position"], "left")
    return joined.withColumn("ratio", F.when((F.col("dwell") > 0) & (F.coalesce("dwell_mean", F.lit(0.0)) > 0), F.col("dwell") / F.col("dwell_mean")).otherwise(1.0)).drop("dwell_mean")


REQUIRED = ("read_id", "pod5", "anchor_end", "target")


def manifest(spark: SparkSession, path: str, require: tuple[str, ...] = ()) -> DataFrame:
    """A training manifest by its suffix (parquet, csv, tsv or txt, the latter two tab-separated). Another suffix, missing
    columns, no rows and repeated reads are errors; each check is one aggregate."""
    if not (kind := re.search(r"\.(parquet|csv|tsv|txt)$", path.rstrip("/").lower())):
        raise ValueError(f"{path}: a manifest is .parquet, .csv, .tsv or .txt")
    path, suffix = path.rstrip("/"), kind[1]
    rows = spark.read.parquet(path) if suffix == "parquet" else spark.read.csv(path, sep="," if suffix == "csv" else "\t", header=True, inferSchema=True)
    if missing := {*REQUIRED, *require} - set(rows.columns):
        raise ValueError(f"{path}: missing columns {sorted(missing)}")
    sizes = rows.groupBy("read_id").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    if not sizes["n"]:
        raise ValueError(f"{path}: no rows")
    if sizes["most"] > 1:
        raise ValueError(f"{path}: repeated read_id")
    return rows


def mapped_only(alignments: DataFrame, min_mapq: int = 0, tags: tuple[str, ...] = ("mv", "ns"), unmapped: bool = False, secondary: bool = False, supplementary: bool = False) -> DataFrame:
    """The alignments that count: by flag bits, mapping quality, and the tags they must have."""
    keep = F.col("sequence").isNotNull() & F.col("read_id").isNotNull()
    for bit, wanted in ((0x4, unmapped), (0x100, secondary), (0x800, supplementary)):
        if not wanted:
            keep &= F.col("flag").bitwiseAND(bit) == 0
    keep &= F.coalesce("mapping_quality", F.lit(0)) >= min_mapq
    for tag in tags:
        keep &= F.col("tags").getItem(tag).isNotNull()
    return alignments.where(keep)


def cl_tag(tags: Column) -> Column:
    """The CL tag, else cl, as a small integer; null if it is no number."""
    return F.coalesce(tags["CL"].try_cast("smallint"), tags["cl"].try_cast("smallint"))


def sha256(spark: SparkSession, path: str) -> str:
    """The lowercase hex SHA-256 of one file's bytes, such as a level table's, by which its drift is seen. The file is read
    as one value, so it is at most 2 GB."""
    rows = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return rows[0][0]
