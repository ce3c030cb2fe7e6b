"""Focus bases and the chunks around them; k-mer levels; encodings as spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, sequence, signal

EDGE = 5  # bases at either end that are no focus when there is no motif


def motif_counts(rows: DataFrame, key: str, text: str, motifs: list[str]) -> DataFrame:
    """key, motif, n, first, last: all hits, overlapping ones too."""
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("motif"), sequence.motif_hits(F.col(text), m).alias("p")) for m in motifs])).alias("x"))
    p = F.col("x.p")
    return each.where(F.size(p) > 0).select(key, "x.motif", F.size(p).cast("long").alias("n"), arrays.at(p, F.lit(0)).cast("long").alias("first"), F.element_at(p, -1).cast("long").alias("last"))


def focus_bases(rows: DataFrame, key: str, text: str, motif: str | None, offset: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, base_idx: every motif hit plus the offset; without a motif every base but EDGE at either end."""
    places = sequence.motif_hits(F.col(text), motif) if motif else F.filter(arrays.indices(F.length(text)), lambda i: (i >= EDGE) & (i < F.length(text) - EDGE))
    return rows.select(key, *keep, F.explode(F.transform(places, lambda p: p + (offset if motif else 0))).alias("base_idx"))


def expected_levels(rows: DataFrame, key: str, text: str, levels: DataFrame, k: int, centre: int | None = None) -> DataFrame:
    """key, base_idx, level: the level of the k-mer whose centre a base is; a base without one has 0. The level table
    has at most 4 ** k rows and is sent to the workers while that is under a million."""
    centre = k // 2 if centre is None else centre
    each = rows.select(key, F.posexplode(sequence.kmers(F.col(text), k)).alias("i", "kmer"))
    table = F.broadcast(levels) if 4**k < 1_000_000 else levels
    return each.join(table, "kmer", "left").select(key, (F.col("i") + centre).alias("base_idx"), F.coalesce("level", F.lit(0.0)).alias("level"))


def anchored(reads: DataFrame, focus: DataFrame, key: str, base_map: str) -> DataFrame:
    """The reads of the focus table (key, label_int, anchor) with base_idx: the last base that starts at or before the
    anchor sample, moved to EDGE bases from either end. A read too short for that has no row."""
    bases = F.size(base_map) - 1
    base = F.least(bases - EDGE - 1, F.greatest(F.lit(EDGE), signal.base_of_sample(F.col(base_map), F.col("anchor"))))
    return reads.join(focus, key).withColumn("base_idx", base).where("base_idx >= 0")


def focus_sample(base_map: Column, base: Column, justify: str = "center") -> Column:
    start, stop = arrays.at(base_map, base), arrays.at(base_map, base + 1)
    return {"start": start, "end": stop, "center": F.floor((start + stop) / 2).cast("int")}[justify]


def cut(rows: DataFrame, samples: Column, base_map: Column, base: Column, left: int, right: int, feature_start: int, feature_end: int, justify: str = "center") -> DataFrame:
    """Adds focus_sample, chunk_signal (left + right samples, 0 outside), chunk_map (base starts inside the chunk) and
    chunk_dwells (feature_end - feature_start + 1 dwell times, 0 outside). Bases outside the map give no row."""
    rows = rows.where((base >= 0) & (base < F.size(base_map) - 1)).withColumn("focus_sample", focus_sample(base_map, base, justify))
    start = F.col("focus_sample") - left
    inside = F.filter(F.transform(base_map, lambda x: x - start), lambda x: (x > 0) & (x < left + right))
    return (
        rows.withColumn("chunk_signal", arrays.padded(samples, start, start + left + right))
        .withColumn("chunk_map", F.concat(F.array(F.lit(0)), inside, F.array(F.lit(left + right))))
        .withColumn("chunk_dwells", arrays.padded(F.transform(signal.dwells(base_map), lambda x: x.cast("double")), base + feature_start, base + feature_end + 1))
    )


def base_window(base_map: Column, base: Column, left: int, right: int) -> Column:
    """(start, stop) samples of `left` bases before to `right` after, as far as the map goes."""
    last = F.size(base_map) - 1
    return F.struct(arrays.at(base_map, F.greatest(F.lit(0), base - left)).alias("start"), arrays.at(base_map, F.least(last, base + right + 1)).alias("stop"))


def signal_kmer_spans(rows: DataFrame, key: str, codes: Column, base_map: Column, before: int, after: int) -> DataFrame:
    """key, row, start, stop: where the k-mer encoding of a signal has ones. Row 4 * place + base for every place of the
    k-mer around a base, over the base's samples; places outside the sequence and unknown bases have none."""
    def one(c: Column, m: Column, i: Column, p: Column) -> Column:
        code = F.when(i + p - before >= 0, arrays.at(c, i + p - before))
        return F.struct((4 * p + code).alias("row"), code.alias("code"), arrays.at(m, i).alias("start"), arrays.at(m, i + 1).alias("stop"))

    places = F.sequence(F.lit(0), F.lit(before + after))
    spans = arrays.let(codes, base_map, lambda c, m: F.flatten(F.transform(arrays.indices(F.size(m) - 1), lambda i: F.transform(places, lambda p: one(c, m, i, p)))))
    each = rows.select(key, F.explode(spans).alias("x"))
    return each.where("x.code >= 0 and x.stop > x.start").select(key, "x.row", "x.start", "x.stop")
