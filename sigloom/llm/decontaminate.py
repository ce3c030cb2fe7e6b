"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window is `width` consecutive words of an item, or all words of a shorter item. It is the set of its word
shingles; a document contains it only if it has them all, so the necessary prefix is one shingle. The shingles of the
windows are counted over the whole corpus and the rarest of each window is its join key (rarity order). A document's
shingles that are keys give candidates, each with the words around it; they are joined to the windows. The key's place in
the window bounds where the window must start and end (positional and length bound); what is left is compared word by word.

Windows, counts, keys and candidates are tables, and no item passes through the driver. What is sent to all workers is a
sieve of B.BITS bits, the same for any benchmark: it passes every wanted shingle and some others, which the join drops.

Null text: no words. Null item_id, or an item without words: no window. Repeated rows keep their own rows; items that
share an item_id count once. A text of many MB is a block of its own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(block: B.Block) -> B.Words:
    return B.Words(LOWER[block.data], block.offsets, GAP)


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item, window (its words joined by a space), size: the distinct windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches):
            w = words_of(block)
            raw, out = w.data.tobytes(), []
            for item, a, b in zip(block.batch.column("item").to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                n = min(width, b - a)
                words = [raw[x:y].decode("utf-8", "replace") for x, y in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)]
                out += [(item, " ".join(words[k : k + n]), n) for k in range(b - a - n + 1)] if n else []
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["item", "window", "size"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(run, "item string, window string, size int").distinct()


def shingles(rows: DataFrame, shingle: int) -> DataFrame:
    """window -> window, size, k, place, gram: its shingles of k words, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches, column="window"):
            w = words_of(block)
            h, of, ks, places, grams = w.hashes(), [], [], [], []
            for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                k = min(shingle, b - a)
                g = B.gram_hashes(h[a:b], k)
                of.append(np.full(len(g), i))
                ks.append(np.full(len(g), k, np.int32))
                places.append(np.arange(len(g), dtype=np.int32))
                grams.append(g)
            of = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays(
                [block.batch.column("window").take(of), block.batch.column("size").take(of), pa.array(np.concatenate(ks)), pa.array(np.concatenate(places)), pa.array(np.concatenate(grams).view(np.int64))],
                names=["window", "size", "k", "place", "gram"],
            )

    return rows.mapInArrow(run, "window string, size int, k int, place int, gram long")


def sieved(w: B.Words, rows: int, shingle: int, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """k, and of the shingles of k words that pass the sieve: row, first word and hash."""
    h, of = w.hashes(), np.repeat(np.arange(rows), np.diff(w.first))
    for k in range(1, shingle + 1):
        g = B.gram_hashes(h, k).view(np.int64)
        at = np.flatnonzero(B.may_want(bits, g))
        at = at[of[at] == of[at + k - 1]]
        if len(at):
            yield k, of[at], at, g[at]


def shingle_counts(documents: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """k, gram, n: how often the whole corpus has each of these shingles, and some others."""
    sent = documents.sparkSession.sparkContext.broadcast(B.marked(wanted, "gram"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches):
            for k, _, _, g in sieved(words_of(block), block.n, shingle, sent.value):
                gram, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram), pa.array(n)], names=["k", "gram", "n"])

    return documents.select("text").mapInArrow(run, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))


def scanned(documents: DataFrame, keys: DataFrame, width: int, shingle: int) -> DataFrame:
    """row, doc_id, n_words, found: of each row its shingles that may be keys, with the words around them."""
    sent = documents.sparkSession.sparkContext.broadcast(B.marked(keys, "gram"))
    kind = pa.list_(pa.struct([("k", pa.int32()), ("gram", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches):
            w = words_of(block)
            raw, found = w.data.tobytes(), [[] for _ in range(block.n)]
            for k, of, at, g in sieved(w, block.n, shingle, sent.value):
                low, high = np.maximum(w.first[of], at - (width - k)), np.minimum(w.first[of + 1], at + width)
                for i, p, gram, a, b in zip(of.tolist(), at.tolist(), g.tolist(), low.tolist(), high.tolist(), strict=True):
                    around = b" ".join([raw[x:y] for x, y in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)])
                    found[i].append({"k": k, "gram": gram, "at": p - int(w.first[i]), "left": p - a, "around": around.decode("utf-8", "replace")})
            yield pa.RecordBatch.from_arrays([block.batch.column("row"), block.batch.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.array(found, kind)], names=["row", "doc_id", "n_words", "found"])

    return documents.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_words long, found array<struct<k: int, gram: long, at: long, left: int, around: string>>")


def judged(documents: DataFrame, benchmark: DataFrame, width: int, shingle: int, share: float) -> DataFrame:
    """(row, doc_id, text) -> row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = documents.sparkSession
    B.small_batches(spark)

    def kept(df: DataFrame, name: str) -> DataFrame:
        folder = B.scratch(spark, name)
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    items = kept(windows(benchmark, width), "windows")
    grams = kept(shingles(items.select("window", "size").distinct(), shingle), "shingles")
    rare = grams.join(shingle_counts(documents, grams, shingle), ["k", "gram"], "left")
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "place", "k")).alias("x")
    keys = kept(rare.groupBy("window", "size").agg(first).select("window", "size", "x.k", "x.gram", "x.place"), "keys")

    rows = kept(scanned(documents, keys, width, shingle), "candidates")
    met = rows.select("row", F.explode("found").alias("f")).select("row", "f.*").join(keys, ["k", "gram"])
    start = F.col("left") - F.col("place")
    there = F.array_join(F.slice(F.split("around", " "), F.greatest(start, F.lit(0)) + 1, F.col("size")), " ")
    hits = kept(met.where((start >= 0) & (there == F.col("window"))).select("row", (F.col("at") - F.col("place")).alias("first"), "size", "window").distinct(), "hits")

    span = F.struct("first", (F.col("first") + F.col("size")).alias("end"))
    union = F.aggregate(
        F.sort_array(F.collect_list(span)), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["first"], s["end"]))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")), lambda s: s["n"],
    )
    covered = hits.select("row", "first", "size").distinct().groupBy("row").agg(union.alias("hit"))
    names = hits.select("row", "window").distinct().join(items.select("window", "item"), "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("names"))
    n_hit, some = F.coalesce("hit", F.lit(0)), F.coalesce("names", F.array().cast("array<string>"))
    out = rows.select("row", "doc_id", "n_words").join(covered.join(names, "row"), "row", "left")
    out = out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(some).cast("long").alias("n_items"), F.sha2(F.array_join(some, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / share) >= F.col("n_words")))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 13, shingle: int = 3, share: float = 0.05) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row per row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    return judged(rows, benchmark, width, shingle, share).drop("row")


def clean(documents: DataFrame, benchmark: DataFrame, width: int = 13, shingle: int = 3, share: float = 0.05) -> DataFrame:
    """The documents that are not contaminated, all their columns. They are read again and known by their places, so
    `documents` must be a table or another source that gives the same partitions each time."""
    row = F.monotonically_increasing_id().alias("row")
    found = judged(documents.select(F.lit(None).cast("long").alias("doc_id"), "text", row), benchmark, width, shingle, share)
    whole = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("whole"), row)
    return whole.join(found.where("contaminated").select("row"), "row", "left_anti").select("whole.*")
