"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

1. Each text is tokenised once. A document's ids are cut into pieces of `limit` ids; only the last may be shorter.
2. The pieces' lengths are counted: at most `limit` counts, whatever the number of documents.
3. On that histogram, lengths are placed longest first, each piece into the shortest pack there is, which has the most
   room, and into a new one if it doesn't fit there. Packs of one pattern are counted, and counts are split as needed, so
   a step places as many pieces as there are such packs. The driver holds patterns, never pieces.
4. Pieces are joined back to patterns by their rank among the pieces of their length. Ranks come from counts per
   (bucket of doc_id, length) and a window inside each bucket, so a length that a third of all pieces share is ranked
   in as many tasks as there are buckets.

Null or empty text: one piece that holds the end id alone. Repeated rows each get their own place. Null doc_id: a row
like any other. No rows: no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import tokens as T

BUCKET = 200_000  # pieces that are ranked in one window, of all lengths

def pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """The vocabulary drops white space, so a text's ids are its words' ids one after another."""
    tokenizer = T.lower_words(path)
    for block in B.blocks(batches, owner="packing"):
        found, upto = tokenizer.ids(block)
        raw = memoryview(np.insert(found, upto[1:], end_id).astype("<u4", copy=False)).cast("B")
        upto = (upto + np.arange(block.n + 1)).tolist()  # with the end ids
        out: list[tuple] = []
        for doc, first, last in zip(block.batch.column("doc_id").to_pylist(), upto, upto[1:], strict=False):
            for start in range(first, last, limit):
                stop = min(start + limit, last)
                out.append((doc, start - first, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), last - first))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenised(documents: DataFrame, path: str, limit: int = 2048, end_id: int = 1) -> DataFrame:
    return documents.select("doc_id", "text").mapInArrow(lambda it: pieces(it, path, limit, end_id), PIECES)


def packs(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many sequences have each."""
    open_packs: dict[int, list] = {}  # room -> [(pattern, count)], none with a count of 0
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room == 0:
            done.append((pattern, count))
            return
        if not open_packs.get(room):
            insort(rooms, room)
        open_packs.setdefault(room, []).append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                # no pack has room: a new one is the shortest until it is full, so pieces of this length fill it
                side = max(1, limit // length)
                full, rest = divmod(left, side)
                if full:
                    put(limit - side * length, (length,) * side, full)
                if rest:
                    put(limit - rest * length, (length,) * rest, 1)
                break
            room = rooms[-1]
            pattern, count = open_packs[room].pop()
            if not open_packs[room]:
                rooms.pop()
            used = min(count, left)
            left -= used
            if count > used:
                put(room, pattern, count - used)
            put(room - length, (*pattern, length), used)
    done += [x for room in rooms for x in open_packs[room]]
    return done


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), by rank: pieces of consecutive ranks go to consecutive sequences."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append((ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        sequence += count
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """With rank: 0.. among the rows of a length. A bucket's ranks start after those of the buckets before it. Rows are dealt
    by the numbers that they got when they were written (`row`), so equal ones are spread like any others."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    return (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(first, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("place"))
        .drop("bucket", "base", "place", "row")
    )


def placed(rows: DataFrame, table: dict[int, np.ndarray]) -> DataFrame:
    names = [f.name for f in rows.schema.fields if f.name != "rank"]
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cut) if len(order) else []:
                t = table[int(length[at[0]])]
                k = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = t[k, 1] + rank[at] - t[k, 0], t[k, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, schema)


def pack(documents: DataFrame, path: str, limit: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    B.small_batches(spark)
    folder = B.scratch(spark, "pieces")
    tokenised(documents, path, limit, end_id).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    # at most `limit` rows reach the driver
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    table = slots(packs(histogram, limit))
    parts, n = int(spark.conf.get("spark.sql.shuffle.partitions")), sum(histogram.values())
    return placed(ranked(rows, max(8 * parts, n // BUCKET)), table)
