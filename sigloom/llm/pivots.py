"""Hard negatives for anchors, by a pivot table.

A vector x gets one more coordinate, sqrt(M - |x|^2), with M the largest squared length; an anchor a gets a 0 there. Then
|a - x|^2 = |a|^2 + M - 2<a, x>: order by inner product is order by distance. The table holds every vector's distances to a
few pivots. By the triangle inequality an anchor's own distances to the pivots bracket its distance to each vector,

    max_j |d(a, p_j) - d(x, p_j)|  <=  d(a, x)  <=  min_j (d(a, p_j) + d(x, p_j)),

and so its score; vectors whose bracket misses all scores that are wanted go, and the others are scored in whole numbers.

1. Pivots are the corners of a bounded sample, each farthest from those before. A vector belongs to the cell of its nearest
   pivot. Of each cell the least and largest distance to every pivot is kept (pivots x pivots numbers).
2. Positives: the scores that an anchor is sure to reach among a bounded seed sample give a floor. Brackets of whole
   cells against the floor tell which cells the anchor must visit; there, brackets of single vectors do.
3. Negatives: the same, with a floor and a ceiling for each of the anchor's positives.

Cells are cut into pieces of bounded size by a hash of the whole row, and so are the anchors that visit a piece; a piece
returns its best for each of its anchors, and the best of the pieces win. Nothing is left out: a floor is the score of real
vectors, and the brackets are widened by more than their rounding.

Components are whole numbers, floor(scale * x); scores are exact. Rows take part if their id, label and vector are given, all
components are finite, and the squared length in whole numbers is at most LARGEST (a hundred inner products fit a long). Shorter vectors count as filled up with zeros; an empty one scores 0. Rows that are repeated exactly count once; of
rows that share an id but differ, each is an anchor of its own and none is a partner of its own id; their results are
ranked apart, ties going by the rows' hashes. An anchor without another row of its label has no positives. Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

PIVOTS, PIVOT_SAMPLE, SEEDS = 24, 4096, 4096
PIECE, ANCHORS = 32_768, 512  # vectors and anchors of a piece, about
LARGEST = 1 << 56
SLACK = 4e-6  # of the largest length: distances are stored as float32


def whole(vectors: DataFrame, embedding: str, label: Column, scale: int) -> DataFrame:
    """id, label, x (whole numbers), key: the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.when(fine, F.transform(x, lambda v: F.floor(scale * v))).alias("x"))
    size = F.aggregate(F.col("x"), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(size <= float(LARGEST))
    return rows.groupBy("id", "label", "x").agg(F.lit(1).alias("one")).select("id", "label", "x", F.xxhash64("id", "label", "x").alias("key"))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Lists of whole numbers as rows of d, filled up with zeros."""
    out = [np.zeros((0, d), np.int64)]
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        flat, size = c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().to_numpy(zero_copy_only=False)
        rows = np.zeros((len(c), d), np.int64)
        rows[np.arange(d) < size[:, None]] = flat
        out.append(rows)
    return np.concatenate(out)


class Pivots:
    """Pivots in the augmented space."""

    def __init__(self, sample: np.ndarray, most: float, n: int = PIVOTS):
        self.most = most
        x = self.augmented(sample)
        at, near = [], np.full(len(x), np.inf)
        while len(at) < min(n, len(x)):
            at.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(x - x[at[-1]], axis=1))
        self.points = x[at]

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))[:, None]], axis=1)

    def distances(self, augmented: np.ndarray) -> np.ndarray:
        away = (augmented**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * augmented @ self.points.T
        return np.sqrt(np.maximum(away, 0))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1))

    def scores(self, size: float | np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of what lies so far from an anchor of squared length `size`, a little widened."""
        slack = SLACK * np.sqrt(self.most)
        nearest, farthest = np.maximum(nearest - slack, 0), farthest + slack
        margin = 1e-9 * self.most + 1
        return (size + self.most - farthest**2) / 2 - margin, (size + self.most - nearest**2) / 2 + margin


def products(x: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products in whole numbers; through doubles where every partial sum is below 2**53."""
    return (x.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64) if exact else x @ anchor


def best(score: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    at = np.arange(len(score))
    if len(at) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((keys[at], ids[at], -score[at]))[:k]]


def listed(values: np.ndarray, of: np.ndarray) -> pa.ListArray:
    """values, `of` how many a row."""
    ends = np.zeros(len(of) + 1, np.int32)
    np.cumsum(of, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


class Mine:
    """What every task knows: pivots, the cells' distances to them, a seed sample. All bounded."""

    def __init__(self, pivots: Pivots, low: np.ndarray, high: np.ndarray, seeds: tuple[np.ndarray, np.ndarray, np.ndarray], d: int):
        self.pivots, self.low, self.high, self.d = pivots, low, high, d
        self.seed_ids, self.seed_labels, self.seed_x = seeds
        self.exact = pivots.most < 1 << 52

    def cells(self, size: float, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score in each cell."""
        nearest = np.maximum(np.maximum(self.low - away, away - self.high), 0).max(1)
        return self.pivots.scores(size, nearest, (self.high + away).min(1))

    def asked(self, k: int, same: bool):
        """Anchors with floors and ceilings of what they look for -> the cells to visit and the floors raised by the seeds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("x"), self.d)
                away = self.pivots.of_anchors(x)
                floors, ceilings = batch.column("floors").to_pylist(), batch.column("ceilings").to_pylist()
                cells, raised = [], []
                for i, (anchor, label) in enumerate(zip(batch.column("id").to_numpy(), batch.column("label").to_numpy(), strict=True)):
                    mine = (self.seed_ids != anchor) & ((self.seed_labels == label) == same)
                    score = products(self.seed_x[mine], x[i], self.exact)
                    floor, ceiling = np.array(floors[i], np.int64), np.array(ceilings[i], np.int64)
                    for j, (a, b) in enumerate(zip(floors[i], ceilings[i], strict=True)):
                        inside = score[(score >= a) & (score <= b)]
                        if len(inside) >= k:
                            floor[j] = np.partition(inside, len(inside) - k)[len(inside) - k]
                    least, most = self.cells(float((x[i].astype(np.float64) ** 2).sum()), away[i])
                    cells.append(np.flatnonzero(((most[:, None] >= floor) & (least[:, None] <= ceiling)).any(1)).astype(np.int32))
                    raised.append(floor)
                columns = [batch.column(c) for c in ("id", "label", "x", "key", "ceilings")]
                floors = listed(np.concatenate([np.zeros(0, np.int64), *raised]), np.array([len(r) for r in raised]))
                yield pa.RecordBatch.from_arrays([*columns, floors, listed(np.concatenate([np.zeros(0, np.int32), *cells]), np.array([len(c) for c in cells]))], names=["id", "label", "x", "key", "ceilings", "floors", "cells"])

        return run

    def visited(self, k: int, same: bool):
        """A piece of a cell and the anchors that visit it -> k rows for each anchor and ceiling."""

        def run(piece: pa.Table, anchors: pa.Table) -> pa.Table:
            out = [[np.zeros(0, np.int64)] for _ in range(6)]
            if piece.num_rows and anchors.num_rows:
                ids, labels, keys, x = piece["id"].to_numpy(), piece["label"].to_numpy(), piece["key"].to_numpy(), matrix(piece["x"], self.d)
                table = np.frombuffer(b"".join(piece["away"].to_pylist()), np.float32).reshape(len(ids), -1).T  # a row a pivot
                asked = matrix(anchors["x"], self.d)
                away, floors, ceilings = self.pivots.of_anchors(asked).astype(np.float32), anchors["floors"].to_pylist(), anchors["ceilings"].to_pylist()
                for i, (anchor, label, key) in enumerate(zip(anchors["id"].to_numpy(), anchors["label"].to_numpy(), anchors["key"].to_numpy(), strict=True)):
                    left = np.flatnonzero((ids != anchor) & ((labels == label) == same))
                    lowest, highest = min(floors[i]), max(ceilings[i])
                    nearest, farthest = np.zeros(len(left), np.float32), np.full(len(left), np.inf, np.float32)
                    for j, row in enumerate(table):
                        row = row[left]
                        np.maximum(nearest, np.abs(row - away[i, j]), out=nearest)
                        np.minimum(farthest, row + away[i, j], out=farthest)
                    least, most = self.pivots.scores(float((asked[i].astype(np.float64) ** 2).sum()), nearest.astype(np.float64), farthest.astype(np.float64))
                    left = left[(most >= lowest) & (least <= highest)]
                    score = products(x[left], asked[i], self.exact)
                    for j, (a, b) in enumerate(zip(floors[i], ceilings[i], strict=True)):
                        at = np.flatnonzero((score >= a) & (score <= b))
                        at = at[best(score[at], ids[left[at]], keys[left[at]], k)]
                        for column, values in zip(out, (np.full(len(at), anchor), np.full(len(at), key), np.full(len(at), j), ids[left[at]], keys[left[at]], score[at]), strict=True):
                            column.append(values)
            return pa.table([np.concatenate(c) for c in out], names=["anchor", "anchor_key", "slot", "id", "key", "score"])

        return B.trimmed(run)


def floor_div(a: Column, b: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def pieces(n_rows: int, n: int) -> int:
    return max(1, -(-n_rows // n))


def search(table: DataFrame, anchors: DataFrame, mine: Mine, sizes: dict[int, int], n_anchors: int, k: int, same: bool) -> DataFrame:
    """anchor, anchor_key, slot, id, key, score, rank: for each slot of an anchor (a floor and a ceiling) the k best rows
    of its label (same) or of others."""
    ask = anchors.mapInArrow(mine.asked(k, same), "id long, label long, x array<long>, key long, ceilings array<long>, floors array<long>, cells array<int>")
    n_blocks = pieces(n_anchors, ANCHORS)
    cut = F.get(F.array(*[F.lit(pieces(sizes.get(c, 0), PIECE)) for c in range(len(mine.low))]), F.col("cell"))
    key = F.xxhash64("key", F.lit(7))
    ask = ask.select("id", "label", "x", "key", "floors", "ceilings", F.explode("cells").alias("cell"), F.pmod(key, F.lit(n_blocks)).alias("block"))
    ask = ask.withColumn("piece", F.explode(F.sequence(F.lit(0), (cut - 1).cast("int"))))
    used = ask.select("cell", "piece", "block").distinct()  # a vector is sent only to blocks of anchors that visit its piece
    dealt = table.withColumn("piece", F.pmod(key, cut).cast("int"))
    blocks = used.groupBy("cell", "piece").agg(F.collect_list("block").alias("blocks"))  # n_anchors / ANCHORS at most
    sent = dealt.join(blocks, ["cell", "piece"]).withColumn("block", F.explode("blocks"))
    at = ("cell", "piece", "block")
    found = sent.groupBy(*at).cogroup(ask.groupBy(*at)).applyInArrow(mine.visited(k, same), "anchor long, anchor_key long, slot long, id long, key long, score long")
    order = Window.partitionBy("anchor", "anchor_key", "slot").orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, embedding: str = "embedding", label: Column | None = None, every: int = 100, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: anchors are the rows whose id is divisible by
    `every`; negatives score from low to high per cent of the positive."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    B.small_batches(spark)
    folder = B.scratch(spark, "pivots")
    whole(vectors, embedding, F.col("label") if label is None else label, scale).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    size = F.aggregate(F.col("x"), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, d, most = rows.agg(F.count("*"), F.max(F.size("x")), F.max(size)).first()
    if not n:
        return spark.createDataFrame([], schema)
    order = F.xxhash64("key", F.lit(11))
    sample = rows.orderBy(order, "id", "key").limit(max(PIVOT_SAMPLE, SEEDS)).toArrow()  # bounded
    x = matrix(sample["x"], d)
    pivots = Pivots(x[:PIVOT_SAMPLE], float(most))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = pivots.distances(pivots.augmented(matrix(batch.column("x"), d))).astype(np.float32)
            raw = pa.Array.from_buffers(pa.binary(4 * away.shape[1]), len(away), [None, pa.py_buffer(np.ascontiguousarray(away))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "x", "key")), raw.cast(pa.binary()), pa.array(away.argmin(1).astype(np.int32))], names=["id", "label", "x", "key", "away", "cell"])

    rows.mapInArrow(measured, "id long, label long, x array<long>, key long, away binary, cell int").write.parquet(f"{folder}/table")
    table = spark.read.parquet(f"{folder}/table")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(pivots.points)
        low, high, count = np.full((k, k), np.inf, np.float32), np.full((k, k), -np.inf, np.float32), np.zeros(k, np.int64)
        for batch in batches:
            away = np.frombuffer(b"".join(batch.column("away").to_pylist()), np.float32).reshape(-1, k)
            cell = batch.column("cell").to_numpy()
            np.minimum.at(low, cell, away)
            np.maximum.at(high, cell, away)
            count += np.bincount(cell, minlength=k)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), *(listed(m[at].ravel(), np.full(len(at), k)) for m in (low, high))], names=["cell", "n", "low", "high"])

    # a row a cell: the least and largest distance to each pivot
    spans = table.select("away", "cell").mapInArrow(ranges, "cell long, n long, low array<float>, high array<float>")
    each = [F.min(F.get("low", F.lit(j))).alias(f"low{j}") for j in range(len(pivots.points))] + [F.max(F.get("high", F.lit(j))).alias(f"high{j}") for j in range(len(pivots.points))]
    k = len(pivots.points)
    least, farthest, sizes = np.full((k, k), np.inf), np.full((k, k), -np.inf), {}
    for r in spans.groupBy("cell").agg(F.sum("n").alias("n"), *each).collect():  # PIVOTS rows
        sizes[r["cell"]] = r["n"]
        least[r["cell"]] = [r[f"low{j}"] for j in range(k)]
        farthest[r["cell"]] = [r[f"high{j}"] for j in range(k)]
    seeds = sample["id"].to_numpy()[:SEEDS], sample["label"].to_numpy()[:SEEDS], x[:SEEDS]
    mine = Mine(pivots, least, farthest, seeds, d)

    anchors = table.where(F.col("id") % every == 0).select("id", "label", "x", "key")
    n_anchors = anchors.count()
    everything = F.array(F.lit(-(1 << 62))).alias("floors"), F.array(F.lit(1 << 62)).alias("ceilings")
    search(table, anchors.select("*", *everything), mine, sizes, n_anchors, positives, same=True).write.parquet(f"{folder}/positives")
    found = spark.read.parquet(f"{folder}/positives").select("anchor", "anchor_key", "rank", F.col("id").alias("positive_id"), F.col("key").alias("positive_key"), F.col("score").alias("positive_score"))
    # low * p <= 100 * s <= high * p, in whole numbers
    p = F.col("positive_score")
    bounds = found.select("*", (-floor_div(-low * p, 100)).alias("floor"), floor_div(high * p, 100).alias("ceiling"))
    bounds = bounds.where(F.col("floor") <= F.col("ceiling"))
    slots = bounds.groupBy("anchor", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "floor", "ceiling"))).alias("s"))  # `positives` of them
    of = slots.select(F.col("anchor").alias("id"), F.col("anchor_key").alias("key"), F.col("s.floor").alias("floors"), F.col("s.ceiling").alias("ceilings"), F.col("s.rank").alias("ranks"))
    slotted = anchors.join(of, ["id", "key"])
    hits = search(table, slotted.select("id", "label", "x", "key", "floors", "ceilings"), mine, sizes, n_anchors, negatives, same=False)
    named = of.select(F.col("id").alias("anchor"), F.col("key").alias("anchor_key"), F.posexplode("ranks").alias("slot", "of_rank"))
    hits = hits.withColumnRenamed("rank", "place").join(named, ["anchor", "anchor_key", "slot"])
    out = hits.join(found.withColumnRenamed("rank", "of_rank"), ["anchor", "anchor_key", "of_rank"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda t: t[1] * t[2]))::BIGINT AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INT AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 10
"""
