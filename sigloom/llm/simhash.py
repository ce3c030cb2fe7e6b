"""SimHash near-duplicates by meet-in-the-middle ball hashing, radius 3.

Two fingerprints at 3 or fewer bits meet at a variant that lies within half the radius of each. Flipping one bit changes
the parity of the set bits, so it is enough that all variants have even parity: an odd fingerprint emits its 64
variants at one bit, an even one itself and its 2,016 variants at two bits. Distances 1 and 3 join an odd and an even
one (1 + 0, 1 + 2), distance 2 joins two odd ones (1 + 1) or two even ones (0 + 2).

The shuffle is on variants by their leading bits: a fingerprint is sent once to each leading pattern that its variants
have, and the task of that pattern writes the variants out, sorts them and finds the collisions. More leading bits are
used for more fingerprints, so a task's share stays bounded; a share that is still large is worked off in parts.

In a set of fingerprints that collide at a variant, one member is within the radius of all the others (an odd one, or
the variant itself); links from it to the others connect the set, so a set of n gives n - 1 links, not n * n. Two even
members without such a centre are 4 bits apart, or meet at another variant. Links are verified by their distance.

Null or empty text, or no words: fingerprint 0, linked like any other. Repeated rows keep their own rows. Null doc_id:
a row like any other, which never names a component (one of only such rows has a null component_id). Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import similar
from .components import components

SHARE, WORK = 4096, 4_000_000  # distinct fingerprints a leading pattern; variants written out at once
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprint(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    line, run, at = b" ".join(words), xxhash.xxh64_intdigest, 0
    if len(words) <= k:
        return np.array([run(line, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([at], ends[:-1] + 1))
    return np.fromiter((run(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches):
            block.data = LOWER[block.data]
            out = np.zeros(block.n, np.uint64)
            for i, text in enumerate(block.texts()):
                if len(h := shingle_hashes(text.split(), shingle)):
                    out[i] = fingerprint(h)
            yield pa.RecordBatch.from_arrays([block.batch.column("doc_id").cast(pa.int64()), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _flips(low: int, high: int, n: int) -> np.ndarray:
    """Masks of n bits out of low..high-1."""
    one = [1 << i for i in range(low, high)]
    return np.array({0: [0], 1: one, 2: [a | b for k, a in enumerate(one) for b in one[:k]]}[n], np.uint64)


def _within(fps: np.ndarray, prefix: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants whose leading bits are prefix, and the index of the fingerprint of each."""
    low = np.uint64(64 - lead)
    away = np.bitwise_count((fps >> low) ^ np.uint64(prefix)) if lead else np.zeros(len(fps), np.uint8)
    odd = np.bitwise_count(fps) % 2 == 1
    out, who = [], []
    base = (fps & ((np.uint64(1) << low) - np.uint64(1))) | (np.uint64(prefix) << low) if lead else fps
    for rows, flips in ((odd & (away == 0), (1,)), (odd & (away == 1), (0,)), (~odd & (away == 0), (0, 2)), (~odd & (away == 1), (1,)), (~odd & (away == 2), (0,))):
        at = np.flatnonzero(rows)
        for n in flips:
            masks = _flips(0, 64 - lead, n)
            out.append((base[at][:, None] ^ masks[None, :]).ravel())
            who.append(np.repeat(at, len(masks)))
    return np.concatenate(out), np.concatenate(who)


def _stars(variants: np.ndarray, fps: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Links (centre, other) of the sets that collide at a variant."""
    order = np.argsort(variants)
    v, who = variants[order], who[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    size = np.diff(np.concatenate((first, [len(v)])))
    of = np.repeat(np.arange(len(first)), size)
    keep = size[of] > 1
    v, who, of = v[keep], who[keep], of[keep]
    f = fps[who]
    middle = (np.bitwise_count(f) % 2 == 1) | (f == v)
    centre = np.zeros(len(first), np.uint64)
    has = np.zeros(len(first), bool)
    centre[of[middle]], has[of[middle]] = f[middle], True
    pair = np.stack([centre[of], f], 1)[has[of] & (centre[of] != f)]
    return np.unique(pair, axis=0) if len(pair) else pair


def local_links(fps: np.ndarray, prefix: int, lead: int) -> np.ndarray:
    parts = 0
    while (len(fps) * 600) >> parts > WORK and lead + parts < 40:
        parts += 1
    found = [np.zeros((0, 2), np.uint64)]
    for sub in range(1 << parts):
        variants, who = _within(fps, (prefix << parts) | sub, lead + parts)
        if len(variants):
            found.append(_stars(variants, fps, who))
    return np.unique(np.concatenate(found), axis=0)


def links(fps: DataFrame, count: int, radius: int = 3) -> DataFrame:
    """fp (distinct) -> (a, b): links that connect all fingerprints within the radius, each verified."""
    if radius != 3:
        raise ValueError("the parity rule above is for a radius of 3")
    lead = max(6, min(24, (max(1, count) // SHARE).bit_length()))
    one, two = _flips(0, lead, 1), np.concatenate((_flips(0, lead, 1), _flips(0, lead, 2)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("fp").to_numpy().view(np.uint64)
            for part in (f[k : k + 4096] for k in range(0, len(f), 4096)):
                odd = np.bitwise_count(part) % 2 == 1
                for rows, masks in ((part[odd], one), (part[~odd], two)):
                    to = (rows >> np.uint64(64 - lead))[:, None] ^ np.concatenate((np.zeros(1, np.uint64), masks))[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(to.ravel().view(np.int64)), pa.array(np.repeat(rows, len(masks) + 1).view(np.int64))], names=["lead", "fp"])

    def meet(group: pa.Table) -> pa.Table:
        f = group.column("fp").to_numpy().view(np.uint64)
        pair = local_links(f, int(group.column("lead")[0].as_py()), lead)
        return pa.table({"a": pair[:, 0].copy().view(np.int64), "b": pair[:, 1].copy().view(np.int64)})

    found = fps.select("fp").mapInArrow(send, "lead long, fp long").groupBy("lead").applyInArrow(meet, "a long, b long")
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def written(documents: DataFrame, shingle: int) -> DataFrame:
    """The fingerprints in the shared folder: they are read more than once."""
    spark = documents.sparkSession
    B.small_batches(spark)
    folder = B.scratch(spark, "fingerprints")
    fingerprints(documents, shingle).write.parquet(folder)
    return spark.read.parquet(folder)


def near_duplicates(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id, one row per row."""
    rows = written(documents, shingle)
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, distinct.count()))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(known.join(least, "root").select("fp", "component_id"), "fp")


def survivors(documents: DataFrame, shingle: int = 3, similar_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group, that of the smallest doc_id, all its columns. Groups are the components of both kinds of
    links over all documents: fingerprints within the radius, and shingle sets of the similarity. Rows that share a doc_id
    are documents of their own if their texts differ, in the order of the texts' MD5; if id and text are the same, the row
    of the smallest other columns is the one. Rows without a doc_id cannot be told apart and stay."""
    named = documents.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = _survivors(named, shingle, similar_shingle, similarity)
    else:
        rows = _numbered(named)
        left = _survivors(rows.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text")), shingle, similar_shingle, similarity)
        out = rows.join(left.select(F.col("doc_id").alias("node")), "node", "left_semi").select("row.*")
    return out.unionByName(documents.where("doc_id is null"))


def _numbered(documents: DataFrame) -> DataFrame:
    """node, row: each distinct doc_id and text once, numbered in that order."""
    spark, folder = documents.sparkSession, B.scratch(documents.sparkSession, "numbered")
    mark = F.concat(F.col("text").isNull().cast("string"), F.md5(F.coalesce("text", F.lit("")))).alias("mark_")
    keys = documents.select("doc_id", mark).distinct().repartitionByRange("doc_id", "mark_").sortWithinPartitions("doc_id", "mark_")
    keys.select("doc_id", "mark_", F.monotonically_increasing_id().alias("node")).write.parquet(f"{folder}/keys")  # ascends over the ranges
    keys = spark.read.parquet(f"{folder}/keys")
    others = [f.name for f in documents.schema if f.name not in ("doc_id", "text") and f.dataType.typeName() in ("string", "long", "integer", "double", "float", "boolean", "date", "timestamp", "binary", "short", "byte")]
    rows = documents.select(F.struct(*documents.columns).alias("row"), "doc_id", mark).join(keys, ["doc_id", "mark_"])
    chosen = F.min_by("row", F.struct(F.lit(0), *[F.col(f"row.`{c}`") for c in others])).alias("row")
    rows.groupBy("node").agg(chosen).write.parquet(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")


def _survivors(documents: DataFrame, shingle: int, similar_shingle: int, similarity: float) -> DataFrame:
    """Of documents whose doc_ids are all there and differ."""
    rows = written(documents, shingle)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    near = links(least, least.count())
    a, b = (least.select(F.col("fp").alias(x), F.col("least").alias(f"doc_{x}")) for x in "ab")
    known = near.join(a, "a").join(b, "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    known = known.unionByName(rows.join(least, "fp").where("doc_id != least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    grouped = similar.groups(documents, known, similar_shingle, similarity)
    return documents.join(grouped.where("node != root").select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
