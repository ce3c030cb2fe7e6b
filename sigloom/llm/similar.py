"""Groups of documents whose sets of word shingles are alike to a given Jaccard similarity: an exact join.

SimHash at 3 of 64 bits joins copies with a few edits in long texts; two texts that share four fifths of their five-word
shingles mostly differ in 8 to 14 bits. This finds those, and all of them.

Equal sets are one class, known by a 64-bit hash of the set. Shingles have one order everywhere: those that are common
in a sample of the documents last, by their count there, the others by their hash. Which order that is changes the cost
and never the result. Of sets with a similarity of t or more, the first shingle in common is among the first
size - ceil(t * size) + 1 of each, so the classes are joined on these. At that shingle, sizes and places bound what two
sets can share, and parities of a set's shingles bound from below what they don't, first 256 of them, then as many as the set
is large: pairs beyond a bound go, and none of those is similar. What stays is held against whole sets.

A group of n near copies has n * n pairs at each shingle. So first all classes at a shingle are held against its first
and last class; these links and those already known give components. Copies that are alike to most of their group but to
neither of the two stay outside of it, and each of them would meet the whole group. So what is outside of a shingle's
largest component is held against some HUBS classes of it, others at each shingle, in up to TURNS turns. Then all pairs of a
shingle whose components differ are looked at, but for those with its first or last class, which were. A link within a
component would change nothing. The pairs of a frequent shingle are dealt to tasks in blocks.

Rows without a doc_id or without words have no links. Rows that share a doc_id are one document with all their links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import components

SAMPLE, COMMON, OFTEN = 20_000, 100_000, 4  # documents in the sample, shingles sent to the workers, documents that hold one
BLOCK = 2048  # classes at a shingle that a task holds against all others there
PARITIES = 4  # longs
HUBS, TURNS = 32, 2  # about how many classes of a component at a shingle the others there are held against, and how often
WHOLE = 3  # classes at a shingle all of whose pairs have its first or last class
CHUNK = 6 << 20  # bytes of keys that a task works on at once
SLACK = 1e-9  # bounds in floating point let through rather than lose
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(block: B.Block, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; a text of fewer words is one shingle."""
    w = B.Words(LOWER[block.data], block.offsets)
    h = w.hashes() if len(w) else np.zeros(0, np.uint64)
    grams = B.gram_hashes(h, shingle)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= shingle:
            yield np.unique(grams[a : b - shingle + 1])
        else:
            yield B.gram_hashes(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def set_hash(s: np.ndarray) -> int:
    return int(B.mixed(np.array([B.mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def parities(s: np.ndarray) -> np.ndarray:
    """Of each of some classes of shingles, whether the set has an odd number: bits, as many classes as the set is large
    or more, 64 * PARITIES at least, always a power of two."""
    n = max(64 * PARITIES, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def folded(odd: np.ndarray, words: int) -> np.ndarray:
    """The same for fewer classes."""
    return np.bitwise_xor.reduce(odd.reshape(-1, words), axis=0)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A number of shingles that one of the two sets has and the other lacks: there may be more of them."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def common_of(documents: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, ascending, and how many have each: at most COMMON."""
    parts = max(1, documents.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches):
            grams, n = np.unique(np.concatenate(list(shingle_sets(block, shingle))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0).select("text")
    counts = some.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "gram").limit(COMMON).collect()
    grams, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    order = np.argsort(grams.view(np.uint64))
    return grams.view(np.uint64)[order], n[order]


def in_order(s: np.ndarray, common: np.ndarray, n: np.ndarray) -> np.ndarray:
    if not len(common):
        return s
    k = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[np.argsort(np.where(common[k] == s, n[k], 0), kind="stable")]


def prefix(size: int, similarity: float) -> int:
    return size - math.ceil(similarity * size - SLACK) + 1


def classes(documents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, class (of its set), size, keys (the set's first shingles in order, 8 bytes each; null where the task has
    sent the class before), odd (its parities)."""
    sent = documents.sparkSession.sparkContext.broadcast(common_of(documents, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a number a document of the task
        for block in B.blocks(batches):
            sets = list(shingle_sets(block, shingle))
            names = [set_hash(s) for s in sets]
            keys = [None if n in seen or seen.add(n) else in_order(s, *sent.value)[: prefix(len(s), similarity)].tobytes() for n, s in zip(names, sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column("doc_id"), pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(keys, pa.binary()), pa.array([parities(s).tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "class", "size", "keys", "odd"],
            ).filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, class long, size int, keys binary, odd binary")


class Chunk:
    """The distinct classes of a chunk and their keys, the same whenever they are computed."""

    def __init__(self, rows: pa.Table, least: float):
        names, first = np.unique(rows["class"].to_numpy(), return_index=True)
        self.names, self.rows = names, rows.select(["size", "odd", "keys"]).take(pa.array(first))
        keys = [np.frombuffer(k, np.uint64) for k in self.rows["keys"].to_pylist()]
        n = np.array([len(k) for k in keys], np.int64)
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.of = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(self.of)) - np.repeat(np.cumsum(n) - n, n)
        size = self.rows["size"].to_numpy()[self.of]
        # early enough to be the first that a longer set shares
        self.near = size - self.at >= least * size - SLACK


def sent_keys(chunk: Chunk, number: int, buckets: int) -> pa.Table:
    """Of each bucket, the chunk's distinct keys, each with whether several classes have it (1) and one has it early (2)."""
    key, at, n = np.unique(chunk.key, return_inverse=True, return_counts=True)
    state = (n > 1).astype(np.uint8)
    early = np.zeros(len(key), bool)
    early[at[chunk.near]] = True
    state |= early.astype(np.uint8) << 1
    to = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    key, state, to = key[order], state[order], to[order]
    edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(to) else np.zeros(1, np.int64)
    both = list(zip(edge[:-1], edge[1:], strict=True))
    return pa.table(
        {
            "bucket": pa.array(to[edge[:-1]] if both else [], pa.int64()), "chunk": pa.array([number] * len(both), pa.int64()),
            "keys": pa.array([key[a:b].tobytes() for a, b in both], pa.binary()), "states": pa.array([state[a:b].tobytes() for a, b in both], pa.binary()),
        }
    )


def useful_keys(bucket: pa.Table) -> pa.Table:
    """Of each chunk, the keys that several classes have and one has early."""
    keys = [np.frombuffer(k, np.uint64) for k in bucket["keys"].to_pylist()]
    states = np.concatenate([np.frombuffer(s, np.uint8) for s in bucket["states"].to_pylist()])
    key, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    several, early = n > 1, np.zeros(len(key), bool)
    several[at[states & 1 > 0]] = True
    early[at[states & 2 > 0]] = True
    useful = (several & early)[at]
    ends = np.cumsum([len(k) for k in keys])
    kept = [k[useful[e - len(k) : e]] for k, e in zip(keys, ends, strict=True)]
    some = [i for i, k in enumerate(kept) if len(k)]
    return pa.table({"chunk": bucket["chunk"].take(pa.array(some, pa.int64())), "keys": pa.array([kept[i].tobytes() for i in some], pa.binary())})


KEYED = "key long, class long, size int, at int, " + ", ".join(f"odd{i} long" for i in range(PARITIES))


def keyed_rows(chunk: Chunk, useful: pa.Table) -> pa.Table:
    """A row for each class and useful key."""
    found = [np.frombuffer(k, np.uint64) for k in useful["keys"].to_pylist()] if useful.num_rows else []
    some = np.flatnonzero(np.isin(chunk.key, np.concatenate(found))) if found else np.zeros(0, np.int64)
    of = chunk.of[some]
    odd = [folded(np.frombuffer(o, np.uint64), PARITIES) for o in chunk.rows["odd"].to_pylist()]
    odd = (np.stack(odd) if odd else np.zeros((0, PARITIES), np.uint64)).view(np.int64)[of]
    out = {"key": chunk.key[some].view(np.int64), "class": chunk.names[of], "size": chunk.rows["size"].to_numpy()[of], "at": chunk.at[some].astype(np.int32)}
    return pa.table(out | {f"odd{i}": np.ascontiguousarray(odd[:, i]) for i in range(PARITIES)})


def keyed_of(rows: DataFrame, similarity: float) -> DataFrame:
    """KEYED, of the classes' keys that several classes have and one has early enough. Classes are dealt into chunks of
    some MB, so that copies meet and count once; keys travel as packed arrays, first alone, then those of use with the rest."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    number = max(parts, total // CHUNK)
    dealt = rows.where("keys is not null").select(F.pmod(F.xxhash64("class"), F.lit(number)).alias("chunk"), "class", "size", "keys", "odd").repartition(max(parts, number // 2), "chunk")
    least = 2 * similarity / (1 + similarity)

    def send(group: pa.Table) -> pa.Table:
        return sent_keys(Chunk(group, least), group["chunk"][0].as_py(), number)

    def pick(group: pa.Table, useful: pa.Table) -> pa.Table:
        return keyed_rows(Chunk(group, least), useful)

    marks = dealt.groupBy("chunk").applyInArrow(B.trimmed(send), "bucket long, chunk long, keys binary, states binary").groupBy("bucket").applyInArrow(B.trimmed(useful_keys), "chunk long, keys binary")
    return dealt.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(B.trimmed(pick), KEYED)


def sets_of(documents: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """class, grams: the hashes of a set's shingles; of all documents whose doc_id is wanted and maybe others."""
    sent = documents.sparkSession.sparkContext.broadcast(B.marked(wanted, "doc_id"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(B.may_want(sent.value, batch.column("doc_id").cast(pa.int64()).to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(some(batches)):
            sets = list(shingle_sets(block, shingle))
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "grams"])

    return documents.select("doc_id", "text").mapInArrow(run, "class long, grams binary")


def alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams"), batch.column("others"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                short, long = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if short >= similarity * long else 0
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def perhaps_alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 1 - 2 * similarity / (1 + similarity)
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column("odd"), batch.column("others"), batch.column("total").to_pylist(), strict=True):
                keep.append(apart(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) <= most * n + SLACK)
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def possible(x: str, y: str, similarity: float) -> Column:
    """Whether sets of these sizes, with this shingle at these places as their first in common, and of these parities
    can be that similar."""
    total = F.col(f"{x}.size") + F.col(f"{y}.size")
    shared = F.least(F.col(f"{x}.size") - F.col(f"{x}.at"), F.col(f"{y}.size") - F.col(f"{y}.at"))
    apart = sum((F.bit_count(F.col(f"{x}.odd{i}").bitwiseXOR(F.col(f"{y}.odd{i}"))) for i in range(PARITIES)), F.lit(0))
    sizes = F.least(f"{x}.size", f"{y}.size") >= similarity * F.greatest(f"{x}.size", f"{y}.size") - SLACK
    least = similarity / (1 + similarity)
    return sizes & (shared >= least * total - SLACK) & (apart <= (1 - 2 * least) * total + SLACK)


def groups(documents: DataFrame, known: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root): the doc_ids that a link joins to others, each with the smallest that it reaches, over the links
    `known` (a, b) and those between texts that are that similar."""
    spark = documents.sparkSession
    B.small_batches(spark)

    def kept(df: DataFrame, name: str) -> DataFrame:
        folder = B.scratch(spark, name)
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    documents = documents.where("doc_id is not null")
    rows = kept(classes(documents, shingle, similarity), "sets")
    first = kept(rows.groupBy("class").agg(F.min("doc_id").alias("doc_id")), "first")
    repeated = not rows.groupBy("doc_id", "class").count().where("count > 1").isEmpty()
    known = known.unionByName(rows.select("doc_id", "class").join(first.withColumnRenamed("doc_id", "b"), "class").where("doc_id != b").select(F.col("doc_id").alias("a"), "b"))
    near = F.col("size") - F.col("at") >= 2 * similarity / (1 + similarity) * F.col("size") - SLACK
    keyed = kept(keyed_of(rows, similarity).join(first, "class"), "keyed")

    def links(pairs: DataFrame) -> DataFrame:
        """(x, y) classes -> (a, b) doc_ids of the similar ones."""
        pairs = pairs.distinct()
        ends = pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct().join(first, "class")
        odd = rows.select("class", "doc_id", "size", "odd").join(ends.hint("merge"), ["class", "doc_id"], "left_semi")
        odd = odd.dropDuplicates(["class"]) if repeated else odd
        x, y = (odd.select(F.col("class").alias(c), F.col("size").alias(f"size_{c}"), F.col("odd").alias(o)) for c, o in (("x", "odd"), ("y", "others")))
        both = pairs.join(x.hint("merge"), "x").join(y.hint("merge"), "y").select("x", "y", "odd", "others", (F.col("size_x") + F.col("size_y")).alias("total"))
        pairs = kept(both.mapInArrow(perhaps_alike(similarity), "x long, y long"), "pairs")
        wanted = pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct().join(first.select("class", "doc_id"), "class")
        sets = sets_of(documents, wanted, shingle)
        sets = (sets.dropDuplicates(["class"]) if repeated else sets).join(wanted.select("class").hint("merge"), "class", "left_semi")
        # one plan at every size: how many documents are wanted depends on the corpus, so none is sent to the workers
        sized = pairs.join(sets.withColumnRenamed("class", "x"), "x").join(sets.select(F.col("class").alias("y"), F.col("grams").alias("others")), "y")
        found = sized.select(F.col("x").alias("a"), F.col("y").alias("b"), "grams", "others").mapInArrow(alike(similarity), "a long, b long")
        id_of = first.select("class", "doc_id")
        found = found.join(id_of.select(F.col("class").alias("a"), F.col("doc_id").alias("x")), "a").join(id_of.select(F.col("class").alias("b"), F.col("doc_id").alias("y")), "b")
        return kept(found.select(F.col("x").alias("a"), F.col("y").alias("b")), "links")

    entry = F.struct("class", "size", "at", *(f"odd{i}" for i in range(PARITIES)))
    ends = keyed.groupBy("key").agg(F.min(entry).alias("low"), F.max(entry).alias("high"))
    held = keyed.select("key", entry.alias("x")).join(ends, "key").select("x", F.explode(F.array("low", "high")).alias("y"))
    known = known.unionByName(links(held.where((F.col("x.class") != F.col("y.class")) & possible("x", "y", similarity)).select(F.least("x.class", "y.class").alias("x"), F.greatest("x.class", "y.class").alias("y"))))
    roots = kept(components(known), "roots")

    def rooted_by(roots: DataFrame) -> DataFrame:
        return keyed.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))

    def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
        return kept(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")

    for turn in range(TURNS):
        rooted = rooted_by(roots)
        largest = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("n")).where(f"most.count < n and n > {WHOLE}")
        sided = kept(rooted.join(largest, "key").select("key", entry.alias("e"), (F.col("root") == F.col("most.root")).alias("inside"), "most.count"), "sided")
        drawn = F.pmod(F.xxhash64("e.class", "key", F.lit(turn)), F.col("count")) < HUBS
        x, y = sided.where("not inside").select("key", F.col("e").alias("x")), sided.where("inside").where(drawn).select("key", F.col("e").alias("y"))
        more = links(x.join(y, "key").where(possible("x", "y", similarity)).select(F.least("x.class", "y.class").alias("x"), F.greatest("x.class", "y.class").alias("y")))
        if more.isEmpty():
            break
        roots = joined(roots, more)

    rooted = rooted_by(roots).join(ends.select("key", F.col("low.class").alias("first"), F.col("high.class").alias("last")), "key")
    # a shingle of one component has no pair to look at, one of few classes none that was not held against its ends
    differ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where(f"low < high and n > {WHOLE}").select("key", "n")
    rooted = kept(rooted.where("class != first and class != last").drop("first", "last").join(differ, "key").withColumn("of", F.ceil(F.col("n") / BLOCK).cast("int")), "rooted")
    x = rooted.where(near).withColumn("deal", F.pmod("class", "of").cast("int")).alias("x")
    y = rooted.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).alias("y")
    shorter = F.struct("x.size", "x.class") < F.struct("y.size", "y.class")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.deal") == F.col("y.deal")) & (F.col("x.root") != F.col("y.root")) & shorter & possible("x", "y", similarity))
    more = links(met.select(F.col("x.class").alias("x"), F.col("y.class").alias("y")))
    return roots if more.isEmpty() else joined(roots, more)
