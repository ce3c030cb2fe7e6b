"""Removal of repeated passages: compressed FM-indexes over shards of the corpus.

A window is `width` consecutive words of a document; a word goes if some window over it also starts in a document with
a smaller doc_id. A shard must see all windows of equal words together, so windows are dealt by content: a window's
seed is its leftmost smallest hash of SEED consecutive words. Windows of one document that follow each other with one
seed make a segment; it holds width to 2 * width - SEED words and stands for all of its windows.

1. Rows are dealt into blocks of some MB by a hash of the row, so no document, source or copy group fills a block.
   (This one exchange of the texts is read three times.)
2. Each block sends its distinct seeds to buckets, with the number of distinct segments of each; a bucket tells the blocks
   which of them other blocks have too, and which are hot: a stock phrase in many surroundings would bring them all to one
   shard. The windows of a hot seed are dealt one by one, by the hash of all their words, which equal windows share too.
3. Each block sends its distinct segments of shared seeds to the seeds' shards, with the smallest doc_id of each: a
   passage that a block holds a thousand times travels once.
4. A shard indexes its distinct segments and streams them through the index: backward search gives the matching
   statistic of every window end; ends at or above `width` are reported with the smallest doc_id of their interval.
5. Those come back to the blocks, which mark the words and join the kept ones.

Words are told apart by 64-bit hashes inside a shard, and segments by a 64-bit hash of their words: two different ones of
a shard or block are taken for equal with a chance of some n * n / 2**65 for n of them. A text of many MB makes a block of
its own.

Null or empty text: no words. A null doc_id is larger than any other: its words go where another document has them, and
nothing goes for its sake. Repeated rows share their doc_id, so neither removes words of the other. Other columns are
ignored. No rows: no result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .fmindex import DEPTH, FMIndex

SEED = 5
HOT = 4096  # distinct segments of a seed
BLOCK, BUCKET = 3 << 20, 8 << 20


class Segments:
    """A block's words, windows and segments, the same whenever they are computed."""

    def __init__(self, table: pa.Table, width: int, hot: np.ndarray | None = None):
        batch = table.combine_chunks().to_batches()[0] if table.num_rows else None
        self.batch = batch
        text = batch.column("text").fill_null("").cast(pa.large_string()).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.docs = B.ids_of(batch)
        self.words = w = B.Words(data, offsets - offsets[0])
        h = w.hashes() if len(w) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
        last = w.first[1:][row] - width  # of each word's document: the last place where a window can start
        self.windows = np.flatnonzero(np.arange(len(w)) <= last)
        self.row = row[self.windows]
        if not len(self.windows):
            self.first = self.count = self.doc = self.start = self.stop = np.zeros(0, np.int64)
            self.seed = self.deal = self.key = np.zeros(0, np.uint64)
            return
        grams = B.gram_hashes(h, SEED)
        best, where = grams[self.windows], self.windows.copy()
        for j in range(1, width - SEED + 1):
            other = grams[self.windows + j]
            less = other < best
            best[less], where[less] = other[less], (self.windows + j)[less]
        alone = np.isin(best, hot) if hot is not None and len(hot) else np.zeros(len(best), bool)
        new = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (self.row[1:] != self.row[:-1]) | alone[1:])))
        self.first = new  # of each segment: its first window's number
        self.count = np.diff(np.append(new, len(self.windows)))
        self.seed = best[new]
        self.start = self.windows[new]
        self.stop = self.start + self.count + width - 1
        self.doc = self.docs[self.row[new]]
        up, down = B.powers(len(h) + 1)
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=run[1:])
        words = (run[self.stop] - run[self.start]) * down[self.start]
        self.key = B.mixed(words + (self.stop - self.start).astype(np.uint64))
        self.deal = np.where(alone[new], B.mixed(words), self.seed)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct seeds, and how many distinct segments each has, 255 at most."""
        _, example = np.unique(self.key, return_index=True)
        seeds, n = np.unique(self.seed[example], return_counts=True)
        return seeds, np.minimum(n, 255).astype(np.uint8)

    def shared(self, seeds: np.ndarray) -> np.ndarray:
        """Segments whose seed other blocks have, or two documents of this one."""
        u, at = np.unique(self.seed, return_inverse=True)
        low, high = np.full(len(u), B.NULL_ID), np.full(len(u), np.iinfo(np.int64).min)
        np.minimum.at(low, at, self.doc)
        np.maximum.at(high, at, self.doc)
        return np.flatnonzero(((low < high) | np.isin(u, seeds))[at])

    def sent(self, seeds: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shared segments; of each, the number of its distinct segment; those by shard: example and shard."""
        some = self.shared(seeds)
        shard = (self.deal[some] % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.key[some], shard))
        k, s = self.key[some][order], shard[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]))) if len(order) else np.zeros(0, bool)
        number = np.zeros(len(some), np.int64)
        number[order] = np.cumsum(new) - 1
        return some, number, some[order[new]], s[new]


def seeds_of(rows: pa.Table, column: str) -> np.ndarray:
    got = [np.frombuffer(x, np.uint64) for x in rows.column(column).to_pylist() if x] if rows.num_rows else []
    return np.concatenate(got) if got else np.zeros(0, np.uint64)


def removal(documents: DataFrame, width: int = 13, texts: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per row; with texts also kept: the words that stay, joined by a space."""
    if not SEED <= width <= DEPTH:
        raise ValueError(f"a window has {SEED} to {DEPTH} words")
    spark = documents.sparkSession
    B.small_batches(spark)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks, buckets = max(2 * parts, size // BLOCK), max(parts, size // BUCKET)
    row = F.xxhash64(F.monotonically_increasing_id())
    dealt = documents.select("doc_id", "text", F.pmod(row, F.lit(n_blocks)).alias("block")).repartition(max(parts, size // (4 * BLOCK)), "block")

    def seeds(group: pa.Table) -> pa.Table:
        s, n = Segments(group, width).counted()
        to = s % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        s, n, to = s[order], n[order], to[order].astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(s) else np.zeros(1, np.int64)
        cuts = list(zip(edge[:-1], edge[1:], strict=True))
        return pa.table({"bucket": pa.array(to[edge[:-1]] if cuts else [], pa.int64()), "block": pa.array([group["block"][0].as_py()] * len(cuts), pa.int64()), "seeds": pa.array([s[a:b].tobytes() for a, b in cuts], pa.binary()), "sizes": pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary())})

    def common(group: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint64) for x in group["seeds"].to_pylist()]
        u, at, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        size = np.bincount(at, np.concatenate([np.frombuffer(x, np.uint8) for x in group["sizes"].to_pylist()]), len(u))
        more, large = (n > 1)[at], ((n > 1) & (size > hot))[at]
        ends = np.cumsum([len(r) for r in rows])
        both = [(r[more[e - len(r) : e]], r[large[e - len(r) : e]]) for r, e in zip(rows, ends, strict=True)]
        some = [i for i, (k, _) in enumerate(both) if len(k)]
        return pa.table({"block": group["block"].take(pa.array(some, pa.int64())), "seeds": pa.array([both[i][0].tobytes() for i in some], pa.binary()), "hot": pa.array([both[i][1].tobytes() for i in some], pa.binary())})

    def send(group: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "block": [], "texts": [], "sizes": [], "docs": []}
        if group.num_rows:
            s = Segments(group, width, seeds_of(rows, "hot"))
            some, number, example, shard = s.sent(seeds_of(rows, "seeds"), buckets)
            docs = np.full(len(example), B.NULL_ID)
            np.minimum.at(docs, number, s.doc[some])
            raw = s.words.data.tobytes()
            texts = [raw[a:b] for a, b in zip(s.words.starts[s.start[example]].tolist(), s.words.ends[s.stop[example] - 1].tolist(), strict=True)]
            edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(1, np.int64)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                for k, v in (("shard", int(shard[a])), ("block", group["block"][0].as_py()), ("texts", b"".join(texts[a:b])), ("sizes", np.array([len(t) for t in texts[a:b]], np.int32).tobytes()), ("docs", docs[a:b].tobytes())):
                    out[k].append(v)
        return pa.table({k: pa.array(v, pa.binary() if k in ("texts", "sizes", "docs") else pa.int64()) for k, v in out.items()})

    def search(group: pa.Table) -> pa.Table:
        sizes = [np.frombuffer(x, np.int32) for x in group["sizes"].to_pylist()]
        least = shard_minima(np.frombuffer(b"".join(group["texts"].to_pylist()), np.uint8), np.concatenate(sizes).astype(np.int64), np.concatenate([np.frombuffer(x, np.int64) for x in group["docs"].to_pylist()]), width)
        ends = np.cumsum([len(x) for x in sizes])
        return pa.table({"block": group["block"], "shard": group["shard"], "least": pa.array([b"".join(x.tobytes() for x in least[e - len(x) : e]) for x, e in zip(sizes, ends, strict=True)], pa.binary())})

    def finish(group: pa.Table, found: pa.Table) -> pa.Table:
        return kept(group, found, width, buckets, texts)

    marks = dealt.groupBy("block").applyInArrow(B.trimmed(seeds), "bucket long, block long, seeds binary, sizes binary").groupBy("bucket").applyInArrow(B.trimmed(common), "block long, seeds binary, hot binary")
    segments = dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(B.trimmed(send), "shard long, block long, texts binary, sizes binary, docs binary")
    found = segments.groupBy("shard").applyInArrow(B.trimmed(search), "block long, shard long, least binary")
    both = found.select("block", F.col("shard"), F.col("least").alias("payload"), F.lit(None).cast("binary").alias("hot")).unionByName(marks.select("block", F.lit(-1).cast("long").alias("shard"), F.col("seeds").alias("payload"), "hot"))
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(B.trimmed(finish), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def shard_minima(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each segment, the smallest doc_id of each of its windows in this shard."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    w = B.Words(data, offsets)
    h = w.hashes()
    n = np.diff(w.first)
    vocabulary, ids = np.unique(h, return_inverse=True)
    up, down = B.powers(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=run[1:])
    key = B.mixed((run[w.first[1:]] - run[w.first[:-1]]) * down[w.first[:-1]] + n.astype(np.uint64))
    _, example, number = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(example), B.NULL_ID)
    np.minimum.at(least, number, docs)
    # the distinct segments one after another, each followed by 0
    length = n[example]
    at = np.cumsum(length + 1) - length - 1
    text = np.zeros(int((length + 1).sum()), np.int64)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(at, length) + inside] = ids[np.repeat(w.first[example], length) + inside] + 1
    of = np.repeat(np.arange(len(example)), length + 1)
    index = FMIndex(text, len(vocabulary) + 1)
    count = length - width + 1
    first = np.cumsum(count) - count
    ends = np.repeat(at + width, count) + np.arange(int(count.sum())) - np.repeat(first, count)
    matched, low, high = index.matching(text, ends, width)
    out = least[of[ends - 1]]
    hit = np.flatnonzero(matched >= width)
    if len(hit):
        lows, to = np.unique(low[hit], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[to] = high[hit]
        by_place = np.append(least[of[index.places]], B.NULL_ID)
        out[hit] = np.minimum.reduceat(by_place, np.stack((lows, highs), 1).ravel())[::2][to]
    parts = np.split(out, first[1:]) if len(example) else []
    return [parts[k] for k in number.tolist()]


def kept(group: pa.Table, found: pa.Table, width: int, shards: int, texts: bool) -> pa.Table:
    names = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")[: 4 + texts]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 + texts]
    if not group.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    s = Segments(group, width, seeds_of(found, "hot"))
    gone = np.zeros(len(s.words) + 1, np.int64)
    if found.num_rows:
        to, payload = found["shard"].to_numpy(), found["payload"].to_pylist()
        seeds = [np.frombuffer(p, np.uint64) for k, p in zip(to, payload, strict=True) if k < 0]
        least = [p for _, p in sorted((k, p) for k, p in zip(to.tolist(), payload, strict=True) if k >= 0)]
    else:
        seeds, least = [], []
    some, number, example, _ = s.sent(np.concatenate(seeds) if seeds else np.zeros(0, np.uint64), shards) if len(s.windows) else (None,) * 4
    if some is not None and len(some):
        minima = np.frombuffer(b"".join(least), np.int64)
        begin = np.cumsum(s.count[example]) - s.count[example]
        n = s.count[some]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        smaller = minima[np.repeat(begin[number], n) + inside] < np.repeat(s.doc[some], n)
        at = (np.repeat(s.start[some], n) + inside)[smaller]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + width, -1)
    stays = np.cumsum(gone)[:-1] == 0
    raw, first = s.words.data.tobytes(), s.words.first.tolist()
    starts, ends = s.words.starts.tolist(), s.words.ends.tolist()
    out = []
    removed = np.concatenate(([0], np.cumsum(~stays)))
    for i, doc in enumerate(s.batch.column("doc_id").to_pylist()):
        a, b = first[i], first[i + 1]
        text = b" ".join([raw[starts[k] : ends[k]] for k in (np.flatnonzero(stays[a:b]) + a).tolist()])
        out.append((doc, b - a, int(removed[b] - removed[a]), hashlib.sha256(text).hexdigest(), *([text.decode("utf-8", "replace")] if texts else ())))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
