"""A smoothed bigram model in a log-frequency Bloom filter.

Tokens are words (A-Z lower-cased) and one end a text; the end also stands before a text's first token. So a token's count
as a context is its count as a token, and the filter's events are tokens and (context, token) pairs.

Filter. A count c has the level of the largest of VALUES that is at most c (1, 2 ... 8, then steps of a quarter); the filter
holds the keys (event, 1) .. (event, level). A count is read back by probing levels until one is missing. Every event of
the training texts is held, however rare and however many there are, so the filter grows with the corpus: it is cut into
segments by the event's hash, each of bounded size, and stored as a table of bit arrays, a row a segment (`fit`). Scoring
knows the training texts by that table alone.

`fit`: tasks count the events of FLUSH training tokens at a time and send them to the segments; a segment sums them and
writes its bits, beside its tokens with their exact counts (for the base score).

`scores`, where the stored filter is of at most HELD bytes: it is sent to all workers, and tasks probe it as they read the
texts. Larger ones stay cut, and probes go to the segments; results are the same:
1. Rows are dealt into blocks of some MB by a hash of the row. (This one exchange of the texts is read twice.)
2. A block sends its distinct events to the segments.
3. Each stored segment is joined to what was asked of it and probed once for each distinct event; the levels go back to the
   blocks, in the order of the request.
4. A block scores its rows.

An event travels at most once a block or FLUSH, and segments are cut by the pair's hash, so a frequent context or token
fills no segment.

Probability of w after h: (n(h, w) + MU * q(w)) / (n(h) + MU). n(h, w): the pair's count as read, the lower end of its level;
n(h): the upper end of the context's; q: add-0.1 unigrams from counts as read. Over all w it sums to at most 1, but for
false positives (some 0.8 % of the events that were never seen read as seen once). A context that was never seen gives q(w).

The base score is add-0.1 unigrams from exact counts. Words are told apart by 64-bit hashes: among a billion distinct words,
two share one with a chance of some 3 %, and those two would then be counted as one. Pairs are told apart by 32 bits beside
their segment, whose size is bounded (of two million pairs there, a pair that was never seen equals one by 0.05 %).

Null or empty text: the end token alone. Null doc_id: scored, not learned from, not held out. Repeated rows keep their
own rows and count as often as they are there. No training rows: counts of 0. A text of many MB is a block of its own.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

MU, PROBES, ADDED = 400.0, 7, 0.1  # MU: the best of eight on a tenth of the training rows, learning from the rest
BLOCK, SEGMENT = 5 << 20, 16 << 20  # bytes of text in a block; for which there is a segment
HELD = 4 << 20  # bytes of a filter that is sent to all workers
FLUSH = 2_000_000  # tokens that a task counts at once
END = np.uint64(0x5851F42D4C957F2D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PAIR = np.uint64(0x3333)


def values(top: float = 2.0**62) -> np.ndarray:
    """What levels 0, 1, 2 ... stand for."""
    out = [0, 1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, np.int64)


VALUES = values()


def level(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(VALUES, count, side="right") - 1


def steps(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a block's texts one after another, and each row's first. As each text ends with the end, which also
    stands before a text, a token's context is always the token before it (before the first: the end)."""
    w = B.Words(LOWER[block.data], block.offsets)
    n = len(w)
    token = np.full(n + block.n, END)
    token[np.arange(n) + np.repeat(np.arange(block.n), np.diff(w.first))] = w.hashes()
    return token, w.first[:-1] + np.arange(block.n)


class Segment:
    """A Bloom filter of the keys (event, level), for events known by 64 bits."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        levels = level(counts)
        entries = int(levels.sum())
        self.bits = np.uint64(max(64, int(entries * PROBES / math.log(2))))
        table = np.zeros(int(self.bits), bool)
        ends = np.cumsum(levels)
        for lo in range(0, entries, 1_000_000):
            entry = np.arange(lo, min(entries, lo + 1_000_000))
            k = np.searchsorted(ends, entry, side="right")
            at = self.at_level(keys[k], entry - ends[k] + levels[k] + 1)
            for probe in range(PROBES):
                table[self.place(at, probe)] = True
        self.table = np.packbits(table, bitorder="little")

    @classmethod
    def stored(cls, bits: bytes, size: int) -> Segment:
        out = cls.__new__(cls)
        out.table, out.bits = np.frombuffer(bits, np.uint8), np.uint64(size)
        return out

    @staticmethod
    def at_level(keys: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        return B.mixed(keys + np.asarray(j).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        """The upper half of an odd multiple of the key, scaled to the bits (fewer than 2**32): no division."""
        return (((keys * np.uint64(2 * probe + 1) ^ keys >> np.uint64(7 + probe)) >> np.uint64(32)) * self.bits >> np.uint64(32)).astype(np.int64)

    def present(self, keys: np.ndarray) -> np.ndarray:
        """Places in keys whose every probe finds its bit set."""
        still = np.arange(len(keys))
        for probe in range(PROBES):
            at = self.place(keys, probe)
            hit = np.flatnonzero((self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(hit) < len(still):
                still, keys = still[hit], keys[hit]
        return still

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level of each key. As all lower ones are there too, levels 1, 2, 4, 8 ... are probed until one is
        missing, then the gap is halved."""
        low, high = np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
        left, j = np.arange(len(keys)), 1
        while len(left):
            left = left[self.present(self.at_level(keys[left], j))]
            low[left], high[left] = j, 2 * j
            j *= 2
        left = np.flatnonzero(high - low > 1)
        while len(left):
            middle = (low[left] + high[left]) // 2
            there = np.zeros(len(left), bool)
            there[self.present(self.at_level(keys[left], middle))] = True
            low[left[there]], high[left[~there]] = middle[there], middle[~there]
            left = left[high[left] - low[left] > 1]
        return low


def distinct(token: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct tokens and the distinct pairs' keys; of each place the numbers of its token, context and pair."""
    words, at = np.unique(token, return_inverse=True)
    context = np.concatenate((at[-1:], at[:-1]))  # the last token is an end
    size = np.int64(len(words))
    codes, pair = np.unique(context * size + at, return_inverse=True)
    return words, B.mixed(words[codes // size] * B.BASE + words[codes % size] + PAIR), at, context, pair


def dealt(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which keys go to the segments, and the segments in that order."""
    to = (keys % np.uint64(segments)).astype(np.int64)
    order = np.lexsort((keys, to))
    return order, to[order]


def packed(x: np.ndarray) -> bytes:
    """Ascending whole numbers as gaps of as few bytes as the largest needs; the first byte says how many."""
    gaps = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    gaps = np.frombuffer(raw, np.uint8)[1:].reshape(-1, raw[0])
    out = np.zeros((len(gaps), 8), np.uint8)
    out[:, : raw[0]] = gaps
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def by_segment(words: np.ndarray, word_to: np.ndarray, pairs: np.ndarray, pair_to: np.ndarray) -> Iterator[tuple[int, slice, slice, bytes, bytes]]:
    """Each segment's share of tokens and of pairs; a pair is known by 32 bits beside its segment."""
    for to in np.union1d(word_to, pair_to).tolist():
        a, b = np.searchsorted(word_to, (to, to + 1))
        c, d = np.searchsorted(pair_to, (to, to + 1))
        yield to, slice(a, b), slice(c, d), packed(words[a:b]), packed(pairs[c:d] >> np.uint64(32))


COUNTS = pa.schema([("segment", pa.int64()), ("words", pa.binary()), ("word_n", pa.binary()), ("pairs", pa.binary()), ("pair_n", pa.binary())])
FILTER = pa.schema([("segment", pa.int64()), ("bits", pa.binary()), ("size", pa.int64()), ("words", pa.binary()), ("word_n", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("read", pa.int64())])
REQUEST = pa.schema([("segment", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())])
ANSWER = pa.schema([("segment", pa.int64()), ("block", pa.int64()), ("word_level", pa.binary()), ("word_n", pa.binary()), ("pair_level", pa.binary())])
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def events(token: np.ndarray, segments: int) -> pa.Table:
    """The events of some texts' tokens, each with how often it occurs in them."""
    words, pairs, at, _, pair = distinct(token)
    (w, word_to), (p, pair_to) = dealt(words, segments), dealt(pairs, segments)
    word_n, pair_n = np.bincount(at)[w].astype(np.uint32), np.bincount(pair)[p].astype(np.uint32)
    return table([(to, x, word_n[a].tobytes(), y, pair_n[c].tobytes()) for to, a, c, x, y in by_segment(words[w], word_to, pairs[p], pair_to)], COUNTS)


def built(group: pa.Table) -> pa.Table:
    """A segment's counts -> its filter, its tokens with their exact counts, and the sums of those."""

    def summed(name: str) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([unpacked(x) for x in group[name + "s"].to_pylist()]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.concatenate([np.frombuffer(x, np.uint32) for x in group[name + "_n"].to_pylist()]).astype(np.int64))
        return keys, total

    (word, word_n), (pair, pair_n) = summed("word"), summed("pair")
    s = Segment(np.concatenate((B.mixed(word), B.mixed(pair + PAIR))), np.concatenate((word_n, pair_n)))
    read = int(VALUES[level(word_n)].sum())
    return table([(group["segment"][0].as_py(), s.table.tobytes(), int(s.bits), packed(word), word_n.tobytes(), int(word_n.sum()), len(word), read)], FILTER)


class Events:
    """A block's rows as events, the same whenever they are computed: distinct tokens and pairs in the order in which they
    are sent to the segments, and of each place in the texts the numbers of its token, context and pair."""

    def __init__(self, group: pa.Table, segments: int):
        whole = group.select(["text"]).combine_chunks().to_batches()[0]
        whole = pa.RecordBatch.from_arrays([whole.column("text").fill_null("").cast(pa.large_string())], names=["text"])
        token, self.first = steps(next(B.blocks(iter([whole]), limit=1 << 62)))
        self.lengths = np.diff(np.append(self.first, len(token)))
        words, pairs, at, context, pair = distinct(token)
        order, self.word_to = dealt(words, segments)
        self.words, place = words[order], np.argsort(order)
        self.token, self.context = place[at], place[context]
        order, self.pair_to = dealt(pairs, segments)
        self.pairs, self.pair = pairs[order], np.argsort(order)[pair]

    def requests(self, number: int) -> pa.Table:
        return table([(to, number, x, y) for to, _, _, x, y in by_segment(self.words, self.word_to, self.pairs, self.pair_to)], REQUEST)


def probed(asked: pa.Table, stored: pa.Table) -> pa.Table:
    """The levels that a stored segment gives for what blocks ask of it (each event probed once), and the tokens' exact
    counts. A segment that is not stored holds nothing."""
    words, pairs = ([unpacked(x) for x in asked[name].to_pylist()] for name in ("words", "pairs"))
    word, word_at = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True)
    pair, pair_at = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs]), return_inverse=True)
    word_level, pair_level, word_n = np.zeros(len(word), np.uint8), np.zeros(len(pair), np.uint8), np.zeros(len(word), np.int64)
    if stored.num_rows:
        row = stored.to_pylist()[0]
        s = Segment.stored(row["bits"], row["size"])
        word_level, pair_level = s.levels(B.mixed(word)).astype(np.uint8), s.levels(B.mixed(pair + PAIR)).astype(np.uint8)
        known, n = unpacked(row["words"]), np.frombuffer(row["word_n"], np.int64)
        at = np.minimum(np.searchsorted(known, word), len(known) - 1)
        word_n = np.where(known[at] == word, n[at], 0)
    w, p = np.cumsum([0, *map(len, words)]), np.cumsum([0, *map(len, pairs)])
    cut = lambda x, ends: [x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    columns = (asked["segment"].to_pylist(), asked["block"].to_pylist(), cut(word_level[word_at], w), cut(word_n[word_at], w), cut(pair_level[pair_at], p))
    return table(list(zip(*columns, strict=True)), ANSWER)


def probabilities(pair: np.ndarray, context: np.ndarray, token: np.ndarray, mass: float, mu: float) -> np.ndarray:
    """From levels; mass: of the unigrams as read."""
    q = (VALUES[token] + ADDED) / mass
    n = np.where(context > 0, VALUES[np.minimum(context + 1, len(VALUES) - 1)] - 1, 0)
    return (np.where(context > 0, VALUES[pair], 0) + mu * q) / (n + mu)


class Model(NamedTuple):
    """filter: a row a segment, stored in the shared folder; size: the bytes of all rows; tokens, types and read: sums of
    the tokens' exact counts, of their number, and of the counts as read."""

    filter: DataFrame
    segments: int
    size: int
    tokens: int
    types: int
    read: int


def scored(group: pa.Table, found: pa.Table, segments: int, tokens: int, types: int, read: int, mu: float = MU) -> pa.Table:
    e = Events(group, segments)
    order = np.argsort(found["segment"].to_numpy())
    column = lambda name, kind: np.frombuffer(b"".join(found[name].take(pa.array(order)).to_pylist()), kind)
    word_level, pair_level, n = column("word_level", np.uint8), column("pair_level", np.uint8), column("word_n", np.int64)
    p = probabilities(pair_level[e.pair], word_level[e.context], word_level[e.token], read + ADDED * (types + 1), mu)
    base = np.log10((n + ADDED) / (tokens + ADDED * (types + 1)))
    sums = lambda x: pa.array(np.add.reduceat(x, e.first))
    return pa.table({"doc_id": group["doc_id"], "n_tokens": pa.array(e.lengths), "n_known": sums((n > 0).astype(np.int64)[e.token]), "base_score": sums(base[e.token]), "score": sums(np.log10(p))})


def fit(training: DataFrame, segments: int) -> Model:
    """The model of the texts of a table, stored: learned once, used by any number of score() calls."""
    spark = training.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in B.blocks(batches):
            held.append(steps(block)[0])  # each ends with an end, which also stands before the next one's first token
            size += len(held[-1])
            if size >= FLUSH:
                yield from events(np.concatenate(held), segments).to_batches()
                held, size = [], 0
        if size:
            yield from events(np.concatenate(held), segments).to_batches()

    folder = B.scratch(spark, "filter")
    training.select("text").mapInArrow(run, ddl(COUNTS)).groupBy("segment").applyInArrow(B.trimmed(built), ddl(FILTER)).write.parquet(folder)
    stored = spark.read.schema(ddl(FILTER)).parquet(folder)
    sums = stored.agg(F.sum(F.octet_length("bits") + F.octet_length("words") + F.octet_length("word_n")), F.sum("tokens"), F.sum("types"), F.sum("read")).first()
    return Model(stored, segments, *(int(x or 0) for x in sums))


def scores(documents: DataFrame, model: Model, blocks: int, mu: float = MU) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, n_known, base_score, score, one row per row."""
    spark, segments, sums = documents.sparkSession, model.segments, model[3:]
    if model.size <= HELD:
        sent = spark.sparkContext.broadcast({r["segment"]: table([tuple(r)], FILTER) for r in model.filter.collect()})
        nothing = table([], FILTER)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in B.blocks(batches):
                group = pa.Table.from_batches([block.batch])
                asked = Events(group, segments).requests(0)
                found = [probed(asked.slice(k, 1), sent.value.get(s, nothing)) for k, s in enumerate(asked["segment"].to_pylist())]
                yield from scored(group, pa.concat_tables(found), segments, *sums, mu).to_batches()

        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.xxhash64(F.monotonically_increasing_id())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(row, F.lit(blocks)).alias("block")).repartition(max(parts, blocks // 4), "block")

    def ask(group: pa.Table) -> pa.Table:
        return Events(group, segments).requests(group["block"][0].as_py())

    def finish(group: pa.Table, found: pa.Table) -> pa.Table:
        return scored(group, found, segments, *sums, mu)

    asked = rows.groupBy("block").applyInArrow(B.trimmed(ask), ddl(REQUEST))
    found = asked.groupBy("segment").cogroup(model.filter.groupBy("segment")).applyInArrow(B.trimmed(probed), ddl(ANSWER))
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(B.trimmed(finish), SCORED)


def score(documents: DataFrame, held: int = 0, of: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row; learns from the rows whose
    crc32(doc_id) mod `of` is not `held`."""
    spark = documents.sparkSession
    B.small_batches(spark)
    part = F.crc32(F.col("doc_id").cast("string")) % of
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = fit(documents.where(part != held), max(parts, size // SEGMENT))
    out = scores(documents, model, max(2 * parts, size // BLOCK))
    return out.select("doc_id", F.coalesce(part == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
