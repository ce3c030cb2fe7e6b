"""Text columns as byte blocks: what the operators do per word, they do with numpy over a block of some MB.

A block is a run of whole rows of an Arrow batch. Its size bounds a worker's memory; one text longer than the
bound makes a block of its own, so no text is ever cut.
"""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BLOCK_BYTES = 1 << 20
NULL_ID = np.iinfo(np.int64).max  # the place of a null doc_id: after all others

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}
KEPT_POWERS = 4 << 20  # a longer text's powers are not kept


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    made = {}
    for name, b in (("up", BASE), ("down", BASE_INV)):
        out = np.full(max(n, 1 << 20), b, np.uint64)
        out[0] = 1
        made[name] = np.multiply.accumulate(out)
    if n <= KEPT_POWERS:
        _powers.update(made)
    return made["up"][:n], made["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Rows lo..hi of a batch: ids, the texts' bytes (null: empty) and where each text starts and ends in them."""

    def __init__(self, batch: pa.RecordBatch, text: pa.Array, lo: int, hi: int, offsets: np.ndarray, data: np.ndarray):
        self.batch = batch.slice(lo, hi - lo)
        self.n = hi - lo
        self.offsets = offsets[lo : hi + 1] - offsets[lo]
        self.data = data[offsets[lo] : offsets[hi]]

    def texts(self) -> list[bytes]:
        raw, o = self.data.tobytes(), self.offsets.tolist()
        return [raw[a:b] for a, b in zip(o, o[1:], strict=False)]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, owner: str = "") -> Iterator[Block]:
    """owner: the operator whose remembered things a worker keeps meanwhile."""
    serving(owner)
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        text = text.cast(pa.large_string()) if not pa.types.is_large_string(text.type) else text
        text = text.fill_null("").cast(pa.large_binary())
        _, where, raw = text.buffers()
        offsets = np.frombuffer(where, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
            yield Block(batch, text, lo, hi, offsets, data)
            lo = hi
        del batch, text, where, raw, offsets, data
    released()


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a block's texts: byte starts and ends, the first word of each row, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.data = data
        n = len(data)
        gap = space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = gap[:-1]
        after[:-1] = gap[1:]
        self.starts = np.flatnonzero(~gap & (before | edge[:n]))
        self.ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # rows' words: first[i]..first[i+1]

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        run = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[self.data] * up[: len(self.data)], out=run[1:])
        return mixed((run[self.ends] - run[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries of h; rows' edges are the caller's."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * BASE + h[j : j + n]
    return mixed(out)


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    return batch.column(column).cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


BITS = 1 << 25  # of what tells tasks which rows a later join may want


def marked(wanted: DataFrame, column: str) -> np.ndarray:
    """BITS bits, those set whose place is a wanted value modulo BITS: what is not marked is not wanted."""
    at = F.pmod(F.col(column), F.lit(BITS))
    words = wanted.groupBy((at / 64).cast("long").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def may_want(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (bits[(values & (BITS - 1)) >> 6] >> (values & 63)) & 1 == 1


_kept: dict[str, dict[str, tuple]] = {}


def serving(owner: str) -> None:
    """A worker serves one operator after another: it forgets what it remembers for any other than this one."""
    if _kept and owner not in _kept:
        _kept.clear()
        released()


def remembered(owner: str, slot: str, key: object, make: Callable):
    """What a worker remembers for an operator between tasks; a slot holds one thing."""
    serving(owner)
    held = _kept.setdefault(owner, {})
    if slot not in held or held[slot][0] != key:
        held.pop(slot, None)
        held[slot] = (key, make())
    return held[slot][1]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def released() -> None:
    """Gives unused memory back to the system: an idle worker is alive for a minute."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def trimmed(f: Callable) -> Callable:
    """A function of groups that gives memory back after each."""
    if f.__code__.co_argcount == 1:

        def one(group: pa.Table) -> pa.Table:
            serving("")
            out = f(group)
            del group
            released()
            return out

        return one

    def two(group: pa.Table, other: pa.Table) -> pa.Table:
        serving("")
        out = f(group, other)
        del group, other
        released()
        return out

    return two


BATCH, USUAL, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4m"


def small_batches(spark) -> None:
    """Rows travel to Python in batches of some MB, unless the session has its own setting: texts and sets can be long."""
    now = str(spark.conf.get(BATCH, str(USUAL))).lower()
    if now in (str(USUAL), f"{USUAL}b", "64m", "64mb"):
        spark.conf.set(BATCH, SMALL)


def scratch(spark, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir. Where that is unset, a local master alone gets a
    folder of its own, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        if "folder" not in _local:
            _local["folder"] = tempfile.mkdtemp(prefix="spark-")
        base = _local["folder"]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_local: dict = {}


def documents(spark, sf_dir: str):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
