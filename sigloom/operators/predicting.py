"""Prediction: a chunk table meets a table of models in Arrow batches, and reads get calls.

Every batch of chunks is put into the models' input form once and scored by all models, so chunks are neither copied a model
nor shuffled. A worker holds a bounded number of loaded models, those used last. What follows, the reduction to a score a
read, votes, thresholds and tags, is aggregation and expressions.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammar
from . import metrics, votes

MOST_MODELS, MOST_TEXT = 4096, 16 << 20  # models of a table, and characters of their locations: what every task is told
HELD = 32  # loaded models of a worker

CODES = np.full(256, -1, np.int8)
for _letters, _code in (("Aa", 0), ("Cc", 1), ("Gg", 2), ("TtUu", 3)):
    CODES[[ord(c) for c in _letters]] = _code

Model = Callable[[dict[str, np.ndarray]], np.ndarray]


@dataclass(frozen=True)
class Inputs:
    """What the models take: signal (rows, channels, signal_len), sequence (rows, 4, kmer) or, by signal_kmer, (rows, 4 * letters,
    signal_len), and features (rows, channels, kmer, or the whole window if wide)."""

    signal_len: int
    kmer: int
    signal_kmer: tuple[int, int] | None = None
    features: bool = False
    feature_start: int | None = None
    dwell_offset: int = 0
    wide: bool = False

    def of(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        names = [c for c in ("signal", "signal_residual") if c in batch.schema.names]
        out = {"signal": np.stack([fitted(batch.column(c), self.signal_len) for c in names], 1)}
        if self.signal_kmer is None:
            out["sequence"] = one_hot(batch.column("sequence").to_pylist(), self.kmer)
        else:
            rows = zip(batch.column("sequence_with_kmer_context").to_pylist(), batch.column("seq_to_sig").to_pylist(), strict=True)
            out["sequence"] = np.stack([spread_kmers(text, places, self.signal_len, *self.signal_kmer) for text, places in rows])
        if self.features:
            held = np.array(batch.column("features").to_pylist(), np.float64)
            if not self.wide and held.shape[2] > self.kmer:
                start = -(self.kmer // 2) if self.feature_start is None else self.feature_start
                low, high = grammar.kmer_slice(self.kmer // 2, start, self.dwell_offset, self.kmer, held.shape[2])
                held = held[:, :, low:high]
            out["features"] = held
        return out

    def columns(self, chunks: DataFrame) -> list[str]:
        wanted = ["signal", "signal_residual", *(["sequence"] if self.signal_kmer is None else ["sequence_with_kmer_context", "seq_to_sig"]), *(["features"] if self.features else [])]
        return [c for c in wanted if c in chunks.columns or c != "signal_residual"]


def fitted(column: pa.Array, n: int) -> np.ndarray:
    """Lists as rows of n: filled with 0 on the right, or cut about the middle."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == n).all():
        return flat.reshape(-1, n).astype(np.float64)
    out, ends = np.zeros((len(sizes), n)), np.concatenate([[0], np.cumsum(sizes)])
    for row, a, size in zip(out, ends, sizes, strict=False):
        skip = max(0, (size - n) // 2)
        part = flat[a + skip : a + min(size, skip + n)]
        row[: len(part)] = part
    return out


def one_hot(texts: list[str], n: int) -> np.ndarray:
    if any(len(t) != n for t in texts):
        raise ValueError(f"a chunk's k-mer is not {n} letters long")
    codes = CODES[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)].reshape(-1, n)
    return (codes[:, None, :] == np.arange(4)[:, None]).astype(np.float64)


def spread_kmers(text: str, places: list[int], n: int, before: int, after: int) -> np.ndarray:
    """Row 4 * place + base is 1 over the samples of a base whose k-mer has that base there."""
    codes = CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    edges = np.clip(np.asarray(places), 0, n)
    base = np.repeat(np.arange(len(edges) - 1), np.maximum(np.diff(edges), 0))
    sample = np.arange(edges[0], edges[0] + len(base))
    out = np.zeros((4 * (before + 1 + after), n))
    for place in range(before + 1 + after):
        inside = base + place < len(codes)
        code = codes[(base + place)[inside]]
        out[4 * place + code[code >= 0], sample[inside][code >= 0]] = 1
    return out


class Held:
    """The models that a worker used last."""

    def __init__(self) -> None:
        self.models: OrderedDict[tuple, Model] = OrderedDict()

    def get(self, load: Callable[[str], Model], where: str, most: int) -> Model:
        key = (load.__module__, load.__qualname__, where)
        if key not in self.models:
            while len(self.models) >= most:
                self.models.popitem(last=False)
            self.models[key] = load(where)
        self.models.move_to_end(key)
        return self.models[key]


_held = Held()


def onnx(where: str) -> Model:
    """An ONNX model by path, which every worker can read; inputs by name, or the signal alone if it takes one."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    session = onnxruntime.InferenceSession(where, options)
    names = [i.name for i in session.get_inputs()]
    return lambda x: np.asarray(session.run(None, {names[0]: x["signal"].astype(np.float32)} if len(names) == 1 else {k: x[k].astype(np.float32) for k in names})[0])


def listed(models: DataFrame, most: int = MOST_MODELS) -> list:
    """The models in their order, as every task must know them; too many are an error, not a slow job."""
    rows = models.orderBy("place").limit(most + 1).collect()
    if not rows:
        raise ValueError("there are no models")
    if len(rows) > most or sum(len(r["location"]) for r in rows) > MOST_TEXT:
        raise ValueError(f"more than {most} models, or {MOST_TEXT} characters of locations")
    return rows


def scored(chunks: DataFrame, models: DataFrame, inputs: Inputs, load: Callable[[str], Model] = onnx, keep: tuple[str, ...] = ("read_id", "base_index"), held: int = HELD) -> DataFrame:
    """keep, logits: the outputs of all models (place, location) in the order of place, one list."""
    where = [r["location"] for r in listed(models)]
    taken = inputs.columns(chunks)
    both = [*keep, *[c for c in taken if c not in keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = inputs.of(batch)
            out = [np.asarray(_held.get(load, w, held)(x), np.float64).reshape(batch.num_rows, -1) for w in where]
            values = np.concatenate(out, axis=1)
            ends = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=[*keep, "logits"])

    fields = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in keep)
    return chunks.select(*both).mapInArrow(run, f"{fields}, logits array<double>")


def of_read(rows: DataFrame, which: str, *columns: str) -> DataFrame:
    """A row a read: the columns of its first or last chunk in base order. A bundle takes the last, as its later chunks
    replace the earlier; a single model's call is the first's."""
    best = {"first": F.min, "last": F.max}[which]
    return rows.groupBy("read_id").agg(best(F.struct("base_index", *columns)).alias("x")).select("read_id", "x.*")


def pair_probabilities(scores: DataFrame, models: DataFrame) -> DataFrame:
    """read_id, base_index, probs: a probability a pair model, its logit scaled by the model's platt_a and platt_b where
    there are any, in the order of place."""
    rows = listed(models)
    platt = F.array(*[F.struct(F.lit(1.0 if r["platt_a"] is None else float(r["platt_a"])).alias("a"), F.lit(0.0 if r["platt_b"] is None else float(r["platt_b"])).alias("b")) for r in rows])
    told = F.concat(F.lit(f"{len(rows)} models gave "), F.size("logits").cast("string"), F.lit(" scores"))
    fits = F.when(F.size("logits") == len(rows), F.col("logits")).otherwise(F.raise_error(told).cast("array<double>"))
    return scores.withColumn("probs", F.zip_with(fits, platt, lambda x, p: 1 / (1 + F.exp(-(p["a"] * x + p["b"]))))).drop("logits")


METHODS = {"naive": lambda v, p: votes.pairwise(v, p), "weighted": lambda v, p: votes.pairwise(v, p, weighted=True), "tournament": votes.tournament, "one_vs_all": votes.one_vs_all}


def called_by_bundle(probabilities: DataFrame, pairs: DataFrame, method: str = "naive") -> DataFrame:
    """read_id, probs, call, confidence: a read's probabilities put to the vote; pairs are (pair, neg, pos, place)."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method!r}")
    reads = of_read(probabilities, "last", "probs")
    cast = reads.select("read_id", F.posexplode("probs").alias("place", "prob")).join(F.broadcast(pairs.select("pair", "place")), "place").select("read_id", "pair", "prob")
    return reads.join(METHODS[method](cast, pairs), "read_id").select("read_id", "probs", "call", "confidence")


def called_by_classes(scores: DataFrame, labels: list[str], temperature: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """read_id, base_index, keep, probs, call, confidence of each read's first chunk: softmax over one model's classes."""
    probs = metrics.softmax(F.transform("logits", lambda x: x / temperature))
    rows = of_read(scores.withColumn("probs", probs).drop("logits"), "first", *keep, "probs")
    name = F.get(F.array(*[F.lit(x) for x in labels]), metrics.argmax(F.col("probs")))
    return rows.withColumn("call", F.coalesce(name, metrics.argmax(F.col("probs")).cast("string"))).withColumn("confidence", F.array_max("probs"))


def tagged(calls: DataFrame, least_confidence: int = 0, least_margin: int = 0, abstain_disrupted: bool = False) -> DataFrame:
    """Adds aa, ac, am and pp, the tags of a call: aa is `unc` below a threshold, both of which are bytes; ac and am hold the
    figures even then. abstain_disrupted: the margin binds only where junction_indel and junction_mapped tell of a
    disrupted junction."""
    order = F.sort_array("probs", asc=False)
    margin = F.when(F.size("probs") > 1, F.get(order, F.lit(0)) - F.get(order, F.lit(1))).otherwise(F.lit(1.0))
    rows = calls.withColumn("ac", votes.byte(F.col("confidence"))).withColumn("am", votes.byte(margin)).withColumn("pp", F.transform("probs", votes.byte))
    wide: Column = F.col("am") >= least_margin
    if abstain_disrupted:
        wide = wide | ~votes.disrupted(F.col("junction_indel"), F.col("junction_mapped"))
    return rows.withColumn("aa", F.when((F.col("ac") >= least_confidence) & wide, F.col("call")).otherwise("unc"))


def marked(probabilities: DataFrame) -> DataFrame:
    """read_id, mp, ml: a binary model's chunks in base order, their places and probabilities as bytes, cut off."""
    cut = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.get("probs", F.lit(0)) * 255))).cast("int")
    rows = probabilities.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("base_index", cut.alias("b")))).alias("x"))  # one read's chunks
    return rows.select("read_id", F.col("x.base_index").alias("mp"), F.col("x.b").alias("ml"))


def on_alignments(alignments: DataFrame, calls: DataFrame) -> DataFrame:
    """Every alignment, with its read's tags where there are any."""
    return alignments.join(calls, "read_id", "left")
