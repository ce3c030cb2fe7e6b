"""Reads to training or prediction chunks in one operator, with a failure budget.

A read is prepared and cut inside array expressions of its own row: nothing is exploded before the chunks are there, and
every step is linear in the read's samples or bases. A read that can't be prepared has an error text in place of chunks;
reads, absent signals, failures and reads with chunks are counted while the chunks are written, and a run that failed for
more than half of the reads it attempted is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import arrays, sequence, signal
from ..functions.arrays import at, indices, let
from .chunks import EDGE

MOST_FAILED = 0.5  # of the reads that were attempted
AROUND_SIGNAL = (4, 4)  # letters around a chunk's own bases, for the signal's k-mer encoding


@dataclass(frozen=True)
class Plan:
    """How reads are prepared and cut. A window is left and right samples around the focus sample, or context_bases around
    the focus base, filled up or cut about its middle to signal_len samples. feature_start and feature_end are bases from the
    focus base, both inside; None takes the k-mer's."""

    left: int = 50
    right: int = 50
    context_bases: tuple[int, int] | None = None
    signal_len: int | None = None
    kmer: int = 5
    justify: str = "center"
    feature_start: int | None = None
    feature_end: int | None = None
    mask: str | None = None
    reverse: bool = False
    norm: str = "median_mad"
    pa_mean: float | None = None
    pa_stdev: float | None = None
    anchor: str = "basecall"
    recover_clipped: bool = False

    def __post_init__(self) -> None:
        if (self.context_bases is None) != (self.signal_len is None):
            raise ValueError("context_bases and signal_len go together")
        if self.justify not in ("start", "center", "end") or self.anchor not in ("basecall", "reference") or self.mask not in (None, "left", "right"):
            raise ValueError("justify is start, center or end; anchor basecall or reference; mask left, right or None")
        if self.norm == "pa_scaling" and (self.pa_mean is None or self.pa_stdev is None):
            raise ValueError("pa_scaling needs pa_mean and pa_stdev")

    @property
    def window(self) -> tuple[int, int]:
        return (-self.kmer if self.feature_start is None else self.feature_start, self.kmer if self.feature_end is None else self.feature_end)

    @property
    def samples(self) -> int:
        return self.signal_len or self.left + self.right

    def of(self, **changes) -> Plan:
        return replace(self, **changes)


def failed_because(plan: Plan) -> Column:
    """The first reason for which a read can't be prepared; null if there is none."""
    t = F.col("table")
    reasons = [
        (t.isNull(), "no move table"),
        (F.col("sequence").isNull() | (F.col("sequence") == ""), "no sequence"),
        (F.least(t["samples"], F.size("v")) <= t["trim"], "no samples"),
    ]
    if plan.norm == "pa_scaling":
        reasons.append((F.col("cal_offset").isNull() | F.col("cal_scale").isNull(), "no calibration"))
    if plan.anchor == "reference":
        reasons.append((F.col("reference_sequence").isNotNull() & F.col("cigar").isNotNull() & ~F.exists("cigar", lambda c: c["op"].isin(*sequence.MATCHING) & (c["len"] > 0)), "no mapped base"))
    out = F.lit(None).cast("string")
    for test, text in reversed(reasons):
        out = F.when(F.coalesce(test, F.lit(False)), text).otherwise(out)
    return out


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with columns that are computed here, once a row. A generator stands between them and what uses them: the
    optimiser would otherwise write their expressions into every use, and into filters on what follows."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def signals_and_maps(reads: DataFrame, plan: Plan) -> DataFrame:
    """Adds text (what positions index), signal, map, whole (the signal before it is cut to the aligned part) and cut_at."""
    t = F.col("table")
    kept = F.slice("v", t["trim"] + 1, F.greatest(F.least(t["samples"], F.size("v")) - t["trim"], F.lit(0)))
    base_map = signal.move_map(t["moves"], t["stride"], F.lit(0), t["samples"] - t["trim"])
    cal = (F.col("cal_offset"), F.col("cal_scale")) if plan.norm == "pa_scaling" else (None, None)
    rows = settled(reads, whole=signal.normalised(kept, plan.norm, plan.pa_mean, plan.pa_stdev, *cal), map=base_map)
    if plan.reverse:
        rows = settled(rows, map=let(F.col("map"), F.size("whole"), signal.reversed_map), whole=F.reverse("whole"))
    if plan.anchor == "basecall":
        return settled(rows, cut_at=F.lit(0), text=F.col("sequence"), signal=F.col("whole"))
    on_reference = F.col("reference_sequence").isNotNull() & F.col("cigar").isNotNull()
    rows = settled(rows, map=F.when(on_reference, signal.reference_map(F.col("map"), F.col("cigar"))).otherwise(F.col("map").cast("array<bigint>")).cast("array<int>"))
    rows = settled(rows, cut_at=F.when(on_reference, at(F.col("map"), F.lit(0))).otherwise(F.lit(0)), text=F.when(on_reference, F.col("reference_sequence")).otherwise(F.col("sequence")))
    part = F.slice("whole", F.greatest(F.col("cut_at"), F.lit(0)) + 1, F.greatest(F.element_at("map", -1) - F.col("cut_at"), F.lit(0)))
    moved = let(F.col("map"), F.col("cut_at"), lambda m, c: F.transform(m, lambda x: x - c))
    return settled(rows, signal=F.when(on_reference, part).otherwise(F.col("whole")), map=moved)


def with_features(rows: DataFrame, levels: bool) -> DataFrame:
    """Adds dwells, bases (of every sample), features (channels x bases, in the contract's order) and, with expected
    levels, residual."""
    rows = settled(rows, dwells=signal.dwells(F.col("map")), bases=signal.bases_of_samples(F.col("map")))
    made = {"dwell_": signal.dwell_features(F.col("dwells")), "level_": signal.level_features(F.col("signal"), F.col("map"))}
    if levels:
        made["expected_"] = signal.fitted_levels(F.col("levels"), F.size("dwells"))
    rows = settled(rows, **made)
    groups = [("dwell_", signal.DWELL_CHANNELS), ("level_", signal.LEVEL_CHANNELS)]
    if levels:
        residual = signal.residual_features(F.col("level_").getField("level_mean"), F.col("expected_"))
        rows = settled(rows, residual_=residual, residual=signal.spread_residual(F.col("signal"), F.col("map"), F.col("bases"), F.col("expected_")))
        groups.append(("residual_", signal.RESIDUAL_CHANNELS))
    channels = [F.col(x).getField(c).cast("array<double>") for x, names in groups for c in names]
    return settled(rows, features=F.array(*channels)).drop("dwell_", "level_", "expected_", "residual_")


def window_of(m: Column, base: Column, focus: Column, plan: Plan) -> tuple[Column, Column]:
    """First sample and end of a chunk's window, before it is filled up."""
    if plan.context_bases is None:
        return focus - plan.left, focus + plan.right
    last = F.size(m) - 2
    start = at(m, F.greatest(F.lit(0), F.least(last, base - plan.context_bases[0])))
    stop = at(m, F.greatest(F.lit(0), F.least(last, base + plan.context_bases[1])) + 1)
    asked = F.greatest(F.lit(0), stop - start)
    moved = start + F.when(asked > plan.signal_len, F.floor((asked - plan.signal_len) / 2).cast("int")).otherwise(F.lit(0))
    return moved, F.least(moved + plan.signal_len, F.greatest(stop, moved)) if plan.signal_len else stop


def chunks_of(plan: Plan, levels: bool) -> Column:
    """The chunks of a prepared read's focus bases: array<struct>."""
    low, high = plan.window
    n = plan.samples

    def cut(text, sig, res, whole, shift, m, bases, dwells, features, f) -> Column:
        base = f["position"].cast("int")
        focus = at(m, base) if plan.justify == "start" else at(m, base + 1) if plan.justify == "end" else F.floor((at(m, base) + at(m, base + 1)) / 2).cast("int")

        def inner(base: Column, focus: Column, start: Column, stop: Column) -> Column:
            end = start + n if plan.context_bases is None else stop
            lowest = F.greatest(F.lit(0), start)
            # the window's bases: the last that starts at or before its first sample, to the first that starts at or after its end
            first = F.greatest(F.lit(0), signal.base_at(bases, m, lowest if plan.context_bases is None else start))
            past = F.least(F.length(text), signal.base_at(bases, m, F.least(F.size(sig), end) - 1 if plan.context_bases is None else end - 1) + 1)
            inside = lambda values: F.transform(indices(F.lit(n)), lambda i: F.coalesce(F.when((start + i >= 0) & (start + i < end), at(values, start + i)), F.lit(0.0)))
            samples = inside(sig)
            if plan.recover_clipped and plan.context_bases is None:
                samples = F.transform(indices(F.lit(n)), lambda i: F.coalesce(F.when(start + i >= 0, at(sig, start + i)), F.when(start + i + shift >= 0, at(whole, start + i + shift)), F.lit(0.0)))
            around = lambda a, b: sequence.between(text, a, b)
            kmer, context = around(base - plan.kmer, base + plan.kmer + 1), around(first - AROUND_SIGNAL[0], past + AROUND_SIGNAL[1])
            if plan.mask:
                kmer, context = sequence.one_side_masked(kmer, F.lit(plan.kmer), plan.mask), let(context, lambda c: sequence.one_side_masked(c, base - first + AROUND_SIGNAL[0], plan.mask))

            def mapped(first: Column, past: Column) -> Column:
                size = F.least(past + 1, F.size(m)) - first
                return F.transform(indices(size), lambda i: F.when(i == size - 1, n).when(i == 0, 0).otherwise(at(m, first + i) - start))

            fields = {
                "base_index": base, "signal": samples, "sequence": kmer, "dwells": arrays.padded(F.transform(dwells, lambda x: x.cast("double")), base + low, base + high + 1),
                "features": F.transform(features, lambda c: arrays.padded(c, base + low, base + high + 1)), "seq_to_sig": let(first, past, mapped),
                "sequence_with_kmer_context": context, "focus_signal_pos": focus - start if plan.context_bases else F.lit(plan.left),
                "junction_indel": F.coalesce(f["junction_indel"], F.lit(0)), "junction_mapped": F.coalesce(f["junction_mapped"], F.lit(False)), "label_int": f["label_int"],
            }
            if levels:
                fields["signal_residual"] = inside(res)
            return F.struct(*[c.alias(k) for k, c in fields.items()])

        return let(base, focus, lambda b, s: let(*window_of(m, b, s, plan), lambda x, y: inner(b, s, x, y)))

    def of(text, sig, res, whole, shift, m, bases, dwells, features, focus) -> Column:
        there = F.filter(focus, lambda f: (f["position"] >= 0) & (f["position"] < F.size(m) - 1))
        return F.transform(there, lambda f: cut(text, sig, res, whole, shift, m, bases, dwells, features, f))

    residual = F.col("residual") if levels else F.array().cast("array<double>")
    names = ("text", "signal", residual, "whole", "cut_at", "map", "bases", "dwells", "features", "focus")
    return let(*[F.col(x) if isinstance(x, str) else x for x in names], of)


def focus_of(place: Column, label_int: Column | None = None, indel: Column | None = None, mapped: Column | None = None) -> Column:
    """One focus base as the struct that `focus` holds."""
    none = F.lit(None)
    return F.struct(place.cast("int").alias("position"), (none if indel is None else indel).cast("int").alias("junction_indel"), (none if mapped is None else mapped).cast("boolean").alias("junction_mapped"), (none if label_int is None else label_int).cast("int").alias("label_int"))


def motif_focus(text: Column, motif: str | None, offset: int = 0, label_int: int | None = None) -> Column:
    """The focus bases of a text: every motif hit plus the offset, or without a motif all but EDGE at either end."""
    places = sequence.motif_hits(text, motif) if motif else F.filter(indices(F.length(text)), lambda i: (i >= EDGE) & (i < F.length(text) - EDGE))
    return F.transform(places, lambda p: focus_of(p + (offset if motif else 0), F.lit(label_int)))


def sampled_focus(base_map: Column, bases: Column, label_int: Column, sample: Column) -> Column:
    """The one focus base that a focus table gives by a sample: the last base that starts at or before it, EDGE bases from
    either end."""
    base = F.least(bases - EDGE - 1, F.greatest(F.lit(EDGE), signal.base_of_sample(base_map, sample)))
    return F.array(focus_of(base, label_int))


def extract(reads: DataFrame, plan: Plan, motif: str | None = None, offset: int = 0, label_int: int | None = None, focus: str | None = None, levels: bool = False) -> DataFrame:
    """One row a read: read_id, the columns that are no input of the cut, outcome (chunks, no chunks, missing, failed),
    error and chunks (null unless there are some).

    Reads: read_id, sequence, v (raw samples, null if there are none: missing), table (a move table); with anchor reference
    also reference_sequence and cigar, of which a null makes the read its basecall's; with pa_scaling cal_offset and
    cal_scale; with levels an array of a level a base. Focus bases come from the motif in the text, from the read's own column
    `focus` (structs as of focus_of), or from its columns label_int and anchor_sample (focus="sample"), where a null anchor
    is a read that isn't wanted. A focus base outside the map has no chunk. A read whose chunk covers no base fails.
    """
    inputs = {"sequence", "v", "table", "reference_sequence", "cigar", "cal_offset", "cal_scale", "levels", "focus", "label_int", "anchor_sample"}
    kept = [c for c in reads.columns if c not in inputs]
    missing = F.col("v").isNull()
    rows = settled(reads, missing_=missing, error=F.when(~missing, failed_because(plan)))
    ready = F.col("error").isNull() & ~F.col("missing_")
    # nothing is computed for a read that has no chance
    rows = settled(rows, v=F.when(ready, F.col("v")), table=F.when(ready, F.col("table")))
    rows = signals_and_maps(rows, plan)
    if focus == "sample":
        rows = settled(rows, focus=F.when(F.col("anchor_sample").isNotNull(), sampled_focus(F.col("map"), F.length("text"), F.col("label_int"), F.col("anchor_sample"))))
    elif focus is None:
        rows = settled(rows, focus=motif_focus(F.col("text"), motif, offset, label_int))
    rows = settled(with_features(rows, levels), chunks=F.when(ready, F.coalesce(chunks_of(plan, levels), F.array())))
    hollow = F.exists("chunks", lambda c: F.size(c["seq_to_sig"]) == 0)
    late = F.when(F.col("cut_at") < 0, F.lit("the aligned part starts before the signal")).when(hollow, F.lit("a chunk covers no base"))
    rows = settled(rows, error=F.when(ready, late).otherwise(F.col("error")))
    outcome = F.when(F.col("missing_"), "missing").when(F.col("error").isNotNull(), "failed").when(F.size("chunks") > 0, "chunks").otherwise("no chunks")
    rows = settled(rows, outcome=outcome)
    return rows.select(*kept, "outcome", "error", F.when(F.col("outcome") == "chunks", F.col("chunks")).alias("chunks"))


def chunk_rows(extracted: DataFrame) -> DataFrame:
    """A row a chunk, with the read's own columns."""
    kept = [c for c in extracted.columns if c not in ("outcome", "error", "chunks")]
    return extracted.where("outcome = 'chunks'").select(*kept, F.explode("chunks").alias("c")).select(*kept, "c.*")


def yields(extracted: DataFrame) -> DataFrame:
    """outcome, error, reads, chunks: what became of the reads."""
    return extracted.groupBy("outcome", "error").agg(F.count("*").alias("reads"), F.sum(F.coalesce(F.size("chunks"), F.lit(0))).alias("chunks"))


class FailureBudget:
    """Counts outcomes while rows are written; check() raises if too many attempted reads failed."""

    def __init__(self, name: str = "prepare"):
        self.seen = Observation(name)

    def watch(self, extracted: DataFrame) -> DataFrame:
        of = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
        return extracted.observe(
            self.seen, F.count(F.lit(1)).alias("total_reads"), of("missing").alias("reads_missing"), of("failed").alias("failed_reads"),
            of("chunks").alias("reads_with_chunks"), of("no chunks").alias("reads_without_chunks"), F.sum(F.when(F.col("outcome") == "chunks", F.size("chunks")).otherwise(0)).alias("total_chunks"),
        )

    def check(self, most: float = MOST_FAILED) -> dict[str, int]:
        stats = {k: v or 0 for k, v in self.seen.get.items()}
        tried = stats["total_reads"] - stats["reads_missing"]
        if tried and stats["failed_reads"] / tried > most:
            raise RuntimeError(f"{stats['failed_reads']} of {tried} attempted reads failed, more than {most:.0%}; {stats['reads_missing']} of {stats['total_reads']} had no signal")
        return stats


def prepare(reads: DataFrame, path: str, plan: Plan, most_failed: float = MOST_FAILED, **options) -> dict[str, int]:
    """Writes a row a read to path (Parquet) and gives the counts back; a run over its budget leaves nothing at path that
    reads as finished: rows go to a folder beside it, which becomes path only if the budget holds."""
    budget = FailureBudget()
    spark = reads.sparkSession
    beside = path.rstrip("/") + ".unchecked"
    budget.watch(extract(reads, plan, **options)).write.mode("overwrite").parquet(beside)
    stats = budget.check(most_failed)
    if stats["total_chunks"] == 0:
        raise ValueError(f"no chunks: {stats}")
    of = spark._jvm.org.apache.hadoop.fs.Path
    source, target = of(beside), of(path)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(path)
    if not system.rename(source, target):
        raise OSError(f"{beside} could not become {path}")
    return stats
