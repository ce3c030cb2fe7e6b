"""Reads made ready: move tables, signals joined to alignments, motifs found on the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, sequence, signal

BIN = 1 << 14  # letters of a reference that are searched and joined at once
TOLERANCE = 3  # bases by which a mapped motif's length may differ


def move_table(mv: Column, samples: Column, trim: Column) -> Column:
    """(stride, moves, samples, trim) of the tags: the first number of mv is the stride, the rest are moves; a missing trim
    is 0. Null without mv, without the number of samples, or with an empty mv."""
    return F.when(mv.isNotNull() & samples.isNotNull() & (F.size(mv) > 0), F.struct(F.get(mv, F.lit(0)).alias("stride"), F.slice(mv, F.lit(2), F.greatest(F.size(mv) - 1, F.lit(0))).alias("moves"), samples.alias("samples"), F.coalesce(trim, F.lit(0)).alias("trim")))


def parsed_moves(text: Column) -> Column:
    """A tag's numbers, `5,1,0,1`; null if one isn't a number."""
    numbers = F.transform(F.split(text, ","), lambda x: x.try_cast("int"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def with_signals(alignments: DataFrame, signals: DataFrame, key: str = "read_id") -> DataFrame:
    """All alignments, with their signals where there are any; `missing` marks the others. Signals are the large side, so
    neither is broadcast by this join."""
    return alignments.join(signals.hint("merge").withColumn("found_", F.lit(True)), key, "left").withColumn("missing", F.col("found_").isNull()).drop("found_")


def scaled(values: Column) -> Column:
    """Less the median, over 1.4826 times the median deviation; 0 where that is 0."""

    def of(v: Column, m: Column) -> Column:
        spread = arrays.median(F.transform(v, lambda x: F.abs(x - m)))
        return arrays.let(spread, lambda s: F.transform(v, lambda x: F.when(s > 0, (x - m) / (1.4826 * s)).otherwise(F.lit(0.0))))

    return arrays.let(values, arrays.median(values), of)


def prepared(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """Adds signal and map of each row's raw `v` and `table` (a move table): the samples from the trim to the table's number
    of samples, scaled, and the first sample of every base among them; reversed, both count from the end."""
    t = F.col("table")
    kept = F.slice("v", t["trim"] + 1, F.greatest(F.least(t["samples"], F.size("v")) - t["trim"], F.lit(0)))
    base_map = signal.move_map(t["moves"], t["stride"], F.lit(0), t["samples"] - t["trim"])
    out = rows.withColumn("signal", scaled(kept)).withColumn("map", base_map)
    if reverse:
        out = out.withColumn("signal", F.reverse("signal")).withColumn("map", signal.reversed_map(F.col("map"), t["samples"] - t["trim"]))
    return out


def indel_inside(cigar: Column, reference_start: Column, start: Column, stop: Column, edges: bool = False) -> Column:
    """Whether an insertion or deletion stands in [start, stop) of the reference before its last base is mapped. edges: not
    counted within TOLERANCE bases of either end, or within half of a shorter interval."""
    margin = F.least(F.lit(TOLERANCE), F.floor((stop - start) / 2)) if edges else F.lit(0)
    low, high = (start + margin).cast("long"), (stop - margin).cast("long")
    empty = F.struct(reference_start.cast("long").alias("r"), F.lit(False).alias("first"), F.lit(False).alias("last"), F.lit(False).alias("indel"))

    def step(s: Column, c: Column) -> Column:
        n, op = c["len"].cast("long"), c["op"]
        done = s["first"] & s["last"]
        holds = lambda x: op.isin(*sequence.MATCHING) & (x >= s["r"]) & (x < s["r"] + n)
        here = ~done & (s["r"] >= low) & (((op == sequence.INSERT) & (s["r"] < high)) | ((op == sequence.DELETE) & (n > 0)))
        r = s["r"] + F.when(op.isin(*sequence.MATCHING, sequence.DELETE), n).otherwise(F.lit(0))
        return F.struct(r.alias("r"), (s["first"] | holds(start)).alias("first"), (s["last"] | holds(stop - 1)).alias("last"), (s["indel"] | here).alias("indel"))

    return F.aggregate(cigar, empty, step, lambda s: s["indel"])


def motif_places(references: DataFrame, motif: str, size: int = BIN) -> DataFrame:
    """reference_name, bin, places: where the motif starts on a reference, by bins of `size` letters; bins without one are
    left out. A reference is cut before it is searched, so no row holds more places than a bin has letters."""
    s, n = F.col("sequence"), F.length("sequence")
    # pieces of a text of single bytes are cut by bytes: by letters each cut would read the text from its start
    raw, plain = s.cast("binary"), F.octet_length("sequence") == n
    start, width = lambda i: i.cast("int") * size + 1, F.lit(size + len(motif) - 1)
    pieces = F.when(plain, F.transform(arrays.indices(F.ceil(n / size)), lambda i: F.substring(raw, start(i), width).cast("string"))).otherwise(F.transform(arrays.indices(F.ceil(n / size)), lambda i: F.substring(s, start(i), width)))
    rows = references.select("reference_name", F.posexplode(pieces).alias("bin", "piece"))
    return rows.select("reference_name", "bin", sequence.motif_hits(F.col("piece"), motif).alias("p")).where(F.size("p") > 0).select("reference_name", "bin", F.transform("p", lambda p: p + F.col("bin") * size).alias("places"))


def reference_motifs(alignments: DataFrame, references: DataFrame, motif: str, anchor: str = "query", skip_indels: bool = False, allow_edge_indels: bool = False, require_mapping: bool = True) -> DataFrame:
    """read_id, position, junction_indel, junction_mapped: the reference's motifs inside every alignment. A motif is
    accepted if its ends map to the read and its length there is the same (skip_indels, where no indel may stand in it) or
    differs by TOLERANCE at most. anchor: the position is the read's, or the reference's from the alignment's start; only
    the latter can do without mapping. Alignments meet the motifs of the bins that they reach into. Alignments (read_id, reference_name, reference_start, cigar) of unknown references
    have no motif; references are (reference_name, sequence)."""
    rule = {"anchor": anchor, "skip_indels": skip_indels, "allow_edge_indels": allow_edge_indels, "require_mapping": require_mapping}
    return motifs_by_rule(alignments, references, motif, {"": rule}).drop("rule")


def motifs_by_rule(alignments: DataFrame, references: DataFrame, motif: str, rules: dict[str, dict]) -> DataFrame:
    """The rows of reference_motifs under each of some rules (name: its options), and the rule's name as `rule`. A motif is
    taken through an alignment once, whatever the number of rules."""
    n, first, start = len(motif), F.col("reference_start"), F.col("p")
    end = first + F.aggregate("cigar", F.lit(0).cast("long"), lambda s, c: s + F.when(c["op"].isin(*sequence.ON_REFERENCE), c["len"].cast("long")).otherwise(F.lit(0)))
    length, mapped = F.col("x.q_stop") - F.col("x.q_start"), F.col("x").isNotNull()

    def outcome(name: str, anchor: str = "query", skip_indels: bool = False, allow_edge_indels: bool = False, require_mapping: bool = True) -> Column:
        if anchor not in ("query", "reference"):
            raise ValueError(f"anchor is query or reference, not {anchor!r}")
        if anchor == "query" and not require_mapping:
            raise ValueError("positions of the read need a mapping")
        kept = F.lit(True)
        if require_mapping:
            fits = (length == n) & ~indel_inside(F.col("cigar"), first, start, start + n, allow_edge_indels) if skip_indels else F.abs(length - n) <= TOLERANCE
            kept = mapped & fits
        position = F.col("x.q_start") if anchor == "query" else (start - first).cast("long")
        return F.struct(F.lit(name).alias("rule"), position.alias("position"), kept.alias("kept"))

    outcomes = [outcome(name, **options) for name, options in rules.items()]
    spans = alignments.withColumn("end_", end).where(F.col("end_") > first)
    bins = F.sequence(F.floor(F.greatest(first, F.lit(0)) / BIN).cast("int"), F.floor((F.col("end_") - 1) / BIN).cast("int"))
    met = spans.where("end_ > 0").withColumn("bin", F.explode(bins)).join(motif_places(references, motif, BIN), ["reference_name", "bin"])
    inside = F.filter("places", lambda p: (p >= first) & (p + n <= F.col("end_")))
    hits = met.select("read_id", "reference_start", "cigar", F.explode(inside).alias("p"))
    # a generator keeps the outcome's filter from being written with the whole walk in it, once for each use
    hits = hits.withColumn("x", sequence.query_interval(F.col("cigar"), first, start, start + n, advance_skips=False))
    each = hits.select("read_id", F.coalesce(length - n, F.lit(0)).alias("junction_indel"), mapped.alias("junction_mapped"), F.explode(F.array(*outcomes)).alias("o"))
    return each.where("o.kept").select("read_id", "o.position", "junction_indel", "junction_mapped", "o.rule")


def check_shapes(rows: DataFrame, signal_len: int, features: int | None = None, channels: int = 1, signal: str = "chunk_signal", feature: str = "chunk_features") -> DataFrame:
    """The rows, as an error where a chunk's shape isn't the model's: signals are arrays of numbers (one channel) or of
    channels, features an array of channels or null."""
    nested = rows.schema[signal].dataType.elementType.typeName() == "array"
    held = F.size(signal) if nested else F.lit(1)
    length = F.size(F.get(signal, F.lit(0))) if nested else F.size(signal)
    fits = (held == channels) & (length == signal_len)
    if features is not None:
        fits = fits & (F.col(feature).isNull() | (F.size(feature) == features))
    told = F.concat_ws(" ", F.lit("a chunk has"), held.cast("string"), F.lit("channels of"), length.cast("string"), F.lit(f"samples; the model takes {channels} of {signal_len}, with {features} features"))
    return rows.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))


def check_window(window: int, target: int, samples_per_base: float, state_len: int = 4) -> None:
    """An error if a window can't hold a target's bases at the reads' own rate, or a target emits nothing."""
    if target <= state_len:
        raise ValueError(f"a target of {target} bases emits nothing after {state_len}")
    if window < target * samples_per_base:
        raise ValueError(f"{window} samples can't hold {target} bases of {samples_per_base} samples")


def feature_window(config: dict, chunks: DataFrame | None = None) -> tuple[int | None, int | None]:
    """The stored feature window: of a corpus's columns, which must hold one value each, or of a config. None where nothing
    is stored."""
    names = ("feature_start", "feature_end")
    if chunks is None:
        return config.get(names[0]), config.get(names[1])
    there = [c for c in names if c in chunks.columns]
    if not there:
        return None, None
    ends = chunks.agg(*[f(c).alias(f"{k}_{c}") for c in there for k, f in (("low", F.min), ("high", F.max))]).first()
    for c in there:
        if ends[f"low_{c}"] != ends[f"high_{c}"]:
            raise ValueError(f"{c} differs among the chunks: {ends[f'low_{c}']} to {ends[f'high_{c}']}")
    return tuple(ends[f"low_{c}"] if c in there else None for c in names)


def indexed_sequence(anchor: Column, basecall: Column, reference: Column, cigar: Column) -> Column:
    """The text that string positions index: the reference's part if the anchor is the reference and there is one with a
    CIGAR, else the basecall."""
    return F.when((anchor == "reference") & reference.isNotNull() & cigar.isNotNull(), reference).otherwise(basecall)


def disagreeing(configs: DataFrame, keys: list[str]) -> DataFrame:
    """key, value, input, other: where an input (rows input, key, value) differs from the first input's value of one of the
    keys; a missing value is null and equals a missing one."""
    wanted = configs.where(F.col("key").isin(keys))
    every = configs.select("input").distinct().select("input", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    values = every.join(wanted.groupBy("input", "key").agg(F.min("value").alias("value")), ["input", "key"], "left")
    first = configs.agg(F.min("input").alias("input")).join(values, "input").select("key", F.col("value").alias("first"))
    return values.join(first, "key").where(~F.col("value").eqNullSafe(F.col("first"))).select("key", F.col("first").alias("value"), "input", F.col("value").alias("other"))
