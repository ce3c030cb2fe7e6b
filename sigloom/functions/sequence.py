"""Sequence functions of one read: motifs, k-mer levels, encodings, CIGAR coordinates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import at, indices, let, running

MATCH, INSERT, DELETE, SKIP, SOFT, HARD, PAD, EQUAL, DIFFER = range(9)  # CIGAR operation codes
MATCHING, ON_REFERENCE, ON_QUERY = (MATCH, EQUAL, DIFFER), (MATCH, DELETE, SKIP, EQUAL, DIFFER), (MATCH, INSERT, SOFT, EQUAL, DIFFER)

LATER_BYTES = bytes(range(0x80, 0xC0))  # of a letter's UTF-8, all but the first
ROWS = [bytes(49 if b in letters else 48 for b in range(256)) for letters in (b"Aa", b"Cc", b"Gg", b"TtUu")]


def capital(sequence: Column) -> Column:
    """ASCII letters in upper case; unlike upper() this never changes a text's length."""
    return F.translate(sequence, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def recoded(text: Column, letters: str, codes: str) -> Column:
    """translate() for ASCII letters, in tasks' own Python: a batch's bytes at once, where translate looks up a letter at a
    time. Bytes of other letters are above ASCII and stay. No place for it in a lambda."""
    table = bytes.maketrans(letters.encode("ascii"), codes.encode("ascii"))

    def of(batch: pa.Array) -> pa.Array:
        mask, offsets, data = batch.cast(pa.string()).buffers()
        data = data and pa.py_buffer(data.to_pybytes().translate(table))
        return pa.Array.from_buffers(pa.string(), len(batch), [mask, offsets, data], batch.null_count, batch.offset)

    return F.arrow_udf(of, "string")(text)


def motif_hits(sequence: Column, motif: str, start: Column | None = None, stop: Column | None = None) -> Column:
    """All places, overlapping ones too, where the motif stands in upper or lower case, inside [start, stop)."""
    if not motif:
        raise ValueError("a motif has a letter at least")
    wanted = motif.upper()

    def of(text: Column) -> Column:
        # cut before every hit, so the work goes by hits; a hit at the very start leaves no piece before it
        pieces = F.split(text, "(?=\\Q" + wanted + "\\E)")
        return F.filter(running(F.transform(pieces, F.length)), lambda p, i: (i > 0) | text.startswith(wanted))

    hits = let(capital(sequence), of)
    if start is not None:
        hits = F.filter(hits, lambda p: p >= start)
    return hits if stop is None else F.filter(hits, lambda p: p + len(motif) <= stop)


def base_codes(sequence: Column) -> Column:
    """A 0, C 1, G 2, T and U 3, anything else -1."""
    letters = F.split(capital(sequence), "")
    code = lambda c: F.when(c == "A", 0).when(c == "C", 1).when(c == "G", 2).when(c.isin("T", "U"), 3).otherwise(-1)
    return F.transform(letters, code)


def _one_hot_rows(text: pa.Array) -> pa.Array:
    rows = ([(raw or b"N").translate(t, LATER_BYTES).decode() for t in ROWS] if raw is not None else None for raw in text.cast(pa.binary()).to_pylist())
    return pa.array(rows, pa.list_(pa.string()))


def one_hot_rows(sequence: Column) -> Column:
    """The rows of one_hot as texts of 0 and 1, a digit a letter, in tasks' own Python: a call a row, where expressions make
    one a letter. An empty text has a 0, as one_hot has; null for null. No place for it in a lambda."""
    return F.arrow_udf(_one_hot_rows, "array<string>")(sequence)


def one_hot(sequence: Column) -> Column:
    """Four rows (A, C, G, T) of 0 and 1; other letters are 0 in all."""
    def row(codes: Column, base: int) -> Column:
        return F.transform(codes, lambda c: F.when(c == base, 1).otherwise(0))

    return let(base_codes(sequence), lambda codes: F.array(*[row(codes, b) for b in range(4)]))


def kmers(sequence: Column, k: int) -> Column:
    """The k-mer that starts at every place, in upper case with T for U. One pass: a letter is read, and the k from it on
    are looked at. No place for it in a lambda."""
    return F.regexp_extract_all(recoded(sequence, "abcdefghijklmnopqrstuvwxyzU", "ABCDEFGHIJKLMNOPQRSTTVWXYZT"), F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def context(sequence: Column, base: Column, before: int, after: int) -> Column:
    """Letters base - before .. base + after, N outside the sequence."""
    start, n = base - before, F.length(sequence)
    left = F.greatest(F.lit(0), -start)
    right = F.greatest(F.lit(0), base + after + 1 - n)
    middle = F.substring(sequence, F.greatest(start, F.lit(0)) + 1, F.greatest(F.lit(0), F.lit(before + after + 1) - left - right))
    return F.concat(F.repeat(F.lit("N"), left), middle, F.repeat(F.lit("N"), right))


def one_side_masked(kmer: Column, focus: Column, side: str) -> Column:
    """N on one side of the focus letter, which stays."""
    n = F.length(kmer)
    i = F.greatest(F.lit(0), F.least(n - 1, focus))
    if side == "left":
        return F.concat(F.repeat(F.lit("N"), i), F.substring(kmer, i + 1, n - i))
    if side == "right":
        return F.concat(F.substring(kmer, F.lit(1), i + 1), F.repeat(F.lit("N"), n - i - 1))
    raise ValueError(f"side is left or right, not {side!r}")


def query_interval(cigar: Column, reference_start: Column, start: Column, stop: Column, advance_skips: bool = True) -> Column:
    """Query coordinates of the reference interval [start, stop): a struct (q_start, q_stop), or null if either edge is
    not inside a matching block. advance_skips=False leaves N out of the reference position, as some callers want."""
    moves_reference = ON_REFERENCE if advance_skips else tuple(o for o in ON_REFERENCE if o != SKIP)
    empty = F.struct(reference_start.cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))

    def step(s: Column, c: Column) -> Column:
        n = c["len"].cast("long")
        inside = lambda x: c["op"].isin(*MATCHING) & (x >= s["r"]) & (x < s["r"] + n)
        last = stop.cast("long") - 1
        a = F.coalesce(s["a"], F.when(inside(start), s["q"] + start - s["r"]))
        b = F.coalesce(s["b"], F.when(inside(last), s["q"] + last - s["r"] + 1))
        r = s["r"] + F.when(c["op"].isin(*moves_reference), n).otherwise(F.lit(0))
        q = s["q"] + F.when(c["op"].isin(*ON_QUERY), n).otherwise(F.lit(0))
        return F.struct(r.alias("r"), q.alias("q"), a.alias("a"), b.alias("b"))

    return F.aggregate(cigar, empty, step, lambda s: F.when(s["a"].isNotNull() & s["b"].isNotNull(), F.struct(s["a"].alias("q_start"), s["b"].alias("q_stop"))))


def between(text: Column, start: Column, stop: Column) -> Column:
    """text[start:stop] with N outside; empty if stop is not after start."""
    n = F.length(text)
    left = F.greatest(F.lit(0), F.least(stop, F.lit(0)) - start)
    right = F.greatest(F.lit(0), stop - F.greatest(start, n))
    size = F.greatest(F.lit(0), stop - start)
    middle = F.substring(text, F.greatest(start, F.lit(0)) + 1, F.greatest(F.lit(0), size - left - right))
    return F.concat(F.repeat(F.lit("N"), F.least(left, size)), middle, F.repeat(F.lit("N"), F.least(right, size)))


def walked(cigar: Column) -> Column:
    """The CIGAR with the reference and query places before every operation: structs (op, len, r, q), from 0."""
    moves = lambda ops: F.transform(cigar, lambda c: F.when(c["op"].isin(*ops), c["len"].cast("int")).otherwise(F.lit(0)))
    return let(cigar, running(moves(ON_REFERENCE)), running(moves(ON_QUERY)), lambda c, r, q: F.transform(c, lambda x, i: F.struct(x["op"].alias("op"), x["len"].cast("long").alias("len"), at(r, i).cast("long").alias("r"), at(q, i).cast("long").alias("q"))))


def knots(cigar: Column) -> Column:
    """Reference and query places of the first and last base of every matching block: struct (x, y), from 0."""
    def of(steps: Column) -> Column:
        ends = lambda field: F.flatten(F.transform(steps, lambda s: F.array(s[field], s[field] + s["len"] - 1)))
        return F.struct(ends("r").alias("x"), ends("q").alias("y"))

    return let(F.filter(walked(cigar), lambda s: s["op"].isin(*MATCHING) & (s["len"] > 0)), of)


def reference_places(cigar: Column) -> Column:
    """The read's place, a fraction between matching blocks, of every reference base of an alignment and of its end. The
    line goes through 0, the knots, and the end of the last matching block; what follows that block is left out. Without a
    matching block there is one place, 0."""
    def of(k: Column) -> Column:
        n = F.size(k["x"])
        x = F.concat(F.array(F.lit(0).cast("long")), k["x"], F.array(F.element_at(k["x"], -1) + 1))
        y = F.concat(F.array(F.lit(0).cast("long")), k["y"], F.array(F.element_at(k["y"], -1) + 1))

        def piece(x: Column, y: Column, i: Column) -> Column:
            x0, x1, y0, y1 = at(x, i), at(x, i + 1), at(y, i), at(y, i + 1)
            slope = (y1 - y0) / F.greatest(x1 - x0, F.lit(1))
            return F.transform(indices(x1 - x0), lambda p: slope * p + y0)

        whole = let(x, y, lambda x, y: F.concat(F.flatten(F.transform(indices(F.size(x) - 1), lambda i: piece(x, y, i))), F.array(F.element_at(y, -1).cast("double"))))
        return F.when(n > 0, whole).otherwise(F.array(F.lit(0.0)))

    return let(knots(cigar), of)
