"""Calls by edit distance to a reference panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import indices, let

PANEL = 5_000  # references that are sent along with the plan; larger panels are met in parts
KEYS = 128  # subsequences of a text that may be its keys


def nearest(decodes: DataFrame, text: str, references: DataFrame, name: str, sequence: str) -> DataFrame:
    """Adds call, distance and margin (the runner-up's distance less the call's; 0 for a tie or a single reference). Of
    equal distances the smaller name wins. The panel is a bounded table of references, read by the driver; each part of
    PANEL rows narrows the best two further. A distinct text is measured once against every reference, however many rows
    have it; rows get its call by a join."""
    panel = sorted((r[name], r[sequence]) for r in references.select(name, sequence).where(F.col(name).isNotNull() & F.col(sequence).isNotNull()).toLocalIterator())
    if not panel:
        raise ValueError("the reference panel is empty")
    kind = f"array<struct<d: int, name: {references.schema[name].dataType.simpleString()}>>"
    out = decodes.select(F.col(text).alias("text_")).distinct().withColumn("best_", F.array().cast(kind))

    def closest(t: Column, part: Column, before: Column) -> Column:
        measured = F.transform(part, lambda r: F.struct(F.levenshtein(t, r["sequence"]).alias("d"), r["name"].alias("name")))
        return F.slice(F.sort_array(F.concat(before, measured)), F.lit(1), F.lit(2))

    for k in range(0, len(panel), PANEL):
        part = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("sequence")) for n, s in panel[k : k + PANEL]])
        out = out.withColumn("best_", let(F.col("text_"), part, F.col("best_"), closest))
    first, second = F.get("best_", F.lit(0)), F.get("best_", F.lit(1))
    calls = out.select("text_", first["name"].alias("call"), first["d"].alias("distance"), F.coalesce(second["d"] - first["d"], F.lit(0)).alias("margin"))
    return decodes.join(calls, decodes[text].eqNullSafe(calls["text_"]), "left").drop("text_")


def subsequences(text: Column, less: int) -> Column:
    """The distinct texts that are left without 0 to `less` of the letters."""
    def without_one(t: Column) -> Column:
        return F.transform(indices(F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i), F.substring(t, i + 2, F.length(t))))

    def of(found: Column, last: Column, left: int) -> Column:
        if not left:
            return found
        return let(F.array_distinct(F.flatten(F.transform(last, without_one))), lambda now: of(F.concat(found, now), now, left - 1))

    return let(F.array(text), lambda t: of(t, t, less))


def within(texts: DataFrame, text: str, references: DataFrame, sequence: str, distance: int) -> DataFrame:
    """text, sequence, distance: the distinct pairs at most that many edits apart, for panels of any size. Nulls pair with
    nothing; an empty text is a text.

    An alignment of two texts that few edits apart has a letter in common in all places but those, so a sequence whose
    subsequences are few (KEYS at most) meets the texts that share one of the length of the longer less the distance. A
    longer sequence is cut into distance + 1 even segments, one of which any text within the distance has unchanged. Such
    sequences are keyed by (length, number of the segment, segment), texts by their pieces where that segment can then
    stand: the edits before and after it bound its shift. So a join on keys finds every pair, and only those it finds are
    measured. A text emits some distance ** 3 keys: this is for a few edits; a segment that very many sequences share (a
    common prefix as long as a segment) makes as many candidates, which Spark splits where they are skewed."""
    if distance < 0:
        raise ValueError("a distance is at least 0")
    near = lambda met: met.select("s", "t", F.levenshtein("s", "t", distance).alias("d")).where("d >= 0").distinct()
    short = distance
    while sum(math.comb(short + 1, i) for i in range(distance + 1)) <= KEYS and distance:
        short += 1
    n, size, i = F.col("n"), F.col("size"), F.col("i")
    seen, listed = texts.select(F.col(text).alias("s")).where("s is not null").distinct(), references.select(F.col(sequence).alias("t")).where("t is not null").distinct()
    kept = listed.where(F.length("t") <= short).select("t", F.explode(subsequences(F.col("t"), distance)).alias("key"))
    asked = seen.where(F.length("s") <= short + distance).select("s", F.explode(subsequences(F.col("s"), distance)).alias("key"))
    first = near(asked.join(kept, "key").where(F.length("key") == F.greatest(F.lit(0), F.greatest(F.length("s"), F.length("t")) - distance)))

    number = F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("i")
    start = F.floor(i * size / (distance + 1)).cast("int")
    width = F.floor((i + 1) * size / (distance + 1)).cast("int") - start
    rows = listed.where(F.length("t") > short).select("t", F.length("t").alias("size"), number)
    kept = rows.select("t", "size", "i", F.substring("t", start + 1, width).alias("piece"))

    rows = seen.select("s", F.length("s").alias("n")).where(n + distance > short)
    rows = rows.select("*", F.explode(F.sequence(F.greatest(F.lit(short + 1), n - distance), n + distance)).alias("size")).select("*", number)
    low = F.greatest(F.lit(0), start - i, start + n - size - (distance - i))
    high = F.least(n - width, start + i, start + n - size + (distance - i))
    rows = rows.select("*", low.alias("low"), high.alias("high"), width.alias("width")).where("low <= high")
    rows = rows.select("*", F.explode(F.sequence("low", "high")).alias("at"))
    asked = rows.select("s", "size", "i", F.substring("s", F.col("at") + 1, F.col("width")).alias("piece")).distinct()

    met = first.unionByName(near(asked.join(kept, ["size", "i", "piece"])))
    return met.select(F.col("s").alias("text"), F.col("t").alias("sequence"), F.col("d").alias("distance"))


def nearest_within(decodes: DataFrame, text: str, references: DataFrame, name: str, sequence: str, distance: int) -> DataFrame:
    """Adds call, distance and margin as `nearest`, of the references at most `distance` edits away: all null if there is
    none, margin null if there is no second. The panel may be of any size."""
    found = within(decodes, text, references, sequence, distance)
    names = references.select(F.col(sequence).alias("sequence"), F.col(name).alias("name")).where("name is not null").distinct()
    by = found.join(names, "sequence").groupBy("text", "distance").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    best = by.groupBy("text").agg(F.min(F.struct("distance", "n", "name")).alias("b"), F.sort_array(F.collect_set("distance")).alias("all"))
    margin = F.when(F.col("b.n") > 1, 0).otherwise(F.get("all", F.lit(1)) - F.col("b.distance"))
    calls = best.select(F.col("text").alias("text_"), F.col("b.name").alias("call"), F.col("b.distance").alias("distance"), margin.alias("margin"))
    return decodes.join(calls, decodes[text] == calls["text_"], "left").drop("text_")


def encoded(target: Column, alphabet: str) -> Column:
    """A target's letters as numbers from 1 over alphabet[1:] (0 is the blank); another letter is an error that names it."""
    known = alphabet[1:]
    code = lambda b: F.when(F.instr(F.lit(known), b) > 0, F.instr(F.lit(known), b)).otherwise(F.raise_error(F.format_string("target contains %s, which is not in the alphabet %s", b, F.lit(alphabet))).cast("int"))
    return F.when(F.length(target) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(target, ""), code))


def decoded(codes: Column, alphabet: str) -> Column:
    """The inverse of `encoded`; blanks are left out, a number outside of the alphabet is an error."""
    letters = F.array(*map(F.lit, alphabet))
    letter = lambda c: F.when((c >= 0) & (c < len(alphabet)), F.get(letters, c)).otherwise(F.raise_error(F.format_string("%d is not in the alphabet %s", c, F.lit(alphabet))).cast("string"))
    return F.array_join(F.transform(F.filter(codes, lambda c: c != 0), letter), "")


def emitted(target: Column, state: int) -> Column:
    """What a decoder of that state length can emit of a target."""
    return F.substring(target, F.lit(state + 1), F.length(target))
