"""Calls from pairwise votes. Votes are rows (read_id, pair, prob); pairs is a small table (pair, neg, pos, place)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_labels(pair: Column, known: Column | None = None) -> Column:
    """(neg, pos) of a pair: the known ones, else what stands before and after the first underscore."""
    neg = F.substring_index(pair, "_", 1)
    split = F.struct(neg.alias("neg"), F.substr(pair, F.length(neg) + 2).alias("pos"))
    return split if known is None else F.coalesce(known, split)


def cast(votes: DataFrame, pairs: DataFrame, weighted: bool = False) -> DataFrame:
    """Two rows a vote: read_id, class, vote, place (the class's place of first appearance among the pairs)."""
    rows = votes.join(F.broadcast(pairs), "pair")
    weight = F.abs(2 * F.col("prob") - 1) if weighted else F.lit(1.0)
    both = F.array(
        F.struct(F.col("neg").alias("class"), ((1 - F.col("prob")) * weight).alias("vote"), (2 * F.col("place")).alias("place")),
        F.struct(F.col("pos").alias("class"), (F.col("prob") * weight).alias("vote"), (2 * F.col("place") + 1).alias("place")),
    )
    return rows.select("read_id", "pair", F.explode(both).alias("x")).select("read_id", "pair", "x.*")


def tallied(cast_votes: DataFrame) -> DataFrame:
    """Votes by read and class, rounded so that equal sums of different order tie."""
    return cast_votes.groupBy("read_id", "class").agg(F.round(F.sum("vote"), 9).alias("votes"), F.min("place").alias("place"))


def called(tally: DataFrame) -> DataFrame:
    """The class of most votes, the earlier of equal ones, and its share (0 if there are no votes)."""
    best = tally.groupBy("read_id").agg(F.max(F.struct("votes", (-F.col("place")).alias("first"), "class")).alias("x"), F.sum("votes").alias("all"))
    share = F.when(F.col("all") > 0, F.col("x.votes") / F.col("all")).otherwise(F.lit(0.0))
    return best.select("read_id", F.col("x.class").alias("call"), F.round(share, 9).alias("confidence"))


def pairwise(votes: DataFrame, pairs: DataFrame, weighted: bool = False) -> DataFrame:
    return called(tallied(cast(votes, pairs, weighted)))


def tournament(votes: DataFrame, pairs: DataFrame, top: int = 5) -> DataFrame:
    """A second round among the first round's top classes, with the pairs that are wholly among them. Equal votes go to
    the class that ranked higher in the first; without such a pair that is the call, with a confidence of 0."""
    rank = F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("votes"), "place"))
    stay = tallied(cast(votes, pairs)).withColumn("rank", rank).where(F.col("rank") <= top).select("read_id", "class", "rank")
    sides = pairs.select("pair", F.explode(F.array("neg", "pos")).alias("class"))
    # a pair stays for a read if both its classes do
    left = stay.join(F.broadcast(sides), "class").groupBy("read_id", "pair").count().where("count = 2").select("read_id", "pair")
    again = cast(votes.join(left, ["read_id", "pair"], "left_semi"), pairs).select("read_id", "class", "vote")
    tally = stay.join(again, ["read_id", "class"], "left").groupBy("read_id", "class").agg(F.round(F.coalesce(F.sum("vote"), F.lit(0.0)), 9).alias("votes"), F.min("rank").alias("place"))
    return called(tally)


def one_vs_all(votes: DataFrame, pairs: DataFrame) -> DataFrame:
    """score(neg) = 1 - prob; the class of the highest score."""
    rows = votes.join(F.broadcast(pairs), "pair").select("read_id", F.struct(F.round(1 - F.col("prob"), 9).alias("score"), (-F.col("place")).alias("first"), F.col("neg").alias("class")).alias("x"))
    return rows.groupBy("read_id").agg(F.max("x").alias("x")).select("read_id", F.col("x.class").alias("call"), F.round("x.score", 6).alias("confidence"))


def byte(p: Column) -> Column:
    """A probability as 0..255, halves to even."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(p * 255).cast("int")))


def disrupted(indel: Column, mapped: Column) -> Column:
    return ~mapped | F.coalesce(indel != 0, F.lit(False))


def accepted(calls: DataFrame, least_confidence: int = 0, least_margin: int = 0, abstain_disrupted: bool = False) -> DataFrame:
    """probs (array), call, junction_indel, junction_mapped -> confidence and margin as bytes, and the call or `unc`.
    With abstain_disrupted the margin binds only where the junction is disrupted."""
    order = F.sort_array("probs", asc=False)
    margin = F.when(F.size("probs") > 1, F.get(order, F.lit(0)) - F.get(order, F.lit(1))).otherwise(F.lit(1.0))
    rows = calls.withColumn("ac", byte(F.get(order, F.lit(0)))).withColumn("am", byte(margin))
    wide = F.col("am") >= least_margin
    if abstain_disrupted:
        wide = wide | ~disrupted(F.col("junction_indel"), F.col("junction_mapped"))
    return rows.withColumn("aa", F.when((F.col("ac") >= least_confidence) & wide, F.col("call")).otherwise("unc"))


def tags(predictions: DataFrame, pick: str = "first") -> DataFrame:
    """One row a read from rows (read_id, base_idx, prob): the first or last chunk's probability, and all of them as
    bytes, cut off rather than rounded, in base order."""
    order = {"first": F.min, "last": F.max}[pick]
    chosen = predictions.groupBy("read_id").agg(order(F.struct("base_idx", "prob")).alias("x"), F.sort_array(F.collect_list(F.struct("base_idx", F.floor(F.col("prob") * 255).cast("int").alias("b")))).alias("all"))
    return chosen.select("read_id", F.col("x.prob").alias("prob"), F.array_join(F.transform("all", lambda t: t["b"].cast("string")), ",").alias("ml"))
