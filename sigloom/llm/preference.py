"""Preference pairs for chat models, with DataFrame functions alone.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same role, same text) is rendered
once, as the prompt; what follows in each is its completion. A turn is rendered as a header, its text and an end mark; a
completion's mask names runs of characters in order, `1xN` for N characters to be learned (text and end mark of the
trained role) and `0xN` for N others.

A conversation's turns are ordered by turn (null first), then role, then text; repeated rows are repeated turns. Null
role or text: empty. Null conv_id: no pair. A conversation without a partner: no pair. Equal conversations: both
completions are empty and `equal` is true. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def mask(turns: Column, trained: str) -> Column:
    def runs(t: Column) -> Column:
        return F.concat(F.lit("0x"), F.length(header(t)), F.when(t["role"] == trained, F.lit(" 1x")).otherwise(F.lit(" 0x")), F.length(body(t)))

    return F.array_join(F.transform(turns, runs), " ")


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two lists of turns."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, F.lit(1), n), lambda t, i: (t["role"] == F.get(b, i)["role"]) & (t["text"] == F.get(b, i)["text"]))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs == 0, n.cast("long")).otherwise(differs - 1).cast("long")


def formatted(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(pair_id, rejected boolean, turn, role, text) -> pair_id, n_common, prompt, chosen, chosen_mask, rejected,
    rejected_mask, equal. One shuffle, on pair_id; a list holds one pair's turns."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def side(rejected: bool) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("rejected") == rejected, turn)))

    pairs = turns.where("pair_id is not null").groupBy("pair_id").agg(side(False).alias("a"), side(True).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    n = F.col("n_common").cast("int")
    rest = {c: F.slice(F.col(c), n + 1, F.size(c)) for c in "ab"}
    return pairs.withColumn("n_common", common_turns(F.col("a"), F.col("b"))).select(
        "pair_id",
        "n_common",
        rendered(F.slice("a", F.lit(1), n)).alias("prompt"),
        rendered(rest["a"]).alias("chosen"),
        mask(rest["a"], trained).alias("chosen_mask"),
        rendered(rest["b"]).alias("rejected"),
        mask(rest["b"], trained).alias("rejected_mask"),
        ((F.size("a") == n) & (F.size("b") == n)).alias("equal"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Turns of pairs of neighbours: of conversations 2k and 2k + 1, the first is the chosen one."""
    return conversations.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.col("conv_id").bitwiseAND(1) == 1).alias("rejected"), "turn", "role", "text")


ORACLE = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side,
         list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS x
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT a.pair_id, a.x AS a, b.x AS b FROM t a JOIN t b USING (pair_id) WHERE a.side = 0 AND b.side = 1),
s AS (SELECT *, list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role = b[i].role AND a[i].text = b[i].text) AS same FROM p),
n AS (SELECT *, coalesce(nullif(list_position(same, false), 0) - 1, len(same)) AS k FROM s)
SELECT pair_id, CAST(k AS BIGINT) AS n_common,
       array_to_string(list_transform(a[:k], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS prompt,
       array_to_string(list_transform(a[k + 1:], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS chosen,
       array_to_string(list_transform(a[k + 1:], lambda t: '0x' || (length(t.role) + 5) || CASE WHEN t.role = 'assistant' THEN ' 1x' ELSE ' 0x' END || (length(t.text) + 8)), ' ') AS chosen_mask,
       array_to_string(list_transform(b[k + 1:], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS rejected,
       array_to_string(list_transform(b[k + 1:], lambda t: '0x' || (length(t.role) + 5) || CASE WHEN t.role = 'assistant' THEN ' 1x' ELSE ' 0x' END || (length(t.text) + 8)), ' ') AS rejected_mask,
       len(a) = k AND len(b) = k AS equal
FROM n
"""
