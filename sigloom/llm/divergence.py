"""Source divergence audit: how far the term shares of a language's sources lie apart, by term-block dense matrices.

1. One pass over the texts counts each (lang, source, term) a block of some MB, exactly, with the number of documents that
   hold the term; Spark adds the counts up. From here on nothing grows with the texts, only with groups x terms.
2. A language keeps the terms of at least `least` of its documents. A kept term is dealt to a block by its hash; a block
   holds so few terms that its matrix, groups x terms of int64, stays below CELLS.
3. A task makes the matrix of a (language, block), with a row for the language itself, turns counts into shares and adds
   up |p - q| for all pairs of rows by broadcasting one row against those below it. It returns the block's part of the
   pair matrix, and for each group a heap of the `top` terms in which it exceeds its language.
4. Spark sums the parts of the pair matrices and merges the heaps.

A share is p = 1 + floor(SCALE * (count + smooth) / (N + smooth * V)), in whole numbers throughout: exact for N up to 9e15,
with N the group's occurrences of kept terms and V the number of kept terms.

Rows: each row of the table is a document, also where rows repeat or share a doc_id. A null text is empty; a null lang or
source is ''. A group without terms has its rows like any other; a language without kept terms gives pairs of value 0 and
no terms. Ties go by the item's UTF-8 bytes. A text of any length is one block of its own. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

SCALE_STEPS, SCALE_BASE = 3, 1000  # SCALE is their power, 1e9: a step keeps what it multiplies below 2**63
BLOCK_BYTES = 4 << 20
CELLS = 1 << 22
LEAST_TERMS = 512

GAP = np.ones(256, bool)
GAP[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spelled(words: B.Words) -> pa.DictionaryArray:
    """The words themselves, coded by the distinct ones: words are the runs of non-gap bytes, so their bytes are what is
    left when the gaps go."""
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=ends[1:])
    kept = words.data[~GAP[words.data]]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(kept)).dictionary_encode()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count, docs of each block; and a row of null term for each of its groups."""
    for block in B.blocks(batches, limit=BLOCK_BYTES, owner="divergence"):
        words = B.Words(LOWER[block.data], block.offsets, GAP)
        coded = spelled(words)
        names = [block.batch.column(c).fill_null("").dictionary_encode() for c in ("lang", "source")]
        lang, source = (c.indices.to_numpy().astype(np.int64) for c in names)
        n_sources = max(1, len(names[1].dictionary))
        groups, of_row = np.unique(lang * n_sources + source, return_inverse=True)
        n_terms = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(block.n, dtype=np.int64), np.diff(words.first))
        in_row, times = np.unique(row * n_terms + coded.indices.to_numpy(), return_counts=True)
        keys, at = np.unique(of_row[in_row // n_terms] * n_terms + in_row % n_terms, return_inverse=True)
        counts = np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64)
        docs = np.bincount(at, minlength=len(keys)).astype(np.int64)
        group = groups[np.concatenate([keys // n_terms, np.arange(len(groups))])]
        none = pa.nulls(len(groups), pa.large_string())
        zero = np.zeros(len(groups), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                names[0].dictionary.take(pa.array(group // n_sources)),
                names[1].dictionary.take(pa.array(group % n_sources)),
                pa.concat_arrays([coded.dictionary.take(pa.array(keys % n_terms)), none]).cast(pa.string()),
                pa.array(np.concatenate([counts, zero])),
                pa.array(np.concatenate([docs, zero])),
            ],
            names=["lang", "source", "term", "count", "docs"],
        )


def shares(count: np.ndarray, total: np.ndarray, kept: int, smooth: int) -> np.ndarray:
    """1 + floor(SCALE * (count + smooth) / (total + smooth * kept)) by long division."""
    by = total + smooth * kept
    out, rest = np.divmod(count + smooth, by)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * SCALE_BASE, by)
        out = out * SCALE_BASE + digit
    return out + 1


def largest(value: np.ndarray, name: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` largest values, ties by name."""
    at = np.arange(len(value))
    if len(value) > top:
        at = np.flatnonzero(value >= np.partition(value, len(value) - top)[len(value) - top])
    return at[np.lexsort((name[at], -value[at]))[:top]]


def tile(smooth: int, top: int):
    """A (lang, block)'s part of the pair matrix (a < b in the order of sources) and its groups' heaps of terms."""

    def run(entries: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")  # nulls last: the language itself
        lang, kept = groups["lang"][0], groups["kept"][0].as_py()
        source = groups["source"].combine_chunks().cast(pa.large_string())
        terms = pc.unique(entries["term"]).sort()
        names = np.array([t.encode() for t in terms.to_pylist()], object)
        own = entries["source"].cast(pa.large_string())
        row = pc.fill_null(pc.index_in(own, value_set=source.drop_null()), len(source) - 1).to_numpy()
        matrix = np.zeros((len(source), len(names)), np.int64)
        matrix[row, pc.index_in(entries["term"], value_set=terms).to_numpy()] = entries["count"].to_numpy()
        p = shares(matrix, groups["total"].to_numpy()[:, None], kept, smooth) if kept else matrix
        n = len(source) - 1
        left, right, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(n - 1):
            step = max(1, CELLS // max(1, len(names)))
            for j in range(i + 1, n, step):  # all pairs of row i with a run of rows below it
                values.append(np.abs(p[j : min(n, j + step)] - p[i]).sum(1))
                right.append(np.arange(j, min(n, j + step)))
                left.append(np.full(len(right[-1]), i))
        heap_of, heap_term, heap_value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(n):
            above = np.flatnonzero((matrix[i] > 0) & (p[i] > p[n]))
            value = p[i, above] - p[n, above]
            best = largest(value, names[above], top)
            heap_of.append(np.full(len(best), i))
            heap_term.append(above[best])
            heap_value.append(value[best])
        pairs, heaps = np.concatenate(values), np.concatenate(heap_value)
        size = len(pairs) + len(heaps)
        return pa.table(
            [
                pa.repeat(lang, size),
                source.take(pa.array(np.concatenate([*left, *heap_of]))).cast(pa.string()),
                pa.concat_arrays([pa.repeat(pa.scalar("pair"), len(pairs)), pa.repeat(pa.scalar("term"), len(heaps))]),
                pa.concat_arrays([source.take(pa.array(np.concatenate(right))).cast(pa.string()), terms.take(pa.array(np.concatenate(heap_term))).cast(pa.string())]),
                pa.array(np.concatenate([pairs, heaps])),
            ],
            names=["lang", "source", "part", "item", "value"],
        )

    return B.trimmed(run)


def audit(documents: DataFrame, least: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank (from 1 in each group and part)."""
    spark = documents.sparkSession
    texts = documents.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    found = texts.mapInArrow(counted, "lang string, source string, term string, count long, docs long")
    folder = B.scratch(spark, "divergence")
    found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    groups = spark.read.parquet(f"{folder}/counts").where("term is null").select("lang", "source")  # read anew: it meets itself below
    terms = counts.where("term is not null")
    terms.groupBy("lang", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "count").write.parquet(f"{folder}/kept")
    kept = spark.read.parquet(f"{folder}/kept")

    # the matrices' size: one number for all languages, from the language that needs most blocks
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("count").alias("total")), "lang", "left").select("lang", F.col("sources") + 1, F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total")).toDF("lang", "rows", "kept", "total")
    terms_a_block = F.least(F.greatest(F.lit(LEAST_TERMS), 4 * F.col("rows")), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("rows"))))
    n_blocks = langs.agg(F.max(F.ceil(F.col("kept") / terms_a_block))).first()[0] or 1
    block = F.pmod(F.xxhash64("term"), F.lit(int(n_blocks))).cast("int").alias("block")

    entries = terms.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    sizes = entries.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    of_groups = groups.join(sizes, ["lang", "source"], "left").join(langs.select("lang", "kept"), "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept")
    rows = of_groups.unionByName(langs.select("lang", F.lit(None).cast("string").alias("source"), "total", "kept"))
    used = kept.select("lang", block).unionByName(langs.select("lang", F.lit(0).alias("block"))).distinct()
    cells = entries.select("lang", "source", "term", "count", block).unionByName(kept.select("lang", F.lit(None).cast("string").alias("source"), "term", "count", block))
    parts = cells.groupBy("lang", "block").cogroup(rows.join(used, "lang").groupBy("lang", "block")).applyInArrow(tile(smooth, top), "lang string, source string, part string, item string, value long")
    parts.write.parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")

    halves = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = halves.select("lang", ways.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    best = parts.where("part = 'term'").select("*", ranked).where(F.col("rank") <= top)
    return pairs.select("*", ranked).unionByName(best)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS q
  FROM g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_parts AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 50
"""
