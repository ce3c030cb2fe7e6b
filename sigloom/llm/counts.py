"""Token counts of texts without token ids.

1. Every text is cut into the pre-tokens of a byte-level BPE file. The distinct pre-tokens and their frequencies over the
   whole corpus are one group-by.
2. The pieces of each distinct pre-token are counted once, by the file's own merges.
3. The counts are joined to each document's pre-token frequencies and summed. The most frequent pre-tokens, of HEAD entries,
   HEAD_BYTES bytes and LONG bytes each at most, are sent to the workers and summed as the texts stream by; the rest is
   joined by a shuffle. A frequent pre-token thus never meets its documents in one task.

Special strings (added tokens) count one each, as the library does by default, and cut the text.

Null or empty text: no bytes, no tokens. Repeated rows keep their own rows. Null doc_id: a row like any other. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .tokens import written

HEAD, HEAD_BYTES, LONG = 300_000, 8 << 20, 64
FLUSH = 600_000
#: White space as the tokenizer's regular expressions have it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pre-tokens as byte-level files cut them: endings after an apostrophe, runs of letters, of numbers and of other signs, each
#: with the space before it, and white space.
ENDINGS = "'(?:[stmd]|re|ve|ll)"
GAPS = f"[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
CUT = re.compile(f"{ENDINGS}| ?[^\\W\\d_]+| ?\\d+| ?(?:[^\\w{WHITE}]|_)+|{GAPS}")
#: The same where there are numbers that are no decimal digits, which the standard library takes for letters.
OTHER_NUMBERS = regex.compile(r"[\p{Nl}\p{No}]")
CUT_ANY = regex.compile(f"{ENDINGS}| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WHITE}\\p{{L}}\\p{{N}}]+|{GAPS}")


def cut(text: str) -> list[str]:
    return CUT.findall(text) if text.isascii() or not OTHER_NUMBERS.search(text) else CUT_ANY.findall(text)


class PieceCounter:
    """Pieces of pre-tokens, as the file gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(path)
        self.model = full.model
        special = sorted((t.content for t in full.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def pieces(self, form: str) -> int:
        return len(self.model.tokenize(written(form)))

    def forms(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings it has."""
        if not self.special or not self.special.search(text):
            return cut(text), 0
        parts = self.special.split(text)
        return [f for part in parts for f in cut(part)], len(parts) - 1


def counter(path: str) -> PieceCounter:
    return B.remembered("counts", "pieces", path, lambda: PieceCounter(path))


def distinct_units(documents: DataFrame, path: str) -> DataFrame:
    """form, n (occurrences in the corpus), pieces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = counter(path), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["form", "n"])

        for block in B.blocks(batches, owner="counts"):
            for text in block.texts():
                seen.update(c.forms(text.decode("utf-8", "replace"))[0])
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n = [c.pieces(f) for f in batch.column("form").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["form", "n", "pieces"])

    units = documents.select("text").mapInArrow(gather, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    return units.mapInArrow(count, "form string, n long, pieces long")


def head_of(units: DataFrame, most: int = HEAD, size: int = HEAD_BYTES) -> dict[str, int]:
    """form -> pieces of the pre-tokens of the highest counts n that are not long: as many whole counts as make `most`
    entries and `size` bytes at most."""
    # counts below 1024 one by one, then in eighths of a power of two: some hundred rows
    step = F.when(F.col("n") < 1024, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 8) + 1024.0 - 80)
    short = units.where(F.octet_length("form") <= LONG)
    steps = {r["step"]: (r["k"], r["size"]) for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.sum(F.octet_length("form")).alias("size")).collect()}
    entries, held, least = 0, 0, float("inf")
    for s in sorted(steps, reverse=True):
        entries, held = entries + steps[s][0], held + steps[s][1]
        if entries > most or held > size:
            break
        least = s
    if least == float("inf"):
        return {}
    table = short.where(step >= least).select("form", "pieces").toArrow()
    return dict(zip(table["form"].to_pylist(), table["pieces"].to_pylist(), strict=True))


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, one row per row."""
    spark = documents.sparkSession
    folder = B.scratch(spark, "units")
    distinct_units(documents, path).write.parquet(folder)
    units = spark.read.parquet(folder)
    sent = spark.sparkContext.broadcast(head_of(units))  # bounded as the module's text says

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known = counter(path), sent.value
        for block in B.blocks(batches, owner="counts"):
            sums, rest_form, rest_n, rest_of = [], [], [], [0]
            for text in block.texts():
                found, n = c.forms(text.decode("utf-8", "replace"))
                pieces = [known.get(f, -1) for f in found]
                n += sum(pieces)
                if -1 in pieces:
                    rest = Counter(f for f, p in zip(found, pieces, strict=True) if p < 0)
                    n += sum(rest.values())
                    rest_form += rest
                    rest_n += rest.values()
                sums.append(n)
                rest_of.append(len(rest_form))
            rest = pa.StructArray.from_arrays([pa.array(rest_form, pa.string()), pa.array(rest_n, pa.int32())], ["form", "n"])
            yield pa.RecordBatch.from_arrays(
                [block.batch.column("row"), block.batch.column("doc_id"), pa.array(np.diff(block.offsets)), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(rest_of, pa.int32()), rest)],
                names=["row", "doc_id", "n_bytes", "known", "rest"],
            )

    keyed = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    folder = B.scratch(spark, "known")
    keyed.mapInArrow(run, "row long, doc_id long, n_bytes long, known long, rest array<struct<form: string, n: int>>").write.parquet(folder)
    docs = spark.read.parquet(folder)
    rest = docs.select("row", F.explode("rest").alias("u")).select("row", "u.form", "u.n")
    sums = rest.join(units.select("form", "pieces"), "form").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    return docs.join(sums, "row", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
