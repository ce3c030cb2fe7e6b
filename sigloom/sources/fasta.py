"""FASTA as a Spark data source: one partition a file, rows (name, sequence)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """name: the header's first word; sequence: its lines joined, in upper case."""
    name, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts).upper()
            name, parts = (line[1:].split() or [""])[0], []
        elif line and name is not None:
            parts.append(line)
    if name is not None:
        yield name, "".join(parts).upper()


class FastaReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        import gzip

        with gzip.open(partition.value, "rt") if partition.value.endswith(".gz") else open(partition.value) as file:
            yield from records(file)


class FastaDataSource(DataSource):
    """spark.dataSource.register(FastaDataSource); spark.read.format("fasta").load("a.fa,b.fa")"""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "name string, sequence string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options["path"].split(","))


def from_text(spark, path: str):
    """The same from a store that only Spark reads: files come as binary rows, so one file must fit a task."""
    from pyspark.sql import functions as F

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [r for content in batch["content"] for r in records(iter(bytes(content).decode().splitlines()))]
            yield pd.DataFrame(rows, columns=["name", "sequence"])

    return spark.read.format("binaryFile").load(path).select(F.col("content")).mapInPandas(run, "name string, sequence string")
