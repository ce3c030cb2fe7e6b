import gzip
import struct

import pytest

from sigloom.sources import bam, fasta, sinks, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "a.fa", ">one first\nacg\nT\n\n>two\nGG\n")
    spark.dataSource.register(fasta.FastaDataSource)
    assert [tuple(r) for r in spark.read.format("fasta").load(path).collect()] == [("one", "ACGT"), ("two", "GG")]
    assert fasta.from_text(spark, path).count() == 2


def test_bam(spark, tmp_path):
    def record(name, flag, start, cigar, sequence, tags):
        packed = bytes((bam.BASES.index(sequence[i]) << 4) | (bam.BASES.index(sequence[i + 1]) if i + 1 < len(sequence) else 0) for i in range(0, len(sequence), 2))
        body = struct.pack("<iiBBHHHiiii", 0, start, len(name) + 1, 60, 0, len(cigar), flag, len(sequence), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | o) for o, n in cigar) + packed + b"\xff" * len(sequence) + tags
        return struct.pack("<i", len(body)) + body

    tags = b"mvBc" + struct.pack("<i", 3) + bytes([5, 1, 0]) + b"nsi" + struct.pack("<i", 10) + b"CLC" + bytes([7]) + b"RGZrun\0"
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 99)
    data += record("r1", 0, 7, [(4, 1), (0, 4)], "ACGTN", tags) + record("r2", 4, -1, [], "AC", b"")
    path = tmp_path / "x.bam"
    path.write_bytes(gzip.compress(data))
    spark.dataSource.register(bam.BamDataSource)
    rows = spark.read.format("bam").load(str(path))
    first = rows.where("read_id = 'r1'").first()
    assert (first["sequence"], first["reference_name"], first["reference_start"]) == ("ACGTN", "chr1", 7)
    assert first["tags"] == {"mv": "5,1,0", "ns": "10", "CL": "7", "RG": "run"}
    assert [tuple(c) for c in first["cigar"]] == [(4, 1), (0, 4)]
    kept = tables.mapped_only(rows)
    assert [r["x"] for r in kept.select(tables.cl_tag(kept["tags"]).alias("x")).collect()] == [7]
    assert tables.mapped_only(rows, tags=(), unmapped=True).count() == 2
    assert tables.mapped_only(rows, tags=()).count() == 1
    with pytest.raises(ValueError):
        next(bam.alignments(gzip.open(write_gz(tmp_path / "y", b"nope"))))


def write_gz(path, data):
    path.write_bytes(gzip.compress(data))
    return path


def test_tables(spark, tmp_path):
    levels = tables.kmer_levels(spark, write(tmp_path / "k.tsv", "# c\nacg\t1.5\n\nAAA\tx\nACG\t2.5\n"))
    assert [tuple(r) for r in levels.collect()] == [("ACG", 2.5)]
    focus = tables.focus_table(spark, write(tmp_path / "f.tsv", "read_id\tlabel_int\tanchor_sample\na\t1\t5\n\t1\t1\na\t0\t9\n"))
    assert [r.asDict() for r in focus.collect()] == [{"read_id": "a", "label_int": 0, "anchor_sample": 9}]
    with pytest.raises(ValueError, match="missing"):
        tables.focus_table(spark, write(tmp_path / "g.tsv", "read_id\tx\na\t1\n"))
    spec = tables.comparisons(spark, write(tmp_path / "c.tsv", "#h\nm\ta, b\tn\tc\n")).first()
    assert (spec["meta1"], spec["labels1"], spec["labels2"]) == ("m", ["a", "b"], ["c"])
    with pytest.raises(ValueError, match="four"):
        tables.comparisons(spark, write(tmp_path / "d.tsv", "m\ta\n"))


def test_templates_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("A", 0, 4.0), ("B", 0, 0.0), ("A", 1, 2.0)], "aa string, position int, dwell_mean double")
    got = {(r["aa"], r["position"]): r["dwell_mean"] for r in tables.dwell_templates(rows, rows).collect()}
    assert got == {("A", 0): 4.0, ("B", 0): 4.0, ("A", 1): 2.0, ("B", 1): 1.0}
    bases = spark.createDataFrame([("A", 0, 8.0), ("A", 0, 0.0), ("C", 0, 3.0)], "aa string, position int, dwell double")
    assert sorted(r["ratio"] for r in tables.template_ratios(bases, rows).collect()) == [1.0, 1.0, 2.0]
    path = write(tmp_path / "m.csv", "read_id,pod5,anchor_end,target\na,p,5,ACG\na,p,6,ACG\n")
    with pytest.raises(ValueError, match="repeated"):
        tables.manifest(spark, path)
    with pytest.raises(ValueError, match="missing"):
        tables.manifest(spark, path, ("group",))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string")
    sinks.write_corpus(rows, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/split=test")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_corpus(rows.where("false"), str(tmp_path / "e"))
    with pytest.raises(ValueError):
        sinks.checked_yield(rows.where("x = 1"), 3)
    history = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.6)], "epoch int, loss double")
    assert sinks.best_checkpoint(history).first()["epoch"] == 2
    assert sinks.best_checkpoint(history, 1.0).first()["epoch"] == 3
    folds = spark.createDataFrame([(0, None, 0.9), (1, 0.2, 0.5), (2, 0.2, 0.7)], "fold int, final_val_loss double, best_val_f1 double")
    assert sinks.best_fold(folds).first()["fold"] == 2
