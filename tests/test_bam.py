"""BAM: any number of partitions gives the same rows; filters reach the scan; what is written is read back."""

import gzip
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.sources import bam, bgzf, tables

REFERENCES = [("chr1", 10_000_000), ("tRNA-Ala-AGC-1", 90), ("ü", 5)]
HEADER = "@HD\tVN:1.6\n@CO\tText of some length\n"


def rows(n=3000, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 20, 21, 300]) if i % 400 else 150_000  # some records take several blocks
        where = rng.choice([None, "chr1", "tRNA-Ala-AGC-1"])
        tags = {"mv": ("Bc", "5,1,0,-1"), "ns": ("i", str(i)), "CL": ("C", "7"), "sd": ("f", "1.5"), "RG": ("Z", "run é"), "XA": ("A", "q"), "XS": ("BS", "65535,0"), "XE": ("Bf", "")}
        held = {k: v for k, v in tags.items() if rng.random() < 0.8}
        flag = rng.choice([0, 16, 4, 256, 2048, 1])
        out.append((
            f"read-{i}", flag, where, rng.randint(0, 9_000_000) if where else -1, rng.randint(0, 60), [(0, size)] if size else [], "".join(rng.choices("ACGTN", k=size)) or None,
            {k: v for k, (_, v) in held.items()}, "".join(chr(33 + rng.randint(0, 60)) for _ in range(size)) if size and i % 3 else None, where if i % 5 == 0 else None, -1, rng.randint(-400, 400), {k: t for k, (t, _) in held.items()},
        ))
    return out


COLUMNS = [f.name for f in bam.ARROW][:13]


def plain(r):
    return tuple(tuple((c["op"], c["len"]) if hasattr(c, "asDict") else tuple(c) for c in v) if isinstance(v, list) else tuple(sorted(v.items())) if isinstance(v, dict) else v for v in r)


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """(path of a file whose records run over its blocks' ends, rows)"""
    data = rows()
    path = tmp_path_factory.mktemp("bam") / "made.bam"
    places = {n: i for i, (n, _) in enumerate(REFERENCES)}
    with open(path, "wb") as out:
        writer = bgzf.Writer(out, whole=False)
        writer.add(bam.packed_header(REFERENCES, HEADER))
        for r in data:
            record = dict(zip(COLUMNS, r, strict=True))
            record["cigar"] = [{"op": o, "len": n} for o, n in r[5]]
            writer.add(bam.packed(record, places))
        writer.flush()
        out.write(bgzf.END)
    return str(path), data


@pytest.mark.parametrize("split", [1 << 40, 200_000, 70_000, 9_000])
def test_any_split_gives_all_rows_once(spark, made, split):
    path, data = made
    spark.dataSource.register(bam.BamDataSource)
    got = spark.read.format("bam").option("split_bytes", str(split)).option("batch", "100").load(path)
    n = got.rdd.getNumPartitions()
    assert n == 1 if split == 1 << 40 else n > 3
    assert sorted(plain(r[c] for c in COLUMNS) for r in got.collect()) == sorted(plain(r) for r in data)


def test_filters_reach_the_scan(spark, made):
    path, data = made
    got = bam.read(spark, path, min_mapq=20, split_bytes=100_000)
    want = {r[0] for r in data if not r[1] & (4 | 256 | 2048) and r[4] >= 20 and {"mv", "ns"} <= set(r[7]) and r[6]}
    assert {r["read_id"] for r in got.select("read_id").collect()} == want and want
    seen = []

    class Spy(bam.PushingReader):
        def pushFilters(self, filters):
            left = list(super().pushFilters(filters))
            seen.append((len(self.tests), len(left)))
            return left

    tests, left = bam.tests_of([bam.ds.EqualTo(("unmapped",), False), bam.ds.GreaterThanOrEqual(("mapping_quality",), 20), bam.ds.IsNotNull(("sequence",)), bam.ds.Not(bam.ds.EqualTo(("secondary",), True)), bam.ds.In(("reference_name",), ("chr1",))])
    assert [t[0] for t in tests] == ["unmapped", "mapping_quality", "secondary", "reference_name"] and len(left) == 1
    reader = Spy([path], 1 << 40, [], 10)
    reader.pushFilters([bam.ds.EqualTo(("read_id",), "read-7")])
    assert seen == [(1, 0)]
    part = reader.partitions()[0]
    assert [r for b in reader.read(part) for r in b.column("read_id").to_pylist()] == ["read-7"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "mapping_quality" not in plan.split("BatchScan")[0].split("Filter")[-1]  # no filter of Spark's is left on it


def test_filters_and_spark_agree(spark, made):
    path, data = made
    spark.dataSource.register(bam.BamDataSource)
    for on in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
        got = spark.read.format("bam").option("pushdown", on).load(path)
        tests = {
            "reverse": got.where("reverse"), "not reverse": got.where("not reverse"), "none": got.where("reference_name = 'chr1' and reference_start > 4000000 and mapping_quality <= 30"),
            "in": got.where("flag in (4, 16)"), "there": got.where("reference_name is not null"), "apart": got.where("reference_name <> 'chr1'"),
        }
        n = {k: v.count() for k, v in tests.items()}
        want = {
            "reverse": sum(bool(r[1] & 16) for r in data), "not reverse": sum(not r[1] & 16 for r in data), "none": sum(r[2] == "chr1" and r[3] > 4_000_000 and r[4] <= 30 for r in data),
            "in": sum(r[1] in (4, 16) for r in data), "there": sum(r[2] is not None for r in data), "apart": sum(r[2] not in (None, "chr1") for r in data),
        }
        assert n == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@pytest.mark.parametrize("single", [False, True])
def test_what_is_written_is_read_back(spark, made, tmp_path, single):
    path, data = made
    spark.dataSource.register(bam.BamDataSource)
    source = spark.read.format("bam").load(path).repartition(5)
    target = f"{tmp_path}/out" + (".bam" if single else "")
    bam.write(source, target, REFERENCES, HEADER, single)
    found = bam.files([target])
    assert len(found) == (1 if single else 5) and not list(tmp_path.glob("*unfinished*"))
    for one in found:  # every file is whole: gzip's own reader takes it, and it ends in the end block
        raw = open(one, "rb").read()
        assert raw.endswith(bgzf.END) and gzip.decompress(raw).startswith(b"BAM\1")
        assert next(bam.alignments(gzip.open(one)))[0].startswith("read-")
    got = spark.read.format("bam").option("split_bytes", "150000").load(target)
    assert sorted(plain(r[c] for c in COLUMNS) for r in got.collect()) == sorted(plain(r) for r in data)
    assert [tuple(r) for r in bam.references(spark, target).collect()] == [(i, n, k) for i, (n, k) in enumerate(REFERENCES)]
    with pytest.raises(Exception, match="out"):
        bam.write(source, target, REFERENCES)
    bam.write(source.where("read_id = 'read-1'"), target, REFERENCES, single=single, mode="overwrite")
    assert spark.read.format("bam").load(target).count() == 1


def test_rows_with_little_in_them(spark, tmp_path):
    few = spark.createDataFrame([("a", {"XX": "5", "YY": "text"}), (None, None)], "read_id string, tags map<string,string>")
    bam.write(few, f"{tmp_path}/few", [])
    got = sorted((r["read_id"], r["sequence"], r["reference_name"], r["tags"], r["tag_types"]) for r in spark.read.format("bam").load(f"{tmp_path}/few").collect())
    assert got == [("*", None, None, {}, {}), ("a", None, None, {"XX": "5", "YY": "text"}, {"XX": "i", "YY": "Z"})]
    assert tables.mapped_only(spark.read.format("bam").load(f"{tmp_path}/few"), tags=()).count() == 0
    with pytest.raises(Exception, match="254"):
        bam.write(few.withColumn("read_id", F.lit("x" * 300)), f"{tmp_path}/long", [])
    assert not (tmp_path / "long").exists()


def test_broken_files(spark, made, tmp_path):
    path, _ = made
    raw = open(path, "rb").read()
    (tmp_path / "cut.bam").write_bytes(raw[: len(raw) // 2])
    with pytest.raises(Exception, match="ends inside"):
        spark.read.format("bam").load(f"{tmp_path}/cut.bam").count()
    at = raw.index(bgzf.MAGIC, 200_000)
    spoilt = bytearray(raw)
    spoilt[at + 60] ^= 0xFF
    (tmp_path / "spoilt.bam").write_bytes(bytes(spoilt))
    with pytest.raises(Exception):
        spark.read.format("bam").load(f"{tmp_path}/spoilt.bam").collect()


def test_bins():
    assert bam.bin_of(0, 1) == 4681 and bam.bin_of(0, 1 << 29) == 0 and bam.bin_of((1 << 14) - 1, (1 << 14) + 1) == 585 and bam.bin_of(1 << 14, (1 << 14) + 5) == 4682


def test_a_head_in_the_data_is_no_block(tmp_path):
    """What looks like a block's head inside a block leads to no other head."""
    payload = bgzf.MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", 90)
    stored = bgzf.block(payload * 20, level=0)
    path = tmp_path / "x"
    path.write_bytes(stored + bgzf.block(b"second") + bgzf.END)
    system, inside = bgzf.opened(str(path))
    with system.open_input_file(inside) as file:
        assert bgzf.first_block(file, 1, path.stat().st_size) == len(stored)


def test_a_sequence_is_packed_as_a_whole_and_unknown_letters_are_named():
    row = {"read_id": "r", "sequence": bam.BASES + "acgun"}
    assert bam.parsed(bam.packed(row, {})[4:], [])[6] == bam.BASES + "ACGTN"
    for letter in "EFI5":  # some of them would read as codes
        with pytest.raises(ValueError, match=f"a sequence has {letter}"):
            bam.packed({"read_id": "r", "sequence": f"AC{letter}G"}, {})


def test_columns_are_taken_apart_as_they_are():
    kinds = {"c": pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())])), "t": pa.map_(pa.string(), pa.string()), "s": pa.string()}
    columns = {"c": [[{"op": 0, "len": 3}, {"op": 1, "len": 2}], None, [], [{"op": 2, "len": None}]], "t": [[("a", "1"), ("b", None)], [], None, [("c", "2")]], "s": ["x", None, "", "y"]}
    for name, kind in kinds.items():
        for column in (whole := pa.array(columns[name], kind), whole.slice(1), whole.slice(0, 1), whole.slice(4)):
            assert bam.values_of(column) == column.to_pylist()
