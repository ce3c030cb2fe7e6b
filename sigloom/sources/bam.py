"""BAM as a Spark data source and sink: alignments with their tags.

Reading. A file of blocks is cut into partitions of split_bytes; a partition has the records that start in a block that
starts in it. Its first block is found by the block's own head, its first record by what a record must look like, checked
over the records that follow it. A file that is one gzip stream without blocks is one partition. With pushdown, filters on
the fixed fields (flag and its bits, mapping_quality, reference_name, reference_start, read_id) are applied before a record is
decoded; the tags that the option require_tags names always are. Rows come in Arrow batches.

Writing. Each task writes a file of its own, which is a whole BAM file; they get their names when all are done. With the
option single the tasks write blocks alone, and the end of the job joins header, parts and end block in one file.

Tags are text, arrays comma-joined numbers; tag_types has their types (i, f, Z, ..., or B and the array's).
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import bgzf

#: Fixed values of the format: letters of packed bases, sizes and codes of tag types, bits of the flag, first bins by shift.
BASES = "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
BITS = {"unmapped": 0x4, "reverse": 0x10, "secondary": 0x100, "supplementary": 0x800}
BINS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
SCHEMA = (
    "read_id string, flag int, reference_name string, reference_start int, mapping_quality int, cigar array<struct<op: int, len: int>>,"
    " sequence string, tags map<string, string>, qualities string, next_reference_name string, next_reference_start int, template_length int, tag_types map<string, string>,"
    " unmapped boolean, reverse boolean, secondary boolean, supplementary boolean"
)
ARROW = pa.schema([
    ("read_id", pa.string()), ("flag", pa.int32()), ("reference_name", pa.string()), ("reference_start", pa.int32()), ("mapping_quality", pa.int32()),
    ("cigar", pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())]))), ("sequence", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("qualities", pa.string()),
    ("next_reference_name", pa.string()), ("next_reference_start", pa.int32()), ("template_length", pa.int32()), ("tag_types", pa.map_(pa.string(), pa.string())),
    *[(name, pa.bool_()) for name in BITS],
])
NIBBLES, CODES, KNOWN = str.maketrans("0123456789abcdef", BASES), str.maketrans(BASES, "0123456789abcdef"), frozenset(BASES)
SPLIT_BYTES, ROWS, LARGEST, CHAIN = 32 << 20, 2048, 1 << 28, 8
HEAD = struct.Struct("<iiBBHHHiiii")


def parsed_tags(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """Values and types by tag."""
    out, kinds, at = {}, {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out[name], at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(b"\0", at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            kind += chr(data[at])
            code, n = NUMBERS[kind[1]], struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{code}", data, at + 5)
            out[name], at = ",".join(map(str, values)), at + 5 + n * struct.calcsize(code)
        else:
            code = NUMBERS[kind]
            out[name], at = str(struct.unpack_from(f"<{code}", data, at)[0]), at + struct.calcsize(code)
        kinds[name] = kind
    return out, kinds


def packed_tags(tags: dict[str, str], kinds: dict[str, str]) -> bytes:
    """The inverse; a tag without a type is a 32-bit number if it reads as one, else text."""
    out = b""
    for name, text in tags.items():
        kind = kinds.get(name) or ("i" if re.match(r"-?\d{1,9}\Z", text) else "Z")
        out += name.encode() + kind[0].encode()
        if kind == "A":
            out += text.encode("latin-1")
        elif kind in ("Z", "H"):
            out += text.encode() + b"\0"
        else:
            code = NUMBERS[kind[-1]]
            values = [float(x) if code == "f" else int(x) for x in text.split(",") if x]
            out += (kind[1].encode() + struct.pack("<i", len(values)) if kind[0] == "B" else b"") + struct.pack(f"<{len(values)}{code}", *values)
    return out


def parsed(record: bytes, names: list[str]) -> tuple:
    reference, start, l_name, quality, _, n_cigar, flag, l_seq, next_reference, next_start, length = HEAD.unpack_from(record, 0)
    at = 32 + l_name
    name = record[32 : at - 1].decode()
    cigar = [{"op": x & 15, "len": x >> 4} for x in struct.unpack_from(f"<{n_cigar}I", record, at)]
    at += 4 * n_cigar
    half = (l_seq + 1) // 2
    sequence = record[at : at + half].hex().translate(NIBBLES)[:l_seq]
    scores = record[at + half : at + half + l_seq]
    tags, kinds = parsed_tags(record[at + half + l_seq :])
    named = lambda i: names[i] if i >= 0 else None
    qualities = None if not l_seq or scores[0] == 0xFF else bytes(min(q, 93) + 33 for q in scores).decode()
    return name, flag, named(reference), start, quality, cigar, sequence or None, tags, qualities, named(next_reference), next_start, length, kinds, *[bool(flag & b) for b in BITS.values()]


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    return next((first + (start >> shift) for shift, first in BINS if start >> shift == (end - 1) >> shift), 0)


def packed(row: dict, places: dict[str, int]) -> bytes:
    """A row as a record, its size before it. Missing fields are the format's own: -1, 0, nothing."""
    name, sequence, cigar = (row.get("read_id") or "*").encode() + b"\0", row.get("sequence") or "", row.get("cigar") or []
    if len(name) > 255:
        raise ValueError(f"a read's name has {len(name) - 1} bytes, at most 254 fit")
    start = -1 if row.get("reference_start") is None else row["reference_start"]
    span = sum(c["len"] for c in cigar if c["op"] in (0, 2, 3, 7, 8)) or 1
    letters = sequence.upper().replace("U", "T")
    if not KNOWN.issuperset(letters):
        raise ValueError(f"a sequence has {', '.join(sorted(set(letters) - KNOWN))}, which no record can hold")
    codes = letters.translate(CODES)
    scores = row.get("qualities")
    at = lambda key: -1 if row.get(key) is None else places[row[key]]
    next_start = -1 if row.get("next_reference_start") is None else row["next_reference_start"]
    head = HEAD.pack(at("reference_name"), start, len(name), row.get("mapping_quality") or 0, bin_of(max(start, 0), max(start, 0) + span), len(cigar), row.get("flag") or 0, len(sequence), at("next_reference_name"), next_start, row.get("template_length") or 0)
    body = head + name + struct.pack(f"<{len(cigar)}I", *[c["len"] << 4 | c["op"] for c in cigar]) + bytes.fromhex(codes + "0" * (len(codes) % 2))
    body += bytes(ord(q) - 33 for q in scores) if scores else b"\xff" * len(sequence)
    body += packed_tags(dict(row.get("tags") or {}), dict(row.get("tag_types") or {}))
    return struct.pack("<i", len(body)) + body


def values_of(column: pa.Array) -> list:
    """A column's values as to_pylist gives them; maps and lists of structs are taken apart as a whole, not value by value."""
    kind = column.type
    if pa.types.is_map(kind):
        parts = list(zip(column.keys.to_pylist(), column.items.to_pylist(), strict=True))
    elif pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        fields = [f.name for f in kind.value_type]
        parts = [dict(zip(fields, x, strict=True)) for x in zip(*(f.to_pylist() for f in column.values.flatten()), strict=True)]
    else:
        return column.to_pylist()
    at = column.offsets.to_pylist()
    return [parts[a:b] if there else None for a, b, there in zip(at, at[1:], column.is_valid().to_pylist(), strict=False)]


def packed_header(references: list[tuple[str, int]], text: str = "") -> bytes:
    raw = text.encode()
    parts = [b"BAM\1", struct.pack("<i", len(raw)), raw, struct.pack("<i", len(references))]
    for name, length in references:
        parts.append(struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", length))
    return b"".join(parts)


def parsed_header(read: Callable[[int], bytes]) -> tuple[str, list[tuple[str, int]]]:
    """Text and references (name, length) of an unpacked stream."""
    number = lambda: struct.unpack("<i", read(4))[0]
    if read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = read(number()).rstrip(b"\0").decode()
    return text, [(read(number())[:-1].decode(), number()) for _ in range(number())]


def alignments(file) -> Iterator[tuple]:
    """Records of an open, decompressed BAM stream."""
    names = [name for name, _ in parsed_header(file.read)[1]]
    for record in records(file.read):
        yield parsed(record, names)


def records(read: Callable[[int], bytes]) -> Iterator[bytes]:
    while len(raw := read(4)) == 4:
        yield read(struct.unpack("<i", raw)[0])


def looks_right(data: bytes, at: int, n_references: int) -> int | None:
    """Where the record that may start there ends; None if it can't be one. Only what is in data is looked at."""
    if at + 36 > len(data):
        return None
    size = struct.unpack_from("<i", data, at)[0]
    if not 33 <= size <= LARGEST:
        return None
    reference, start, l_name, _, _, n_cigar, flag, l_seq, next_reference, next_start, _ = HEAD.unpack_from(data, at + 4)
    if not (-1 <= reference < n_references and -1 <= next_reference < n_references and start >= -1 and next_start >= -1 and l_name >= 1 and l_seq >= 0 and flag < 0x1000):
        return None
    if 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] != 0 or any(not 33 <= b <= 126 for b in name[:-1])):
        return None
    return at + 4 + size


def first_record(data: bytes, stop: int, n_references: int, whole: bool) -> int | None:
    """The first place before stop from which records follow one another, up to CHAIN of them or to the end of data; whole:
    nothing comes after data, so the last must end there."""
    for at in range(min(stop, len(data))):
        end, n = looks_right(data, at, n_references), 0
        while end is not None and end < len(data) and n < CHAIN:
            if end + 36 > len(data) and not whole:
                break
            end, n = looks_right(data, end, n_references), n + 1
        if end is not None and (not whole or n == CHAIN or end == len(data)):
            return at
    return None


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int  # 0: a stream without blocks
    first: int = 0  # of the file's first part: bytes of the header


def tests_of(filters: list[ds.Filter]) -> tuple[list[tuple], list[ds.Filter]]:
    """Filters on fixed fields as (name, operation, value), and the others."""
    kinds = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.In: "in", ds.IsNotNull: "there"}
    fixed = {"flag", "mapping_quality", "reference_name", "reference_start", "read_id", *BITS}
    taken, left = [], []
    for one in filters:
        plain, sign = (one.child, False) if isinstance(one, ds.Not) else (one, True)
        kind = kinds.get(type(plain))
        if kind and len(plain.attribute) == 1 and plain.attribute[0] in fixed and (sign or plain.attribute[0] in BITS):
            taken.append((plain.attribute[0], kind, getattr(plain, "value", None), sign))
        else:
            left.append(one)
    return taken, left


def passes(record: bytes, names: list[str], tests: list[tuple]) -> bool:
    """Whether a record's fixed fields pass, looked at where they lie."""
    if not tests:
        return True
    reference, start, l_name, quality, _, _, flag, *_ = HEAD.unpack_from(record, 0)
    for name, kind, value, sign in tests:
        if name in BITS:
            x = bool(flag & BITS[name])
        elif name == "reference_name":
            x = names[reference] if reference >= 0 else None
        elif name == "read_id":
            x = record[32 : 31 + l_name].decode()
        else:
            x = {"flag": flag, "mapping_quality": quality, "reference_start": start}[name]
        if kind == "there":
            right = x is not None
        elif x is None:
            return False
        else:
            right = {"=": lambda: x == value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value, "in": lambda: x in value}[kind]()
        if right != sign:
            return False
    return True


class BamReader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int, require_tags: list[str], batch: int):
        self.paths, self.split_bytes, self.require_tags, self.batch = paths, split_bytes, require_tags, batch
        self.tests: list[tuple] = []

    def partitions(self) -> list[Part]:
        out = []
        for path in files(self.paths):
            system, inside = bgzf.opened(path)
            size = system.get_file_info(inside).size
            with system.open_input_file(inside) as file:
                if bgzf.length_at(file.read_at(min(64, size), 0), 0) is None:
                    out.append(Part(path, 0, 0))
                    continue
                read, taken = reading(bgzf.blocks(file, 0, size))
                parsed_header(read)
            out.append(Part(path, 0, min(size, self.split_bytes), taken()))
            out += [Part(path, a, min(size, a + self.split_bytes)) for a in range(self.split_bytes, size, self.split_bytes)]
        return out

    def records(self, part: Part) -> Iterator[tuple[bytes, list[str]]]:
        system, inside = bgzf.opened(part.path)
        if not part.stop:
            with system.open_input_stream(inside, compression=None) as raw, gzip.open(raw) as file:
                names = [name for name, _ in parsed_header(file.read)[1]]
                yield from ((r, names) for r in records(file.read))
            return
        size = system.get_file_info(inside).size
        with system.open_input_file(inside) as file:
            names = [name for name, _ in parsed_header(reading(bgzf.blocks(file, 0, size))[0])[1]]
            start = 0 if part.first else bgzf.first_block(file, part.start, size)
            if start is None or start >= part.stop:
                return
            yield from ((r, names) for r in part_records(bgzf.blocks(file, start, size), part, len(names)))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        held = []
        for record, names in self.records(part):
            if not passes(record, names, self.tests):
                continue
            row = parsed(record, names)
            if all(t in row[7] for t in self.require_tags):
                held.append(row)
            if len(held) == self.batch:
                yield arrow(held)
                held = []
        if held:
            yield arrow(held)


class PushingReader(BamReader):
    """The reader for a session that lets sources take filters; in another one Spark refuses it."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        self.tests, left = tests_of(filters)
        yield from left


def part_records(blocks: Iterator[tuple[int, bytes]], part: Part, n_references: int) -> Iterator[bytes]:
    """The records that start in the blocks before part.stop."""
    data, edges, ended = b"", [], False  # edges: (place in data, place of the block in the file)

    def more() -> bool:
        nonlocal data, ended
        place, content = next(blocks, (None, b""))
        if place is None:
            ended = True
            return False
        edges.append((len(data), place))
        data += content
        return True

    def within(at: int) -> bool:
        """Whether the block that holds a place of data starts before the part's end."""
        return max((e for e in edges if e[0] <= at), default=(0, part.stop))[1] < part.stop

    at = part.first
    if part.first:
        while len(data) < at and more():
            pass
    else:
        n = 0
        while True:  # the first record may start in a later block than the first
            while len(data) < n + 4 * bgzf.MOST and more():
                pass
            # a long record may reach beyond what is there: more is read until the chain can be told
            found = first_record(data, len(data), n_references, ended)
            if found is not None and (ended or looks_right(data, found, n_references) <= len(data)):
                at = found
                break
            if ended or len(data) > LARGEST:
                return
            n = len(data)
    while True:
        while len(data) < at + 4 and more():
            pass
        if len(data) < at + 4 or not within(at):
            return
        end = at + 4 + struct.unpack_from("<i", data, at)[0]
        while len(data) < end and more():
            pass
        if len(data) < end:
            raise ValueError("the file ends inside a record")
        yield data[at + 4 : end]
        at = end
        if at > 8 * bgzf.MOST:
            data = data[at:]
            last = max((e for e in edges if e[0] <= at), default=None)
            edges[:] = [(0, last[1])] + [(e - at, p) for e, p in edges if e > at]
            at = 0


def reading(blocks: Iterator[tuple[int, bytes]]) -> tuple[Callable[[int], bytes], Callable[[], int]]:
    """read(n) over blocks, and how much it has given."""
    held, given = bytearray(), 0

    def read(n: int) -> bytes:
        nonlocal given
        while len(held) < n:
            place, content = next(blocks, (None, b""))
            if place is None:
                break
            held.extend(content)
        out = bytes(held[:n])
        del held[:n]
        given += len(out)
        return out

    return read, lambda: given


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    for i in (7, 12):
        columns[i] = [list(m.items()) for m in columns[i]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def files(paths: list[str]) -> list[str]:
    """The paths, and instead of a folder the .bam files in it."""
    out = []
    for path in paths:
        system, inside = bgzf.opened(path)
        if system.get_file_info(inside).type == bgzf.fs.FileType.Directory:
            found = system.get_file_info(bgzf.fs.FileSelector(inside))
            out += sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.base_name.endswith(".bam"))
        else:
            out.append(path)
    if not out:
        raise ValueError(f"no .bam in {', '.join(paths)}")
    return out


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    records: int


class BamWriter(DataSourceArrowWriter):
    def __init__(self, path: str, references: list[tuple[str, int]], text: str, single: bool, overwrite: bool):
        self.path, self.references, self.text, self.single, self.overwrite = path, references, text, single, overwrite
        self.folder = f"{path.rstrip('/')}.{uuid.uuid4().hex}.unfinished"
        system, inside = bgzf.opened(path)
        if not overwrite and system.get_file_info(inside).type != bgzf.fs.FileType.NotFound:
            raise FileExistsError(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part, name, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        places = {name: i for i, (name, _) in enumerate(self.references)}
        system, folder = bgzf.opened(self.folder)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            writer = bgzf.Writer(out)
            if not self.single:
                writer.add(packed_header(self.references, self.text))
                writer.flush()
            for batch in iterator:
                for values in zip(*map(values_of, batch.columns), strict=True):
                    writer.add(packed(dict(zip(batch.schema.names, values, strict=True)), places))
                    n += 1
            writer.flush()
            if not self.single:
                out.write(bgzf.END)
        return Written(part, name, n)

    def commit(self, messages: list[Written]) -> None:
        """What a task wrote that was tried again has no message and goes with the folder."""
        system, target = bgzf.opened(self.path)
        folder = bgzf.opened(self.folder)[1]
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        if self.overwrite and (kind := system.get_file_info(target).type) != bgzf.fs.FileType.NotFound:
            system.delete_dir(target) if kind == bgzf.fs.FileType.Directory else system.delete_file(target)
        if self.single:
            with system.open_output_stream(f"{target}.joining", compression=None) as out:
                head = bgzf.Writer(out)
                head.add(packed_header(self.references, self.text))
                head.flush()
                for m in parts:
                    with system.open_input_stream(f"{folder}/{m.name}", compression=None) as file:
                        while piece := file.read(8 << 20):
                            out.write(piece)
                out.write(bgzf.END)
            system.move(f"{target}.joining", target)
        else:
            system.create_dir(target, recursive=True)
            for m in parts:
                system.move(f"{folder}/{m.name}", f"{target}/part-{m.part:05d}.bam")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        system, folder = bgzf.opened(self.folder)
        if system.get_file_info(folder).type == bgzf.fs.FileType.Directory:
            system.delete_dir(folder)


class BamDataSource(DataSource):
    """spark.dataSource.register(BamDataSource); spark.read.format("bam").load("a.bam,b.bam"). Options: split_bytes,
    require_tags (comma-joined), batch, pushdown (which needs spark.sql.python.filterPushdown.enabled); to write: references (JSON of name, length), header, single."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        tags = [t for t in self.options.get("require_tags", "").split(",") if t]
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else BamReader
        return kind(self.options["path"].split(","), int(self.options.get("split_bytes", SPLIT_BYTES)), tags, int(self.options.get("batch", ROWS)))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        references = [(str(n), int(k)) for n, k in json.loads(self.options.get("references", "[]"))]
        return BamWriter(self.options["path"], references, self.options.get("header", ""), self.options.get("single", "false").lower() == "true", overwrite)


def read(spark: SparkSession, path: str, min_mapq: int = 0, tags: tuple[str, ...] = ("mv", "ns"), unmapped: bool = False, secondary: bool = False, supplementary: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The alignments that count, chosen while they are read: by the flag's bits, mapping quality, and the tags they must
    have; a name and a sequence are always needed."""
    spark.dataSource.register(BamDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("bam").option("split_bytes", str(split_bytes)).option("require_tags", ",".join(tags)).option("pushdown", "true").load(path)
    for bit, wanted in (("unmapped", unmapped), ("secondary", secondary), ("supplementary", supplementary)):
        if not wanted:
            rows = rows.where(F.col(bit) == F.lit(False))
    return rows.where((F.col("mapping_quality") >= min_mapq) & F.col("read_id").isNotNull() & F.col("sequence").isNotNull())


def write(rows: DataFrame, path: str, references: list[tuple[str, int]], header: str = "", single: bool = False, mode: str = "append") -> None:
    """Rows of SCHEMA's columns (missing ones are the format's own missing values) as BAM files, or one file."""
    rows.sparkSession.dataSource.register(BamDataSource)
    schema = rows.sparkSession.createDataFrame([], SCHEMA).schema
    shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    shaped.write.format("bam").option("references", json.dumps(references)).option("header", header).option("single", str(single).lower()).mode(mode).save(path)


def references(spark: SparkSession, path: str) -> DataFrame:
    """place, reference_name, length of a file's header."""
    system, inside = bgzf.opened(files([path])[0])
    size = system.get_file_info(inside).size
    with system.open_input_file(inside) as file:
        found = parsed_header(reading(bgzf.blocks(file, 0, size))[0])[1]
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(found)], "place int, reference_name string, length long")
