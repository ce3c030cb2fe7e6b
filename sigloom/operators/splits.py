"""Leak-free splits, folds, merges, relabelling and sampling weights.

Every assignment is by read: a read's rows share one split however many files or rows it has. Order is by the md5 of a
seed and the key, which any engine can repeat. Ranking all keys would need one task for a global row number, so ranks
are built from counts of md5 prefixes and windows inside a prefix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = 100_000  # keys, about, that are ranked in one window


def shuffled(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def digits(rows: int) -> int:
    """Hexadecimal digits of a prefix that cuts shuffled keys into ranges of about RANGE."""
    n = 2
    while 16**n * RANGE < rows:
        n += 1
    return n


def numbered(rows: DataFrame, within: list[str], part: Column, order: list[str], name: str) -> DataFrame:
    """With `name`: 0.. in each group of `within`, in the order of `part` and then of `order`. Ranks come from counts by part
    and windows inside one, so a group of any size is ranked in as many tasks as it has parts."""
    rows = rows.withColumn("part_", part)
    before = Window.partitionBy(*within).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*within, "part_").agg(F.count("*").alias("size_")).withColumn("base_", F.coalesce(F.sum("size_").over(before), F.lit(0))).drop("size_")
    inside = Window.partitionBy(*within, "part_").orderBy(*order)
    return rows.withColumn("place_", F.row_number().over(inside) - 1).join(bases, [*within, "part_"]).withColumn(name, F.col("base_") + F.col("place_")).drop("part_", "base_", "place_")


def ranked(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct keys with rank (from 0, in shuffled order) and n, their number."""
    prefix = digits(keys.count())
    rows = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("h", shuffled(key, seed)).withColumn("p", F.substring("h", 1, prefix))
    sizes = rows.groupBy("p").count()  # one row a RANGE of keys
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"), F.sum("count").over(Window.partitionBy()).alias("n"))
    inside = Window.partitionBy("p").orderBy("h", key)
    return rows.join(starts, "p").select(key, (F.col("base") + F.row_number().over(inside) - 1).alias("rank"), "n")


def checked(train: float, val: float) -> None:
    if min(train, val) < 0 or train + val > 1:
        raise ValueError(f"fractions must not be negative or sum to more than 1: {train}, {val}")


def by_read(rows: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """key -> split: the first int(n * train) keys train, the next int(n * val) val, the rest test."""
    checked(train, val)
    n_train, n_val = F.floor(F.col("n") * F.lit(float(train))), F.floor(F.col("n") * F.lit(float(val)))
    split = F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val").otherwise("test")
    return ranked(rows, key, seed).select(key, split.alias("split"))


def folds(rows: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """key, fold, split: part i tests in fold i and validates in fold i - 1; the first n % k parts have one key more."""
    if k < 3:
        raise ValueError("k must be at least 3")
    small, more = F.floor(F.col("n") / k), F.col("n") % k
    cut = more * (small + 1)
    part = F.when(F.col("rank") < cut, F.floor(F.col("rank") / (small + 1))).otherwise(more + F.floor((F.col("rank") - cut) / F.greatest(small, F.lit(1))))
    parts = ranked(rows, key, seed).select(key, part.cast("int").alias("part"))
    split = F.when(F.col("part") == F.col("fold"), "test").when(F.col("part") == (F.col("fold") + 1) % k, "val").otherwise("train")
    return parts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(key, "fold", split.alias("split"))


def by_group(rows: DataFrame, group: str, label: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """group -> split, inside each label: one group trains; of two the second tests; of three or more the fractions train
    and validate, one group each at least, and where these take all, validation shrinks, but not below one group. So of
    three groups at 0.8 none tests. A group that labels share goes where the last label puts it."""
    checked(train, val)
    pairs = rows.select(group, label).where(F.col(group).isNotNull() & F.col(label).isNotNull()).distinct().withColumn("h", shuffled(group, seed))
    sizes = pairs.groupBy(label).agg(F.count("*").alias("n"))
    placed = numbered(pairs, [label], F.substring("h", 1, 3), ["h", group], "rank").join(sizes, label)
    n_train, share = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(train)))), F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(val))))
    n_val = F.when(n_train + share >= F.col("n"), F.greatest(F.lit(1), F.col("n") - n_train - 1)).otherwise(share)
    many = F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val").otherwise("test")
    split = F.when(F.col("n") == 1, "train").when(F.col("n") == 2, F.when(F.col("rank") == 0, "train").otherwise("test")).otherwise(many)
    last = placed.withColumn("split", split).groupBy(group).agg(F.max(F.struct(label, "split")).alias("x"))
    return last.select(group, F.col("x.split").alias("split"))


def last_label(files: list[DataFrame], key: str, label: str) -> DataFrame:
    """key -> the label of the last file that has the key (of a file's several, the largest)."""
    tagged = [f.select(key, label, F.lit(i).alias("file")) for i, f in enumerate(files)]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.max(F.struct("file", label)).alias("x")).select(key, F.col(f"x.{label}").alias(label))


#: Which whole numbers a float of single precision holds all of; wider ones make it double.
IN_FLOAT = ("boolean", "byte", "short")
WHOLE = ("boolean", "byte", "short", "integer", "long")


def promoted(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The narrowest type that holds both: wider whole numbers, floats, text for text and anything plain; arrays by their
    elements. None if there is none, as for arrays of different depth."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = promoted(a.elementType, b.elementType)
        return None if inner is None else T.ArrayType(inner, a.containsNull or b.containsNull)
    x, y = a.typeName(), b.typeName()
    if x in WHOLE and y in WHOLE:
        return (a, b)[WHOLE.index(y) > WHOLE.index(x)]
    if {x, y} <= {*WHOLE, "float", "double"}:
        return T.FloatType() if {x, y} <= {*IN_FLOAT, "float"} else T.DoubleType()
    if "string" in (x, y) and {x, y} <= {*WHOLE, "float", "double", "string"}:
        return T.StringType()
    return None


def output_types(schemas: list[T.StructType], names: list[str]) -> dict[str, T.DataType]:
    """Column -> the type that holds all inputs' values, found by the schemas alone. Inputs must have the same columns; what
    doesn't fit is an error that names the input and the column."""
    first = schemas[0]
    for name, schema in zip(names[1:], schemas[1:], strict=True):
        if set(schema.names) != set(first.names):
            raise ValueError(f"{name}: missing {sorted(set(first.names) - set(schema.names))}, extra {sorted(set(schema.names) - set(first.names))}")
    out = {f.name: f.dataType for f in first}
    for name, schema in zip(names[1:], schemas[1:], strict=True):
        for f in schema:
            both = promoted(out[f.name], f.dataType)
            if both is None:
                raise ValueError(f"{name}: column {f.name} is {f.dataType.simpleString()}, in {names[0]} and others up to it {out[f.name].simpleString()}")
            out[f.name] = both
    return out


def of_width(array: Column, widths: tuple[int, ...]) -> Column:
    """Whether an array and the arrays in it have these lengths; a null one has any."""
    fits = F.size(array) == widths[0]
    inside = F.forall(array, lambda x: of_width(x, widths[1:])) if len(widths) > 1 else F.lit(True)
    return array.isNull() | (fits & inside)


def merged(files: list[DataFrame], names: list[str] | None = None, widths: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """All rows of files that must have the same columns, each of the narrowest type that holds all its values. widths: of
    array columns, the lengths that every row must have, by depth; another length is an error when the rows are read, and
    names the input."""
    names = names or [f"input {i}" for i in range(len(files))]
    types = output_types([f.schema for f in files], names)
    out = []
    for name, f in zip(names, files, strict=True):
        for column, lengths in (widths or {}).items():
            told = F.concat(F.lit(f"{name}: column {column} has "), F.size(column).cast("string"), F.lit(f" entries in a row, or entries of another length, not {lengths}"))
            f = f.withColumn(column, F.when(of_width(F.col(column), lengths), F.col(column)).otherwise(F.raise_error(told).cast(f.schema[column].dataType)))
        out.append(f.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()]))
    return reduce(DataFrame.unionByName, out)


def relabelled(files: list[DataFrame], label: str, zero: list[str], one: list[str]) -> list[DataFrame]:
    """Files get 0 or 1 by their first (smallest) label; files of neither group keep their labels."""
    if both := set(zero) & set(one):
        raise ValueError(f"labels in both groups: {sorted(both)}")
    out = []
    for f in files:
        first = f.agg(F.min(label)).first()[0]
        value = "0" if first in zero else "1" if first in one else None
        out.append(f if value is None else f.withColumn(label, F.lit(value)))
    return out


def label_codes(rows: DataFrame, label: str) -> DataFrame:
    """label -> code, in alphabetical order; one row a label."""
    return rows.select(label).where(F.col(label).isNotNull()).distinct().select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("code"))


def first_codes(rows: DataFrame, value: str, order: str) -> DataFrame:
    """value -> code, in the order of first appearance; one row a value."""
    firsts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first"))
    return firsts.select(value, (F.row_number().over(Window.orderBy("first")) - 1).alias("code"))


def routed(rows: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """Rows with their split; rows without one are kept with a null. Write with partitionBy('split')."""
    return rows.join(assignment, key, "left")


def sampling_weights(rows: DataFrame, field: str) -> DataFrame:
    """weight = 1 / number of rows that share the field; null and empty count as `unknown`, 0 is a value."""
    name = group_name(field)
    counts = rows.groupBy(name.alias("g")).count()
    return rows.withColumn("g", name).join(counts, "g").withColumn("weight", 1.0 / F.col("count")).drop("count").withColumnRenamed("g", "sampling_group")


def group_name(field: str) -> Column:
    return F.coalesce(F.nullif(F.col(field).cast("string"), F.lit("")), F.lit("unknown"))


def gated(rows: DataFrame, score: str, margin: str, least_score: float, least_margin: float) -> DataFrame:
    """Scored rows of a margin above (not at) the least and a score of at least the least."""
    return rows.where(F.col(score).isNotNull() & (F.col(margin) > least_margin) & (F.col(score) >= least_score))


def coverage(rows: DataFrame, column: str) -> DataFrame:
    """Share of rows with a value; 0 for no rows."""
    return rows.agg(F.coalesce(F.avg(F.col(column).isNotNull().cast("double")), F.lit(0.0)).alias("coverage"))


def resolved(rows: DataFrame, key: str, batch: str, holdout: str | None, corpus_split: str | None, share: float, seed: int = 42) -> DataFrame:
    """split: test for batches that start with the held-out prefix; else the corpus's own split; else a shuffled share."""
    if holdout:
        return rows.withColumn("split", F.when(F.coalesce(F.col(batch), F.lit("")).startswith(holdout), "test").otherwise("train"))
    if corpus_split and corpus_split in rows.columns:
        return rows.withColumn("split", F.col(corpus_split))
    tests = ranked(rows, key, seed).select(key, F.when(F.col("rank") < F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(share)))), "test").otherwise("train").alias("split"))
    return rows.join(tests, key)


def planned(manifest: DataFrame, chunk: int, test: float, per_group: int | None = None, seed: int = 42, shard: list[str] | None = None) -> DataFrame:
    """A balanced corpus plan: long enough reads; shuffled batches take turns, and a group's reads are ranked in the order
    of the turns; the first share of a group tests, then at most `per_group` (default: what the smallest group has) train.
    A shard of batches is cut out afterwards, so it never changes the plan. No read that is long enough, or a batch of the
    shard without reads in the plan, is an error. Columns read_id, anchor_end, batch, group -> the same, rank and split."""
    long = manifest.where(F.col("anchor_end") > chunk + 200).withColumn("h", shuffled("read_id", seed))
    n = long.count()
    if not n:
        raise ValueError(f"no read has an anchor_end above {chunk + 200}")
    turns = numbered(long, ["batch"], F.substring("h", 1, digits(n)), ["h", "read_id"], "turn").drop("h")
    rows = numbered(turns, ["group"], F.floor(F.col("turn") / 5_000), ["turn", "batch", "read_id"], "rank")
    sizes = long.groupBy("group").agg(F.count("*").alias("n"))
    if per_group is None:
        per_group = sizes.agg(F.min(F.floor(F.col("n") * F.lit(float(1 - test))))).first()[0] or 0
    n_test = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(test))))
    split = F.when(F.col("rank") < n_test, "test").when(F.col("rank") - n_test < per_group, "train")
    out = rows.join(sizes, "group").withColumn("split", split).where("split is not null").drop("turn", "n")
    if not shard:
        return out
    out = out.where(F.col("batch").isin(shard))
    if missing := set(shard) - {r["batch"] for r in out.select("batch").distinct().collect()}:
        raise ValueError(f"batches without reads in the plan: {sorted(missing)}")
    return out
