"""op3 and op6 against DuckDB and brute force."""

import math

import duckdb
import numpy as np
import pytest

from sigloom.llm import preference, queries, rotatedbits

TURNS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "yes"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "no"), (1, 4, "user", "ok"),
    (2, 0, "system", "s"), (3, 0, "user", "s"), (4, 0, "user", "é\n"), (5, 0, "user", "é\n"),
    (6, 0, None, None), (6, 0, None, None), (7, None, "user", ""), (7, 0, "assistant", "x" * 3000), (8, 0, "user", "alone"),
    (None, 0, "user", "no id"), (10, 1, "user", "b"), (10, 0, "user", "a"), (11, 0, "user", "a"), (11, 1, "user", "b"), (11, 1, "user", "b"),
]


@pytest.mark.parametrize("source", ["made", "sample"])
def test_op3_is_its_sql(spark, tmp_path, source):
    folder = "/root/testdata/sf0.01"
    if source == "made":
        folder = str(tmp_path)
        rows = [(*t, "clash", 1) for t in TURNS]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string, rejected int").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    got = queries.op3_chat_preference(spark, folder)
    path = f"{folder}/conversations.parquet" + ("/*.parquet" if source == "made" else "")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    want = c.sql(preference.ORACLE)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(r[x] for x in columns) for r in got.collect()), key=repr)
    b = sorted(want.project(", ".join(f'"{x}"' for x in columns)).fetchall(), key=repr)
    assert a == b
    if source == "made":
        first = next(r for r in got.collect() if r["pair_id"] == 0)
        assert first["n_common"] == 3 and first["chosen"] == "<|assistant|>\nyes<|end|>\n" and first["chosen_mask"] == "0x14 1x11"
        assert first["rejected_mask"] == "0x14 1x10 0x9 0x10"


def test_op3_stays_in_the_jvm(spark):
    plan = queries.op3_chat_preference(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def exact(ids, x, every, k):
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        at = ids.index(q)
        d = sorted((math.dist(x[at], v), i) for i, v in zip(ids, x, strict=True) if i != q)[:k]
        out[q] = d
    return out


def test_op6_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=7).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[100][1]) for i in range(30)]  # copies of a query
    good = list(rows)
    rows += [(2000, None), (2001, []), (2002, [0.0] * 7), (2003, [float("nan")] * 7), (2004, [1.0] * 6), (2005, [None] + [1.0] * 6), (2006, [float("inf")] * 7), (None, [1.0] * 7), (5, rows[5][1])]
    spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, q int, v string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in queries.op6_nearest_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = exact([i for i, _ in good], [v for _, v in good], 100, 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, rows_ in got.items():
        rows_.sort()
        assert [r for r, _, _ in rows_] == list(range(1, 11))
        assert [(s, i) for _, s, i in rows_] == sorted((s, i) for _, s, i in rows_)
        hits += len({i for _, _, i in rows_} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, _, i in got[100]] == list(range(1000, 1010))


def test_op6_rows_that_share_an_id_all_take_part(spark, tmp_path):
    rows = [(0, [1.0, 1.0]), (0, [5.0, 5.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [4.0, 1.0]), (2, [9.0, 9.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in queries.op6_nearest_neighbours(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 3.0), (4, 2, round(math.dist((1, 1), (9, 9)), 6))]


def test_op6_few_rows(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in queries.op6_nearest_neighbours(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]


def test_op6_recall(spark):
    folder = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = exact([r["vec_id"] for r in e], [r["embedding"] for r in e], 100, 10)
    got = queries.op6_nearest_neighbours(spark, folder).collect()
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert hits >= 0.95 * 10 * len(want)


@pytest.mark.parametrize("size", [1e200, 1e160, 1e-170])
def test_op6_components_whose_squares_are_no_doubles(spark, tmp_path, size):
    x = np.random.default_rng(6).normal(size=(400, 8)) * (1 if size == 1e200 else size)
    x[7] = max(size, x[7, 0])  # at 1e200 it is one row among plain ones
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = exact(range(400), x.tolist(), 100, 10)
    got = {}
    for r in sorted(queries.op6_nearest_neighbours(spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert {q: [i for _, i in rows] for q, rows in got.items()} == {q: [i for _, i in rows] for q, rows in want.items()}
    assert all(math.isclose(a, b) for q in want for (a, _), (b, _) in zip(got[q], want[q], strict=True))


def test_op6_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    codes = rotatedbits.Codes.of(x, x.mean(0), rotatedbits.rotation(64))
    for q in rng.normal(size=(5, 64)):
        low, high = codes.bounds(q, x.mean(0), rotatedbits.rotation(64))
        d = ((x - q) ** 2).sum(1)
        assert ((low <= d) & (d <= high)).mean() > 0.99
