"""op13 against its SQL and brute force, and what the pivot table leaves to be scored."""

import duckdb
import numpy as np
import pytest

from sigloom.llm import pivots, queries

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<double>, label int, id long, key long, cell int, x string, block int, rank int, floors long"
CLASH = (1, 2, 3, "x", 4, 5, 6)


def brute(rows):
    """Every pair, in Python's whole numbers."""
    e = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * v)) for v in x)) for i, x, label in rows}
    out = []
    for a, label, x in e:
        if a % 100:
            continue
        score = [(-sum(p * q for p, q in zip(x, y, strict=False)), b, other == label) for b, other, y in e if b != a]
        score.sort()
        for p, b, _ in [s for s in score if s[2]][:5]:
            hits = [(-s, n) for s, n, same in score if not same and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, b, i + 1, n, -p, s) for i, (s, n) in enumerate(hits)]
    return sorted(out)


def run(spark, folder, rows):
    spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(5).write.parquet(f"{folder}/embeddings.parquet")
    return sorted(tuple(r[c] for c in NAMES) for r in queries.op13_hard_negatives(spark, str(folder)).collect())


def test_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 1, 30])).tolist(), int(rng.integers(0, 3))) for i in range(600)]
    rows += [(1000 + i, rows[100][1], i % 4) for i in range(40)]  # copies of an anchor, in all labels: ties
    rows += [(2000, [1.0] * 6, 9), (2100, [0.0] * 6, 1), (2200, [], 1), (2300, [1.0, 2.0], 0), (-100, [0.5] * 6, 2), (-7, [0.5] * 7, 2)]
    good = rows + [rows[100], rows[3]]  # exact repeats count once
    bad = [(3000, None, 1), (3001, [1.0, None], 1), (3002, [float("nan")] * 6, 1), (3003, [float("inf")] * 6, 1), (3004, [1.0] * 6, None), (None, [1.0] * 6, 1), (3100, [1e30] * 6, 1)]
    want = brute(good)
    assert run(spark, tmp_path, good + bad) == want and len(want) > 100


def test_rows_that_share_an_anchor_id_are_anchors_of_their_own(spark, tmp_path):
    rows = [(100, [1.0, 0.0], 0), (100, [0.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.5, 0.5], 1), (3, [0.6, 0.2], 1)]
    assert run(spark, tmp_path, rows) == brute(rows) and len(brute(rows)) == 3


def test_op13_is_its_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    got = sorted(tuple(r[n] for n in NAMES) for r in queries.op13_hard_negatives(spark, "/root/testdata/sf0.1").collect())
    assert got == sorted(c.sql(pivots.ORACLE).fetchall()) and got


def test_pieces_and_blocks(spark, tmp_path, monkeypatch):
    """Many cells, pieces and blocks of anchors, on vectors in clusters: the same rows."""
    for name, n in (("PIECE", 50), ("ANCHORS", 4), ("SEEDS", 64), ("PIVOT_SAMPLE", 64)):
        monkeypatch.setattr(pivots, name, n)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist(), int(rng.integers(0, 3))) for i in range(3000)]
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("most", [None, 1e12])
def test_brackets_hold(most):
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(2000, 16))).astype(np.int64)
    of = pivots.Pivots(x[:200], float(most or (x.astype(float) ** 2).sum(1).max()))
    table = of.distances(of.augmented(x)).astype(np.float32).astype(np.float64)
    for q in x[:20]:
        away = of.of_anchors(q[None])[0].astype(np.float32).astype(np.float64)
        low, high = of.scores(float((q.astype(float) ** 2).sum()), np.abs(table - away).max(1), (table + away).min(1))
        score = x @ q
        assert (low <= score).all() and (score <= high).all()


def test_brackets_pass_over_most_of_a_clustered_table():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32))
    x = np.floor(256 * (centres[rng.integers(0, 20, 20_000)] + 0.05 * rng.normal(size=(20_000, 32)))).astype(np.int64)
    of = pivots.Pivots(x[:4096], float((x.astype(float) ** 2).sum(1).max()))
    table = of.distances(of.augmented(x))
    left = []
    for q in x[:50]:
        score = x @ q
        floor = np.partition(score[:4096], 4096 - 5)[4096 - 5]
        _, high = of.scores(float((q.astype(float) ** 2).sum()), np.abs(table - of.of_anchors(q[None])[0]).max(1), np.full(len(x), np.inf))
        assert (score[high < floor] < floor).all()
        left.append((high >= floor).mean())
    assert np.mean(left) < 0.2


def test_nothing_to_mine(spark, tmp_path):
    assert run(spark, tmp_path / "a", [(1, [1.0], 1), (2, [1.0], 1)]) == []  # no anchor
    assert run(spark, tmp_path / "b", [(100, [1.0], 1), (2, [1.0], 2)]) == []  # no positive
    assert run(spark, tmp_path / "c", [(100, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]) == []  # a negative score has no band
    assert run(spark, tmp_path / "d", []) == []
