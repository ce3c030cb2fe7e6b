"""op12 against its SQL and against a plain program."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from sigloom.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, count long, docs long, block int, value long, rank int, part string, item string"
CLASH = ("t", 1, 2, 3, 4, 5, "p", "i")


def rows():
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("Alpha", "beta", "Été", "日本", "x", "Ω") for b in "abcdefgh"]
    out = []
    for i in range(400):
        lang = rng.choice(["en", "fr", None, "", "xx"]) if i % 3 else "en"
        source = rng.choice(["s1", "s2", "s3", None, "", "Z", "é"]) if i % 2 else "s1"
        out.append((i, rng.choice([" ", "-", "1", "\n"]).join(rng.choice(words[: 10 + i % 38]) for _ in range(rng.randint(0, 60))), lang, source))
    out += [(1, None, "en", "quiet"), (2, "", "none", "a"), (3, "123 ... \x00", "none", "b"), (4, "rare", "none", None), (5, "alphaA " * 40_000, "en", "s2")]
    out += [out[7]] * 40  # repeated rows are documents of their own
    return [(*r, *CLASH) for r in out]


def oracle(path):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return sorted(c.sql(divergence.ORACLE).fetchall())


def plain(data, least=30, smooth=5, top=50):
    """The contract, with Python's whole numbers."""
    docs = [(r[1] or "", r[2] or "", r[3] or "") for r in data]
    out = []
    for lang in {d[1] for d in docs}:
        held, of = Counter(), {s: Counter() for _, own, s in docs if own == lang}
        for text, own, source in docs:
            if own == lang:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
                terms = "".join(c if "a" <= c <= "z" or c >= "\x80" else " " for c in low).split(" ")
                terms = [t for t in terms if t]
                held.update(set(terms))
                of[source].update(terms)
        kept = [t for t, n in held.items() if n >= least]
        share = lambda c, n: 1 + 10**9 * (c + smooth) // (n + smooth * len(kept))
        total = {s: sum(c[t] for t in kept) for s, c in of.items()}
        whole = Counter()
        for c in of.values():
            whole.update({t: c[t] for t in kept})
        n = sum(whole.values())
        for s, c in of.items():
            pairs = [(o, sum(abs(share(c[t], total[s]) - share(d[t], total[o])) for t in kept)) for o, d in of.items() if o != s]
            terms = [(t, share(c[t], total[s]) - share(whole[t], n)) for t in kept if c[t] > 0]
            for part, found, most in (("pair", pairs, None), ("term", [x for x in terms if x[1] > 0], top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("terms_a_block", [512, 3])
def test_op12(spark, tmp_path, monkeypatch, terms_a_block):
    monkeypatch.setattr(divergence, "LEAST_TERMS", terms_a_block)
    monkeypatch.setattr(divergence, "CELLS", 40 if terms_a_block == 3 else 1 << 22)  # many blocks
    data = rows()
    spark.createDataFrame(data, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op12_divergence(spark, str(tmp_path)).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain(data) == oracle(f"{tmp_path}/documents.parquet/*.parquet")
    assert any(r[0] == "none" and r[4] == 0 for r in got) and any(r[2] == "term" for r in got)


def test_op12_on_the_sample(spark):
    got = sorted(tuple(r) for r in queries.op12_divergence(spark, "/root/testdata/sf0.01").select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == oracle("/root/testdata/sf0.01/documents.parquet")


def test_shares_are_exact_for_large_counts():
    rng = random.Random(4)
    for _ in range(200):
        kept = rng.randint(1, 10**6)
        total = rng.randint(0, 9 * 10**15 - 5 * kept)
        count = rng.randint(0, total)
        got = divergence.shares(np.array([[count]]), np.array([[total]]), kept, 5)[0, 0]
        assert got == 1 + 10**9 * (count + 5) // (total + 5 * kept)


def test_heaps_keep_ties_in_order():
    names = np.array([b"b", b"a", "é".encode(), b"c"], object)
    assert divergence.largest(np.array([5, 5, 9, 5]), names, 3).tolist() == [2, 1, 0]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_divergence(spark, str(tmp_path)).collect() == []
