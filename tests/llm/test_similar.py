"""The join of shingle sets against all pairs."""

import random

import numpy as np
import pytest

from sigloom.llm import similar, simhash


def text(words):
    return " ".join(words)


def edited(words, rng, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.random()}"
    return words


def shingles(t, k=5):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def smallest(rows, links):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {d: find(d) for d in root}


def all_pairs(rows, similarity=0.8):
    sets = [(d, shingles(t)) for d, t in rows if t]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= similarity * len(x | y):
                yield a, b


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def star(rng):
    """An original amid its copies' ids; copies differ from one another."""
    o = fresh(rng, 400)
    return [text(edited(o, rng, 6)) for _ in range(20)] + [text(o)] + [text(edited(o, rng, 6)) for _ in range(20)]


def chain(rng):
    out = [fresh(rng, 300)]
    while len(out) < 25:
        out.append(edited(out[-1], rng, 4))
    rng.shuffle(out)
    return [text(w) for w in out]


def template(rng):
    """Nine tenths a template, below the similarity; a few pairs of them are alike."""
    t = fresh(rng, 360)
    own = [fresh(rng, 60) for _ in range(30)]
    return [text(t + w) for w in own] + [text(t + edited(w, rng, 1)) for w in own[:6]] + [text(t[:150] + w + t[150:]) for w in own[:6]]


def around(rng):
    """Sizes and similarities at the bound, copies, short and empty texts."""
    o = fresh(rng, 104)
    return [text(o), text(o[:84]), text(o[:83]), text(o[10:94]), text(o), text(o[:3]), text(o[:3]), text(o[:4]), "", None, text(o).upper(), text(fresh(rng, 25) + o)]


@pytest.mark.parametrize("block", [similar.BLOCK, 3])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(7)
    texts = [t for make in (star, chain, template, around) for t in make(rng)]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame([*rows, (None, texts[0]), rows[3]], "doc_id long, text string")
    known = spark.createDataFrame([(ids[0], ids[-1])], "a long, b long")
    want = smallest(rows, [*all_pairs(rows), (ids[0], ids[-1])])
    got = {d: d for d in ids} | {r["node"]: r["root"] for r in similar.groups(docs, known).collect()}
    assert got == want
    assert len(set(want.values())) < len(rows) - 60


def test_survivors_of_a_star(spark):
    texts = star(random.Random(3))
    rows = list(enumerate(texts, 1))
    assert set(smallest(rows, all_pairs(rows)).values()) == {1}
    assert [r["doc_id"] for r in simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1]


def test_parities_bound_what_sets_do_not_share():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    for n in (0, 1, 20, 300):
        y = np.unique(np.concatenate((x[n:], rng.integers(0, 2**63, n, dtype=np.uint64))))
        assert similar.apart(similar.parities(x), similar.parities(y)) <= len(np.setxor1d(x, y))
    longer = np.unique(np.concatenate((x, rng.integers(0, 2**63, 700, dtype=np.uint64))))
    assert 256 / 4 < similar.apart(similar.parities(x), similar.parities(longer)) <= 700
    assert similar.apart(similar.parities(longer), similar.parities(longer)) == 0


def test_texts_outside_of_a_group_of_copies_do_not_meet_all_of_it(spark, monkeypatch):
    """Copies that are alike to most of their group, but rarely to a given one of it."""
    rng = random.Random(5)
    o = fresh(rng, 120)
    texts = [text(edited(o, rng, 1 + i % 4)) for i in range(400)]
    rows = list(enumerate(texts, 1))
    met = []
    original = similar.perhaps_alike

    def counted(similarity):
        inner, seen = original(similarity), spark.sparkContext.accumulator(0)
        met.append(seen)

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield from inner(iter([batch]))

        return run

    monkeypatch.setattr(similar, "perhaps_alike", counted)
    known = spark.createDataFrame([], "a long, b long")
    got = {d: d for d, _ in rows} | {r["node"]: r["root"] for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == smallest(rows, all_pairs(rows))
    pairs = [m.value for m in met]
    print(pairs)
    assert pairs[-1] < 2 * len(rows)  # of the pairs whose components differ
