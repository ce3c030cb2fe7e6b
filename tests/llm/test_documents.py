"""Queries over documents against brute force, on a corpus with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F

from sigloom.llm import blocks, bloomlm, counts, language, packing, pii, queries, simhash, tokens

BIG = 2**63 - 1


def result(spark, name, folder, *columns):
    return sorted((tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect()), key=repr)


def ascii_words(text, fold=False):
    raw = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.lower() if fold else raw)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode()) if doc_id is not None else None


def test_op1_removes_what_a_smaller_document_has(spark, corpus):
    folder, rows = corpus
    least = {}
    docs = [(BIG if r["doc_id"] is None else r["doc_id"], ascii_words(r["text"])) for r in rows]
    for i, w in docs:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, BIG), i)
    want = []
    for (i, w), r in zip(docs, rows, strict=True):
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((r["doc_id"], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert result(spark, "op1_substrings", folder, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 500


def test_op2_packs_every_id_once(spark, corpus):
    from tokenizers import Tokenizer

    folder, rows = corpus
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[r["doc_id"], s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    got = queries.op2_packing(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(r["length"] for r in got)
    assert len(places) <= used / 2048 + 3


def test_op2_patterns_place_all_lengths():
    import random

    rng = random.Random(4)
    for _ in range(100):
        histogram = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(rng.randint(1, 40))}
        placed = Counter()
        for pattern, n in packing.packs(histogram, 64):
            assert n > 0 and sum(pattern) <= 64
            for length in pattern:
                placed[length] += n
        assert placed == Counter(histogram)


def test_op1_hot_seeds_give_the_same(spark, corpus):
    from sigloom.llm import substrings

    folder, _ = corpus
    docs = blocks.documents(spark, folder)
    rng = np.random.default_rng(2)
    stock = "a stock phrase of the whole house".split()
    more = [(1000 + i, " ".join([*(f"w{x}" for x in rng.integers(0, 9, 14)), *stock, *(f"w{x}" for x in rng.integers(0, 3, 9))]), None, None, None, *(None,) * 9) for i in range(400)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    want = sorted(map(repr, substrings.removal(docs).collect()))
    assert sorted(map(repr, substrings.removal(docs, hot=1).collect())) == want
    assert sum("n_removed=0" not in r for r in want) > 50


def one_by_one(histogram, limit):
    """The totals of shortest-pack-first, a piece at a time."""
    packs = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        k = min(range(len(packs)), key=packs.__getitem__, default=None)
        if k is None or packs[k] + length > limit:
            packs.append(length)
        else:
            packs[k] += length
    return sorted(packs)


def test_op2_is_shortest_pack_first():
    import random

    assert sorted(packing.packs({10: 1, 8: 1, 2: 1}, 12)) == [((8, 2), 1), ((10,), 1)]
    rng = random.Random(6)
    for _ in range(150):
        histogram = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 25))}
        assert sorted(sum(p) for p, n in packing.packs(histogram, 64) for _ in range(n)) == one_by_one(histogram, 64)


def test_op2_patterns_of_many_pieces_are_few():
    import random
    import time

    rng = random.Random(7)
    histogram = {k: rng.randint(1, 40_000_000 // k) for k in range(1, 2048)} | {2048: 10_000_000}
    began = time.time()
    found = packing.packs(histogram, 2048)
    assert time.time() - began < 60 and len(found) < 200_000
    total = sum(k * n for k, n in histogram.items())
    assert sum(n for _, n in found) <= 1.02 * total / 2048 + 1


def test_op4_components_are_those_of_all_pairs(spark, corpus):
    folder, rows = corpus
    fps = []
    for r in rows:
        w = ascii_words(r["text"], True)
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        bits = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in sh) for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if 2 * bits[b] > len(sh)))
    group = list(range(len(rows)))
    for _ in range(20):
        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, BIG), r["doc_id"])
    want = [(r["doc_id"], f"{f:016x}", least.get(g)) for r, f, g in zip(rows, fps, group, strict=True)]
    assert result(spark, "op4_simhash", folder, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_op4_links_connect_all_pairs_within_three_bits():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(15)]
    fps = np.unique(np.array([*map(int, base), *near], np.uint64))
    found = np.concatenate([simhash.local_links(fps, p, 6) for p in range(64)])
    assert (np.bitwise_count(found[:, 0] ^ found[:, 1]) <= 3).all()
    at = {int(f): i for i, f in enumerate(fps)}

    def classes(pairs):
        g = list(range(len(fps)))

        def root(x):
            while g[x] != x:
                x = g[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            g[max(a, b)] = min(a, b)
        return [root(i) for i in range(len(fps))]

    every = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    assert classes([(at[int(a)], at[int(b)]) for a, b in found]) == classes(every)


def test_op5_counts_as_the_library(spark, corpus, monkeypatch):
    from tokenizers import Tokenizer

    folder, rows = corpus
    monkeypatch.setattr(counts.head_of, "__defaults__", (50, 300))  # most pre-tokens take the shuffle
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in rows:
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 512))
    assert result(spark, "op5_token_counts", folder, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_op5_and_op2_units_of_random_texts():
    import random

    from tokenizers import Tokenizer

    rng = random.Random(8)
    parts = ["a", "b", "'s", "'T", "É", "ß", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "1", "!", "<|endoftext|>", "日", "\x1c", "\x01", "the", " cat", ".", "\xa0", "İ", "²", "½", "Ⅷ", "٣", "_", "e\u0301", "中文", "\u2028", "\x85", "'ll", "''"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    c, t = counts.PieceCounter(path), Tokenizer.from_file(path)
    lower = tokens.LowerWordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(4000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        forms, special = c.forms(s)
        assert special + sum(map(c.pieces, forms)) == len(t.encode(s, add_special_tokens=False).ids), s
        words = s.encode().split()
        known = lower.learn(set(words))
        assert np.frombuffer(b"".join(known[w] for w in words), "<u4").tolist() == lower.full.encode(s, add_special_tokens=False).ids, s


def test_op7_base_is_exact_and_the_model_is_a_distribution_that_beats_it(spark, corpus):
    folder, rows = corpus
    c = Counter()
    for r in rows:
        if r["doc_id"] is not None and crc(r["doc_id"]) % 10:
            c.update([*ascii_words(r["text"], True), b""])
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = [*ascii_words(r["text"], True), b""]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((r["doc_id"], r["doc_id"] is not None and crc(r["doc_id"]) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, round(base, 6)))
    got = queries.op7_language_model(spark, folder).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def quantised(c, upper=False):
    """The lower end of a count's level, or the upper one, by steps."""
    low = high = 0
    while high <= c:
        low, high = high, max(high + 1, high * 5 // 4)
    return high - 1 if upper else low


def model_scores(rows):
    """(score, whether every pair was seen) of each row, by dictionaries."""
    token, pair = Counter(), Counter()
    for r in rows:
        if r["doc_id"] is not None and crc(r["doc_id"]) % 10:
            w = [b"", *ascii_words(r["text"], True), b""]
            token.update(w[1:])
            pair.update(zip(w, w[1:], strict=False))
    mass = sum(quantised(c) for c in token.values()) + 0.1 * (len(token) + 1)
    out = []
    for r in rows:
        w, total = [b"", *ascii_words(r["text"], True), b""], 0.0
        for h, x in zip(w, w[1:], strict=False):
            q = (quantised(token[x]) + 0.1) / mass
            n = quantised(token[h], upper=True) if token[h] else 0
            total += math.log10((quantised(pair[h, x]) + bloomlm.MU * q) / (n + bloomlm.MU))
        out.append(total)
    return out


def test_op7_score_is_that_of_dictionaries(corpus, monkeypatch):
    import pyarrow as pa

    _, rows = corpus
    monkeypatch.setattr(bloomlm, "PROBES", 40)  # no false positives
    learned = [r for r in rows if r["doc_id"] is not None and crc(r["doc_id"]) % 10]
    as_table = lambda some: pa.table({"doc_id": pa.array([r["doc_id"] for r in some], pa.int64()), "text": pa.array([r["text"] for r in some], pa.string())})
    tokens = [bloomlm.steps(next(blocks.blocks(iter(as_table(learned[k::2]).to_batches()), limit=1 << 62)))[0] for k in range(2)]
    sent = pa.concat_tables([bloomlm.events(t, 4) for t in tokens])
    only = lambda t, name, v: t.filter(pa.compute.equal(t[name], v))
    stored = [bloomlm.built(only(sent, "segment", s)) for s in range(4)]
    sums = [sum(t[name][0].as_py() for t in stored) for name in ("tokens", "types", "read")]
    counts = Counter()
    for r in learned:
        counts.update([*ascii_words(r["text"], True), b""])
    assert sums == [sum(counts.values()), len(counts), sum(map(quantised, counts.values()))]
    want = {id(r): s for r, s in zip(rows, model_scores(rows), strict=True)}
    parts = [(rows[k::3], as_table(rows[k::3])) for k in range(3)]
    asked = pa.concat_tables([bloomlm.Events(t, 4).requests(k) for k, (_, t) in enumerate(parts)])
    found = pa.concat_tables([bloomlm.probed(only(asked, "segment", s), stored[s]) for s in range(4)])
    for k, (some, t) in enumerate(parts):
        got = bloomlm.scored(t, only(found, "block", k), 4, *sums)
        assert np.allclose(got["score"].to_numpy(), [want[id(r)] for r in some], rtol=1e-9)


@pytest.mark.parametrize("held", [0, 1 << 40])
def test_op7_filter_outlives_its_builder_and_is_the_same_sent_or_joined(spark, monkeypatch, held):
    """A filter fitted on one table scores others: with no training text, and with texts it never saw."""
    monkeypatch.setattr(bloomlm, "HELD", held)
    kind = "doc_id long, text string, lang int"
    training = spark.createDataFrame([(1, "a b a b c", 0), (1, "a b a b c", 0), (2, None, 0)], kind)
    model = bloomlm.fit(training, 3)
    assert (model.tokens, model.types) == (13, 4)
    texts = spark.createDataFrame([(7, "a b", 1), (8, "", 1), (None, "never seen", 1), (7, "a b", 1)], kind)
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["score"], 9)) for r in bloomlm.scores(texts, model, 2).collect()))
    assert [g[:3] for g in got] == [(0, 3, 1), (7, 3, 3), (7, 3, 3), (8, 1, 1)] and got[1] == got[2]
    q = lambda n: (n + 0.1) / (13 + 0.1 * 5)
    p = lambda pair, n, x: math.log10((pair + bloomlm.MU * q(x)) / (n + bloomlm.MU))
    assert got[1][3] == pytest.approx(p(2, 3, 4) + p(4, 4, 4) + p(0, 4, 3), abs=1e-6)
    empty = bloomlm.fit(training.where("false"), 3)
    assert [(r["n_known"], round(10 ** r["score"], 6)) for r in bloomlm.scores(texts.where("doc_id = 8"), empty, 2).collect()] == [(0, 1.0)]
    assert bloomlm.scores(texts.where("false"), model, 2).count() == 0


def test_op7_packing_of_ascending_numbers():
    for x in ([], [0], [2**64 - 1], [0, 0, 5, 2**32, 2**63 + 1], list(range(300))):
        assert bloomlm.unpacked(bloomlm.packed(np.array(x, np.uint64))).tolist() == x


def test_op7_query_is_that_model_but_for_false_positives(spark, corpus):
    folder, rows = corpus
    want = sorted(zip(([r["doc_id"], r["text"]] for r in rows), model_scores(rows), strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))
    got = sorted(((r["doc_id"], r["score"]) for r in queries.op7_language_model(spark, folder).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert [g[0] for g in got] == [w[0][0] for w in want]
    near = [abs(g - w) <= 0.05 * abs(w) for (_, g), (_, w) in zip(got, want, strict=True)]
    assert sum(near) >= 0.9 * len(near)
    assert sum(g for _, g in got) == pytest.approx(sum(w for _, w in want), rel=0.02)


def test_op7_every_event_is_held_however_many_there_are():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 300_000, dtype=np.uint64))
    counts = rng.zipf(1.5, len(keys)).astype(np.int64)
    counts[:5] = 0, 1, 2**40, 7, 8
    s = bloomlm.Segment(keys, counts)
    got = s.levels(keys)
    want = bloomlm.level(counts)
    assert (got >= want).all() and (got == want).mean() > 0.97
    other = rng.integers(0, 2**63, 100_000, dtype=np.uint64)
    assert (s.levels(other) > 0).mean() < 0.012
    assert [quantised(c) for c in (0, 1, 8, 9, 11, 100, 10**9)] == bloomlm.VALUES[bloomlm.level(np.array([0, 1, 8, 9, 11, 100, 10**9]))].tolist()


def test_op8_rules_are_the_patterns_and_the_tagger_adds(spark, corpus):
    folder, rows = corpus
    got = {r["doc_id"]: r for r in queries.op8_pii(spark, folder).collect()}
    for r in rows:
        text, base = r["text"] or "", []
        for kind in pii.KINDS:
            base += [(kind, m.start(), m.end()) for m in pii.PATTERNS[kind].finditer(text) if pii.passes(kind, m.group())]
        if r["doc_id"] is None or r["doc_id"] == 11:
            continue
        x = got[r["doc_id"]]
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        spans = [s for s in x["spans"].split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
        if not re.search(r"[0-9@]", text):
            assert not spans


def test_op8_emails_as_the_pattern_finds_them():
    import random

    rng = random.Random(2)
    for _ in range(20000):
        s = "".join(rng.choice("a1.-@_+ é%") for _ in range(rng.randint(0, 16)))
        assert list(pii.emails(s)) == [m.span() for m in pii.EMAIL.finditer(s)], s


def test_op8_long_runs_are_linear_and_do_not_crash():
    import time

    began = time.time()
    assert pii.rules("x " + "0" * 5000 + ".1.1.1 y") == [(1, 2, 5008)]
    for text in ("0" * 1_000_000 + ".1.1.1 y", "1." * 500_000, "@" * 500_000, "1" * 1_000_000, "a@" * 500_000, "+1(" * 300_000, "a" * 1_000_000 + "@"):
        pii.rules(text)
    many = "a@b.cd " * 50_000
    assert len(pii.merged(many, pii.rules(many), [(2, 7 * k, 7 * k + 3) for k in range(50_000)])) == 50_000
    assert time.time() - began < 20


def test_op8_ips_as_the_pattern_finds_them():
    import random

    rng = random.Random(2)
    for _ in range(20000):
        s = "".join(rng.choice("12.. a") for _ in range(rng.randint(0, 20)))
        assert [m.span() for m in pii.WHOLE_IP.finditer(s)] == [m.span() for m in pii.IP.finditer(s)], s


def test_op8_tagger_adds_what_no_rule_matches(spark):
    documents = blocks.documents(spark, "/root/testdata/sf0.01")
    model = pii.train(documents)
    texts = [r["text"] or "" for r in documents.collect()]
    rng = np.random.default_rng(99)
    entities = [[t[a:b] for t in texts for k, a, b in pii.rules(t) if k == kind] for kind in range(4)]
    plain = [t for t in texts if len(t) > 300 and not pii.TRIGGER.search(t)]
    made, spans = [], []
    for _ in range(200):
        kind = int(rng.integers(4))
        body, entity = plain[rng.integers(len(plain))], entities[kind][rng.integers(len(entities[kind]))]
        entity = pii.varied(kind, entity, rng)
        cut = int(rng.integers(20, 200))
        made.append(f"{body[:cut]} {entity} {body[cut:]}")
        spans.append((kind, cut + 1, cut + 1 + len(entity)))
    got = pii.all_spans(model, made)
    found = sum(any(k == kind and c < b and a < d for k, c, d in every) for (kind, a, b), (_, every) in zip(spans, got, strict=True))
    wrong = sum(not (c < b and a < d) for (_, a, b), (_, every) in zip(spans, got, strict=True) for _, c, d in every)
    assert found >= 0.85 * len(made) and wrong <= 0.02 * len(made)
    assert sum(len(base) for base, _ in got) < 0.2 * len(made)
    assert all(set(base) <= set(every) for base, every in got)
    assert not any(every for _, every in pii.all_spans(model, plain))


def test_op8_posteriors_are_those_of_all_paths():
    import itertools

    from sigloom.llm.tagger import Tagger

    m = Tagger(3, embed=4, hidden=3)
    m.w["step"] = np.random.default_rng(4).normal(size=(3, 3)).astype(np.float32)
    scores = np.random.default_rng(5).normal(size=(2, 5, 3))
    best, sure = m.certain(scores)
    for s, b, p in zip(scores, best, sure, strict=True):
        paths = {t: np.exp(sum(s[i, x] for i, x in enumerate(t)) + sum(m.w["step"][x, y] for x, y in zip(t, t[1:]))) for t in itertools.product(range(3), repeat=5)}
        total = sum(paths.values())
        assert tuple(b) == max(paths, key=paths.get)
        assert np.allclose(p, [sum(v for t, v in paths.items() if t[i] == b[i]) / total for i in range(5)], rtol=1e-5)


def test_op8_tagger_learns_held_out_spans():
    import random

    from sigloom.llm.tagger import Tagger, classes_of

    rng = random.Random(3)

    def one():
        word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
        text, y = "", []
        for _ in range(6):
            s, tag = (word(), 0) if rng.random() < 0.6 else ("".join(rng.choice("0123456789") for _ in range(9)), 5)
            text += s + " "
            y += ([tag] + [tag + 1] * (len(s) - 1) if tag else [0] * len(s)) + [0]
        return text[:48].ljust(48), (y + [0] * 48)[:48]

    data = [one() for _ in range(300)]
    x, y = np.stack([classes_of(t) for t, _ in data]), np.array([t for _, t in data])
    model = Tagger(9)
    losses = model.fit(x[:250], y[:250], 60)
    assert losses[-1] < losses[0] / 4
    scores, _ = model.forward(x[250:])
    assert (model.decode(scores) == y[250:]).mean() > 0.97


def test_op8_gradients_are_those_of_the_loss():
    from sigloom.llm.tagger import Tagger

    rng = np.random.default_rng(1)
    m = Tagger(5, embed=4, hidden=3)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, y = rng.integers(0, 99, (3, 7)), rng.integers(0, 5, (3, 7))
    scores, seen = m.forward(x)
    _, d, step = m.crf(scores, y)
    grad = m.backward(seen, d) | {"step": step}
    for name, w in m.w.items():
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            old = w[at]
            values = []
            for e in (1e-3, -1e-3):
                w[at] = old + e
                values.append(m.crf(m.forward(x)[0], y)[0])
            w[at] = old
            assert grad[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, abs=2e-3), (name, at)


def test_op9_predicts_only_from_text_and_learned_languages(spark, corpus):
    folder, rows = corpus
    got = queries.op9_language(spark, folder).collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und")
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(ch.isalpha() for ch in texts[r["doc_id"]] or ""))


def test_op9_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in blocks.documents(spark, folder).collect()}
    held = [r for r in queries.op9_language(spark, folder).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_op9_forward_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = language.Model(path, [("en", 300, 5), ("fr", 400, 7), ("en", 1000, 3)])
    s = language.Scorer(model)
    _, pieces = language.vocabulary(path)

    def total(text):
        if not text:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, min(16, len(text)) + 1):
            i = pieces.get(text[:k], len(model.table) - 1 if k == 1 else None)
            if i is not None:
                out = out + model.table[i] * total(text[k:])
        return out

    for word in ("the", "ation", "über", "日本"):
        assert np.allclose(s.score([[word.encode()]])[0], np.log(total("▁" + word)))
    assert np.isfinite(s.score([[b"abc" * 400]])).all()


def test_op9_long_words_are_summed_whole(monkeypatch):
    import random

    monkeypatch.setattr(language, "STRETCH", 37)
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(5)
    model = language.Model(path, [(("en", "fr")[i % 2], rng.randrange(300, 30_000), i) for i in range(2000)])
    s = language.Scorer(model)
    for n in (41, 64, 65, 160, 333):
        word = "".join(rng.choice(["the", "ation", "é", "日本", "x", "ing"]) for _ in range(n))[:n]
        assert np.allclose(s.forward_long("▁" + word), s.forward(["▁" + word])[0], rtol=1e-12)
        assert np.allclose(s.score([[word.encode(), b"the"]])[0], s.forward(["▁" + word])[0] + s.forward(["▁the"])[0])


def test_op9_a_megabyte_without_spaces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    s = language.Scorer(language.Model(path, [("en", 300, 5), ("fr", 400, 7)]))
    assert np.isfinite(s.score([[b"a" * 200_000]])).all()


def test_op9_words_of_either_language_leave_both_finite():
    """A word that is long in one language's pieces must not lose the other's sum, nor two such words together the text's."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    _, pieces = language.vocabulary(path)
    model = language.Model(path, [("aa", pieces["the"], 10**6), ("bb", pieces["ing"], 10**6)])
    s = language.Scorer(model)
    one, two = s.forward_long("\u2581" + "the" * 9_200), s.forward_long("\u2581" + "ing" * 11_200)
    assert np.isfinite(one).all() and np.isfinite(two).all() and one[0] > one[1] and two[0] < two[1]
    both = s.score([[b"the" * 9_200, b"ing" * 11_200], [b"the" * 9_200]])
    assert np.allclose(both[0], one + two) and np.allclose(both[1], one)
    short = s.forward(["\u2581" + "the" * 12, "\u2581" + "ing" * 12])
    assert np.allclose(short[0], s.forward_long("\u2581" + "the" * 12)) and np.allclose(short[1], s.forward_long("\u2581" + "ing" * 12))


def test_op9_long_words_keep_their_document(spark, tmp_path):
    rows = [(i, ("the cat and the dog " if i % 2 else "der Hund und die Katze ") * 20, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, "the" * 12_000, "en"), (101, "the" * 9_000 + " " + "und" * 9_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = language.train(docs, path)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de") for r in got.values())  # NaN fails both
    assert {100, 101} <= {r["doc_id"] for r in language.accepted(docs, model).collect()}


def test_op8_sample_is_bounded_by_texts_and_not_by_ids(spark):
    """Rows of null or repeated ids are drawn like all others, and repeats once."""
    row = "write to ann.lee@mail.example.com now"
    many = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(f"{row} "), F.col("id").cast("string")).alias("text"))
    for docs, most in ((many, 700), (many.withColumn("doc_id", F.lit(7).cast("long")), 700), (many.withColumn("text", F.lit(row)), 1)):
        assert pii.sampled(docs, 500).count() <= most
    assert pii.sampled(many, 500).count() > 300


def test_op10_hits_are_those_of_every_window(spark, corpus):
    folder, rows = corpus
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    windows = {}
    from .conftest import ITEMS

    for i, text in ITEMS:
        w = pattern.findall(fold(text))
        n = min(13, len(w))
        if i is not None and w:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = []
    for r in rows:
        w = pattern.findall(fold(r["text"]))
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= s
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want.append((r["doc_id"], len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    assert result(spark, "op10_decontamination", folder, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert any(x[5] for x in want)


def test_op10_clean_keeps_rows_and_columns(spark, corpus):
    from sigloom.llm import decontaminate

    folder, _ = corpus
    docs, benchmark = blocks.documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")
    judged = {(r["doc_id"], r["n_words"]): r["contaminated"] for r in queries.op10_decontamination(spark, folder).collect()}
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns
    assert left.count() == docs.count() - sum(queries.op10_decontamination(spark, folder).select(F.col("contaminated").cast("int").alias("c")).toPandas()["c"])
    assert not any(judged[r["doc_id"], len(re.findall(rb"[0-9a-z\x80-\xff]+", (r["text"] or "").encode().lower()))] for r in left.collect())


def test_op10_a_long_text_of_one_item(spark):
    from sigloom.llm import decontaminate

    item = " ".join(f"w{k % 7}" for k in range(60))
    docs = spark.createDataFrame([(1, item * 3_000), (2, "nothing here"), (3, f"x {item} y")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got[2] == (2, 0) and got[3] == (62, 60)
    assert got[1][0] == 59 * 3_000 + 1 and got[1][1] > 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_op2_deals_repeated_rows_to_all_buckets(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"), F.col("id").alias("row"))
    ranks = [r["rank"] for r in packing.ranked(rows, 64).collect()]
    assert sorted(ranks) == list(range(20_000))
    sizes = [r["count"] for r in rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(64))).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 500


def test_tokenizer_remembers_no_more_than_its_bounds(monkeypatch):
    """Two generations of words: what is in use stays, the rest goes, and ids are the same."""
    monkeypatch.setattr(tokens, "WORDS", 50)
    monkeypatch.setattr(tokens, "CORES", 100)
    lower = tokens.LowerWordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(40):
        block = {f"word{chr(97 + k % 26)}{chr(97 + i)}({chr(97 + k // 26)}".encode() for i in range(20)} | {b"often"}
        known = lower.learn(block)
        for w in block:
            assert np.frombuffer(known[w], "<u4").tolist() == lower.full.encode(w.decode(), add_special_tokens=False).ids
        assert len(lower.words) + len(lower.older_words) <= 2 * (50 + len(block)) and len(lower.cores) + len(lower.older_cores) <= 200
    made = {f"{chr(97 + i // 26)}{chr(97 + i % 26)}x".encode() for i in range(300)}
    assert len(lower.learn(made)) >= 300 and len(lower.cores) + len(lower.older_cores) <= 200  # a block's words are all there
    lower.learn({b"often"})
    assert b"often" in lower.words


def test_op2_ids_of_random_texts():
    """Texts side by side in a block give the library's own ids: endings, case, marks that join letters, special strings."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(9)
    parts = ["a", "b", "'s", "'T", "'re", "'VE", "'l", "'ll", "'", "''", "r", "e", "É", "é", "ß", "ÿ", "×", "÷", "ª", "ñ", "À", " ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x01", "\x7f", "\xa0", "\x85", " "]
    parts += ["1", "23", "!", ",", "\"", "<", "|", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "日", "J", "̌", "I", "̇", "́", "İ", "²", "Ⅷ", "٣", "_", "The", " cat", ".", "Σ", "K", "ǅ", "Ā", "Ã"]
    path = public_tokenizers.path("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    for size in [0, 1, 1, 2, *[400] * 25]:
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 12]))) for _ in range(size)]
        texts = [None if t == "" and rng.random() < 0.5 else t for t in texts]
        batch = pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
        got = [r for b in packing.pieces(iter([batch]), path, 7, 1) for r in b.to_pylist()]
        want = []
        for i, t in enumerate(texts):
            ids = full.encode(t or "", add_special_tokens=False).ids + [1]
            want += [(i, s, len(ids[s : s + 7]), zlib.crc32(np.array(ids[s : s + 7], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 7)]
        assert [tuple(r.values()) for r in got] == want


def test_op2_handles_a_pretoken_once_whatever_stands_beside_it():
    """Case and punctuation make no new words, and the new ones of a block are merged together."""
    import pyarrow as pa

    stems = [f"stem{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    text = " ".join(w for s in stems for w in (s, s.title(), s.upper(), s + ",", s + ".", f"({s})", s + "'s", f'"{s}!"'))
    path = public_tokenizers.path("word_bpe_49k.json")
    blocks._kept.clear()
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], names=["doc_id", "text"])
    list(packing.pieces(iter([batch]), path, 2048, 1))
    assert len(tokens.lower_words(path).words) == len(stems) + 7
