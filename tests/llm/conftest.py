"""A small corpus with everything awkward in it."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, length long, rank int, score double, row string, block int, form string, spans string, lang_pred string"
CLASH = (7, 8, 9, 0.5, "r", 1, "f", "s", "p")
WORDS = "alpha beta gamma delta Epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été über niño".split()


def texts(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)

    def prose(n: int) -> str:
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n", "  "]) for _ in range(n))

    shared = prose(60)
    common = prose(20)
    rows: list[tuple] = []
    for i in range(40):
        body = prose(rng.randint(1, 120))
        if i % 5 == 0:
            body = body + " " + shared
        if i % 4 == 0:
            body = common + " " + body
        rows.append((10 + i, body, "en" if i % 2 else "fr", "s", len(body)))
    rows += [(100 + i, rows[3][1], "en", "s", 1) for i in range(25)]  # one large group of copies
    near = rows[5][1] + " " + shared
    rows += [(200 + i, near.replace("alpha", f"alpha{i}", 1), "fr", None, None) for i in range(12)]
    rows += [
        (1, None, "en", None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "fr", "s", 5), (4, "word", None, "s", 4), (5, "two words", "en", "s", 9),
        (6, "12345 !!! 678", "en", "s", 13), (7, "日本語 текст ñ", "fr", "s", 12), (8, "x" * 5000, "en", "s", 5000), (9, prose(4000), "en", "s", 1),
        (None, shared, "en", "s", 1), (None, None, None, None, None), (11, shared, "en", "s", 1), (11, shared, "en", "s", 1), (412, "a b c d e f g h i j k l", "en", "s", 1),
        (413, "a\x0bb\x0cc\x1fd\xa0e <|endoftext|> f", "en", "s", 1), (-5, shared + " " + common, "en", "s", 1),
        (414, "Write to ann.lee+x@mail.example.com or +1 (826) 555-4081 190.137.223.204 and 4539578763621486 4556737586899855 now", "en", "s", 1),
        (415, "host 10.0.0.1, bad 300.1.2.3, card 4539 5787 6362 1486, no 1234567890123456", "en", "s", 1), (416, "call +44 20 7946 0958.", "en", "s", 1),
    ]
    return [r + CLASH for r in rows]


ITEMS = [(0, "Alpha beta, gamma DELTA epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (1, "two words"), (2, None), (3, "..."), (4, "word"), (None, "alpha"), (2, "a b c d e f g h i j k l"), (10, "two words")]


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """(folder, rows as dicts)"""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = texts()
    rows.append((300, "so " + ITEMS[0][1] + " it is", "en", "s", 1, *CLASH))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=False)) for r in rows]


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder
