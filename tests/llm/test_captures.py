"""op11: archives written, indexed, looked up and read back, against SQL and plain dictionaries."""

import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sigloom.llm import blocks, captures, queries

SCHEMA = "page_id long, url string, html string, key string, file string, offset long, length long, digest string, refers long, payload_bytes long, record_type string"
CLASH = ("k", "f", 1, 2, "d", 3, 4, "t")


def pages():
    rng = random.Random(3)
    body = "".join(rng.choice("abc <>é") for _ in range(1200))
    rows = [(i, f"http://h{i % 7}.Example.com/p/{i % 40}?q={i}#f", f"<p>{i}</p>" * rng.randint(1, 400)) for i in range(300)]
    rows += [(1000 + i, "https://hot.example.org/same", body) for i in range(2500)]  # a hot payload under a hot key
    rows += [
        (4000, None, None), (4001, "http://x.org", ""), (4002, "", "é" * 500), (4003, "no host", "é" * 500), (4004, "http://a.b/\r\nX: y", "é" * 500),
        (None, "http://n.org/", "n" * 1500), (None, "http://n.org/", "n" * 1500), (None, None, "é" * 500), (4005, "http://e.org/", "s" * 999), (4008, "http://e.org/", "s" * 999),
        (4007, "http://r.org/", "r" * 2000), (4007, "http://r.org/", "r" * 2000), (4006, "http://r.org/", "r" * 2000), (-5, "http://u:p@y.org:8080/" + "z" * 5000, "x" * 3_000_000), (-6, "http://y.org:80", "x" * 3_000_000),
    ]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame([(*r, *CLASH) for r in pages()], SCHEMA).repartition(6).write.parquet(f"{path}/pages.parquet")
    return path


def wanted(path: str) -> list[str]:
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    return sorted(map(repr, c.sql(captures.ORACLE).fetchall()))


def test_every_page_comes_back(spark, folder):
    got = [tuple(r) for r in queries.op11_warc(spark, folder).collect()]
    assert sorted(map(repr, got)) == wanted(folder)
    of = {r[0]: r for r in got if r[0] is not None}
    assert of[1000][3:] == ("revisit", 3499) and of[3499][3:] == ("response", None)
    assert of[4006][3:] == ("revisit", 4007) and of[4007][3:] == of[4005][3:] == ("response", None)  # 999 bytes are no revisit
    assert of[4002][3:] == ("revisit", 4004) and of[-6][3:] == ("revisit", -5)


def test_the_shuffled_join_gives_the_same(spark, folder):
    rows = spark.read.parquet(f"{folder}/pages.parquet")
    got = captures.read_back(rows, held=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(repr(tuple(r)) for r in got.collect()) == wanted(folder)


def test_lookup_finds_the_urls_asked_for_and_their_payloads(spark, folder):
    archive = captures.write(spark.read.parquet(f"{folder}/pages.parquet"), blocks.scratch(spark, "test"))
    again = captures.opened_archive(spark, archive.folder)
    asked = ["https://h3.example.com/p/3?q=3", "https://HOT.example.org:443/same#x", "http://absent.org/", "no host", None, "http://x.org/"]
    got = captures.fetch(again, captures.lookup(again, spark.createDataFrame([(u,) for u in asked * 2], "url string"))).collect()
    found = sorted((r["page_id"] is None, r["page_id"] or 0) for r in got)
    want = [3, *range(1000, 3500), 4000, 4001, 4002, 4003]
    assert found == [(False, i) for i in want] + [(True, 0)]
    three = next(r for r in got if r["page_id"] == 3)
    assert bytes(three["payload"]).decode() == pages()[3][2] and three["target"] == b"http://h3.Example.com/p/3?q=3#f"
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    assert next(r for r in got if r["page_id"] == 4000)["target"] is None


def test_archives_are_warc(spark, folder):
    archive = captures.write(spark.read.parquet(f"{folder}/pages.parquet").where("page_id in (4002, 4003, 4004)"), blocks.scratch(spark, "test"))
    system, path = captures.opened(archive.folder)
    text = b"".join(gzip.decompress(system.open_input_file(f.path).read()) for f in system.get_file_info(captures.fs.FileSelector(f"{path}/warc")))
    assert text.count(b"WARC/1.1\r\n") == 3 and text.count(b"WARC-Type: revisit\r\n") == 2
    assert b"WARC-Target-URI: http://a.b/%0D%0AX:%20y\r\n" in text and text.count("é".encode() * 500) == 1


def test_a_broken_record_is_no_silent_loss():
    payload = b"p" * 1500
    member = captures.record(7, b"http://a/", payload, 1500, hashlib.sha1(payload).hexdigest(), None, captures.EMPTY_DATE)
    assert captures.parsed(member)["payload"] == payload
    other = captures.record(7, b"http://a/", payload[:-1] + b"q", 1500, hashlib.sha1(payload).hexdigest(), None, captures.EMPTY_DATE)
    with pytest.raises(ValueError, match="digest"):
        captures.parsed(other)


def test_keys(spark):
    urls = {
        "http://User@WWW.Example.com:8080?a=b#c": "com,example,www:8080)/?a=b", "https://a.b:443/X y#z": "b,a)/X y", "nothing": "nothing", "": "", None: "",
        "ftp://é.org": "org,é)/", "http:///path": "http:///path",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", captures.surt(F.col("url")).alias("key")).collect()
    assert {r["url"]: r["key"] for r in rows} == urls


def test_spans_hold_every_place_of_a_key():
    rng = random.Random(1)
    for _ in range(200):
        keys = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 4))) for _ in range(40))
        firsts = [keys[i][: captures.PREFIX] for i in range(0, 40, 5)]
        for key in {*keys, b"", b"abba", b"c"}:
            at = {i // 5 for i, k in enumerate(keys) if k == key}
            assert at <= set(captures.span(firsts, key))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op11_warc(spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
