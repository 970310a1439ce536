import base64
import gzip
import io
import struct
import time

import pytest
import zipfile
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from zenithal.llm import media, urlfilter

PNG = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")


def test_url_rules(spark):
    urls = ["http://Example.COM/en/x", "https://www.example.com/en/", "http://a.www.example.com/en/b?q", "http://example.com", "ftp://x.net/fr/1#y", "http://net/es/", "http://anet/es/", "http://x.org/", "no scheme", None, "", "http://?q", "://host.com/"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id int, url string, other string")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    split = urlfilter.split_url(df)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(split, rules).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3] == ("example.com", "", None, "allow") and got[4][2:] == ("net/fr/", "block")
    assert got[5][3] == "block" and got[6][2] is None and got[9] == ("", "", None, "allow") and got[12][2] == "com/"
    large = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(split, rules, max_mapped=2).collect()}
    assert large == got
    none = rules.limit(0)
    assert {r.verdict for r in urlfilter.judge(split, none, default="block").collect()} == {"block"}
    assert urlfilter.judge(split.limit(0), rules).count() == 0


def test_long_hosts_ties_and_names_in_both_ways(spark):
    rules = spark.createDataFrame([("w.a.com", "/xy", "allow"), ("a.com", "/xyzz", "block"), ("a.com", "/xyzz", "allow"), ("b", "", "block"), ("", "/", "block"), ("c.d", None, "block")], "host string, path string, verdict string")
    long = "x." * 100_000 + "a.com"
    rows = [(1, "w.a.com", "/xyzz/1"), (2, long, "/xyzz"), (3, "q" * 1_000_000, "/"), (4, "v.a.com", "/xyz"), (5, None, None), (6, "a.b", ""), (7, "", "/"), (8, "c.d", "/")]
    df = spark.createDataFrame(rows, "id int, host string, path string").select("*", *[F.lit("mine").alias(c) for c in ("rule", "verdict", "d", "j", "key", "copies", "a.b")])
    want = {1: ("w.a.com/xy", "allow"), 2: ("a.com/xyzz", "block"), 6: ("b", "block")}
    for most in (100, 0):
        out = urlfilter.judge(df, rules, max_mapped=most)
        assert sorted(out.columns) == sorted(df.columns)
        got = out.collect()
        assert {r.id: (r.rule, r.verdict) for r in got} == {i: want.get(i, (None, "allow")) for i, _, _ in rows}
        assert all(r.d == r.j == r.key == r.copies == r["a.b"] == "mine" for r in got)
    assert urlfilter.suffixes("a.b.c.d", 2, 9) == ["c.d", "d"] and urlfilter.suffixes("a.b", 5, 1) == ["b"]


def test_collisions_are_confirmed(tmp_path):
    texts = [urlfilter.rule_key(h, "/") + "\0block" for h in "bac"]
    starts = np.cumsum([0, *map(len, texts)])
    for name, data in (("d", np.full(3, 77, "<u8").tobytes()), ("t", "".join(texts).encode()), ("s", starts.astype("<u8").tobytes()), ("none", b"")):
        (tmp_path / name).write_bytes(data)
    array = urlfilter.RuleArray(*(str(tmp_path / x) for x in "dts"))
    same = np.full(2, 77, np.uint64)  # as if all had one digest
    assert array.probe([urlfilter.rule_key("a", "/"), urlfilter.rule_key("x", "/")], same) == ["block", None]
    assert array.probe([urlfilter.rule_key("a", "/")]) == [None]
    empty = urlfilter.RuleArray(*[str(tmp_path / "none")] * 3)
    assert empty.probe(["a"]) == [None]


def test_many_rules_are_written_in_order(spark):
    rules = spark.createDataFrame([(f"h{i}.com", f"/é{i % 7}", "block" if i % 3 else "allow") for i in range(3000)], "host string, path string, verdict string").repartition(5)
    df = spark.createDataFrame([(i, f"h{i}.com", f"/é{i % 7}/x") for i in range(0, 3500, 7)], "id int, host string, path string")
    got = {r.id: (r.rule, r.verdict) for r in urlfilter.judge(df, rules, default="none").collect()}
    assert got == {i: (f"h{i}.com/é{i % 7}", "block" if i % 3 else "allow") if i < 3000 else (None, "none") for i in range(0, 3500, 7)}


def test_oracle_agrees(spark):
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(con.sql(urlfilter.ORACLE_SQL).select("page_id, host, path, rule, verdict").fetchall(), key=str)
    assert sorted([tuple(r) for r in urlfilter.op6_url_filter(spark, "/root/testdata/sf0.001").collect()], key=str) == want


def _zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


def test_sniffing_and_carving(spark):
    wav = media.to_wav(b"BM and %PDF- in prose")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    rows = [(1, PNG, "image/jpeg"), (2, b"xx" + PNG + b"yy" + gif, "image/png"), (3, b"\x89PNG\r\n\x1a\n broken", "image/png"), (4, None, None), (5, b"", "image/gif"), (6, wav, "audio/wav"), (7, _zip(), "application/zip"), (8, zlib.compress(b"x"), None), (9, gif, "image/gif")]
    df = media.sniff(spark.createDataFrame(rows, "id int, media binary, declared string"))
    got = {r.id: r.found for r in df.collect()}
    assert (got[1].type, got[1].length, got[1].corrected) == ("image/png", len(PNG), True)
    assert got[2].type == media.UNKNOWN and [(e.type, e.offset, e.length) for e in got[2].embedded] == [("image/png", 2, len(PNG)), ("image/gif", 4 + len(PNG), len(gif))]
    assert got[3].type == media.UNKNOWN and got[4].length == 0 and got[5].corrected and not got[6].corrected and got[6].length == len(wav)
    assert got[7].type == "application/zip" and got[9].length == len(gif)
    carved = {(r.id, r.carved_type): bytes(r.carved) for r in media.carve(df).collect()}
    assert carved[2, "image/png"] == PNG and carved[2, "image/gif"] == gif


def test_repeated_magic_bytes_take_linear_time():
    cases = [m for m, _, _ in media.SIGNATURES] + [b"RIFF\1\0\0\0WAVEfmt ", b"\0\0\0\x08ftyp", b"%PDF-1", b"PK\3\4PK\5\6" + bytes(18), b"\x1f\x8b\x08\x08\0\0\0\0\0\0", b"%PDF-1 startxref %%EOF"]
    for m in cases:
        began = time.perf_counter()
        media.inspect(m * (2_000_000 // len(m)))
        assert time.perf_counter() - began < 6, m


@pytest.mark.parametrize("unit", [b"GIF89aaaaaaaa!a", b"GIF89a" + b"\1\0\1\0\0\0\0!\xff\2ab", b"GIF87aaaaaaaa,aaaaaaaaaaa", b"OggS\0\0" + bytes(20) + b"\1\5abcde"])
def test_walks_from_many_valid_starts_take_linear_time(unit):
    began = time.perf_counter()
    assert media.inspect(unit * (3_000_000 // len(unit))) == []
    assert time.perf_counter() - began < 12


def test_pictures_and_streams_that_share_their_end():
    head, body = b"GIF89a" + b"\1\0\1\0\0\0\0", b"!\xff\2ab\0;"
    assert media._gif(head + body, 0, media.Marks(head + body)) == len(head + body)
    page = lambda flag: b"OggS\0" + bytes([flag]) + bytes(20) + b"\1\5abcde"
    data = page(2) + page(0) + page(4) + page(2) + page(4)
    marks, n = media.Marks(data), len(page(0))
    assert [media._ogg(data, i * n, marks) for i in (1, 0, 2, 3, 4)] == [2 * n, 3 * n, n, 2 * n, n]


def test_pdf_and_gzip_and_zip_in_a_row():
    pdf, z, g = b"%PDF-1.4 x startxref 1 %%EOF more %%EOF", _zip(), gzip.compress(b"data" * 99)
    found = media.inspect(pdf + b" " + z + z + g + b"x" + pdf)
    at = [0, len(pdf) + 1, len(pdf) + 1 + len(z), len(pdf) + 1 + 2 * len(z), len(pdf) + 2 + 2 * len(z) + len(g)]
    assert found == [(at[0], len(pdf), "application/pdf"), (at[1], len(z), "application/zip"), (at[2], len(z), "application/zip"), (at[3], len(g), "application/gzip"), (at[4], len(pdf), "application/pdf")]


def test_media_query_against_plain_python(spark):
    import hashlib

    texts = ["", None, "abc", "x" * 64, "é" * 50_000, "same", "same"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id int, text string, media string")
    out = {r.key: r for r in media.features(media.store_texts(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        body = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert r.media_bytes == len(body) + 44 and r.media_sha256 == hashlib.sha256(media.to_wav(raw)).hexdigest()
    assert out[5].feature == out[6].feature and out[0].media_sha256 == out[1].media_sha256
    assert media.features(media.store_texts(df.where(F.lit(False)))).count() == 0
