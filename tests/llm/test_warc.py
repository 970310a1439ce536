import hashlib

import pytest
import zstandard

from zenithal.llm import files, warc
from zenithal.session import shared_dir

BIG, OTHER = "x" * 1000, "é" * 600


@pytest.fixture(scope="module")
def written(spark):
    rows = [(1, "http://a/x%20y%0D", BIG), (5, "http://b", BIG), (5, "http://b", BIG), (2, None, "small"), (3, "u", "small"), (4, "u", None), (6, "u", OTHER), (7, "u", OTHER), (None, "n", BIG), (8, "w", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return rows, warc.write_bundles(df, shared_dir(spark, "t"), frame_bytes=1500)


def test_round_trip(spark, written):
    rows, index = written
    got = warc.read_bundles(index).collect()
    assert len(got) == len(rows)
    want = {(i, u, hashlib.sha1((h or "").encode()).hexdigest()) for i, u, h in rows}
    assert {(r.record_id, r.url, r.payload_digest) for r in got} == want
    kinds = {r.record_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[1] == ("revisit", 5) and kinds[5] == ("response", None) and kinds[6] == ("revisit", 7)
    assert kinds[2] == kinds[3] == kinds[4] == kinds[None] == ("response", None)
    assert all(bytes(r.payload) == (dict((i, h) for i, _, h in rows)[r.record_id] or "").encode() for r in got if r.record_type == "response")


def test_lookup_by_offset(spark, written):
    _, index = written
    got = {r.record_id: r for r in warc.lookup(index, spark.createDataFrame([(7,), (2,), (99,)], "record_id long")).collect()}
    assert set(got) == {7, 2} and bytes(got[7].payload) == OTHER.encode()


def test_any_reader_reads_the_bundle(written):
    _, index = written
    for path in {r.path for r in index.collect()}:
        data, plain = files.read(path), b""
        d = zstandard.ZstdDecompressor()
        for at, packed, size, _ in warc.seek_table(path):
            plain += d.decompress(data[at : at + packed], size)
        assert plain.count(b"WARC/1.1\r\n") == index.where(index.path == path).count()


def test_urls_are_written_as_they_are():
    data = warc.record(1, "http://a/x%20y\r\nz", b"p")
    assert b"\r\nWARC-Target-URI: http://a/x%20y%0D%0Az\r\n" in data and warc.parse(data)[0]["url"] == "http://a/x%20y%0D%0Az"


def test_one_common_page_and_many_small_ones(spark):
    rows = [(i, "u", BIG) for i in range(900)] + [(1000 + i, None, str(i)) for i in range(900)] + [(3000 + i // 2, "v", OTHER + str(i // 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as sha", "3 as n").repartition(3)
    got = {}
    for r in warc.read_bundles(warc.write_bundles(df, shared_dir(spark, "t"))).collect():
        got.setdefault(r.record_id, []).append((r.record_type, r.refers_to))
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i] == [("revisit", 899)] for i in range(899)) and got[899] == [("response", None)]
    assert all(got[1000 + i] == [("response", None)] for i in range(900))
    last = {}
    for k, _, h in rows[1800:]:
        last[h] = max(k, last.get(h, k))
    for k, _, h in rows[1800:]:
        assert (("response", None) if k == last[h] else ("revisit", last[h])) in got[k]


def test_empty_table(spark):
    index = warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string, path string"), shared_dir(spark, "t"))
    assert index.count() == 0 and warc.read_bundles(index).count() == 0


def test_damage_is_seen():
    data = warc.record(1, "u", b"payload")
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"payloae"))
