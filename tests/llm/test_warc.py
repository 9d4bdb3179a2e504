"""WARC: exact round trips, damaged archives, SQL."""

import gzip
import hashlib

import duckdb
import pytest

from check_oracle import compare
from claimgeo.llm import warc
from claimgeo.llm.queries import ORACLE, QUERIES

from ..conftest import SF001


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF001}/pages.parquet')")
    line, ok = compare(spark, con, "op9_warc", QUERIES["op9_warc"], ORACLE["op9_warc"], SF001)
    assert ok, line


def test_round_trip_of_awkward_pages(spark, tmp_path):
    nasty = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n0\r\n\r\n"
    long = "😀é" * 20_000
    rows = [(1, "http://a/", "é" * 600), (2, "u\r\nX: y", "é" * 600), (3, None, None), (4, "", ""), (5, "u", nasty * 400),
            (6, "u", long), (7, "u", long), (7, "u", long), (None, "u", long), (8, "u", "short"), (9, "u", "short"),
            (None, "u", "n" * 2000), (10, "u", "y" * 16_384), (11, "u", "z" * 4096)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'k' AS k")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, records_per_archive=3, segment_bytes=1500, chunk_bytes=700)
    got = [(str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest,
            None if r.payload is None else bytes(r.payload).decode()) for r in warc.read_archives(spark, path).collect()]
    want = []
    for i, _, t in rows:
        t = t or ""
        b = t.encode()
        same = [j for j, _, u in rows if u == t and j is not None]
        back = len(b) >= 1000 and same and (i is None or i < max(same))
        want.append((str(i), "revisit" if back else "response", max(same) if back else None, len(b),
                     hashlib.sha1(b).hexdigest(), None if back else t))
    assert sorted(got, key=str) == sorted(want, key=str)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    heads = [h for h, _ in warc.parse(raw)]
    assert sum(h["warc-type"] == "continuation" for h in heads) > 50
    assert all("warc-segment-origin-id" in h for h in heads if h["warc-type"] == "continuation")


def test_damage_is_found(spark, tmp_path):
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunk(bad)
    assert warc.dechunk(b"3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    pages = spark.createDataFrame([(1, "u", "q" * 5000)], "page_id long, url string, html string")
    path = tmp_path / "w"
    warc.write_archives(pages, str(path), segment_bytes=1000)
    part = next(path.glob("part-*"))
    raw = gzip.decompress(part.read_bytes())
    pieces = raw.split(b"WARC/1.1\r\n")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part-0.gz").write_bytes(gzip.compress(b"WARC/1.1\r\n".join(pieces[:3] + pieces[4:])))  # a segment is missing
    with pytest.raises(Exception, match="total length"):
        warc.read_archives(spark, str(tmp_path / "bad")).collect()


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0
