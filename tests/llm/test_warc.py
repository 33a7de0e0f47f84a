import hashlib
import struct
from pathlib import Path

import duckdb
import zstandard
from pyspark.sql import functions as F

from waypoint.llm import warc

PAGES = "page_id bigint, url string, html string, payload_bytes string"
BIG = "<html>é" + "x" * 1200 + "</html>"


def pages(rows):
    data = [
        (1, "http://a/", BIG), (5, None, BIG), (3, "http://b/\r\nX: y", BIG), (5, "again", BIG), (2, "u", "short"), (4, "u", "short"),
        (6, "u", None), (7, "u", ""), (8, "u", "y" * 3_000_000), (None, "n", BIG), (9, "u", "a\r\n\r\nb\r\n\r\n" + "z" * 1000),
    ]
    return rows([(*r, "clash") for r in data], PAGES).repartition(3), data


def test_round_trip_and_sql(spark, rows):
    df, data = pages(rows)
    out = warc.archive(df)
    assert out.columns == ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    want = []
    for i, _, html in data:
        raw = (html or "").encode()
        revisit = html == BIG and i != 5
        want.append((i, "revisit" if revisit else "response", 5 if revisit else None, len(raw), hashlib.sha1(raw).hexdigest()))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert warc.archive(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("pages", df.where("page_id is not null").toPandas())
    names = "page_id, record_type, refers_to, payload_bytes, payload_digest"
    got = con.sql(f"SELECT {names} FROM ({warc.SQL})").fetchall()
    assert sorted(got, key=str) == sorted((w for w in want if w[0] is not None), key=str)


def test_bundles_are_seekable_and_records_are_fetched_alone(spark, rows, tmp_path):
    df, data = pages(rows)
    folder = str(tmp_path)
    index = warc.write_bundles(warc.mark_revisits(df.where("page_id is not null")), folder, frame_bytes=2000, bundle_bytes=4000)
    places = index.collect()
    assert len(places) == len(data) - 1 and len({(p.bundle, p.frame) for p in places}) > 3
    for file in Path(folder).glob("*.zst"):
        raw = file.read_bytes()
        assert struct.unpack("<I", raw[-4:])[0] == warc.SEEKABLE
        reader = warc.BundleReader(folder, file.name)
        joined = b"".join(reader.frame(k) for k in range(len(reader.frames)))
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as whole:
            assert whole.read() == joined  # a plain reader skips the seek table
        for p in places:
            if p.bundle == file.name:
                record = reader.frame(p.frame)[p.offset : p.offset + p.length]
                assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    wanted = rows([(8,), (3,), (77,)], "page_id bigint")
    got = {r.page_id: r for r in warc.fetch_records(index, wanted, folder).collect()}
    assert set(got) == {3, 8} and got[8].payload.decode() == "y" * 3_000_000 and got[3].refers_to == 5
    assert got[3].url == "http://b/%0D%0AX: y"


def test_archives_are_read_back_by_many_tasks(spark, rows, tmp_path):
    data = [(k, "u", f"page {k} " * 300) for k in range(120)]
    df = rows(data, "page_id bigint, url string, html string").coalesce(1)
    index = warc.write_bundles(warc.mark_revisits(df), str(tmp_path), frame_bytes=4000)
    for stretch in (1, 7, 1000):
        back = warc.read_bundles(index, str(tmp_path), payloads=True, stretch=stretch)
        got = back.select("page_id", "payload", F.spark_partition_id().alias("task")).collect()
        assert sorted((r.page_id, r.payload.decode()) for r in got) == [(i, t) for i, _, t in data]
        bundles = index.select("bundle").distinct().count()
        assert len({r.task for r in got}) <= bundles if stretch == 1000 else len({r.task for r in got}) == 4
