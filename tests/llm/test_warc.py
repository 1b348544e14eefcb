import hashlib
import struct

import zstandard

from graphloom.llm import warc


def test_bundle_is_seekable_and_plain_zstandard():
    w = warc.BundleWriter()
    places = [w.add(warc.record(i, "x", f"http://a/{i}\r\n", b"p" * 40_000 + bytes([i]), "d", None)) for i in range(30)]
    data = w.finish()
    assert struct.unpack("<I", data[-4:])[0] == warc.SEEKABLE and len({f for f, _, _ in places}) > 3
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(-1) for _ in [0])
    assert whole.count(b"WARC/1.1\r\n") == 30


def test_write_and_read_back(spark):
    big = "é" * 600
    rows = [(1, "u", big), (5, "u", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, None, None), (7, "", ""), (8, "u", "b" * 999), (9, "u", "b" * 999), (10, "u", "c" * 1000), (10, "u", "c" * 1000), (None, "u", "x")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.archive(pages).collect()), key=str)
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = sorted(((i, len((h or "").encode()), sha(h), "revisit" if h == big and i != 5 else "response", 5 if h == big and i != 5 else None) for i, _, h in rows), key=str)
    assert got == want
    assert warc.archive(pages.where("false")).count() == 0


def test_index_points_at_records(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 5000) for i in range(40)], "page_id long, url string, html string")
    for r in warc.write_bundles(pages).collect():
        head, block = warc.BundleReader(r["bundle"]).record(r["frame"], r["offset"])
        assert head["X-Page-ID"] == str(r["page_id"]) and block.endswith(f"<p>{r['page_id']}</p>".encode())
