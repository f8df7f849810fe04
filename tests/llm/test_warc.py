import gzip
import hashlib
import time

from sievecraft.llm.common import shared_dir
from sievecraft.llm.warc import op6_warc, read_archives, salvage, write_archives

PAGES = "page_id long, url string, html string, kind string"
BIG = "<p>" + "repeated page \r\n\r\n WARC/1.1\r\nnot a record\r\n\r\n" * 10
ROWS = [
    (1, "http://a/\r\nx", "<p>one</p>", "k"), (2, "http://b", BIG, "k"), (3, None, BIG, None), (4, "http://d", None, "k"), (5, "http://e", "", "k"),
    (6, "http://f", "é" * 60, "k"), (9, "http://g", "é" * 60, "k"), (None, "http://n", "é" * 60, "k"), (7, "http://h", "z" * 300000, "k"), (2, "http://b", BIG, "k"),
]


def records_of(path):
    return b"".join(p.read_bytes() for p in sorted(path.iterdir()) if p.name.startswith("part-"))


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = op6_warc(spark, str(tmp_path)).collect()
    want = []
    for i, _, html, _ in ROWS:
        data = (html or "").encode()
        same = [j for j, _, h, _ in ROWS if (h or "").encode() == data and j is not None]
        first = min(same) if len(data) >= 100 and same else i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    write_archives(pages, str(tmp_path / "zipped"), "gzip")
    back = read_archives(spark, str(tmp_path / "zipped"))
    payloads = {r.page_id: bytes(r.payload).decode() for r in back.collect() if r.record_type == "response"}
    assert payloads["2"] == BIG and payloads["4"] == "" and back.where("kind = 'gap'").count() == 0
    assert op6_warc_of_nothing(spark, tmp_path) == 0
    assert shared_dir(spark)


def op6_warc_of_nothing(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    return op6_warc(spark, str(tmp_path / "none")).count()


def test_salvage_of_broken_archives(spark, tmp_path):
    write_archives(spark.createDataFrame(ROWS[:7], PAGES).coalesce(1), str(tmp_path / "w"))
    data = records_of(tmp_path / "w")
    whole = list(salvage(data))
    assert [x["page_id"] for x in whole] == ["1", "2", "3", "4", "5", "6", "9"] and {x["kind"] for x in whole} == {"record"}
    second = whole[1]
    at = second["start"] + 400
    flipped = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    found = list(salvage(flipped))
    assert [x["page_id"] for x in found if x["kind"] == "record"] == ["1", "3", "4", "5", "6", "9"]
    assert [(x["start"], x["end"]) for x in found if x["kind"] == "gap"] == [(second["start"], second["end"])]
    cut_off = list(salvage(b"junk before\n" + data[:-3]))
    assert [x["kind"] for x in cut_off] == ["gap", *["record"] * 6, "gap"] and cut_off[0]["end"] == 12
    members = [gzip.compress(data[x["start"] : x["end"]]) for x in whole]
    broken = members[2][:20] + b"\0\0\0" + members[2][23:]
    found = list(salvage(b"".join([*members[:2], broken, *members[3:]])))
    assert [x["page_id"] for x in found if x["kind"] == "record"] == ["1", "2", "4", "5", "6", "9"]
    assert sum(x["end"] - x["start"] for x in found if x["kind"] == "gap") == len(broken)
    assert list(salvage(b"")) == [] and [x["kind"] for x in salvage(b"no archive")] == ["gap"]


def test_reading_takes_time_in_proportion():
    """Many small members, false gzip marks, version lines in a row, and members with names and extra fields."""
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 400\r\n\r\n" + bytes(range(40, 240)) * 2 + b"\r\n\r\n"
    members = b"".join(gzip.compress(record % k, 1, mtime=0) for k in range(60_000))
    begin = time.time()
    assert sum(x["kind"] == "record" for x in salvage(members)) == 60_000
    for mark in (b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00", b"\x1f\x8b\x08\x08\0\0\0\0\0\0a", b"\x1f\x8b\x08\x00\0\0\0\0\0\xff\x01\xff\xff\0\0"):
        assert [x["kind"] for x in salvage(mark * 200_000)] == ["gap"]
    assert [x["kind"] for x in salvage(b"WARC/1.1\r\nWARC-Type: x\r\n" * 60_000 + b"\r\n")] == ["gap"]
    assert [x["kind"] for x in salvage(b"WARC/1.1\r\n" + b"a: b\r\n" * 20_000 + b"\r\n" + record % 7)] == ["gap", "record"]
    assert time.time() - begin < 90
    named = bytearray(gzip.compress(record % 5, mtime=0))
    named[3] |= 4 + 8 + 16
    found = list(salvage(bytes(named[:10]) + b"\x03\0abc" + b"name\0" + b"comment\0" + bytes(named[10:])))
    assert [x["page_id"] for x in found] == ["5"]
