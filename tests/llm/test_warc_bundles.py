import glob
import hashlib
import struct
from base64 import b32encode

import zstandard
import pytest
from pyspark.sql import functions as F

from thriftline.llm import warc_bundles as wb

SCHEMA = "page_id long, url string, html string, sha string, page int"
PAGES = [
    (1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (4, "http://a/4", None), (2, "http://a/2", ""),
    (6, "http://a/6\r\nX-Injected: y", "own \r\n\r\n WARC/1.1 text"), (7, "u", "ü" * 3_000_000), (8, "u", "ü" * 3_000_000),
    (9, "twice", "repeated"), (9, "twice", "repeated"), (10, "x", "one id, two texts"), (10, "x", "another"), (None, "n", "same"),
    (None, "n", "alone"),
] + [(100 + i, f"http://hot/{i}", "a third of all rows") for i in range(20)]


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


def brute(rows, least=0):
    hashed = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, data in hashed:
        ids = [q for q, d in hashed if d == data and q is not None]
        first = max(ids, default=None)
        response = len(data) < least or p == first
        out.append((p, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit",
                    None if response else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_equals_brute_force(spark, least):
    found = wb.round_trip(table(spark), min_bytes=least)
    assert sorted(map(tuple, found.drop("url").collect()), key=repr) == brute(PAGES, least)


def test_records_by_index(spark, tmp_path):
    folder = str(tmp_path / "archives")
    index = wb.write_bundles(table(spark), folder)
    assert index.count() == len(PAGES)
    some = index.filter(F.col("record_id").isin("<urn:page:7>", "<urn:page:8>", "<urn:page:6>"))
    rows = {r["page_id"]: r for r in wb.read_bundles(some, folder, with_payload=True).collect()}
    assert rows[8]["payload"].decode() == "ü" * 3_000_000 and rows[7]["payload"] is None and rows[7]["refers_to"] == 8
    assert rows[6]["url"] == "http://a/6%0D%0AX-Injected: y" and rows[6]["payload"].decode() == PAGES[5][2]


def test_files_are_plain_seekable_zstandard(spark, tmp_path):
    folder = str(tmp_path / "archives")
    index = wb.write_bundles(table(spark), folder).collect()
    total = 0
    for path in glob.glob(folder + "/*.warc.zst"):
        data = open(path, "rb").read()
        frames, flags, magic = struct.unpack("<IBI", data[-9:])
        assert (flags, magic) == (0x80, 0x8F92EAB1)
        assert struct.unpack_from("<II", data, len(data) - 9 - 12 * frames - 8) == (0x184D2A5E, 12 * frames + 9)
        whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).readall() for _ in range(1))
        total += whole.count(b"WARC-Record-ID: ")
    assert total == len(index)


def test_damage_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "archives")
    index = wb.write_bundles(table(spark), folder)
    index.collect()
    for path in glob.glob(folder + "/*.warc.zst"):
        with open(path, "r+b") as f:
            f.seek(30)
            f.write(b"\xff\xff\xff\xff")
    with pytest.raises(Exception):
        wb.read_bundles(index, folder).collect()


def test_empty_table(spark):
    assert wb.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
