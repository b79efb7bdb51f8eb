"""WARC: round trips, splits at every place, false magic, nulls, repeated rows."""

import gzip
import hashlib

from lithoscope.llm.warc import MAGIC, member, read_archives, record_bytes, records_in, with_revisits, write_archives


def page_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_round_trip_and_revisits(spark, tmp_path):
    long = "é" * 800
    rows = [(1, "u1", long, "x"), (5, None, long, None), (3, "u\n3", long, None), (7, "u7", "short", None), (8, "u8", "short", None),
            (9, "u9", None, None), (None, "u", long, None), (5, "again", long, None)]
    archives = write_archives(with_revisits(page_frame(spark, rows)), str(tmp_path / "a"))
    got = read_archives(archives, split_bytes=97).filter("record_type <> 'warcinfo'").collect()
    digest = hashlib.sha1(long.encode()).hexdigest()
    seen = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    short, empty = hashlib.sha1(b"short").hexdigest(), hashlib.sha1(b"").hexdigest()
    assert seen == sorted([
        ("<urn:page:1>", "revisit", "<urn:page:5>", 1600, digest), ("<urn:page:3>", "revisit", "<urn:page:5>", 1600, digest),
        ("<urn:page:5>", "response", None, 1600, digest), ("<urn:page:5>", "response", None, 1600, digest), ("<urn:page:null>", "response", None, 1600, digest),
        ("<urn:page:7>", "response", None, 5, short), ("<urn:page:8>", "response", None, 5, short), ("<urn:page:9>", "response", None, 0, empty)])
    for path, _ in archives.collect():
        assert gzip.open(path).read().startswith(b"WARC/1.1")


def test_every_split_owns_each_record_once(tmp_path):
    nested = member(record_bytes("99", "n", b"inner", hashlib.sha1(b"inner").hexdigest(), None, "d"))
    payloads = [b"", MAGIC * 50, nested, b"a" * 5000, bytes(range(256)) * 20]
    data = b"".join(member(record_bytes(str(k), "u", p, hashlib.sha1(p).hexdigest(), None, "d"), 0 if p is nested else 4) for k, p in enumerate(payloads))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    for step in [*range(1, 40), 100, 333, len(data)]:
        got = [r["payload"] for s in range(0, len(data), step) for r in records_in(str(path), s, min(len(data), s + step))]
        assert got == payloads, step


def test_damage_padding_and_long_payloads(tmp_path):
    """A damaged record is one row that says where; padding is none; payloads beyond the reader's steps come back whole."""
    import random

    draw = random.Random(4)
    payloads = [draw.randbytes(3 << 20), b"a" * 5000, b"b" * 9000, b"c" * (9 << 20), b"d"]
    members = [member(record_bytes(str(k), "u", p, hashlib.sha1(p).hexdigest(), None, "d")) for k, p in enumerate(payloads)]
    at = [sum(map(len, members[:k])) for k in range(6)]
    bad = bytearray(b"".join(members))
    bad[at[2] + 30] ^= 255
    for name, data, lost, where in (("padded", b"".join(members) + bytes(3000), [], []), ("damaged", bytes(bad), [2], [at[2]]),
                                    ("cut", b"".join(members)[:at[4] + 9], [4], [at[4]]), ("front", b"junk" + b"".join(members), [], [0])):
        path = tmp_path / f"{name}.warc.gz"
        path.write_bytes(data)
        for step in (50_000, 1 << 20, len(data)):
            got = [r for s in range(0, len(data), step) for r in records_in(str(path), s, min(len(data), s + step))]
            assert [r["payload"] for r in got if r["record_type"] == "response"] == [p for k, p in enumerate(payloads) if k not in lost], (name, step)
            assert [r["at"] for r in got if r["record_type"] == "damaged"] == where, (name, step)


def test_empty_table(spark, tmp_path):
    archives = write_archives(with_revisits(page_frame(spark, [])), str(tmp_path / "e"))
    assert archives.count() == 0 and read_archives(archives).count() == 0
