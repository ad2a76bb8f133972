import hashlib
import random
import struct

import pytest
import zstandard

from trackloom.llm import warc as m

PAGES = "page_id long, url string, html string, digest string, first long, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], PAGES).repartition(3)


def cases():
    rnd = random.Random(1)
    words = [f"<p class='{w}'>" for w in ("a", "bee", "élan")] + ["text", "naïve", "\r\n\r\n", "WARC/1.1", "\n", "P*M\x18"]
    page = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, f"https://h{i % 3}.example/{i}", page(rnd.randrange(80))) for i in range(300)]
    rows += [(400 + i, "u", rows[7][2] + "x" * 100) for i in range(60)] + [(390, None, rows[7][2] + "x" * 100)]
    rows += [(500, "u", "x" * 99), (501, "u", "x" * 99), (502, "u", "é" * 50), (503, "u", "é" * 50), (504, "u", "é" * 49), (505, "u", "é" * 49)]
    rows += [(600, None, None), (601, "", ""), (602, "a b\r\nWARC-Type: x", "y" * 200), (None, "u", "y" * 200), (None, "u", "z" * 200), (None, "u", "z" * 200)]
    rows += [(603, "u", "long " * 300_000), (602, "again", "other " * 40), rows[3], (700, "u", "\x00\x1f" * 60)]
    rnd.shuffle(rows)
    return rows


def slow(rows):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        own = first.get(body)
        refers = own if own is not None and own != page else None
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def result(records):
    page = lambda v: int(v[len(m.ID) :]) if v and v != m.ID else None
    rows = [r for r in records if r["record_type"] != "warcinfo"]
    return sorted(((page(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to_id"])) for r in rows), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_round_trip(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("trackloom.llm.common.BROADCAST_ROWS", 0)
    rows, path = cases(), f"file://{tmp_path}/a"
    m.write(table(spark, rows), path, archive_bytes=4000)
    records = m.resolved(m.read(spark, path)).collect()
    assert result(records) == slow(rows)
    assert {r["fault"] for r in records} == {None}
    held = sorted(bytes(r["payload"]) for r in records if r["record_type"] == "response")
    kinds = {(r[0], r[2]): r[3] for r in slow(rows)}
    full = sorted((h or "").encode() for p, _, h in rows if kinds[p, hashlib.sha256((h or "").encode()).hexdigest()] == "response")
    assert held == full
    files = {r["file"] for r in records}
    assert len(files) > 5
    # Another reader of the format sees one frame a record behind a dictionary.
    data = (tmp_path / "a" / sorted(files)[0].rsplit("/", 1)[1]).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(data[8 : 8 + size]))
    plain = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data[8 + size :], read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert plain.count(b"\r\nWARC-Record-ID: ") == sum(r["file"] == sorted(files)[0] for r in records)


def test_small_tables_have_no_dictionary(spark, tmp_path):
    rows = [(1, "u", "<html>"), (2, None, None)]
    m.write(table(spark, rows), f"file://{tmp_path}/a")
    assert result(m.read(spark, f"file://{tmp_path}/a").collect()) == slow(rows)
    m.write(table(spark, []), f"file://{tmp_path}/b")
    assert m.read(spark, f"file://{tmp_path}/b").collect() == []


def archive(*contents, lead=b""):
    return lead + b"".join(zstandard.ZstdCompressor().compress(c) for c in contents)


def faults(data):
    return [(at, fault or m.parse(content)["fault"]) for at, content, fault in m.frames(memoryview(data))]


def test_faults():
    good = m.page_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert faults(archive(good, good)) == [(0, None), (len(archive(good)), None)]
    one = archive(good)
    assert faults(one + archive(good)[:-5])[1][1] == "cut off"
    assert faults(one + b"garbage!!") == [(0, None), (len(one), "no frame")]
    assert faults(one + b"abc")[1][1] == "cut off"
    broken = bytearray(one + one)
    broken[len(one) + 12] ^= 0xFF
    assert faults(bytes(broken))[0][1] is None
    assert faults(bytes(broken))[1][1] is not None
    assert faults(struct.pack("<II", m.DICTIONARY, 100) + b"x")[0][1] == "cut off"
    assert faults(archive(good, lead=struct.pack("<II", 0x184D2A53, 3) + b"abc"))[0][1] is None
    assert faults(b"") == []
    for old, new, fault in [
        (b"WARC/1.1", b"WARC/3.1", "version"), (b"WARC-Date", b"WARC-Dote", "no warc-date"), (b"\r\n\r\nHTTP", b"\r\n\r\n HTTP", "content-length"),
        (b"\r\n\r\nabc", b"\r\n\r\nabd", "payload digest"), (b"Content-Length: 3", b"Content-Length: 4", "body length"), (b"\nHTTP/1", b"\nHTTX/1", "http header"),
    ]:
        assert old in good
        assert m.parse(good.replace(old, new))["fault"] == fault
    again = m.page_record(2, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 1)
    assert (m.parse(again)["payload_bytes"], m.parse(again)["fault"], m.parse(again)["payload"]) == (3, None, None)
    assert m.parse(again.replace(b"WARC-Refers-To", b"WARC-Refers-Xx"))["fault"] == "revisit"


def test_dictionaries_plain_and_packed():
    samples = [f"<html><head><title>{i}</title></head><body>the same words {i}</body>".encode() for i in range(2000)]
    known = zstandard.train_dictionary(4096, samples)
    good = m.page_record(1, "u", samples[0], hashlib.sha256(samples[0]).hexdigest(), None)
    frame = zstandard.ZstdCompressor(dict_data=known).compress(good)
    for held in (known.as_bytes(), zstandard.compress(known.as_bytes())):
        lead = struct.pack("<II", m.DICTIONARY, len(held)) + held
        assert faults(lead + frame + frame) == [(len(lead), None), (len(lead) + len(frame), None)]
    assert faults(frame)[0][1] == "frame"


def test_revisits_need_their_response(spark):
    good = m.page_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    again = [m.page_record(2, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), i) for i in (1, 7)]
    again.append(m.page_record(3, "u", b"abcd", hashlib.sha256(b"abcd").hexdigest(), 1))
    rows = spark.createDataFrame([tuple(m.parse(c)[n] for n in m.NAMES) for c in (good, *again)], m.RECORD)
    assert sorted(str(r["fault"]) for r in m.resolved(rows).collect()) == ["None", "None", "refers to nothing", "refers to nothing"]
