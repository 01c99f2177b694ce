import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tactus.llm import ogg


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=200))
def test_checksum_equals_the_bitwise_one(data):
    assert ogg.checksum(data) == slow_checksum(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=6), st.integers(1, 4))
def test_packets_of_any_length_come_back(lengths, page_packets):
    data = [bytes([k % 256]) * n for k, n in enumerate(lengths)]
    ends = [sum(lengths[: k + 1]) for k in range(len(lengths))]
    media = b"".join(ogg.pages_of(list(zip(data, ends, strict=True)), 9, page_packets))
    stream = ogg.read_media(media)[9]
    assert stream.packets == data
    assert all(g in (-1, e) for g, e in zip(stream.granules, ends, strict=True))
    assert stream.times(1)[-1] == ends[-1]


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_round_trip(raw):
    payload = ogg.padded(raw)
    assert len(payload) % 192 == 0 and payload and payload.startswith(raw) and not payload[len(raw) :].strip(b" ")
    back, length, facts = ogg.restore(ogg.write_media(payload, len(raw)))
    assert (back, length, facts["streams"]) == (payload, len(raw), 2)
    assert facts["duration"] == len(payload) / ogg.RATE


def test_damage_is_found():
    media = bytearray(ogg.write_media(ogg.padded(b"abc" * 400), 1200))
    for at in (0, 5, 30, 200, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read_media(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.read_media(bytes(media[:-3]))


def test_odd_rows_and_query(spark):
    long = "é" * 400_000
    rows = [(1, None, 1), (2, "", 1), (3, "x" * 192, 1), (4, long, 1), (4, long, 1), (5, "ab", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature int")
    got = df.select("doc_id", ogg.media_features(ogg.media_column("text")).alias("f")).select("doc_id", "f.*").collect()
    for (d, t, _), r in zip(rows, got, strict=True):
        payload = ogg.padded((t or "").encode())
        assert r["doc_id"] == d and r["n_bytes"] == len((t or "").encode()) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert got[3][1:] == got[4][1:] and got[2]["payload_bytes"] == 192
    parts = df.where("doc_id = 3").select(F.inline(ogg.packets(ogg.media_column("text")))).collect()
    assert b"".join(r["bytes"] for r in parts if len(r["bytes"]) == 192) == b"x" * 192
    assert df.limit(0).select(ogg.media_features(ogg.media_column("text"))).collect() == []

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in entry.queries()["op6_media_columns"](spark, d).collect():
        payload = ogg.padded(docs[r["doc_id"]])
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["n_bytes"] == len(docs[r["doc_id"]])
