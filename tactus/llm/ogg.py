"""Ogg media columns: pages, lacing, checksums, logical streams and granule positions.

Writing lays a payload out as packets of 8-bit samples in one logical stream and its true length in another, both
multiplexed into one physical stream. Reading goes the other way and trusts nothing: it verifies the checksum of
every page, puts packets together again from lacing values (across pages where they continue), separates the logical
streams by serial number, checks page sequence numbers, and derives each packet's time from granule positions.

Null and empty texts are a payload of padding. Damaged or cut media raise OggError. Equal payloads give equal media:
serial numbers come from the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tactus.llm.text import bounded_batches, utf8

PAD_TO = 192
PAD = b" "
RATE = 8000
#: Samples in a packet, and packets in a page of samples.
PACKET = 960
PAGE_PACKETS = 32

# Fixed values of the container format: capture pattern, header layout, header flags.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1

SAMPLES_HEAD = struct.Struct("<8sII")  # name, rate, bits
LENGTH_HEAD = b"TextLen\0"

REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))

FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """The container's CRC (polynomial 0x04c11db7, not reflected, start 0), by way of the reflected CRC-32."""
    crc = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


def make_page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages_of(packets: list[tuple[bytes, int]], serial: int, page_packets: int, alone: int = 1) -> Iterator[bytes]:
    """Pages of one logical stream. packets: (data, granule position at its end); the first `alone` get own pages."""
    lacing: list[int] = []
    body: list[bytes] = []
    state = {"sequence": 0, "continued": 0}

    def flush(granule: int, goes_on: bool, last: bool) -> bytes:
        flags = state["continued"] * CONTINUED | (state["sequence"] == 0) * FIRST | last * LAST
        page = make_page(serial, state["sequence"], granule, flags, bytes(lacing), b"".join(body))
        state["sequence"] += 1
        state["continued"] = int(goes_on)
        lacing.clear()
        body.clear()
        return page

    ended = NO_PACKET_ENDS
    held = 0
    for k, (data, granule) in enumerate(packets):
        segments = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        while segments:
            if len(lacing) == 255:
                yield flush(ended, at > 0, False)
                ended, held = NO_PACKET_ENDS, 0
            taken, segments = segments[: 255 - len(lacing)], segments[255 - len(lacing) :]
            lacing += taken
            body.append(data[at : at + sum(taken)])
            at += sum(taken)
        ended = granule
        held += 1
        last = k == len(packets) - 1
        if last or k < alone or held == page_packets:
            yield flush(ended, False, last)
            ended, held = NO_PACKET_ENDS, 0


def write_media(payload: bytes, true_length: int) -> bytes:
    """One physical stream: the samples, and beside them the length without padding."""
    serial = zlib.crc32(payload) & 0x7FFFFFFF
    samples = [(SAMPLES_HEAD.pack(b"PCM8    ", RATE, 8), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    length = [(LENGTH_HEAD, 0), (true_length.to_bytes(8, "little"), len(payload))]
    a, b = pages_of(samples, serial, PAGE_PACKETS), pages_of(length, serial | 0x80000000, 1)
    return b"".join([next(a), next(b), *a, *b])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: End of each packet in samples, where a page says so, else -1.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: list[bytes] | None = None

    def times(self, rate: int) -> list[float | None]:
        """Seconds at the end of each packet; packets that share a page are spaced evenly up to its granule."""
        out: list[float | None] = []
        known = 0
        run = 0
        for granule in self.granules:
            run += 1
            if granule >= 0:
                out += [(known + (granule - known) * (j + 1) / run) / rate for j in range(run)]
                known, run = granule, 0
        return out + [None] * run


def read_media(media: bytes) -> dict[int, Stream]:
    """The logical streams by serial number, every page verified."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if media[at : at + 4] != CAPTURE or at + HEADER.size > len(media):
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, segments = HEADER.unpack_from(media, at)
        lacing = media[at + HEADER.size : at + HEADER.size + segments]
        start = at + HEADER.size + segments
        end = start + sum(lacing)
        if version or len(lacing) < segments or end > len(media):
            raise OggError(f"page at byte {at} is cut or of another version")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial} begins twice or nowhere")
        stream = streams.setdefault(serial, Stream(serial))
        if stream.ended or sequence != stream.pages:
            raise OggError(f"page {sequence} of stream {serial} where {stream.pages} is due")
        if bool(flags & CONTINUED) != (stream.part is not None):
            raise OggError(f"a packet of stream {serial} continues from nowhere or breaks off")
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        done = len(stream.packets)
        parts, first = stream.part or [], start
        open_packet = stream.part is not None
        for value in lacing:
            start += value
            open_packet = value == 255
            if not open_packet:
                stream.packets.append(b"".join([*parts, media[first:start]]))
                parts, first = [], start
        stream.part = [*parts, media[first:start]] if open_packet else None
        ends_here = len(stream.packets) - done
        if (granule == NO_PACKET_ENDS) != (ends_here == 0):
            raise OggError(f"granule position of page {sequence} of stream {serial}")
        stream.granules += [-1] * (ends_here - 1) + [granule] * (ends_here > 0)
        at = end
    if any(s.part is not None or not s.ended for s in streams.values()):
        raise OggError("a stream breaks off")
    return streams


def restore(media: bytes) -> tuple[bytes, int, dict]:
    """(payload, its length without padding, facts) from the media alone."""
    streams = read_media(media)
    samples = next(s for s in streams.values() if s.packets[0].startswith(b"PCM8"))
    length = next(s for s in streams.values() if s.packets[0] == LENGTH_HEAD)
    _, rate, bits = SAMPLES_HEAD.unpack(samples.packets[0])
    payload = b"".join(samples.packets[1:])
    last = samples.times(rate)[-1]
    facts = {
        "streams": len(streams),
        "pages": sum(s.pages for s in streams.values()),
        "packets": len(samples.packets) + len(length.packets),
        "rate": rate,
        "bits": bits,
        "duration": last,
    }
    return payload, int.from_bytes(length.packets[1], "little"), facts


def padded(raw: bytes) -> bytes:
    return raw + PAD * (-len(raw) % PAD_TO if raw else PAD_TO)


def describe(payload: bytes, facts: dict) -> str:
    """Mean, deviation and zero crossings of the samples (centred at 128), and the stream's own facts."""
    x = np.frombuffer(payload, np.uint8)
    n = len(x)
    total, square = int(x.sum(dtype=np.int64)), int(np.bincount(x, minlength=256) @ (np.arange(256) ** 2))
    mean = total / n
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    return (
        f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']};seconds={facts['duration']:.6f};"
        f"mean={mean:.6f};deviation={max(square / n - mean * mean, 0) ** 0.5:.6f};crossings={crossings}"
    )


def media_column(text: Column | str) -> Column:
    """Each whole text as Ogg media."""

    bounded_batches()
    @F.pandas_udf("binary")
    def write(texts: pd.Series) -> pd.Series:
        return pd.Series([write_media(padded(raw), len(raw)) for raw in utf8(texts)], dtype=object)

    return write(text)


def media_features(media: Column | str) -> Column:
    """A struct column of FEATURES, all from the media as stored."""

    bounded_batches()
    @F.pandas_udf(FEATURES)
    def read(stored: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in stored:
            payload, length, facts = restore(blob)
            rows.append(
                (
                    length,
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-16:]),
                    len(blob),
                    hashlib.sha256(blob).hexdigest(),
                    describe(payload, facts),
                )
            )
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return read(media)


def packets(media: Column | str, rate: int = RATE) -> Column:
    """array<struct<serial, packet, seconds, bytes>>: the demultiplexed packets of each medium."""

    bounded_batches()
    @F.pandas_udf("array<struct<serial:long,packet:long,seconds:double,bytes:binary>>")
    def split(stored: pd.Series) -> pd.Series:
        out = []
        for blob in stored:
            found = []
            for s in read_media(blob).values():
                found += [{"serial": s.serial, "packet": k, "seconds": t, "bytes": p} for k, (p, t) in enumerate(zip(s.packets, s.times(rate), strict=True))]
            out.append(found)
        return pd.Series(out, dtype=object)

    return split(media)
