"""Media columns: Ogg streams of 8-bit samples, written and read back.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, become unsigned 8-bit samples at
8 kHz.  The samples go in packets into one logical stream, and a second logical stream of the same file
carries a comment packet for each block of samples, so a reader has to demultiplex.  Reading checks each page's checksum and
sequence number, reassembles packets from the lacing values over page bounds, and takes times from granule
positions.

Null or empty texts give 64 zero samples.  Equal texts give equal files: serial numbers come from the
payload.  Damaged pages raise OggError; reading never guesses.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, text_udf

RATE = 8000
PACKET = 4080
#: Bytes with their bits in reverse order: zlib's CRC is the reflected form of Ogg's.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """A page or packet that does not hold together."""


def page_crc(data: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04c11db7, not reflected, start 0) through zlib's reflected one."""
    crc = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def paginate(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream.  Each packet is (data, granule position at its end); the first, which
    names the stream, has a page of its own."""
    lacing, ends, data = bytearray(), [], []
    for body, granule in packets:
        full, rest = divmod(len(body), 255)
        lacing += b"\xff" * full + bytes([rest])
        ends.append((len(lacing) - 1, granule))
        data.append(body)
    stream, pages, at, e = b"".join(data), [], 0, 0
    head = ends[0][0] + 1
    for i in [0, *range(head, len(lacing), 255)]:
        part = bytes(lacing[i : i + 255] if i else lacing[:head])
        size, granule = sum(part), -1
        while e < len(ends) and ends[e][0] < i + len(part):
            granule = ends[e][1]
            e += 1
        flags = (CONTINUED if i and lacing[i - 1] == 255 else 0) | (FIRST if i == 0 else 0)
        flags |= LAST if i + len(part) == len(lacing) else 0
        pages.append(page(serial, len(pages), granule, flags, part, stream[at : at + size]))
        at += size
    return pages


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """payload as an Ogg file of two interleaved logical streams: samples and comments."""
    serial = zlib.crc32(payload) & 0x7FFFFFFF
    ident = b"\x01pcm-u8\x00" + struct.pack("<IQ", rate, len(payload))
    sound, notes = [(ident, 0)], [(b"\x02notes\x00", 0)]
    for at in range(0, len(payload), packet):
        block = payload[at : at + packet]
        sound.append((block, at + len(block)))
        notes.append((b"crc32=%08x" % zlib.crc32(block), at + len(block)))
    a, b = paginate(serial, sound), paginate(serial ^ 0x80000000, notes)
    # the first pages of all streams come first, then the others by turns
    out = [a[0], b[0]]
    for i in range(1, max(len(a), len(b))):
        out += a[i : i + 1] + b[i : i + 1]
    return b"".join(out)


def demux(data: bytes) -> dict[int, dict]:
    """Packets, granule positions and page counts of each logical stream, by serial number."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise OggError(f"cut off at {at}")
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        if magic != b"OggS" or version != 0:
            raise OggError(f"no page at {at}")
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lacing)
        if end > len(data):
            raise OggError(f"cut off at {at}")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at {at}")
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": [], "ended": False})
        if number != s["pages"] or bool(flags & FIRST) != (number == 0) or s["ended"]:
            raise OggError(f"page {number} of stream {serial} out of turn")
        if bool(flags & CONTINUED) != bool(s["open"]):
            raise OggError(f"page {number} of stream {serial}: a packet is broken")
        s["pages"] += 1
        s["ended"] = bool(flags & LAST)
        pos, start, done = at + HEAD.size + n, at + HEAD.size + n, 0
        for length in lacing:
            pos += length
            if length < 255:
                s["packets"].append(b"".join([*s["open"], data[start:pos]]))
                s["open"], start, done = [], pos, done + 1
        if start < pos or (lacing and lacing[-1] == 255):
            s["open"].append(data[start:pos])
        if done:
            s["granules"].append((len(s["packets"]), granule))
        at = end
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def decode(data: bytes) -> dict:
    """The samples of a file of encode(), with times in seconds for each page that ends a packet."""
    streams = demux(data)
    sound = next((s for s in streams.values() if s["packets"] and s["packets"][0].startswith(b"\x01pcm-u8\0")), None)
    notes = next((s for s in streams.values() if s["packets"] and s["packets"][0].startswith(b"\x02notes\0")), None)
    if sound is None or notes is None:
        raise OggError("a logical stream is missing")
    rate, total = struct.unpack_from("<IQ", sound["packets"][0], 8)
    blocks = sound["packets"][1:]
    payload = b"".join(blocks)
    if len(payload) != total or sound["granules"][-1][1] != total:
        raise OggError("samples are missing")
    if [b"crc32=%08x" % zlib.crc32(x) for x in blocks] != notes["packets"][1:]:
        raise OggError("notes and samples differ")
    times = [g / rate for _, g in sound["granules"] if g >= 0]
    return {"payload": payload, "rate": rate, "times": times, "packets": len(blocks), "streams": len(streams),
            "pages": sum(s["pages"] for s in streams.values())}


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))


def features(read: dict) -> str:
    samples = np.frombuffer(read["payload"], np.uint8)
    mean = float(samples.mean(dtype=np.float64))
    level = float(np.sqrt(np.mean((samples.astype(np.float32) - mean) ** 2, dtype=np.float64)))
    return (f"rate={read['rate']};streams={read['streams']};pages={read['pages']};packets={read['packets']};"
            f"seconds={read['times'][-1]:.4f};mean={mean:.3f};rms={level:.3f}")


def _column(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    media = encode(pad(raw))
    read = decode(media)
    got = read["payload"]
    return (len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(media),
            hashlib.sha256(media).hexdigest(), features(read))


SCHEMA = fields("n_bytes long,payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,"
                "media_sha256 string,feature string")


def media(text: Column) -> Column:
    """The Ogg file of a text, as a binary column."""
    return text_udf(fields("media binary"), lambda: lambda t: (encode(pad(t.encode("utf-8", "surrogatepass"))),))(text)["media"]


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the file is written, read back, verified and summed up."""
    made = docs.select(F.col(id_col).alias("doc_id"), text_udf(SCHEMA, lambda: _column)(F.col(text_col)).alias("m"))
    return made.select("doc_id", "m.*")
