"""Media columns: texts stored as 8-bit samples in Ogg streams, and read back page by page.

A stored value holds two logical streams, multiplexed: ``PCM`` with the payload as unsigned 8-bit mono samples,
and ``TAG`` with one packet, the payload's length without padding. Granule positions of ``PCM`` count samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import shared
from strandline.llm import textbytes as tb

# Fixed values of the Ogg format (RFC 3533): capture pattern, header layout, flags.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Stream numbers, samples a second, samples in a packet, and packets of a page of the writer.
PCM, TAG, RATE, PACKET, BLOCK = 1, 2, 8000, 1920, 192
_PCM_HEAD, _TAG_HEAD = struct.Struct("<8sIHH"), struct.Struct("<8sQ")
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are not a sound Ogg stream."""


def checksum(page: bytes) -> int:
    """Ogg's CRC: the polynomial of zlib.crc32, most significant bit first, from 0 and without a final inversion.

    Reversing the bits of each byte and of the result turns it into the CRC that zlib has.
    """
    turned = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(turned.to_bytes(4, "little").translate(_FLIP), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    raw = head + body
    return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def paginate(serial: int, packets: list[tuple[bytes, int]], ends: bool = True) -> list[bytes]:
    """Pages of a logical stream from (packet, granule position at its end). The first packet has a page of its own."""
    pages: list[bytes] = []
    lacing, body, granule, continued = bytearray(), bytearray(), -1, False

    def flush(last: bool) -> None:
        nonlocal granule
        flags = CONTINUED * continued | FIRST * (not pages) | LAST * (last and ends)
        pages.append(page(serial, len(pages), flags, granule, bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        granule = -1

    for k, (packet, at) in enumerate(packets):
        sizes = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while sizes:
            if len(lacing) == 255:
                flush(False)
                continued = done > 0
            room = min(255 - len(lacing), len(sizes))
            part, sizes = sizes[:room], sizes[room:]
            size = sum(part)
            lacing += part
            body += packet[done : done + size]
            done += size
        granule = at
        if k == 0 and len(packets) > 1:
            flush(False)
            continued = False
        elif len(lacing) == 255 and k < len(packets) - 1:
            flush(False)
            continued = False
    flush(True)
    return pages


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: (packets ended so far, granule position) of pages on which a packet ends.
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False

    def seconds(self, rate: int) -> float:
        """Time at the end of the last packet."""
        return self.marks[-1][1] / rate if self.marks else 0.0


def demultiplex(data: bytes) -> dict[int, Stream]:
    """All logical streams by number. Every page's checksum, number and flags are verified, and packets reassembled."""
    streams: dict[int, Stream] = {}
    partial: dict[int, list[bytes]] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError(f"page header cut off at byte {at}")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if magic != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"page cut off at byte {at}")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if serial not in streams:
            if not flags & FIRST:
                raise OggError(f"stream {serial} has no first page")
            streams[serial], partial[serial] = Stream(), []
        elif flags & FIRST:
            raise OggError(f"stream {serial} begins twice")
        s, open_parts = streams[serial], partial[serial]
        if s.ended or number != s.pages:
            raise OggError(f"stream {serial}: page {number} where {s.pages} is due")
        if bool(flags & CONTINUED) != bool(open_parts):
            raise OggError(f"stream {serial}: a packet is not continued")
        s.pages += 1
        before, size, place = len(s.packets), 0, start
        for x in lacing:
            size += x
            if x < 255:
                s.packets.append(b"".join((*open_parts, data[place : place + size])))
                open_parts.clear()
                place, size = place + size, 0
        if size or lacing[-1:] == b"\xff":
            open_parts.append(data[place : place + size])
        if len(s.packets) > before:
            s.marks.append((len(s.packets), granule))
        elif granule != -1:
            raise OggError(f"stream {serial}: a time on a page where no packet ends")
        s.ended = bool(flags & LAST)
        at = end
    for serial, s in streams.items():
        if partial[serial] or not s.ended:
            raise OggError(f"stream {serial} does not end")
    return streams


def encode(text: bytes) -> bytes:
    payload = text + b" " * (-len(text) % BLOCK if text else BLOCK)
    head = (_PCM_HEAD.pack(b"SLPCM8\0\0", RATE, 1, 8), 0)
    sound = paginate(PCM, [head, *((payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET))])
    tag = paginate(TAG, [(_TAG_HEAD.pack(b"SLTAG\0\0\0", len(text)), 0)])
    return b"".join([sound[0], tag[0], *sound[1:], *tag[1:]])  # first pages come before all others


def decode(media: bytes) -> tuple[bytes, int, dict[int, Stream]]:
    """(payload with padding, bytes without padding, streams)."""
    streams = demultiplex(media)
    if {PCM, TAG} - streams.keys():
        raise OggError("a stream is missing")
    magic, rate, channels, bits = _PCM_HEAD.unpack(streams[PCM].packets[0])
    if (magic, rate, channels, bits) != (b"SLPCM8\0\0", RATE, 1, 8):
        raise OggError("unknown kind of samples")
    payload = b"".join(streams[PCM].packets[1:])
    if streams[PCM].marks[-1][1] != len(payload):
        raise OggError("granule position and number of samples differ")
    return payload, _TAG_HEAD.unpack(streams[TAG].packets[0])[1], streams


def features(payload: bytes, streams: dict[int, Stream]) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    level = round(float(np.sqrt((x * x).mean())), 4)
    crossings = int(np.count_nonzero(np.diff(x >= x.mean())))
    s = streams[PCM]
    stamps = zlib.crc32(b"".join(struct.pack("<dq", g / RATE, k) for k, g in s.marks))
    return f"streams={len(streams)};pages={sum(v.pages for v in streams.values())};packets={len(s.packets)};seconds={s.seconds(RATE):.4f};stamps={stamps};mean={float(x.mean()):.4f};rms={level:.4f};crossings={crossings}"


@tb.task("ogg")
def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.column("__row")
        for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__text")):
            yield pa.record_batch([row.slice(i, j - i), pa.array([encode(data[p:q].tobytes()) for p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], names=["__row", "media"])


def media_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``media``: each whole text, padded with blanks to a positive multiple of 192 bytes, as Ogg.

    A null text counts as empty. Equal texts give equal media. A column named media is replaced.
    Repeated rows each give a row; an empty table gives an empty one; nulls elsewhere pass through.
    """
    shared.lean(docs.sparkSession)
    packed = shared.packed(docs, text).withColumnRenamed(f"__{text}", "__text")
    out = packed.mapInArrow(_encode, f"__row {packed.schema['__row'].dataType.simpleString()}, media binary")
    return shared.unpacked(out, docs.columns, ["media"])


_FIELDS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]


@tb.task("ogg")
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, media = batch.column("__row"), batch.column("__media")
        for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__media")):
            rows = []
            for k, p, q in zip(range(i, j), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if not media[k].is_valid:
                    rows.append((None,) * len(_FIELDS))
                    continue
                raw = data[p:q].tobytes()
                own = (len(raw), hashlib.sha256(raw).hexdigest())
                try:
                    payload, n, streams = decode(raw)
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, features(payload, streams), None))
                except (OggError, struct.error, IndexError) as e:
                    rows.append((None, None, None, None, *own, None, str(e) or type(e).__name__))
            yield pa.record_batch([row.slice(i, j - i), *[pa.array([r[c] for r in rows], t) for c, (_, t) in enumerate(_FIELDS)]], names=["__row", *[n for n, _ in _FIELDS]])


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """The columns of ``df`` but ``media``, and what reading the stored bytes back gives.

    n_bytes (without padding), payload_bytes, payload_sha256, tail_crc32 (last 16 bytes of the payload), media_bytes,
    media_sha256, feature, and error. Unsound bytes give error, their own size and hash, and null for the rest;
    null media give nulls. Columns of these names are replaced.
    """
    others = [c for c in df.columns if c != media]
    row = "struct(" + ", ".join(f"`{c}` AS `{c}`" for c in others) + ")" if others else "struct(0 AS `__none`)"
    apart = df.selectExpr(f"{row} AS __row", f"`{media}` AS __media")
    ddl = f"__row {apart.schema['__row'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return shared.unpacked(apart.mapInArrow(_read, ddl), others, [n for n, _ in _FIELDS])
