"""Frames: how one document becomes bytes that stand alone, and how a file of them finds each again."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import BinaryIO, Protocol

import pyarrow as pa
import xxhash
import zstandard

from sylva.errors import ReadError, WriteError

#: What the format's fields can hold, and the largest document that is read back.
U32 = 1 << 32
MOST_RAW = 1 << 30


class Codec(Protocol):
    """Turns the text of a document into a frame and back. Sent to the executors."""

    def encode(self, raw: bytes) -> bytes: ...

    def decode(self, frame: bytes) -> bytes: ...


class Plain:
    """The text itself."""

    def encode(self, raw: bytes) -> bytes:
        return raw

    def decode(self, frame: bytes) -> bytes:
        return frame


@dataclass(frozen=True)
class Zstd:
    """Frames with checksum and size; ``window_log`` 0 leaves the window to the library."""

    level: int = 3
    window_log: int = 19

    def encode(self, raw: bytes) -> bytes:
        window = {"window_log": self.window_log} if self.window_log else {}
        try:
            options = zstandard.ZstdCompressionParameters.from_level(self.level, write_checksum=True, write_content_size=True, **window)
            return zstandard.ZstdCompressor(compression_params=options).compress(raw)
        except (ValueError, zstandard.ZstdError) as error:
            raise WriteError(f"zstd refuses level {self.level} with window 2^{self.window_log}") from error

    def decode(self, frame: bytes) -> bytes:
        try:
            size = zstandard.frame_content_size(frame)
            if not 0 <= size <= MOST_RAW:
                raise ReadError(f"a frame declares {'no size' if size < 0 else f'{size} bytes'}")
            reader = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
            raw = reader.decompress(frame)
        except zstandard.ZstdError as error:
            raise ReadError("a damaged frame") from error
        if not reader.eof or reader.unused_data or len(raw) != size:
            raise ReadError("a frame is cut short or followed by other bytes")
        return raw


@dataclass(frozen=True)
class Lz4:
    """LZ4 frames of independent blocks, with the size and the checksum of the content, by the published frame format."""

    # Fixed values of the format: magic number, version 01 with independent blocks, content size and content checksum, and blocks of 4 MiB.
    MAGIC, FLAGS, BLOCKS, BLOCK, STORED = 0x184D2204, 0b0110_1100, 0x70, 4 << 20, 1 << 31

    def encode(self, raw: bytes) -> bytes:
        head = struct.pack("<BBQ", self.FLAGS, self.BLOCKS, len(raw))
        out = [struct.pack("<I", self.MAGIC), head, bytes([xxhash.xxh32_intdigest(head) >> 8 & 0xFF])]
        for at in range(0, len(raw), self.BLOCK):
            block = raw[at : at + self.BLOCK]
            small = pa.Codec("lz4_raw").compress(block, asbytes=True)
            out += [struct.pack("<I", len(small)), small] if len(small) < len(block) else [struct.pack("<I", len(block) | self.STORED), block]
        return b"".join([*out, struct.pack("<II", 0, xxhash.xxh32_intdigest(raw))])

    def decode(self, frame: bytes) -> bytes:
        try:
            magic, flags, blocks, size, check = struct.unpack_from("<IBBQB", frame)
            if (magic, flags, blocks) != (self.MAGIC, self.FLAGS, self.BLOCKS) or check != xxhash.xxh32_intdigest(frame[4:14]) >> 8 & 0xFF or size > MOST_RAW:
                raise ReadError("not an LZ4 frame of this form")
            out, at, left = [], 15, size
            while (length := struct.unpack_from("<I", frame, at)[0]) != 0:
                data = frame[at + 4 : at + 4 + (length & ~self.STORED)]
                want = min(left, self.BLOCK)
                out.append(data if length & self.STORED else pa.Codec("lz4_raw").decompress(data, want, asbytes=True))
                at, left = at + 4 + len(data), left - want
                if len(out[-1]) != want or not want:
                    raise ReadError("a block of a frame has another size")
            raw = b"".join(out)
            if len(raw) != size or struct.unpack_from("<I", frame, at + 4)[0] != xxhash.xxh32_intdigest(raw) or at + 8 != len(frame):
                raise ReadError("a frame is cut short, damaged or followed by other bytes")
            return raw
        except (OSError, pa.ArrowException, struct.error) as error:
            raise ReadError("a damaged frame") from error


@dataclass(frozen=True)
class Span:
    """Where a frame lies, and the length of its text if the file tells."""

    offset: int
    length: int
    raw_length: int | None


class Format(Protocol):
    """A codec, what goes before and after the frames, and how they are found."""

    codec: Codec

    def header(self) -> bytes: ...

    def trailer(self, sizes: list[tuple[int, int]]) -> bytes: ...

    def locate(self, file: BinaryIO, length: int) -> list[Span]: ...


def _checked(sizes: list[tuple[int, int]]) -> bytes:
    if any(x >= U32 for pair in sizes for x in pair) or len(sizes) >= U32:
        raise WriteError("a frame is too large for the seek table")
    return b"".join(struct.pack("<II", *pair) for pair in sizes)


def _at(file: BinaryIO, offset: int, length: int) -> bytes:
    if offset < 0:
        raise ReadError("the file is too short")
    file.seek(offset)
    data = file.read(length)
    if len(data) != length:
        raise ReadError("the file is too short")
    return data


def _tiled(entries: list[tuple[int, int]], end: int) -> list[Span]:
    """Spans of frames that fill the file from its start up to ``end``."""
    spans, offset = [], 0
    for length, raw in entries:
        spans.append(Span(offset, length, raw))
        offset += length
    if offset != end:
        raise ReadError("the frames don't fill the file up to the seek table")
    return spans


@dataclass(frozen=True)
class ZstdFormat:
    """Zstd frames and their seek table, in the published seekable format: plain decoders read the text."""

    codec: Zstd = Zstd()

    # Fixed values of the format.
    SKIPPABLE, FOOTER_MAGIC, FOOTER = 0x184D2A5E, 0x8F92EAB1, 9
    RESERVED, CHECKSUMS = 0b0111_1100, 0b1000_0000

    def header(self) -> bytes:
        return b""

    def trailer(self, sizes: list[tuple[int, int]]) -> bytes:
        table = _checked(sizes)
        return struct.pack("<II", self.SKIPPABLE, len(table) + self.FOOTER) + table + struct.pack("<IBI", len(sizes), 0, self.FOOTER_MAGIC)

    def locate(self, file: BinaryIO, length: int) -> list[Span]:
        count, descriptor, magic = struct.unpack("<IBI", _at(file, length - self.FOOTER, self.FOOTER))
        if magic != self.FOOTER_MAGIC or descriptor & self.RESERVED:
            raise ReadError("no seek table at the end")
        width = 12 if descriptor & self.CHECKSUMS else 8
        start = length - self.FOOTER - width * count - 8
        table = _at(file, start, 8 + width * count)
        if struct.unpack("<II", table[:8]) != (self.SKIPPABLE, width * count + self.FOOTER):
            raise ReadError("a damaged seek table")
        return _tiled([struct.unpack_from("<II", table, 8 + width * i) for i in range(count)], start)


@dataclass(frozen=True)
class TaggedFormat:
    """Frames of any codec, and a skippable frame with their sizes, their number and a tag."""

    codec: Codec = Lz4()
    tag: bytes = b"TLZ4"

    SKIPPABLE = 0x184D2A50

    def header(self) -> bytes:
        return b""

    def trailer(self, sizes: list[tuple[int, int]]) -> bytes:
        table = _checked(sizes)
        return struct.pack("<II", self.SKIPPABLE, len(table) + 8) + table + struct.pack("<I", len(sizes)) + self.tag

    def locate(self, file: BinaryIO, length: int) -> list[Span]:
        end = _at(file, length - 8, 8)
        count = struct.unpack("<I", end[:4])[0]
        start = length - 16 - 8 * count
        table = _at(file, start, 8 + 8 * count)
        if end[4:] != self.tag or struct.unpack("<II", table[:8]) != (self.SKIPPABLE, 8 * count + 8):
            raise ReadError("no table of frames at the end")
        return _tiled([struct.unpack_from("<II", table, 8 + 8 * i) for i in range(count)], start)


FORMATS: dict[str, Format] = {"zstd": ZstdFormat(), "lz4": TaggedFormat(), "plain": TaggedFormat(Plain(), b"TPLN")}


def decoded_line(codec: Codec, frame: bytes) -> bytes:
    """The text of a frame without the newline that ends it."""
    raw = codec.decode(frame)
    if not raw.endswith(b"\n"):
        raise ReadError("a frame doesn't end in a newline")
    return raw[:-1]
