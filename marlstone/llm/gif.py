"""GIF: an LZW codec, palettes, disposal and transparency, timed frames.

``frames`` reads any GIF87a/89a stream frame by frame: code streams are expanded
through the LZW table, palettes applied, and frames laid on a canvas by the
disposal and transparency rules.  ``encode_samples`` stores bytes as 8-bit
samples: rows of ``width`` pixels under a grey palette, in frames of at most
``rows`` rows, each of which is cleared before the next one shows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAX_CODES = 4096
#: Most pixels of a canvas or frame (four bytes each when composed); larger pictures are refused before anything is allocated.
MAX_PIXELS = 1 << 24


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """GIF code stream (without sub-blocks) of indices below ``1 << bits``."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, widths = [clear], [bits + 1]
    append, sizes = codes.append, widths.append
    table: dict[int, int] = {}
    get = table.get
    following, width, limit = end + 1, bits + 1, 1 << (bits + 1)
    current = -1
    for byte in data:
        if current < 0:
            current = byte
            continue
        key = current << 8 | byte
        code = get(key)
        if code is not None:
            current = code
            continue
        append(current)
        sizes(width)
        current = byte
        if following < MAX_CODES:
            table[key] = following
            if following == limit:
                width += 1
                limit <<= 1
            following += 1
        else:
            append(clear)
            sizes(width)
            table.clear()
            following, width, limit = end + 1, bits + 1, 1 << (bits + 1)
    if current >= 0:
        append(current)
        sizes(width)
        if following == limit and following < MAX_CODES:
            width += 1
    append(end)
    sizes(width)
    return _pack(np.array(codes, np.uint32), np.array(widths, np.uint8))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Concatenate codes of varying widths, least significant bit first."""
    total = int(widths.sum())
    # Each code lies within three bytes, from its first bit on.
    start = np.concatenate([[0], np.cumsum(widths[:-1].astype(np.int64))])
    byte, shifted = start >> 3, codes.astype(np.uint32) << (start & 7).astype(np.uint32)
    size = (total + 7) // 8
    out = np.zeros(size + 3, np.int64)
    for k in range(3):
        part = (shifted >> np.uint32(8 * k)) & np.uint32(255)
        out[: size + 3] += np.bincount(byte + k, part, size + 3)[: size + 3].astype(np.int64)
    return out[:size].astype(np.uint8).tobytes()


def _codes_from(bits: np.ndarray, at: int, width: int, count: int) -> np.ndarray:
    """Up to ``count`` codes of ``width`` bits from a padded byte array."""
    start = at + width * np.arange(count, dtype=np.int64)
    byte = start >> 3
    word = bits[byte].astype(np.uint32) | bits[byte + 1].astype(np.uint32) << np.uint32(8) | bits[byte + 2].astype(np.uint32) << np.uint32(16)
    return (word >> (start & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """Expand a GIF code stream to at most ``size`` indices.

    The width of every code follows from its place after the last clear code,
    so codes are unpacked in blocks; strings are then built code by code.  A
    stream that ends early gives what it holds; a code beyond the table raises
    ValueError.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    padded = np.frombuffer(stream + b"\0\0\0\0", np.uint8)
    total, at = 8 * len(stream), 0
    base: list[bytes] = [bytes([i]) for i in range(clear)] + [b"", b""]
    parts: list[bytes] = []
    got = 0
    table, width, previous = base[:], bits + 1, b""
    while at + width <= total and got < size:
        # After n codes since the clear code the table has end + n entries (the first code adds none).
        room = (1 << width) - len(table) + (0 if previous else 1) if width < 12 else 1 << 12
        count = max(1, min(room, (total - at) // width))
        codes = _codes_from(padded, at, width, count).tolist()
        used = 0
        restart = False
        for code in codes:
            used += 1
            if code == clear:
                restart = True
                break
            if code == end:
                return b"".join(parts)[:size]
            if code < len(table):
                entry = table[code]
            elif code == len(table) and previous:
                entry = previous + previous[:1]
            else:
                raise ValueError("broken LZW stream")
            parts.append(entry)
            got += len(entry)
            if previous and len(table) < MAX_CODES:
                table.append(previous + entry[:1])
            previous = entry
        at += used * width
        if restart:
            table, width, previous = base[:], bits + 1, b""
        elif len(table) >= 1 << width and width < 12:
            width += 1
    return b"".join(parts)[:size]


def _sub_blocks(data: bytes) -> bytes:
    out = [bytes([min(255, len(data) - i)]) + data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(out) + b"\0"


@dataclass
class Frame:
    """One image of the stream, as it lies on the canvas."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    #: RGB of the 256 palette entries.
    palette: np.ndarray
    #: RGBA of the whole canvas when the frame shows; None unless asked for.
    canvas: np.ndarray | None = None

    @property
    def pixels(self) -> np.ndarray:
        """RGB of the frame's own pixels (height, width, 3)."""
        return self.palette[self.indices]


GREY = bytes(v for i in range(256) for v in (i, i, i))


def write_gif(frames: list[tuple[bytes, int, int]], screen: tuple[int, int], *, palette: bytes = GREY, delay_cs: int = 10, disposal: int = 1) -> bytes:
    """GIF89a of (indices, width, height) frames at the top left corner, under one 256-colour palette."""
    out = [b"GIF89a", struct.pack("<HHBBB", *screen, 0xF7, 0, 0), palette]
    for data, width, height in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, height, 0, 8))
        out.append(_sub_blocks(lzw_encode(data)))
    out.append(b"\x3b")
    return b"".join(out)


def encode_samples(payload: bytes, width: int = 192, rows: int = 256) -> bytes:
    """Store bytes (a positive multiple of ``width``) as 8-bit grey samples."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    step = width * rows
    frames = [(payload[i : i + step], width, (min(step, len(payload) - i)) // width) for i in range(0, len(payload), step)]
    return write_gif(frames, (width, min(rows, len(payload) // width)), disposal=2)


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    """A full table of 256 colours, or None if the flags name none; and where it ends."""
    if not flags & 0x80:
        return None, at
    n = 3 << ((flags & 7) + 1)
    full = np.zeros((256, 3), np.uint8)
    full[: n // 3] = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
    return full, at + n


def _row_order(height: int) -> np.ndarray:
    """Stored order of the rows of an interlaced image."""
    return np.concatenate([np.arange(s, height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _checked(width: int, height: int) -> int:
    if width * height > MAX_PIXELS:
        raise ValueError(f"{width} x {height} pixels are more than {MAX_PIXELS}")
    return width * height


def frames(data: bytes, *, canvas: bool = False) -> Iterator[Frame]:
    """The frames of a GIF one by one; ValueError where the stream is none, broken or cut, or its pictures too large."""
    try:
        yield from _frames(data, canvas)
    except (IndexError, struct.error) as error:
        raise ValueError("a GIF that ends early") from error


def decode(data: bytes, *, canvas: bool = False) -> list[Frame]:
    """All frames of a GIF at once (for small ones)."""
    return list(frames(data, canvas=canvas))


def _frames(data: bytes, canvas: bool) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    shared, at = _palette(data, 13, flags)
    _checked(width, height)
    surface = np.zeros((height, width), "<u4") if canvas else None  # RGBA in one number a pixel
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _read_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal = body[0] >> 2 & 7
                delay = 10 * (body[1] | body[2] << 8)
                transparent = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("broken GIF")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, local)
        palette = shared if own is None else own
        if palette is None:
            raise ValueError("a GIF frame without palette")
        bits = data[at]
        if not 1 <= bits <= 8:
            raise ValueError("a GIF frame of no known depth")
        stream, at = _read_blocks(data, at + 1)
        flat = lzw_decode(stream, bits, _checked(w, h))
        if len(flat) < w * h:
            raise ValueError("a GIF frame with pixels missing")
        indices = np.frombuffer(flat, np.uint8).reshape(h, w)
        if local & 0x40:
            straight = np.empty_like(indices)
            straight[_row_order(h)] = indices
            indices = straight
        frame = Frame(left, top, w, h, delay, disposal, transparent, indices, palette)
        if surface is not None:
            before = surface.copy() if disposal == 3 else None
            area = surface[top : top + h, left : left + w]
            seen = indices[: area.shape[0], : area.shape[1]]
            opaque = np.concatenate([palette, np.full((256, 1), 255, np.uint8)], axis=1).view("<u4").ravel()
            np.copyto(area, opaque[seen], where=True if transparent is None else seen != transparent)
            frame.canvas = surface.copy().view(np.uint8).reshape(height, width, 4)
            if disposal == 2:
                area[:] = 0
            elif before is not None:
                surface = before
        yield frame
        delay, disposal, transparent = 0, 0, None
