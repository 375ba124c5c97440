"""Media columns: GIF bytes stored beside timed frames and colour histograms."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm.gif import Frame, encode_samples, frames
from marlstone.llm.words import utf8_rows

WIDTH = 192
HISTOGRAM_BINS = 8
#: Bytes of text and media that one output batch may hold.
BATCH_BYTES = 16_000_000

FRAME = "struct<start_ms:long,delay_ms:int,left:int,top:int,width:int,height:int,disposal:int,transparent:int,red:array<long>,green:array<long>,blue:array<long>>"
MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    f"media_sha256 string, feature string, frames array<{FRAME}>, media binary"
)
_FRAME_FIELDS = [
    ("start_ms", pa.int64()), *((x, pa.int32()) for x in ("delay_ms", "left", "top", "width", "height", "disposal", "transparent")),
    *((x, pa.list_(pa.int64())) for x in ("red", "green", "blue")),
]


def padded(text: bytes | None, unit: int = WIDTH) -> bytes:
    """Text and spaces up to a positive multiple of ``unit`` bytes; null is empty."""
    raw = text or b""
    return raw + b" " * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def visible(canvas: np.ndarray) -> np.ndarray:
    """RGBA of the pixels of a canvas that show, in row order."""
    flat = canvas.reshape(-1, 4)
    shows = flat[:, 3] > 0
    return flat if shows.all() else flat[shows]


def colour_histogram(pixels: np.ndarray, bins: int = HISTOGRAM_BINS) -> list[list[int]]:
    """Counts of equal-width bins for each of the three channels of (n, 3 or 4) pixels."""
    out: list[list[int]] = []
    for c in range(3):
        if c and np.array_equal(pixels[:, c], pixels[:, c - 1]):  # grey
            out.append(out[-1])
        else:
            out.append(np.bincount(pixels[:, c] // (256 // bins), minlength=bins).tolist())
    return out


def frame_row(frame: Frame, start: int) -> dict:
    """Timing, place, rules and histograms of what shows on the canvas; clear pixels do not count."""
    red, green, blue = colour_histogram(visible(frame.canvas))
    return {
        "start_ms": start, "delay_ms": frame.delay_ms, "left": frame.left, "top": frame.top, "width": frame.width, "height": frame.height,
        "disposal": frame.disposal, "transparent": frame.transparent, "red": red, "green": green, "blue": blue,
    }


def media_row(text: bytes | None, keep: bool) -> tuple:
    """Encode, play back, and compute the row of one text from what each frame shows on the canvas."""
    raw = text or b""
    media = encode_samples(padded(text), WIDTH)
    digest, size, crc_tail, rows, clock = hashlib.sha256(), 0, b"", [], 0
    for frame in frames(media, canvas=True):
        # Frames are cleared before the next one, so that a canvas shows the rows of one frame alone.
        samples = visible(frame.canvas)[:, 0].tobytes()
        digest.update(samples)
        size += len(samples)
        crc_tail = (crc_tail + samples)[-16:]
        rows.append(frame_row(frame, clock))
        clock += frame.delay_ms
    red = np.sum([r["red"] for r in rows], axis=0)
    feature = f"gif:{len(rows)}:{clock}:" + ",".join(map(str, red.tolist()))
    return (
        len(raw), size, digest.hexdigest(), zlib.crc32(crc_tail), len(media), hashlib.sha256(media).hexdigest(), feature, rows, media if keep else None,
    )


def _stored(keep: bool):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "media"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct(_FRAME_FIELDS)), pa.binary()]

    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                rows.append((doc, *media_row(text, keep)))
                held += rows[-1][5] if keep else 0
                if held > BATCH_BYTES:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    return run


def store_media(documents: DataFrame, *, keep_media: bool = True) -> DataFrame:
    """Texts stored losslessly as GIFs, one row per input row, features read back.

    The payload is the UTF-8 text and spaces up to a positive multiple of 192
    bytes, one 8-bit grey sample a byte.  ``feature`` is
    ``gif:<frames>:<milliseconds>:<histogram>`` of the samples in eight bins, and
    ``frames`` has timing, place and histograms of every frame; all are taken
    from the canvas that playing the stored bytes shows.  Null and empty texts
    are one row of spaces.  Equal texts give equal
    values; ids may repeat or be null; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.mapInArrow(_stored(keep_media), MEDIA_SCHEMA)
    return out if keep_media else out.drop("media")


FRAME_SCHEMA = (
    "media_id long, frame int, start_ms long, delay_ms int, left int, top int, width int, height int, disposal int, "
    "transparent int, red array<long>, green array<long>, blue array<long>, canvas_sha256 string"
)


def _played(key: int | None, data: bytes | None) -> list[tuple]:
    """Rows of one GIF; none if any part of it cannot be decoded."""
    rows, clock = [], 0
    try:
        for k, frame in enumerate(frames(data, canvas=True) if data else ()):
            rows.append((key, k, *frame_row(frame, clock).values(), hashlib.sha256(frame.canvas.tobytes()).hexdigest()))
            clock += frame.delay_ms
    except ValueError:
        return []
    return rows


def _frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), *(kind for _, kind in _FRAME_FIELDS), pa.string()]
    names = [x.split()[0] for x in FRAME_SCHEMA.split(", ")]
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
            if rows := _played(key, data):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def gif_frames(media: DataFrame, *, id_col: str = "media_id", data_col: str = "media") -> DataFrame:
    """One row per frame of each GIF: timing, place, disposal and histograms of what shows.

    Null, empty, broken or cut bytes, and pictures of more than
    ``gif.MAX_PIXELS``, give no row.
    """
    return media.select(F.col(id_col).cast("long").alias("media_id"), F.col(data_col).alias("media")).mapInArrow(_frame_rows, FRAME_SCHEMA)
