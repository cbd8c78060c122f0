"""Media columns: texts stored losslessly as 8-bit samples of Netpbm (P6) or BMP images, decoded again to numpy arrays.

An image is 64 samples wide, one byte a channel, three channels; its rows are as many as the payload fills. Features come
from the decoded array: it is resized by area with an integral image, written as an NPY tile, and hashed by differences
of neighbouring cells.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: Rows of an image that are resized at once.
BAND = 4096


def pack(raw: bytes) -> bytes:
    """raw with spaces appended up to a positive multiple of a row."""
    return raw + b" " * (-len(raw) % ROW or (0 if raw else ROW))


def encode_ppm(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom up, blue first."""
    h, w, _ = pixels.shape
    pad = -(w * 3) % 4
    rows = pixels[::-1, :, ::-1].reshape(h, w * 3)
    body = np.pad(rows, ((0, 0), (0, pad))).tobytes() if pad else rows.tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    found, at = [], 2
    while len(found) < fields:
        m = re.compile(rb"(?:\s+|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("damaged Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P4, P5 and P6 with 8-bit samples, as an array of rows, columns and channels."""
    kind = data[:2]
    if kind == b"P4":
        (w, h), at = _netpbm_header(data, 2)
        bits = np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at).reshape(h, -1)
        return (1 - np.unpackbits(bits, axis=1)[:, :w, None]) * np.uint8(255)
    if kind not in (b"P5", b"P6"):
        raise ValueError("not a binary Netpbm image")
    (w, h, top), at = _netpbm_header(data, 3)
    if top > 255:
        raise ValueError("samples of 16 bits")
    c = 3 if kind == b"P6" else 1
    return np.frombuffer(data, np.uint8, w * h * c, at).reshape(h, w, c)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 24-bit BMP, bottom-up or top-down."""
    start, = struct.unpack_from("<I", data, 10)
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if bits != 24 or packed:
        raise ValueError("only 24-bit uncompressed BMP")
    stride = (w * 3 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * 3].reshape(abs(h), w, 3)
    return (rows[::-1] if h > 0 else rows)[:, :, ::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the grey values over each cell of a height x width grid, by differences of an integral image.

    Cell borders may cut pixels: the integral image is read between its points by linear interpolation, which is the exact
    area integral of a pixel grid. It is built BAND rows at a time and only its values at the cells' columns and rows are held.
    """
    h, w, c = pixels.shape
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    left, top = np.minimum(xs.astype(int), w - 1), np.minimum(ys.astype(int), h - 1)
    above, cells = np.zeros(width + 1), np.zeros((height + 1, width + 1))
    for low in range(0, h, BAND):
        grey = pixels[low : low + BAND].sum(axis=2, dtype=np.int64)
        total = np.zeros((len(grey), w + 1))
        np.cumsum(grey, axis=1, out=total[:, 1:])
        part = xs - left
        total = np.cumsum(total[:, left] * (1 - part) + total[:, left + 1] * part, axis=0)
        total = np.vstack([above, above + total])
        here = np.flatnonzero((top >= low) & (top < low + BAND))
        part = (ys[here] - top[here])[:, None]
        cells[here] = total[top[here] - low] * (1 - part) + total[top[here] - low + 1] * part
        above = total[-1]
    sums = cells[1:, 1:] - cells[:-1, 1:] - cells[1:, :-1] + cells[:-1, :-1]
    return sums / (c * (h / height) * (w / width))


def difference_hash(cells: np.ndarray) -> str:
    """Hex of one bit per horizontal pair of neighbours: whether the right one is brighter by over a millionth."""
    bits = (cells[:, 1:] - cells[:, :-1]) > 1e-6
    return np.packbits(bits).tobytes().hex()


def npy_tile(cells: np.ndarray) -> bytes:
    """The grid as bytes of an NPY file of uint8."""
    out = io.BytesIO()
    np.save(out, np.floor(cells + 0.5).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def media_row(text: str | None) -> tuple:
    """Payload size, stored form, bytes read back, tile and hash of one text (null: empty)."""
    raw = (text or "").encode()
    payload = pack(raw)
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, CHANNELS)
    stored = encode_bmp(pixels) if zlib.crc32(payload) & 1 else encode_ppm(pixels)
    back = decode(stored)
    read = back.tobytes()
    cells = area_resize(back, 8, 9)
    return len(raw), stored, read, npy_tile(cells), difference_hash(cells)


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per input row: sizes and digests of payload and stored form, and the feature (tile digest and hash).

    The format is BMP where the payload's crc32 is odd, else Netpbm, so equal texts give equal values. Null and empty texts
    become one row of spaces; a null id stays null; equal rows give equal rows. Very long texts are stored and read whole, and resized
    BAND rows at a time. Other columns are not read. keep_media adds the stored image and the NPY tile. No rows give no rows.
    """
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, tile binary" * keep_media

    def make():
        def rows(ids, texts):
            out = []
            for i, t in zip(ids, texts, strict=True):
                n, stored, read, tile, bits = media_row(t)
                feature = f"dhash:{bits};tile:{hashlib.sha256(tile).hexdigest()[:16]}"
                row = [i, n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature]
                out.append(row + [stored, tile] * keep_media)
            return list(zip(*out, strict=True))

        return rows

    return map_rows(docs.select(doc_id, text), make, schema, text)
