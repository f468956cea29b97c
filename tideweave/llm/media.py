"""Images in columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow

TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")
ROW = 64


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); bitmaps as 0 for black and 255 for white."""
    kind, at, head = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        m = TOKEN.match(data, at)
        if not m:
            raise ValueError("Netpbm header ends early")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = head[0], head[1], head[2] if len(head) > 2 else 1
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n = int(np.prod(shape))
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)
    if kind == b"P1":
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        bits = np.frombuffer(re.sub(rb"\s+", b"", body)[:n], np.uint8) - 48
        return ((1 - bits) * 255).astype(np.uint8).reshape(shape)
    if kind in (b"P2", b"P3"):
        return np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.uint8 if top < 256 else np.uint16).reshape(shape)
    out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1).reshape(shape)
    return out if top < 256 else out.astype(np.uint16)


def encode_pgm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (grey palettes as grey, else colour), 24-bit and 32-bit images, top-down or bottom-up."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, width, height, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if packed or bits not in (8, 24, 32):
        raise ValueError("BMP kind isn't supported")
    rows, step = abs(height), (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, rows * step, start).reshape(rows, step)[:, : width * bits // 8]
    raw = raw if height < 0 else raw[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        return palette[raw, 0] if (palette == palette[:, :1]).all() else palette[raw]
    return raw.reshape(rows, width, bits // 8)[:, :, 2::-1]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An 8-bit grey BMP, bottom-up."""
    height, width = pixels.shape
    step = (width + 3) // 4 * 4
    body = np.zeros((height, step), np.uint8)
    body[:, :width] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    return b"BM" + struct.pack("<IHHI", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 0) + palette.tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def integral(pixels: np.ndarray) -> np.ndarray:
    """Sums of the grey image over all rows above and columns before each corner."""
    x = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    np.cumsum(np.cumsum(x, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    return total


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    return reduced(integral(pixels), height, width)


def reduced(total: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area; cells may cut pixels. The integral image is exact, its value between pixels linear."""
    h, w = total.shape[0] - 1, total.shape[1] - 1

    def at(n, cells):
        edge = np.arange(cells + 1) * n / cells
        low = np.minimum(edge.astype(int), n - 1)
        return low, edge - low

    r, fr = at(h, height)
    c, fc = at(w, width)
    rows = total[r] * (1 - fr)[:, None] + total[r + 1] * fr[:, None]
    cells = rows[:, c] * (1 - fc) + rows[:, c + 1] * fc
    return np.diff(np.diff(cells, axis=0), axis=1) / (h / height * w / width)


def difference_hash(pixels: np.ndarray, total: np.ndarray | None = None) -> str:
    """64 bits: whether each cell of an 8 x 9 reduction is brighter than its right neighbour. `total`: the image's integral."""
    small = np.floor(reduced(integral(pixels) if total is None else total, 8, 9) * 1024 + 0.5)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int, total: np.ndarray | None = None) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.floor(reduced(integral(pixels) if total is None else total, side, side) + 0.5), 0, 255).astype(np.uint8))
    return out.getvalue()


def _text_media(side: int, keep: bool):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
    names += ["media", "tile"] if keep else []

    def one(text):
        raw = (text or "").encode()
        size = max(ROW, -(-len(raw) // ROW) * ROW)
        stored = encode_pgm(np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, ROW))
        pixels = decode(stored)
        payload = pixels.tobytes()
        total = integral(pixels)
        tile = npy_tile(pixels, side, total)
        row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(pixels, total), hashlib.sha256(tile).hexdigest())
        return row + ((stored, tile) if keep else ())

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = [one(t) for t in part.column("text").to_pylist()]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names)

    return run


def text_media(docs: DataFrame, side: int = 32, keep: bool = False) -> DataFrame:
    """docs(doc_id, text, ...): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, stored as rows of 64
    grey samples in a PGM image, read back, resized to a `side` x `side` NPY tile and hashed.

    Null texts count as empty; equal texts give equal values, so repeated rows do too; an empty table gives no rows; other
    columns are ignored, so their names can't clash. Neighbouring cells that are equally bright give bit 0. With `keep` the image and the
    tile are returned too. Memory is a few times the longest text.
    """
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile_sha256 string"
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, _text_media(side, keep), schema + (", media binary, tile binary" if keep else ""))


def tiles_of_media(media: DataFrame, side: int = 32) -> DataFrame:
    """media(media_id bigint, media binary) to (media_id, height, width, feature, tile); undecodable or null images give nulls."""

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column("media").to_pylist():
                try:
                    p = decode(x)
                    total = integral(p)
                    rows.append((p.shape[0], p.shape[1], difference_hash(p, total), npy_tile(p, side, total)))
                except (TypeError, ValueError, struct.error, IndexError):
                    rows.append((None, None, None, None))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("media_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["media_id", "height", "width", "feature", "tile"])

    return map_arrow(media.select(F.col("media_id").cast("bigint").alias("media_id"), F.col("media").cast("binary").alias("media")), run, "media_id bigint, height int, width int, feature string, tile binary")
