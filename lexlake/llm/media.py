"""Media columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import batches, pairs, texts

_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as rows x columns (x 3), uint8 or uint16; bitmaps give 0 for black and 1 for white. ValueError if broken."""
    if len(data) < 3 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise ValueError("not a Netpbm file")
    kind, at, head = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        if not (m := _FIELD.match(data, at)):
            raise ValueError("broken header")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = (*head, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    if not 0 < most < 65536:
        raise ValueError("broken maximum")
    n = width * height * depth
    if kind == 1:
        values = 1 - (np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:]), np.uint8)[:n] - 48)
        if (values > 1).any():
            raise ValueError("a sample that is neither 0 nor 1")
    elif kind in (2, 3):
        given = re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n]
        if any(not x.isdigit() or len(x) > 5 or int(x) > most for x in given):
            raise ValueError("a sample above the maximum")
        values = np.array(given, np.uint16 if most > 255 else np.uint8)
    elif kind == 4:
        row = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: row * height]
        if len(raw) < row * height:
            raise ValueError("too few samples")
        return 1 - np.unpackbits(raw.reshape(height, row), axis=1)[:, :width]
    else:
        values = np.frombuffer(data[at + 1 :][: n * (1 + (most > 255))], ">u2" if most > 255 else np.uint8)
    if len(values) < n:
        raise ValueError("too few samples")
    shape = (height, width, 3) if depth == 3 else (height, width)
    return values.reshape(shape).astype(np.uint16 if most > 255 else np.uint8, copy=False)


def encode_pgm(samples: np.ndarray) -> bytes:
    """Rows x columns of 8 bits as a binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (with palette), 24 or 32 bits as rows x columns x 3. ValueError if broken."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    offset, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("a BMP of another kind")
    stride = (width * bits // 8 + 3) & ~3
    if len(data) < offset + stride * abs(height):
        raise ValueError("too few samples")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(used, 4)[:, 2::-1]
        return palette[np.minimum(rows, used - 1)]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Rows x columns x 3 of 8 bits as a 24-bit BMP."""
    height, width = pixels.shape[:2]
    stride = (3 * width + 3) & ~3
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of colour images by the weights of Rec. 601."""
    return image if image.ndim == 2 else image[..., :3] @ np.array([0.299, 0.587, 0.114])


def integral(image: np.ndarray) -> np.ndarray:
    """Sums over all rectangles from the origin, with a zero row and column before them."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=out[1:, 1:])
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target cell is the mean over its exact area, edges inside a sample counted in part: differences of the integral image."""
    s = integral(image)
    for axis, n in ((0, height), (1, width)):
        edge = np.linspace(0, s.shape[axis] - 1, n + 1)
        low = np.minimum(edge.astype(np.int64), s.shape[axis] - 2)
        part = np.expand_dims(edge - low, 1 - axis)
        s = np.diff(np.take(s, low, axis) * (1 - part) + np.take(s, low + 1, axis) * part, axis=axis)
        # The next axis still needs its zero edge, which differences along this one keep.
    return s / (image.shape[0] / height * (image.shape[1] / width))


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Of an 8 x 9 reduction, whether each cell is brighter than its left neighbour, as 16 hex digits."""
    small = np.round(area_resize(grey(image), side, side + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 32) -> bytes:
    """A square 8-bit reduction as an NPY file."""
    np.save(out := io.BytesIO(), np.clip(np.rint(area_resize(grey(image), side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


TILES = pa.schema([("id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])


def media_tiles(files: DataFrame, id_col: str, data_col: str, side: int = 32) -> DataFrame:
    """Of a column of Netpbm or BMP files: id, height, width, tile (NPY), dhash, error.

    A null, broken or empty image gives a row with the reason in error and null in the rest. Very large ones are reduced
    from all their samples. Null ids stay null, equal images give equal tiles, repeated rows give a row each, an empty
    table gives no rows, and other columns play no part.
    """

    def run(got):
        for batch in got:
            yield from batches((_tile(i, data, side) for i, data in pairs(batch, "id", "data")), TILES)

    return files.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{data_col}` as binary) data").mapInArrow(run, "id long, height int, width int, tile binary, dhash string, error string")


def _tile(i: int | None, data: bytes | None, side: int) -> tuple:
    try:
        image = decode(data or b"")
        if not image.size:
            raise ValueError("no samples")
        return i, image.shape[0], image.shape[1], npy_tile(image, side), difference_hash(image), None
    except ValueError as e:
        return i, None, None, None, None, str(e)


def payload_image(text: str | None, width: int = 64) -> tuple[int, bytes]:
    """Bytes of the text, and a binary PGM whose samples they are, zeros appended up to a positive multiple of the width."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // width))
    return len(raw), encode_pgm(np.frombuffer(raw.ljust(rows * width, b"\0"), np.uint8).reshape(rows, width))


STORED = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary())])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored losslessly as an image: doc_id, media (PGM, 64 columns). Null and empty texts are one row of zeros,
    very long ones are stored whole; null ids stay null, repeated rows give a row each, an empty table gives no rows."""

    def run(got):
        for batch in got:
            yield from batches(((i, payload_image(t)[1]) for i, t in pairs(batch, "doc_id", "text")), STORED, 512)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def text_media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as an image, decoded again, and described: one row for each input row, equal for equal texts.

    tile is the decoded image reduced to an NPY file of 32 x 32, feature its difference hash and the tile's crc32. Null
    text is empty; very long texts are stored whole; null ids stay null; repeated rows give a row each; an empty table
    gives no rows; other columns play no part.
    """

    def one(i: int | None, text: str | None) -> tuple:
        n, media = payload_image(text)
        image = decode(media)
        back, tile = image.tobytes(), npy_tile(image)
        return i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(image)}:{zlib.crc32(tile):08x}", tile

    def run(got):
        for batch in got:
            yield from batches((one(i, t) for i, t in pairs(batch, "doc_id", "text")), FEATURES)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
