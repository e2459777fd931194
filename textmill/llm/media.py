"""Media columns: Netpbm and BMP images as numpy arrays, resized, tiled and hashed.

``decode_image`` reads PBM, PGM and PPM (plain and raw) and uncompressed BMP of 1, 4, 8, 24
and 32 bits, those of 32 bits with masks too; all else is an ``ImageError``. ``area_resize`` takes exact area means from an integral image. ``npy_tiles``
cuts an array into tiles and writes each as NPY, ``read_tiles`` puts them together again.
``difference_hash`` compares neighbours of a small resized grey image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import table

#: A payload of bytes is stored as a grey image of this width.
PAYLOAD_WIDTH = 64
TILE_ROWS, TILE_COLUMNS = 512, 512
HASH_ROWS, HASH_COLUMNS = 8, 8


#: Digits of a number in a Netpbm header or of a plain sample.
MOST_DIGITS = 9


class ImageError(ValueError):
    """Bytes that aren't an image of a kind that is read here."""


# ------------------------------------------------------------------ decoding


def _netpbm_header(raw: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers after the magic, with comments skipped, and where the samples begin."""
    at, numbers = 2, []
    while len(numbers) < count:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at] == 35):
            if raw[at] == 35:
                end = raw.find(b"\n", at)
                at = len(raw) if end < 0 else end
            else:
                at += 1
        begin = at
        while at < len(raw) and raw[at : at + 1].isdigit():
            at += 1
        if not 0 < at - begin <= MOST_DIGITS:
            raise ImageError("a number is missing or too long in the Netpbm header")
        numbers.append(int(raw[begin:at]))
    return numbers, at + 1


def _decode_netpbm(raw: bytes) -> np.ndarray:
    kind = raw[1] - 48
    bitmap, plain, channels = kind in (1, 4), kind <= 3, 3 if kind in (3, 6) else 1
    numbers, at = _netpbm_header(raw, 2 if bitmap else 3)
    width, height, top = numbers[0], numbers[1], 1 if bitmap else numbers[2]
    n = width * height * channels
    if not 0 < top < 65536 or not n:
        raise ImageError("the size or the largest sample value is out of range")
    if (n + 7) // 8 > len(raw):
        raise ImageError("samples are missing")
    if plain:
        body = b"\n".join(line.partition(b"#")[0] for line in raw[at - 1 :].split(b"\n"))
        if bitmap:
            body = body.translate(None, b" \t\n\x0b\x0c\r")
            samples = np.frombuffer(body[: len(body) - len(body.lstrip(b"01"))], dtype=np.uint8) - np.uint8(48)
        else:
            numbers = body.split()[:n]
            if not all(x.isdigit() and len(x) <= MOST_DIGITS for x in numbers):
                raise ImageError("a sample isn't a number")
            samples = np.array(numbers, dtype=np.int64)
            if samples.max(initial=0) > top:
                raise ImageError("a sample is over the largest value")
            samples = samples.astype(np.uint8 if top < 256 else np.uint16)
    elif bitmap:
        packed = np.frombuffer(raw[at:], dtype=np.uint8)
        row = (width + 7) // 8
        if len(packed) < row * height:
            raise ImageError("samples are missing")
        samples = np.unpackbits(packed[: row * height].reshape(height, row), axis=1)[:, :width].reshape(-1)
    else:
        kind_of = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(raw) - at < n * kind_of.itemsize:
            raise ImageError("samples are missing")
        samples = np.frombuffer(raw, dtype=kind_of, count=n, offset=at).astype(kind_of.newbyteorder("="))
        if int(samples.max()) > top:
            raise ImageError("a sample is over the largest value")
    if len(samples) < n:
        raise ImageError("samples are missing")
    image = samples[:n].reshape((height, width, 3) if channels == 3 else (height, width))
    return (1 - image) * np.uint8(255) if bitmap else image


def _decode_bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise ImageError("the BMP header is cut")
    (offset,) = struct.unpack_from("<I", raw, 10)
    header, width, height, _, depth, compression = struct.unpack_from("<IiiHHI", raw, 14)
    if header < 40 or (compression, depth) not in ((0, 1), (0, 4), (0, 8), (0, 24), (0, 32), (3, 32)) or width <= 0 or not height:
        raise ImageError("this kind of BMP isn't read")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if offset < 14 + header or len(raw) < offset + rows * stride:
        raise ImageError("samples are missing")
    body = np.frombuffer(raw, dtype=np.uint8, count=rows * stride, offset=offset).reshape(rows, stride)
    if height > 0:
        body = body[::-1]
    if compression == 3:
        return _by_masks(raw, body[:, : 4 * width], rows, width)
    if depth >= 24:
        return body[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1].copy()
    used = struct.unpack_from("<I", raw, 46)[0] or 1 << depth
    if used > 1 << depth or len(raw) < 14 + header + 4 * used:
        raise ImageError("the palette is cut or too large")
    palette = np.frombuffer(raw, dtype=np.uint8, count=4 * used, offset=14 + header).reshape(used, 4)[:, 2::-1]
    if depth == 8:
        index = body[:, :width]
    elif depth == 4:
        index = np.stack([body >> 4, body & 15], axis=2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(body, axis=1)[:, :width]
    if index.size and int(index.max()) >= used:
        raise ImageError("a sample is outside the palette")
    image = palette[index]
    return image[:, :, 0].copy() if (palette == palette[:, :1]).all() else image


def _by_masks(raw: bytes, body: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Pixels of 32 bits whose channels three masks of adjoining bits cut out, as 8 bits each."""
    if len(raw) < 66:
        raise ImageError("the masks are cut")
    pixels = np.ascontiguousarray(body).view("<u4").reshape(rows, width)
    channels = []
    for mask in struct.unpack_from("<III", raw, 54):
        if not mask:
            raise ImageError("a mask is empty")
        shift = (mask & -mask).bit_length() - 1
        most = mask >> shift
        if most & (most + 1):
            raise ImageError("a mask has gaps")
        value = ((pixels & np.uint32(mask)) >> np.uint32(shift)).astype(np.uint64)
        channels.append(((value * 255 + most // 2) // most).astype(np.uint8))
    return np.stack(channels, axis=2)


def decode_image(raw: bytes) -> np.ndarray:
    """(rows, columns) for grey images, (rows, columns, 3) for coloured ones; ImageError for all
    other bytes."""
    if raw[:1] == b"P" and raw[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _decode_netpbm(raw)
    if raw[:2] == b"BM":
        return _decode_bmp(raw)
    raise ImageError("neither Netpbm nor BMP")


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


# ------------------------------------------------------------------ features


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The mean of each target cell's area of a grey image, cells cut through samples included.

    The integral image is read at fractional places by linear interpolation, which is exact
    for samples that are constant over their area.
    """

    def edges(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(n + 1) * (size / n)
        whole = np.minimum(place.astype(np.int64), size - 1)
        return whole, place - whole

    def cumulative(x: np.ndarray, n: int) -> np.ndarray:
        """Integral along the first axis, at the edges of n cells."""
        whole, part = edges(len(x), n)
        total = np.zeros((len(x) + 1, *x.shape[1:]))
        np.cumsum(x, axis=0, out=total[1:])
        return total[whole] + part.reshape(-1, *[1] * (x.ndim - 1)) * x[whole]

    by_row = np.diff(cumulative(np.asarray(image, dtype=np.float64), rows), axis=0)
    cells = np.diff(cumulative(by_row.T, columns), axis=0).T
    return cells * (rows * columns / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray, rows: int = HASH_ROWS, columns: int = HASH_COLUMNS) -> str:
    """Hexadecimal bits, row by row: 1 where a cell is darker than the one to its right."""
    small = np.round(area_resize(grey(image), rows, columns + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


# ------------------------------------------------------------------ tiles


def npy_tiles(image: np.ndarray, rows: int = TILE_ROWS, columns: int = TILE_COLUMNS) -> list[bytes]:
    """NPY files of the tiles, row by row."""
    out = []
    for top in range(0, image.shape[0], rows):
        for left in range(0, image.shape[1], columns):
            held = io.BytesIO()
            np.save(held, np.ascontiguousarray(image[top : top + rows, left : left + columns]), allow_pickle=False)
            out.append(held.getvalue())
    return out


def read_tiles(tiles: list[bytes], across: int) -> np.ndarray:
    """The array whose tiles these are, ``across`` of them side by side."""
    arrays = [np.load(io.BytesIO(t), allow_pickle=False) for t in tiles]
    return np.concatenate([np.concatenate(arrays[k : k + across], axis=1) for k in range(0, len(arrays), across)])


def split_npy(raw: bytes) -> list[bytes]:
    """NPY files that were written one after the other."""
    out, held = [], io.BytesIO(raw)
    while held.tell() < len(raw):
        begin = held.tell()
        np.load(held, allow_pickle=False)
        out.append(raw[begin : held.tell()])
    return out


# ------------------------------------------------------------------ columns


def media_columns(rows: DataFrame, id_col: str, media_col: str, *, tile_rows: int = TILE_ROWS, tile_columns: int = TILE_COLUMNS) -> DataFrame:
    """(id, height, width, channels, tiles array<binary>, feature, error) for images in a binary column.

    Bytes that aren't an image, or null, give nulls and a message in ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1):
                try:
                    image = decode_image(raw.as_py() or b"")
                    if not image.size:
                        raise ImageError("no samples")
                    out.append((*image.shape[:2], 1 if image.ndim == 2 else image.shape[2], npy_tiles(image, tile_rows, tile_columns), difference_hash(image), None))
                except ImageError as wrong:
                    out.append((None, None, None, None, None, str(wrong)))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.string(), pa.string())
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "height", "width", "channels", "tiles", "feature", "error"])

    return rows.select(F.col(id_col).cast("string").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id string, height int, width int, channels int, tiles array<binary>, feature string, error string")


def payload_image(raw: bytes, width: int = PAYLOAD_WIDTH) -> bytes:
    """Bytes as a PGM image: a sample each, padded with 0 to a positive multiple of the width."""
    padded = raw + bytes(-len(raw) % width or (0 if raw else width))
    return encode_pgm(np.frombuffer(padded, dtype=np.uint8).reshape(-1, width))


def _store(media: bool):
    def one(raw: bytes) -> tuple:
        image = decode_image(payload_image(raw))
        stored = b"".join(npy_tiles(image, columns=PAYLOAD_WIDTH))
        back = read_tiles(split_npy(stored), 1)
        payload = back.tobytes()
        found = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(back))
        return (*found, stored) if media else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                rows = [one(t.as_py() or b"") for t in part.column(1).cast(pa.large_binary())]
                cols = list(zip(*rows, strict=True))
                n = 8 if media else 7
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types[:n], strict=True))], names=["doc_id", *names[:n]])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return run, schema + (", media binary" if media else "")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_media: bool = False) -> DataFrame:
    """Each text stored as grey NPY tiles of its UTF-8 bytes and read back, with its features;
    ``with_media`` adds the stored bytes themselves.

    The bytes are a PGM image of width 64 first, padded with 0, which is decoded, cut into
    tiles of 512 rows and written as NPY. Defined cases: a null or empty text is one row of
    64 zero samples; ids may be null or repeat; an empty table gives an empty result; other
    columns aren't read.
    """
    run, schema = _store(with_media)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
