"""Media columns: Netpbm and BMP images, area resizing, NPY tiles, difference hashes.

``decode`` reads PBM, PGM and PPM (plain and raw, 8 and 16 bits) and uncompressed
BMP (8, 24 and 32 bits) into numpy arrays. ``resize`` averages exact areas by an
integral image, so that a target pixel may cover fractions of source pixels.
``media_tiles`` runs this over a binary column; ``op5_media_tiles`` stores each
text as an image and reads it back.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal
rows; a text of any length is one image; an image that cannot be decoded gives a null tile and hash and the reason
in ``error``; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64
TILE = 8
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


def encode_pgm(a: np.ndarray) -> bytes:
    """A raw 8-bit PGM of a 2-D uint8 array."""
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """An 8-bit grey BMP (bottom-up, rows padded to four bytes)."""
    h, w = a.shape
    pad = -w % 4
    rows = np.zeros((h, w + pad), np.uint8)
    rows[:, :w] = a[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    body = rows.tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + 1024 + len(body), 0, 0, 54 + 1024)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, len(body), 2835, 2835, 256, 0) + palette + body


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at, numbers = raw[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(raw, at)
        if not m:
            raise ValueError("netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    w, h = numbers[:2]
    top = numbers[2] if len(numbers) > 2 else 1
    ch = 3 if kind in (3, 6) else 1
    if kind == 1:
        bits = re.sub(rb"#[^\n\r]*|[^01]", b"", raw[at:])
        a = 1 - (np.frombuffer(bits, np.uint8)[: w * h] - 48)
    elif kind in (2, 3):
        a = np.array(re.sub(rb"#[^\n\r]*", b"", raw[at:]).split()[: w * h * ch], np.int64)
    elif kind == 4:
        a = np.frombuffer(raw, np.uint8, offset=at + 1)[: h * -(-w // 8)]
        a = 1 - np.unpackbits(a.reshape(h, -1), axis=1)[:, :w]
    else:
        a = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, count=w * h * ch, offset=at + 1)
    a = a.reshape((h, w, 3) if ch == 3 else (h, w))
    return a.astype(np.uint8 if top < 256 else np.uint16)


def _bmp(raw: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", raw, 10)
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"bmp of {bits} bits, compression {packed}")
    rows, step = abs(h), -(-w * bits // 32) * 4
    a = np.frombuffer(raw, np.uint8, count=rows * step, offset=start).reshape(rows, step)
    a = a[:, : w * bits // 8].reshape(rows, w, bits // 8)
    if h > 0:
        a = a[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", raw, 46)[0] or 256
        colours = np.frombuffer(raw, np.uint8, count=4 * used, offset=14 + size).reshape(-1, 4)[:, 2::-1]
        grey = bool((colours == colours[:, :1]).all())
        a = colours[:, 0][a[:, :, 0]] if grey else colours[a[:, :, 0]]
        return np.ascontiguousarray(a)
    return np.ascontiguousarray(a[:, :, 2::-1])


def decode(raw: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) samples of a Netpbm or BMP image."""
    if raw[:1] == b"P" and raw[1:2] in b"123456" and len(raw) > 2:
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Exact area averages by an integral image; colour becomes its mean."""
    if a.ndim == 3:
        a = a.mean(axis=2)
    if not a.size:
        raise ValueError("an image without pixels")

    def cut(x: np.ndarray, n: int) -> np.ndarray:  # integral along axis 0, taken at n + 1 even places
        total = np.zeros((len(x) + 1, x.shape[1]))
        np.cumsum(x, axis=0, out=total[1:])
        at = np.arange(n + 1) * (len(x) / n)
        lo = np.minimum(at.astype(np.int64), len(x) - 1)
        return np.diff(total[lo] + (at - lo)[:, None] * (total[lo + 1] - total[lo]), axis=0) * (n / len(x))

    return cut(cut(a, h).T, w).T


def difference_hash(a: np.ndarray) -> str:
    """64 bits: is each of 8x9 area means less than its right neighbour; as hex."""
    small = np.round(resize(a, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    """The array as an NPY file."""
    f = io.BytesIO()
    np.save(f, np.ascontiguousarray(a), allow_pickle=False)
    return f.getvalue()


def tile(raw: bytes | None, side: int) -> tuple[bytes | None, str | None, str | None]:
    """(NPY tile, difference hash, error) of one stored image."""
    try:
        a = decode(raw or b"")
        return npy(np.rint(resize(a, side, side)).astype(np.uint8)), difference_hash(a), None
    except (ValueError, struct.error, IndexError) as e:
        return None, None, str(e)[:200]


def media_tiles(df: DataFrame, key: str = "id", image: str = "image", side: int = 32) -> DataFrame:
    """(key, npy, dhash, error) for each row of a binary image column."""
    keyed = df.select(df[key].alias("k"), df[image].alias("image"))

    def run(batches):
        for b in batches:
            out = [tile(x, side) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.string(), pa.string())))], ["k", "npy", "dhash", "error"])

    kind = dict(keyed.dtypes)["k"]
    return keyed.mapInArrow(run, f"k {kind}, npy binary, dhash string, error string").withColumnRenamed("k", key)


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as an 8-bit image and read back: digests, difference hash and those of its NPY tile.

    Texts are stored as raw PGM or, by their checksum's last bit, as BMP.
    """

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                data = (t or "").encode()
                n = len(data)
                payload = np.frombuffer(data.ljust(WIDTH * max(1, -(-n // WIDTH)), b"\0"), np.uint8).reshape(-1, WIDTH)
                form = ("pgm", "bmp")[zlib.crc32(data) & 1]
                stored = encode_bmp(payload) if form == "bmp" else encode_pgm(payload)
                image = decode(stored)
                back = image.tobytes()
                small = npy(np.rint(resize(image, TILE, TILE)).astype(np.uint8))
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), form, small))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            cols = zip(*rows) if rows else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "format", "npy_tile"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, format string, npy_tile binary")


def op5_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` as a stored image, read back, hashed and made an NPY tile (given by its digest)."""
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("tile_sha256", F.sha2("npy_tile", 256)).drop("npy_tile")
