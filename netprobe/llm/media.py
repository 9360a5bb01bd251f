"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized, as NPY tiles with difference hashes.

Defined results: bytes that are null, empty, cut short, of another format or not well formed (letters for
numbers, a sample above the highest, sizes beyond the data) decode to null, as does an image without pixels;
null text is stored as empty text, one row of zeros; equal bytes give equal tiles and hashes; very large
images are summed in bands, so beside the image itself a few rows are held; empty tables give empty tables; ``add_tiles``
keeps other columns and replaces those named like its own.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netprobe.llm.common import materialize, slices

WIDTH, TILE = 64, 32
_GAP = rb"(?:\s|#[^\n]*\n)+(\d{1,9})"
_HEAD = re.compile(rb"P([1-6])" + _GAP * 2)
_MORE = re.compile(_GAP)
#: Pixels of which an integral image is made at once.
BAND = 1 << 20


def decode_netpbm(data: bytes) -> np.ndarray | None:
    """P1 to P6, up to 16 bits a sample: (height, width) or (height, width, 3)."""
    head = _HEAD.match(data)
    if not head:
        return None
    kind, width, height = int(head[1]), int(head[2]), int(head[3])
    at, top = head.end(), 1
    if kind not in (1, 4):
        more = _MORE.match(data, at)
        if not more:
            return None
        at, top = more.end(), int(more[1])
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = math.prod(shape)
    # no format stores more than 8 samples in a byte
    if not n or not 1 <= top <= 65535 or n > 8 * len(data):
        return None
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        if re.search(rb"[^01\s]" if kind == 1 else rb"[^0-9\s]|[0-9]{6}", body):
            return None
        words = re.findall(rb"[01]", body) if kind == 1 else body.split()
        if len(words) < n:
            return None
        out = np.array(words[:n], dtype=np.int64).reshape(shape)
        if out.max() > top:
            return None
        return (1 - out).astype(np.uint8) * 255 if kind == 1 else out.astype(np.uint8 if top < 256 else np.uint16)
    at += 1  # a single white space ends the header
    if kind == 4:
        stride = (width + 7) // 8
        raw = np.frombuffer(data[at : at + stride * height], np.uint8)
        if len(raw) < stride * height:
            return None
        return (1 - np.unpackbits(raw.reshape(height, stride), axis=1)[:, :width]) * 255
    dtype = np.dtype(np.uint8) if top < 256 else np.dtype(">u2")
    if len(data) - at < n * dtype.itemsize:
        return None
    return np.frombuffer(data, dtype, n, at).reshape(shape).astype(dtype.newbyteorder("="))


def decode_bmp(data: bytes) -> np.ndarray | None:
    """Uncompressed 8 (palette), 24 and 32 bits a pixel, bottom-up or top-down."""
    if len(data) < 54 or data[:2] != b"BM":
        return None
    number = lambda at, size, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    begin, header, width, height, bits, packed = number(10, 4), number(14, 4), number(18, 4, True), number(22, 4, True), number(28, 2), number(30, 4)
    rows = abs(height)
    if header < 40 or bits not in (8, 24, 32) or packed or width <= 0 or not rows:
        return None
    stride = (width * bits // 8 + 3) // 4 * 4
    if len(data) - begin < stride * rows:
        return None
    grid = np.frombuffer(data, np.uint8, stride * rows, begin).reshape(rows, stride)
    grid = grid if height < 0 else grid[::-1]
    if bits == 8:
        raw = data[14 + header : 14 + header + (number(46, 4) or 256) * 4]
        table = np.frombuffer(raw[: len(raw) // 4 * 4], np.uint8).reshape(-1, 4)
        index = grid[:, :width]
        return table[index][..., 2::-1] if len(table) > index.max() else None
    return grid[:, : width * bits // 8].reshape(rows, width, bits // 8)[..., 2::-1].copy()


def decode(data: bytes | None) -> np.ndarray | None:
    if not data:
        return None
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(grid: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grid.shape[1], grid.shape[0]) + grid.tobytes()


def _weights(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.arange(to + 1) * (n / to)
    low = np.minimum(edge.astype(np.int64), n)
    return low, np.minimum(low + 1, n), edge - low


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's exact area: differences of the integral image at fractional edges."""
    if image.ndim == 3:
        return np.stack([area_resize(image[..., c], height, width) for c in range(image.shape[2])], axis=-1)
    (n, wide), tall = image.shape, height
    low, high, part = _weights(n, tall)
    # rows of the image summed downwards, kept only where the target's edges lie
    sums, acc = {0: np.zeros(wide)}, np.zeros(wide)
    wanted = np.union1d(low, high)
    step = max(1, BAND // wide)
    for begin in range(0, n, step):
        down = np.cumsum(image[begin : begin + step], axis=0, dtype=np.float64) + acc
        acc = down[-1]
        for row in wanted[(wanted > begin) & (wanted <= begin + len(down))].tolist():
            sums[row] = down[row - begin - 1].copy()
    rows = np.stack([sums[a] + (sums[b] - sums[a]) * p for a, b, p in zip(low.tolist(), high.tolist(), part.tolist(), strict=True)])
    total = np.zeros((tall + 1, wide + 1))
    np.cumsum(rows, axis=1, out=total[:, 1:])
    low, high, part = _weights(wide, width)
    at = total[:, low] + (total[:, high] - total[:, low]) * part
    boxes = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return boxes * (height * width / (n * wide))


def grey(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 areas is darker than its right neighbour."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 65535).astype(image.dtype))
    return out.getvalue()


_TILE = [("height", pa.int32()), ("width", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string())]
_DIGEST = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def _cut(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most_bytes`` in a binary column, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most_bytes, "right")))
        yield batch.slice(i, j - i)
        i = j


def add_tiles(media: DataFrame, column: str = "media", side: int = TILE, digests: bool = False) -> DataFrame:
    """Adds height, width, tile (NPY bytes) and dhash to rows with a binary column; columns of these names are replaced.

    ``digests`` adds sums of the samples and of the stored bytes, and leaves these bytes out."""

    def row(data: bytes | None) -> tuple:
        image = decode(data)
        if image is None:
            return (None,) * (4 + 5 * digests)
        out = (*image.shape[:2], npy_tile(image, side), difference_hash(image))
        if digests:
            payload = image.tobytes()
            out += (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest())
        return out

    added = _TILE + _DIGEST * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _cut(whole, column)):
            rows = [row(x) for x in batch.column(column).to_pylist()]
            kept = [(k, c) for k, c in zip(batch.schema.names, batch.columns, strict=True) if not (digests and k == column)]
            new = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], *new], names=[*[k for k, _ in kept], *[k for k, _ in added]])

    own = media.drop(*[k for k, _ in added])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if not (digests and f.name == column)]
    return own.mapInArrow(run, ", ".join([*fields, *[f"{k} {_SQL[t]}" for k, t in added]]))


def store_texts(docs: DataFrame) -> DataFrame:
    """Texts as 8-bit greyscale images of 64 columns (zeros fill the last row), written as Parquet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            media, n_bytes = [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                rows = max(1, -(-len(raw) // WIDTH))
                media.append(encode_pgm(np.frombuffer(raw.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)))
                n_bytes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, n_bytes long, media binary"), "media")


def query(docs: DataFrame) -> DataFrame:
    """Tiles are written, as NPY bytes in a table in the shared folder, and their sums taken from what is read back."""
    found = materialize(add_tiles(store_texts(docs), digests=True), "tiles")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"))
