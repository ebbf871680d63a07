"""Scanned pages: image bytes to run-length ink.

Files come from Spark's binary reader, or from any table with image bytes. A batch of images is decoded, scaled and thresholded where it lies, one
image at a time, and leaves as one row a page with its strokes, (y, x0, x1) with x1 behind the last inked pixel; no pixel becomes a row. Greys are 8 bits:
binary PGM and PPM, and PNG without interlacing.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A page's width, the step of the sample of greys, and the least and the share by which ink is darker than paper.
WIDTH, STEP = 1400, 4
INK_LEAST, INK_SHARE = 25, 0.40
# Strokes in a batch that a task hands on.
BATCH = 100_000
_STROKE = pa.struct([("y", pa.int32()), ("x0", pa.int32()), ("x1", pa.int32())])
_PAGE = pa.schema([("page_key", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("thresh", pa.int32()), ("strokes", pa.list_(_STROKE))])
_PAGE_DDL = "page_key long, w int, h int, thresh int, strokes array<struct<y:int,x0:int,x1:int>>"
_PACKED = pa.schema([*list(_PAGE)[:4], ("strokes", pa.binary())])


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """PNG's scan lines, each behind the number of its filter, as they were before it."""
    rows = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    if not rows[:, 0].any():
        return rows[:, 1:]
    out, above = np.empty((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y, row in enumerate(rows):
        kind, line = row[0], row[1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line += above
        elif kind in (3, 4):  # these depend on the byte before
            now, up = line.tolist(), above.tolist()
            for i in range(stride):
                a, b = now[i - step] if i >= step else 0, up[i]
                if kind == 3:
                    now[i] = (now[i] + (a + b) // 2) & 255
                else:
                    c = up[i - step] if i >= step else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    now[i] = (now[i] + (a if da <= db and da <= dc else b if db <= dc else c)) & 255
            line = np.array(now, np.uint8)
        elif kind:
            raise ValueError("no such filter")
        out[y] = above = line
    return out


def decode(data: bytes | None) -> np.ndarray | None:
    """Greys (rows, columns) of an image; None where the bytes hold none that is known."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            at, parts = 8, []
            while at < len(data):
                n, kind = struct.unpack(">I4s", data[at : at + 8])
                body = data[at + 8 : at + 8 + n]
                if kind == b"IHDR":
                    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
                elif kind == b"IDAT":
                    parts.append(body)
                at += 12 + n
            step = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
            if depth != 8 or interlaced or not w or not h:
                return None
            pixels = _unfiltered(zlib.decompress(b"".join(parts)), h, w * step, step).reshape(h, w, step)
            return _grey(pixels[:, :, :3] if step > 2 else pixels[:, :, :1])
        if head := re.match(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+255\s", data[:4096]):
            step, w, h = (3 if head[1] == b"6" else 1), int(head[2]), int(head[3])
            return _grey(np.frombuffer(data, np.uint8, w * h * step, head.end()).reshape(h, w, step)) if w and h else None
    except (KeyError, ValueError, TypeError, struct.error, zlib.error, UnboundLocalError):
        pass
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    return ((pixels.astype(np.uint32) @ np.array([19595, 38470, 7471], np.uint32) + 32768) >> 16).astype(np.uint8)  # the usual weights of colours


def scaled(grey: np.ndarray, width: int) -> np.ndarray:
    """To a width, by the mean of what falls on each pixel; height in proportion. The image itself where it has that width."""
    h, w = grey.shape
    if w == width:
        return grey
    height = max(1, round(h * width / w))

    def along(a: np.ndarray, n: int) -> np.ndarray:
        upto = np.vstack((np.zeros((1, a.shape[1])), np.cumsum(a, axis=0, dtype=float)))
        edges = np.linspace(0, len(a), n + 1)
        at = np.minimum(edges.astype(int), len(a) - 1)
        whole = upto[at] + (edges - at)[:, None] * a[at]
        return np.diff(whole, axis=0) / (len(a) / n)

    return np.floor(along(along(grey.astype(float), height).T, width).T + 0.5).astype(np.uint8)


def threshold(grey: np.ndarray) -> int:
    """The grey below which a pixel is ink: from every fourth pixel both ways, some way from the median, paper, to the twentieth, dark."""
    upto = np.cumsum(np.bincount(grey[::STEP, ::STEP].ravel(), minlength=256))  # greys are bytes: counted, not sorted
    paper, dark = (int(np.searchsorted(upto, upto[-1] // k, side="right")) for k in (2, 20))
    return paper - max(INK_LEAST, int(INK_SHARE * (paper - dark)))


def strokes(ink: np.ndarray) -> np.ndarray:
    """Runs of True along rows, as (y, x0, x1), in order."""
    ink = np.asarray(ink, bool)
    h, w = ink.shape
    if not w:
        return np.zeros((0, 3), np.int32)
    turns = np.empty((h, w + 1), bool)
    turns[:, 0], turns[:, w] = ink[:, 0], ink[:, -1]
    np.not_equal(ink[:, 1:], ink[:, :-1], out=turns[:, 1:w])
    at = np.flatnonzero(turns)
    found = np.empty((len(at) // 2, 3), np.int32)
    found[:, 0] = y = at[::2] // (w + 1)
    y *= w + 1
    found[:, 1], found[:, 2] = at[::2] - y, at[1::2] - y
    return found


def bitmap(found: np.ndarray, w: int, h: int) -> np.ndarray:
    """What ``strokes`` came from."""
    y, x0, x1 = found.T
    starts, ends = y.astype(np.int64) * w + x0, y.astype(np.int64) * w + x1
    if (starts >= ends).any() or (starts[1:] < ends[:-1]).any() or len(y) and (x0.min() < 0 or x1.max() > w):  # no runs in order: they are counted
        edges = np.zeros((h, w + 1), np.int8)
        np.add.at(edges, (y, x0), 1)
        np.add.at(edges, (y, x1), -1)
        return np.cumsum(edges, axis=1, dtype=np.int8)[:, :w] > 0
    bounds = np.empty(2 * len(y) + 2, np.int64)
    bounds[0], bounds[1:-1:2], bounds[2:-1:2], bounds[-1] = 0, starts, ends, h * w
    inked = np.zeros(len(bounds) - 1, bool)
    inked[1::2] = True
    return np.repeat(inked, np.diff(bounds)).reshape(h, w)


def packed(found: np.ndarray) -> bytes:
    """Strokes as bytes, in whole columns, compressed: a row of a word has the strokes of the row above it, so these are a small part of the array's."""
    return pa.compress(np.ascontiguousarray(np.diff(found, axis=0, prepend=0).T, np.int32).tobytes(), "zstd", asbytes=True) + struct.pack("<q", len(found))


def stroke_rows(value: pa.Scalar) -> np.ndarray:
    """(y, x0, x1) of a page's strokes as Arrow gives them, packed or as an array."""
    if pa.types.is_binary(value.type):
        data = value.as_py()
        (n,) = struct.unpack("<q", data[-8:])
        flat = np.frombuffer(pa.decompress(data[:-8], 12 * n, "zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)
        return np.cumsum(flat.reshape(3, n), axis=1, dtype=np.int32).T
    flat = value.values
    return np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1) if len(flat) else np.zeros((0, 3), np.int32)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, image) of the files of a folder, at any depth."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("image"))


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes | None]]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.column(0)[k].as_py(), b.column(1)[k].as_py()


def inked(pages: Iterable[tuple[int | None, bytes | None]], width: int | None, most: int = BATCH, pack: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` strokes; the pixels of one page are held at a time."""
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        if pack:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED.types)], schema=_PACKED)
        none = [r[4] is None for r in rows]
        found = [r[4] for r in rows if r[4] is not None]
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int32)
        flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], names=["y", "x0", "x1"])
        ends = np.concatenate(([0], np.cumsum([0 if r[4] is None else len(r[4]) for r in rows]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(none))
        return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], t) for i, t in enumerate(_PAGE.types[:4])], lists], schema=_PAGE)

    for key, data in pages:
        grey = decode(data)
        if grey is None:
            rows.append((key, None, None, None, None))
        else:
            grey = scaled(grey, width) if width else grey
            thresh = threshold(grey)
            found = strokes(grey < thresh)
            rows.append((key, grey.shape[1], grey.shape[0], thresh, packed(found) if pack else found))
            size += len(found)
        if size >= most or len(rows) >= most // 100:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def ink_pages(images: DataFrame, width: int | None = WIDTH, draw: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int | None, bytes | None]]] | None = None, pack: bool = False) -> DataFrame:
    """(page_key, image) to (page_key, w, h, thresh, strokes), scaled to ``width`` where it is given.

    Bytes that are null or no known image give a row of nulls, so that no page goes missing. Other columns are not read.
    ``draw`` makes the images, one at a time, from rows of any columns: they are read where they are made, and no batch of them is held.
    With ``pack`` a page's strokes are bytes, for tables that are written, moved and read again: every operator on strokes takes either."""
    rows = images if draw else images.select(F.col("page_key").cast("long").alias("page_key"), F.col("image").cast("binary").alias("image"))
    return rows.mapInArrow(lambda batches: inked((draw or _given)(batches), width, pack=pack), _PAGE_DDL.split(", strokes")[0] + ", strokes binary" if pack else _PAGE_DDL)


def crops(images: DataFrame, width: int | None = None) -> DataFrame:
    """(image, x, y, w, h, ...) with ``crop``: the box as a PGM, cut to the image and scaled to ``width`` where it is given; null where nothing is left.

    A table of boxes on its page's image is a crop source for readers, without a server between."""

    def cut(image, x, y, w, h):
        import pandas as pd

        out = []
        for data, *box in zip(image, x, y, w, h):
            grey = decode(data) if data is not None and not any(v is None or v != v for v in box) else None
            if grey is not None:
                a, b, c, d = map(int, box)
                grey = grey[max(0, b) : max(0, b + d), max(0, a) : max(0, a + c)]
            out.append(None if grey is None or not grey.size else pgm(scaled(grey, width) if width else grey))
        return pd.Series(out, dtype=object)

    return images.withColumn("crop", F.pandas_udf(cut, "binary")("image", "x", "y", "w", "h"))


def pgm(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.ascontiguousarray(grey, np.uint8).tobytes()


def png(grey: np.ndarray) -> bytes:
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.pad(grey.astype(np.uint8), ((0, 0), (1, 0))).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 1)) + part(b"IEND", b"")
