"""Image kernels in numpy, and the Arrow step that runs them over files.

Decoding is built in for PNG (8 bits, not interlaced) and PNM; other formats,
and pages of PDFs, come through a decoder that the caller passes in.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of preprocessing.
DPI, LONGEST_SKEW, MEDIAN, BLOCK, OFFSET = 300, 45.0, 3, 21, 11
Decoder = Callable[[bytes, int], np.ndarray]


def decode(content: bytes, page: int = 0) -> np.ndarray:
    """RGB array (height, width, 3) of a PNG or PNM file. ValueError for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(content)
    if content[:2] in (b"P5", b"P6"):
        return netpbm(content)[0]
    raise ValueError("unknown image format: pass a decoder")


def netpbm(content: bytes) -> tuple[np.ndarray, int]:
    """The first image of a binary PGM or PPM stream, and how many bytes it takes."""
    parts, at = [], 2
    while len(parts) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        parts.append(int(content[at:end]))
        at = end
    w, h, _ = parts
    planes = 1 if content[:2] == b"P5" else 3
    pixels = np.frombuffer(content, np.uint8, w * h * planes, at + 1).reshape(h, w, planes)
    return np.repeat(pixels, 3, axis=2) if planes == 1 else pixels.copy(), at + 1 + w * h * planes


def _png(content: bytes) -> np.ndarray:
    at, data, palette = 8, b"", None
    width = height = kind = 0
    while at < len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or laced:
                raise ValueError("only PNG of 8 bits, not interlaced: pass a decoder")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data += body
        at += size + 12
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width * planes + 1)
    out = raw[:, 1:] if not raw[:, 0].any() else np.zeros((height, width * planes), np.uint8)
    above = np.zeros(width * planes, np.int32)
    for y in range(height) if raw[:, 0].any() else ():  # lines that aren't filtered stand there as they are
        rule, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if rule == 2:
            line = line + above
        elif rule == 1:
            line = np.cumsum(line.reshape(width, planes), axis=0).ravel()
        elif rule in (3, 4):  # each value needs the one before it
            v, up = line.tolist(), above.tolist()
            for x in range(len(v)):
                left, corner = (v[x - planes], up[x - planes]) if x >= planes else (0, 0)
                if rule == 3:
                    near = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    near = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                v[x] = (v[x] + near) & 255
            line = np.array(v, np.int32)
        above = line & 255
        out[y] = above
    pixels = out.reshape(height, width, planes)
    if kind == 3:
        return palette[pixels[:, :, 0]]
    if planes in (1, 2):
        return np.repeat(pixels[:, :, :1], 3, axis=2)
    return pixels[:, :, :3].copy()


def encode(image: np.ndarray) -> bytes:
    """PNG of a gray or RGB array."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1).astype(np.uint8)], axis=1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The level that splits a gray image into two classes that lie furthest apart."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(n), np.cumsum(n * np.arange(256))
    rest = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * rest * (sums / below - (sums[-1] - sums) / rest) ** 2
    return int(np.nan_to_num(between).argmax())


def _windows(image: np.ndarray, height: int, width: int) -> np.ndarray:
    top, left = height // 2, width // 2
    padded = np.pad(image, ((top, height - 1 - top), (left, width - 1 - left)), mode="edge")
    return np.lib.stride_tricks.sliding_window_view(padded, (height, width))


def median(image: np.ndarray, size: int = MEDIAN) -> np.ndarray:
    """Median of a square of odd size (an even one is made odd)."""
    size += size % 2 == 0
    out, padded = np.empty_like(image), np.pad(image, size // 2, mode="edge")
    for y in range(0, len(image), 64):  # the windows of a strip of rows at a time
        part = padded[y : y + 63 + size]
        out[y : y + 64] = np.median(np.lib.stride_tricks.sliding_window_view(part, (size, size)), axis=(2, 3))
    return out


def bilateral(image: np.ndarray, size: int = 7, color: float = 75.0, space: float = 75.0) -> np.ndarray:
    """Mean of a neighbourhood, weighted by nearness in place and in value."""
    h, w = image.shape
    half, plain = size // 2, image.astype(np.float32)
    padded = np.pad(plain, half, mode="edge")
    total, over = np.zeros_like(plain), np.zeros_like(plain)
    for i in range(size):  # one shift at a time: a page is held a few times, not once for every neighbour
        for j in range(size):
            near = padded[i : i + h, j : j + w]
            weight = np.exp(-((near - plain) ** 2) / (2 * color**2)) * np.float32(np.exp(-((i - half) ** 2 + (j - half) ** 2) / (2 * space**2)))
            total += weight * near
            over += weight
    return np.rint(total / over).astype(np.uint8)


def threshold(image: np.ndarray, adaptive: bool = True, block: int = BLOCK, offset: int = OFFSET) -> np.ndarray:
    """Black and white: against a Gaussian mean of the neighbourhood less an offset, or one level for all."""
    if not adaptive:
        return np.where(image > otsu(image), 255, 0).astype(np.uint8)
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(block) - block // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    rows = np.einsum("ijkl,l->ij", _windows(image.astype(np.float64), 1, block), k)
    mean = np.einsum("ijkl,k->ij", _windows(rows, block, 1), k)
    return np.where(image > np.rint(mean) - offset, 255, 0).astype(np.uint8)


def _outline(ink: np.ndarray) -> np.ndarray:
    """The first and the last inked place (x, y) of each row: no other can be a corner of the hull."""
    rows = np.flatnonzero(ink.any(axis=1))
    first, last = ink[rows].argmax(axis=1), ink.shape[1] - 1 - ink[rows, ::-1].argmax(axis=1)
    return np.stack([np.concatenate([first, last]), np.concatenate([rows, rows])], 1)


def _hull(points: np.ndarray) -> np.ndarray:
    p = sorted(map(tuple, points.tolist()))

    def half(points):
        out: list[tuple] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def skew_angle(image: np.ndarray, longest: float = LONGEST_SKEW) -> float:
    """The turn, in degrees, that straightens the ink: by the smallest rectangle around what is darker than Otsu's level.

    Ink is spread to the sides so that words run together. Under 100 inked
    pixels, under a fifth of a degree or beyond ``longest`` it is 0.
    """
    g = gray(image)
    ink = g <= otsu(g)
    ink = _windows(_windows(ink, 1, 25).max(axis=(2, 3)), 3, 1).max(axis=(2, 3))
    if np.count_nonzero(ink) < 100:
        return 0.0
    hull = _hull(_outline(ink))
    edges = np.diff(np.concatenate([hull, hull[:1]]), axis=0)
    best = (np.inf, 0.0)
    for a in np.unique(np.mod(np.arctan2(edges[:, 1], edges[:, 0]), np.pi / 2)):
        turned = hull @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        area = float(np.prod(np.ptp(turned, axis=0)))
        if area < best[0] - 1e-9:
            best = (area, float(np.degrees(a)))
    angle = best[1] - 90 if best[1] > 45 else best[1]
    return 0.0 if abs(angle) < 0.2 or abs(angle) > longest else angle


def rotate(image: np.ndarray, angle: float, fill: int = 255) -> np.ndarray:
    """Turned by ``angle`` degrees, so that content sloping by it becomes level, on a canvas that holds all of it."""
    if abs(angle) < 0.01:
        return image.copy()
    h, w = image.shape[:2]
    a = np.radians(angle)
    c, s = np.cos(a), np.sin(a)
    W, H = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    yy, xx = np.mgrid[0:H, 0:W].astype(np.float64)
    dx, dy = xx - (W - 1) / 2, yy - (H - 1) / 2
    x, y = c * dx - s * dy + (w - 1) / 2, s * dx + c * dy + (h - 1) / 2
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    padded = np.pad(image.astype(np.float32), ((2, 2), (2, 2)) + ((0, 0),) * (image.ndim - 2), constant_values=fill)
    column = [np.clip(x0 + i + 1, 0, w + 3) for i in range(4)]
    wide = lambda weight: weight if image.ndim == 2 else weight[:, :, None]
    across, down = [[wide(k.astype(np.float32)) for k in _cubic(t)] for t in (x - x0, y - y0)]
    out = np.zeros((H, W) + image.shape[2:], np.float32)
    for j in range(4):  # one row of neighbours at a time
        row = np.clip(y0 + j + 1, 0, h + 3)
        out += down[j] * sum(across[i] * padded[row, column[i]] for i in range(4))
    return np.rint(np.clip(out, 0, 255)).astype(np.uint8)


#: How sharp cubic interpolation is (fixed value).
_SHARP = -0.75


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the neighbours at -1, 0, 1 and 2 of a place ``t`` behind the second."""
    near = lambda d: ((_SHARP + 2) * d - (_SHARP + 3)) * d * d + 1
    far = lambda d: ((_SHARP * d - 5 * _SHARP) * d + 8 * _SHARP) * d - 4 * _SHARP
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def crop(image: np.ndarray, bbox: list[int], padding: int = 4) -> np.ndarray | None:
    x, y, w, h = bbox if len(bbox) == 4 else (0, 0, 0, 0)
    if w <= 0 or h <= 0:
        return None
    part = image[max(0, y - padding) : y + h + padding, max(0, x - padding) : x + w + padding]
    return part if part.size else None


#: Colours of boxes by status.
COLORS = {"match": (34, 197, 94), "partial_match": (245, 158, 11), "mismatch": (239, 68, 68), "missing": (148, 163, 184)}


def draw_boxes(image: np.ndarray, boxes: list[tuple[list[int], str]], width: int = 2) -> np.ndarray:
    """A copy with a frame around every box of positive size, in the colour of its status."""
    out = image.copy()
    for (x, y, w, h), status in ((b, s) for b, s in boxes if len(b) == 4 and b[2] > 0 and b[3] > 0):
        color = COLORS.get(status, (59, 130, 246))
        x0, y0 = max(0, x), max(0, y)
        for d in range(width):
            out[y0 + d : y0 + d + 1, x0 : x + w] = color
            out[max(y0, y + h - 1 - d) : y + h - d, x0 : x + w] = color
            out[y0 : y + h, x0 + d : x0 + d + 1] = color
            out[y0 : y + h, max(x0, x + w - 1 - d) : x + w - d] = color
    return out


def process(image: np.ndarray, deskew: bool = True, adaptive: bool = True, kernel: int = MEDIAN) -> tuple[float, np.ndarray, np.ndarray]:
    """(skew angle, straightened image, black-and-white image): all steps in one pass."""
    angle = skew_angle(image) if deskew else 0.0
    level = rotate(image, angle)
    return angle, level, threshold(median(bilateral(gray(level)), kernel), adaptive)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


SCHEMA = "doc_id string, side string, skew_angle double, width int, height int, color_png binary, png binary, error string"


def preprocess(documents: DataFrame, decoder: Decoder = decode, page: int = 0, keep: bool = False, **options) -> DataFrame:
    """Every file's image made level and black and white; a file that can't be read has ``error`` and no image.

    ``keep`` adds the file's own ``content``.
    """
    schema = SCHEMA + ", content binary" if keep else SCHEMA

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d in batch.itertuples():  # one image in memory at a time
                try:
                    angle, level, done = process(decoder(d.content, page), **options)
                    row = (d.doc_id, d.side, angle, done.shape[1], done.shape[0], encode(level), encode(done), None)
                except (ValueError, IndexError, KeyError, TypeError, zlib.error, struct.error) as e:
                    row = (d.doc_id, d.side, None, None, None, None, None, str(e))
                yield pd.DataFrame([(*row, d.content) if keep else row], columns=_names(schema))

    return documents.select("doc_id", "side", "content").mapInPandas(rows, schema)


PAGES = "doc_id string, side string, page int, png binary, error string"


def pages(documents: DataFrame, decoder: Callable[[bytes], Iterable[np.ndarray]]) -> DataFrame:
    """(doc_id, side, page, png, error): every page of files (doc_id, side, content) that hold several.

    ``decoder`` gives the pages of a file one after the other, so one page is in
    memory at a time. Where it fails, a row with ``error`` and no image follows
    the pages that it gave; null content fails at once.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d in batch.itertuples():
                at = 0
                try:
                    if d.content is None:
                        raise ValueError("no content")
                    for image in decoder(d.content):
                        yield pd.DataFrame([(d.doc_id, d.side, at, encode(image), None)], columns=_names(PAGES))
                        at += 1
                except (ValueError, IndexError, KeyError, OSError, zlib.error, struct.error) as e:
                    yield pd.DataFrame([(d.doc_id, d.side, at, None, str(e))], columns=_names(PAGES))

    return documents.select("doc_id", "side", "content").mapInPandas(rows, PAGES)


ARTEFACTS = "doc_id string, side string, kind string, field_name string, path string, png binary"


def artefacts(images: DataFrame, merged: DataFrame, decoder: Decoder = decode, padding: int = 4) -> DataFrame:
    """Annotated images and crops: (doc_id, side, kind, field_name, path, png), kind ``annotated`` or ``crop``.

    ``images``: (doc_id, side, png), one per side, in the pixels that the boxes
    are given in. ``merged``: matches, one per document and field; each goes to
    the image of its ``doc_side``. Every image that can be read is annotated, also
    without boxes; a field that is missing or lies outside the image has no crop.
    An image that can't be read gives no row. Rows stay rows of one table under
    their ``path``: millions of small files would burden the file system.
    """
    boxes = merged.where("status <> 'missing'").groupBy("doc_id", F.col("doc_side").alias("side"))  # five fields at most
    boxes = boxes.agg(F.array_sort(F.collect_list(F.struct("field_name", "bbox", "status"))).alias("boxes"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d in batch.itertuples():
                try:
                    image = decoder(d.png, 0)
                except (ValueError, IndexError, KeyError, TypeError, zlib.error, struct.error):
                    continue
                found = [(b["field_name"], [int(v) for v in b["bbox"]], b["status"]) for b in (d.boxes if d.boxes is not None else ())]
                out = [(d.doc_id, d.side, "annotated", None, f"{d.doc_id}/{d.side}/annotated.png", encode(draw_boxes(image, [(box, status) for _, box, status in found])))]
                for field, box, _ in found:
                    part = crop(image, box, padding)
                    if part is not None:
                        out.append((d.doc_id, d.side, "crop", field, f"{d.doc_id}/{d.side}/crops/{field}.png", encode(part)))
                yield pd.DataFrame(out, columns=_names(ARTEFACTS))

    return images.select("doc_id", "side", "png").join(boxes, ["doc_id", "side"], "left").mapInPandas(rows, ARTEFACTS)


def artefact_paths(made: DataFrame) -> DataFrame:
    """(doc_id, annotated_front_path, annotated_back_path, crops_dir) for the records; what isn't there is empty."""
    of = lambda side: F.coalesce(F.max(F.when((F.col("kind") == "annotated") & (F.col("side") == side), F.col("path"))), F.lit(""))
    crops = F.when(F.bool_or(F.col("kind") == "crop"), F.concat("doc_id", F.lit("/"))).otherwise(F.lit(""))
    return made.groupBy("doc_id").agg(of("front").alias("annotated_front_path"), of("back").alias("annotated_back_path"), crops.alias("crops_dir"))
