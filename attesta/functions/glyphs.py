"""Text as images that a machine reads: a font of cells, its printer and its reader.

A character of Latin-1 is a cell of six by eight pixels in which eight blocks of
two by two stand for the bits of its code; a space is empty. The reader is an
OCR engine for such images, as queries and tests need one where no trained
engine is at hand; it gives lines or words like the others.
"""

from __future__ import annotations

import numpy as np

WIDTH, HEIGHT, GAP = 6, 8, 4
_BITS = np.arange(8).reshape(1, 4, 1, 2)  # which bit each block stands for, by row and column within a cell


def printed(text: str) -> np.ndarray:
    """A grey page with the lines of the text; what isn't in Latin-1 is a question mark."""
    lines = [line.encode("latin-1", "replace") for line in text.split("\n")]
    wide = max(1, max(map(len, lines)))
    codes = np.frombuffer(b"".join(line.ljust(wide) for line in lines), np.uint8).reshape(len(lines), 1, wide, 1)
    blocks = (codes >> _BITS & 1 == 1) & (codes != 32)
    page = np.full((len(lines), HEIGHT + GAP, wide, WIDTH), 255, np.uint8)
    page[:, :HEIGHT, :, 1:5] = np.where(blocks.repeat(2, axis=1).repeat(2, axis=3), 0, 255)
    return page.reshape(len(lines) * (HEIGHT + GAP), wide * WIDTH)


def read_lines(page: np.ndarray) -> list[tuple[int, str, float]]:
    """(number, text, confidence) of the lines with ink; the confidence is how evenly the blocks are inked."""
    grey = page if page.ndim == 2 else page[:, :, 0]
    n, wide = len(grey) // (HEIGHT + GAP), grey.shape[1] // WIDTH
    if not n or not wide:
        return []
    cells = (grey[: n * (HEIGHT + GAP), : wide * WIDTH] < 128).reshape(n, HEIGHT + GAP, wide, WIDTH)
    ink = cells[:, :HEIGHT, :, 1:5].reshape(n, HEIGHT // 2, 2, wide, 2, 2).sum(axis=(2, 5), dtype=np.uint8)  # of four pixels
    codes = ((ink > 2) * (1 << _BITS)).sum(axis=(1, 3))
    texts, even = np.where(codes == 0, 32, codes).astype(np.uint8), np.abs(ink / 4 - 0.5) * 2
    read = [(i, texts[i].tobytes().decode("latin-1").rstrip()) for i in range(n)]
    return [(i, text, 100.0 * float(np.mean(even[i]))) for i, text in read if text]


def line_engine(page: np.ndarray) -> list[tuple[list[list[float]], str, float]]:
    """(polygon, text, confidence) of each line."""
    out = []
    for i, text, confidence in read_lines(page):
        x0 = float((len(text) - len(text.lstrip())) * WIDTH)
        y0, x1 = float(i * (HEIGHT + GAP)), float(len(text) * WIDTH)
        out.append(([[x0, y0], [x1, y0], [x1, y0 + HEIGHT], [x0, y0 + HEIGHT]], text.strip(), confidence / 100))
    return out


def word_engine(page: np.ndarray) -> list[tuple[str, list[int], float, int, int]]:
    """(text, box, confidence, line, block) of each word, and of each line a blank one with no confidence, as classic engines give."""
    out = []
    for i, text, confidence in read_lines(page):
        out.append(("", [0, i * (HEIGHT + GAP), len(text) * WIDTH, HEIGHT], -1.0, i, 0))
        at = 0
        for word in text.split(" "):
            if word:
                out.append((word, [at * WIDTH, i * (HEIGHT + GAP), len(word) * WIDTH, HEIGHT], confidence, i, 0))
            at += len(word) + 1
    return out
