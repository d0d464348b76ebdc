import json
import zlib

import numpy as np
import pytest

from attesta.functions import images as I
from attesta.service import VerificationService


def page(angle=0.0):
    image = np.full((160, 300), 255, np.uint8)
    for y in range(30, 130, 20):
        image[y : y + 8, 40:260] = 0
    return I.rotate(image, angle)


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(0)
    for shape in ((7, 5), (7, 5, 3)):
        a = rng.integers(0, 256, shape, np.uint8)
        got = I.decode(I.encode(a))
        assert np.array_equal(got, a if a.ndim == 3 else np.repeat(a[:, :, None], 3, axis=2))
    a = rng.integers(0, 256, (5, 4, 3), np.uint8).astype(int)
    raw = b""
    for y, rule in enumerate(range(5)):  # one line for each filter
        line = []
        for x in range(4):
            for p in range(3):
                left, up, corner = (a[y, x - 1, p] if x else 0), (a[y - 1, x, p] if y else 0), (a[y - 1, x - 1, p] if x and y else 0)
                e = left + up - corner
                paeth = min(((abs(e - v), i, v) for i, v in enumerate((left, up, corner))))[2]
                line.append((a[y, x, p] - [0, left, up, (left + up) // 2, paeth][rule]) % 256)
        raw += bytes([rule, *line])
    png = I.encode(a.astype(np.uint8))
    head = png[: png.index(b"IDAT") - 4]
    body = zlib.compress(raw)
    import struct

    png = head + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + png[png.index(b"IEND") - 4 :]
    assert np.array_equal(I.decode(png), a)
    assert I.decode(b"P5 2 1 255\n\x00\x09").tolist() == [[[0, 0, 0], [9, 9, 9]]]
    with pytest.raises(ValueError):
        I.decode(b"GIF")


@pytest.mark.parametrize("angle", [-8.0, 4.5])
def test_skew_is_found_and_undone(angle):
    turned = page(angle)
    back = I.skew_angle(turned)
    assert back == pytest.approx(-angle, abs=1.0)
    assert abs(I.skew_angle(I.rotate(turned, back))) < 1.0
    assert I.skew_angle(page()) == 0.0 and I.skew_angle(np.full((20, 20), 255, np.uint8)) == 0.0


def test_kernels():
    g = page()
    assert set(np.unique(I.threshold(g))) == {0, 255} and set(np.unique(I.threshold(g, adaptive=False))) == {0, 255} and 0 <= I.otsu(g) < 255
    noisy = g.copy()
    noisy[5, 5] = 0
    assert I.median(noisy, 2)[5, 5] == 255 and I.bilateral(g).shape == g.shape
    assert I.crop(g, [290, 150, 50, 50], 4).shape == (14, 14) and I.crop(g, [0, 0, 0, 5]) is None and I.crop(g, [900, 0, 5, 5]) is None
    color = np.repeat(g[:, :, None], 3, axis=2)
    boxed = I.draw_boxes(color, [([10, 10, 20, 10], "mismatch"), ([1, 2], "match"), ([0, 0, 0, 0], "match")])
    assert tuple(boxed[10, 15]) == I.COLORS["mismatch"] and (boxed != color).any(axis=2).sum() < 20 * 10


def test_strips_and_shifts_are_the_whole_window():
    g = np.random.default_rng(1).integers(0, 256, (150, 31), np.uint8)
    w = np.lib.stride_tricks.sliding_window_view(np.pad(g, 1, mode="edge"), (3, 3))
    assert np.array_equal(I.median(g), np.median(w, axis=(2, 3)).astype(np.uint8))
    w = np.lib.stride_tricks.sliding_window_view(np.pad(g.astype(float), 3, mode="edge"), (7, 7))
    d = np.arange(7) - 3
    weight = np.exp(-((w - g[:, :, None, None]) ** 2) / (2 * 75.0**2)) * np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (2 * 75.0**2))
    assert np.abs(I.bilateral(g) - (w * weight).sum(axis=(2, 3)) / weight.sum(axis=(2, 3))).max() <= 0.51


def test_pages(spark):
    def two(content):
        if content == b"bad":
            raise ValueError("no pages")
        yield np.zeros((2, 3), np.uint8)
        yield np.full((2, 3), 9, np.uint8)
        if content == b"cut":
            raise OSError("cut off")

    d = spark.createDataFrame([("a", "front", bytearray(b"ok")), ("b", "front", bytearray(b"bad")), ("c", "back", bytearray(b"cut")), ("d", "front", None)], "doc_id string, side string, content binary")
    got = sorted((r.doc_id, r.page, r.png is not None, r.error) for r in I.pages(d, two).collect())
    assert got == [("a", 0, True, None), ("a", 1, True, None), ("b", 0, False, "no pages"), ("c", 0, True, None), ("c", 1, True, None), ("c", 2, False, "cut off"), ("d", 0, False, "no content")]


def test_artefacts(spark):
    png = bytearray(I.encode(page()))
    images = spark.createDataFrame([("a", "front", png), ("a", "back", png), ("b", "front", bytearray(b"broken")), ("c", "front", None)], "doc_id string, side string, png binary")
    merged = spark.createDataFrame(
        [("a", "name", "front", "match", [10, 10, 20, 10]), ("a", "address", "back", "mismatch", [900, 0, 5, 5]), ("a", "dob", "front", "missing", [0, 0, 0, 0]), ("b", "name", "front", "match", [1, 1, 5, 5])],
        "doc_id string, field_name string, doc_side string, status string, bbox array<int>",
    )
    made = I.artefacts(images, merged)
    got = {r.path: r for r in made.collect()}
    assert sorted(got) == ["a/back/annotated.png", "a/front/annotated.png", "a/front/crops/name.png"]
    assert I.decode(bytes(got["a/front/crops/name.png"].png)).shape == (18, 28, 3)
    assert tuple(I.decode(bytes(got["a/front/annotated.png"].png))[10, 15]) == I.COLORS["match"]
    assert [tuple(r) for r in I.artefact_paths(made).collect()] == [("a", "a/front/annotated.png", "a/back/annotated.png", "a/")]
    assert I.artefacts(images.limit(0), merged).count() == 0


def test_preprocess(spark):
    d = spark.createDataFrame([("a", "front", bytearray(I.encode(page(4.5)))), ("b", "front", bytearray(b"broken"))], "doc_id string, side string, content binary")
    got = {r.doc_id: r for r in I.preprocess(d).collect()}
    assert got["a"].skew_angle == pytest.approx(-4.5, abs=1.0) and got["a"].error is None and I.decode(bytes(got["a"].png)).shape[:2] == (got["a"].height, got["a"].width)
    assert got["b"].error and got["b"].png is None


def test_service(spark, tmp_path):
    def reader():  # local, so that it travels to the workers by value
        return lambda content, page: [([[0, 20 * i], [200, 20 * i + 16]], line, 0.9) for i, line in enumerate(content.decode().split("\n"))]

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "p1.png").write_text("Name: Jane Roe\nDOB: 01/02/1990\nDoc ID: ABCDE1234F")
    (docs / "p1b.png").write_text("Address: 5 Hill Road, Old Town 110001")
    entries = [{"document_path": str(docs / "p1.png"), "back_document_path": str(docs / "p1b.png"), "submitted": {"name": "Jane Roe", "dob": "1990-02-01", "address": "5 Hill Road, Old Town 110001"}}, {"document_path": str(docs / "gone.png"), "submitted": {}}]
    (tmp_path / "m.json").write_text(json.dumps(entries))
    service = VerificationService(spark, str(tmp_path / "store"), engine=reader)
    run = service.verify_batch(str(tmp_path / "m.json"))
    assert [(r.doc_id, r.tier) for r in run.verdicts.collect()] == [("p1", "HIGH")]
    page = service.list_records(search="jane")
    assert page["count"] == 1 and page["records"][0]["has_back_document"] and service.health() == {"status": "ok"}
    record = page["records"][0]["id"]
    assert service.get_record(record)["applicant_name"] == "Jane Roe" and service.stats()["total_records"] == 1
    assert service.delete_record(record) and not service.delete_record(record) and service.get_record(record) is None
    (tmp_path / "none.json").write_text("[]")
    assert service.verify_batch(str(tmp_path / "none.json")).verdicts.count() == 0
    with pytest.raises(ValueError):
        VerificationService(spark, str(tmp_path / "other"), reads="grey")
    files = spark.createDataFrame([("x", "front", bytearray(I.encode(np.full((40, 60, 3), 120, np.uint8)))), ("y", "front", bytearray(b"%PDF"))], "doc_id string, side string, content binary")
    for reads, planes in (("color", 3), ("binary", 1)):  # the engine gets the level image, and a file that isn't one as it came
        level = {r.doc_id: bytes(r.content) for r in VerificationService(spark, str(tmp_path / "store"), reads=reads).level(files).collect()}
        assert level["y"] == b"%PDF" and level["x"][25] == (2 if planes == 3 else 0)
    with pytest.raises(RuntimeError):
        VerificationService(spark, str(tmp_path / "other")).tokens(run.forms)


def test_outline_has_the_hull_of_all_ink():
    rng = np.random.default_rng(2)
    for _ in range(50):
        ink = rng.random((rng.integers(2, 30), rng.integers(2, 30))) < 0.2
        if np.count_nonzero(ink) > 2:
            y, x = np.nonzero(ink)
            assert sorted(map(tuple, I._hull(I._outline(ink)))) == sorted(map(tuple, I._hull(np.stack([x, y], 1))))


def test_cubic_rotation():
    assert [np.round(w, 6).tolist() for w in I._cubic(np.array([0.0]))] == [[0.0], [1.0], [0.0], [0.0]]
    assert np.allclose(sum(I._cubic(np.linspace(0, 1, 11))), 1.0)
    y, x = np.mgrid[0:80, 0:120]
    smooth = (127 + 100 * np.sin(x / 9.0) * np.cos(y / 7.0)).astype(np.uint8)
    back = I.rotate(I.rotate(smooth, 7.0), -7.0)
    top, left = (back.shape[0] - 80) // 2, (back.shape[1] - 120) // 2
    inner = np.abs(back[top : top + 80, left : left + 120].astype(int) - smooth)[15:-15, 15:-15]
    assert inner.mean() < 3  # cubic: a smooth image comes back as it was, but for the canvas' fraction of a pixel
    assert np.array_equal(I.rotate(np.full((30, 40, 3), 255, np.uint8), 12.0), np.full(I.rotate(np.full((30, 40, 3), 255, np.uint8), 12.0).shape, 255))
    assert I.rotate(smooth, 90.0).shape == (120, 80) or I.rotate(smooth, 90.0).shape == (119, 80) or I.rotate(smooth, 90.0).shape == (120, 79)
