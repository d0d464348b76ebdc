import numpy as np
import pyarrow as pa
import pytest

from attesta.functions import glyphs, images, tables


@pytest.mark.parametrize("text", ["Name: Jane Roe\nDOB: 01/02/1990", "", "  two  spaces ", "É à ÿ\n\nx", "~!@#"])
def test_glyphs_round_trip(text):
    page = glyphs.printed(text)
    assert [(i, t) for i, t, _ in glyphs.read_lines(page)] == [(i, line.rstrip()) for i, line in enumerate(text.split("\n")) if line.strip()]
    words = [w for w in glyphs.word_engine(page) if w[0]]
    assert [w[0] for w in words] == text.split()
    for word, (x, y, w, h), confidence, *_ in words:
        assert w == 6 * len(word) and (page[y : y + h, x : x + w] == 0).any() and confidence == 100.0
    grey = np.where(page == 0, 90, 200).astype(np.uint8)
    assert [t for _, t, _ in glyphs.read_lines(grey)] == [t for _, t, _ in glyphs.read_lines(page)]


def test_netpbm_pages():
    pages = [np.arange(6, dtype=np.uint8).reshape(2, 3), np.full((1, 2), 7, np.uint8)]
    stream = b"\n".join(b"P5\n# a remark\n%d %d\n255\n" % p.shape[::-1] + p.tobytes() for p in pages)
    got = list(tables.netpbm_pages(stream))
    assert [g[:, :, 0].tolist() for g in got] == [p.tolist() for p in pages]
    assert len(list(tables.netpbm_pages(images.encode(pages[0])))) == 1


def test_lateral(spark):
    page = glyphs.printed("ab c\nd")
    file = b"".join(b"P5 %d %d 255\n" % page.shape[::-1] + page.tobytes() for _ in range(2))
    d = spark.createDataFrame([("two", bytearray(file)), ("cut", bytearray(file[:-9])), ("bad", bytearray(b"GIF")), ("none", None)], "doc_id string, content binary")
    tables.register(spark)
    pages = spark.sql("SELECT d.doc_id, p.* FROM {d} d, LATERAL document_pages(d.content) p", d=d)
    assert sorted((r.doc_id, r.page, r.png is not None, r.width, r.error is None) for r in pages.collect()) == [("bad", 0, False, None, False), ("cut", 0, True, 24, True), ("cut", 1, False, None, False), ("two", 0, True, 24, True), ("two", 1, True, 24, True)]
    words = spark.sql("SELECT d.doc_id, p.page, w.* FROM {d} d, LATERAL document_pages(d.content) p, LATERAL ocr_tokens(p.png) w WHERE d.doc_id = 'two'", d=d)
    assert sorted((r.page, r.tok_id, r.text, tuple(r.bbox), r.line_num) for r in words.collect()) == [(p, i, t, b, n) for p in (0, 1) for i, t, b, n in ((0, "ab", (0, 0, 12, 8), 0), (1, "c", (18, 0, 6, 8), 0), (2, "d", (0, 12, 6, 8), 1))]


def test_engines_are_plugged_in(spark):
    def maker():
        seen = []  # made once in a worker, by a function that travels by value

        def engine(page):
            seen.append(page.shape)
            return [("x", [1, 2, 3, 4], 150.0, 0, 0), (" ", [0, 0, 1, 1], 50.0, 0, 0), ("low", [0, 0, 1, 1], -1.0, 0, 0), ("y ", [5, 6, 7, 8], 12.5, 1, 2)]

        return engine

    d = spark.createDataFrame([(bytearray(images.encode(np.zeros((2, 2), np.uint8))),)], "png binary")
    tables.register(spark, words=maker)
    got = spark.sql("SELECT w.* FROM {d} d, LATERAL ocr_tokens(d.png) w", d=d).collect()
    assert [(r.tok_id, r.text, list(r.bbox), r.confidence, r.line_num, r.block_num) for r in got] == [(0, "x", [1, 2, 3, 4], 100.0, 0, 0), (1, "y", [5, 6, 7, 8], 12.5, 1, 2)]
    tables.register(spark)


def test_batches_give_what_calls_give_and_stay_small(spark):
    tables.register(spark)
    page = glyphs.printed("ab c\nd")
    stream = b"".join(b"P5 %d %d 255\n" % page.shape[::-1] + page.tobytes() for _ in range(2))
    files = spark.createDataFrame([("x", bytearray(stream)), ("y", bytearray(stream + b"P5 9")), ("z", None)], "doc_id string, content binary")
    pages = tables.file_pages(files)
    assert sorted(pages.collect(), key=str) == sorted(spark.sql("SELECT f.doc_id, p.* FROM {f} f, LATERAL document_pages(f.content) p", f=files).collect(), key=str)
    assert [r.error is None for r in pages.where("doc_id = 'y'").orderBy("page").collect()] == [True, True, False]
    for over, name in ((tables.page_lines, "ocr_lines"), (tables.page_tokens, "ocr_tokens")):
        want = spark.sql(f"SELECT p.doc_id, p.page, o.* FROM {{p}} p, LATERAL {name}(p.png) o", p=pages)
        assert sorted(over(pages.select("doc_id", "page", "png")).collect(), key=str) == sorted(want.collect(), key=str)
    kind = pa.schema([("doc_id", pa.string()), ("png", pa.binary())])
    sent = list(tables.in_batches(((str(i), b"x" * 100_000) for i in range(1000)), kind))
    assert sum(len(b) for b in sent) == 1000 and max(b.nbytes for b in sent) < 2 * tables.SENT_BYTES
