import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from attesta.sources import files as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    S.register(spark)
    top = tmp_path_factory.mktemp("files")
    (top / "docs/deep").mkdir(parents=True)
    (top / "docs/a.png").write_bytes(b"A")
    (top / "docs/deep/b.PDF").write_bytes(b"B")
    (top / "docs/note.txt").write_bytes(b"no document")
    with zipfile.ZipFile(top / "docs/z.zip", "w") as z:
        z.writestr("in/c.png", b"C" * 3000)
        z.writestr("readme", b"no")
    with tarfile.open(top / "docs/t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("d.jpg")
        info.size = 2
        t.addfile(info, io.BytesIO(b"DD"))
    return top


def test_folder_and_archives(spark, folder):
    d = spark.read.format("attesta_documents").load(str(folder / "docs"))
    got = {(r.doc_id, r.path.removeprefix(str(folder)), bytes(r.content)) for r in d.collect()}
    assert got == {("a", "/docs/a.png", b"A"), ("b", "/docs/deep/b.PDF", b"B"), ("c", "/docs/z.zip!in/c.png", b"C" * 3000), ("d", "/docs/t.tar.gz!d.jpg", b"DD")}
    assert d.where("doc_id = 'c'").count() == 1 and d.where("doc_id IN ('a', 'd', 'x')").count() == 2
    names = spark.read.format("attesta_documents").option("content", "false").load(str(folder / "docs"))
    assert names.where("content IS NULL").count() == 4


@pytest.mark.parametrize("lines", [False, True])
def test_manifest_in_slices(spark, folder, lines):
    entries = [{"document_path": str(folder / "docs/a.png"), "back_document_path": f"{folder}/docs/z.zip!in/c.png", "submitted": {"name": "x", "dob": None}}, {"document_path": "/gone.png", "back_document_path": "/gone.png"}, {"document_path": f"{folder}/docs/t.tar.gz!d.jpg"}, {"document_path": f"{folder}/docs/t.tar.gz!missing.jpg"}]
    path = folder / f"m{lines}.json"
    path.write_text("\n".join(map(json.dumps, entries)) + "\n\n" if lines else json.dumps(entries))
    for size in (1 << 20, 37, 1):
        d = spark.read.format("attesta_documents").option("manifest", str(path)).option("sliceBytes", size).load()
        got = sorted((r.doc_id, r.side, bytes(r.content)[:2], r.submitted) for r in d.collect())
        assert got == [("a", "back", b"CC", None), ("a", "front", b"A", {"name": "x", "dob": None}), ("d", "front", b"DD", {})]
    plan = d.where("doc_id = 'd' AND side = 'front'")
    assert [r.doc_id for r in plan.collect()] == ["d"]


def test_filters_keep_other_documents_closed(spark, folder):
    (folder / "p.json").write_text(json.dumps([{"document_path": str(folder / "docs/a.png"), "back_document_path": "/no/such/back.png"}, {"document_path": str(folder / "docs/deep/b.PDF")}]))
    d = spark.read.format("attesta_documents").option("manifest", str(folder / "p.json")).load()
    with pytest.raises(Exception, match="back.png"):
        d.collect()
    assert [bytes(r.content) for r in d.where("doc_id = 'b'").collect()] == [b"B"]  # the broken one isn't opened
    assert [bytes(r.content) for r in d.where(F.col("side") == "front").orderBy("doc_id").collect()] == [b"A", b"B"]


def test_options(spark, folder):
    (folder / "none.json").write_text("")
    assert spark.read.format("attesta_documents").option("manifest", str(folder / "none.json")).load().count() == 0
    with pytest.raises(Exception, match="either"):
        spark.read.format("attesta_documents").load().count()
    assert [S.stem(x) for x in ("/a/b.c.png", "x", ".png", "t.tar!d/e.jpg", "c:\\a\\f.png")] == ["b.c", "x", ".png", "e", "f"]
