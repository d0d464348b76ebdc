import datetime
import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import views
from attesta.plans.verification import verify
from attesta.sources import documents as D
from attesta.sources import records as R
from attesta.streaming import ingest


def test_store(spark, tmp_path):
    store = R.RecordStore(spark, str(tmp_path)).create()
    assert store.stats()["total_records"] == 0 and store.stats()["tier_breakdown"] == {}
    t = datetime.datetime(2024, 5, 1, 12)
    rows = spark.createDataFrame([("r1", t, "Ann O_e", "HIGH", 96.25, '{"a": 1}'), ("r2", t, "Bob", "LOW", 10.0, "not json"), ("r3", t + datetime.timedelta(1), "annie", None, None, None)], "id string, timestamp timestamp_ntz, applicant_name string, tier string, overall_score double, audit_json string")
    assert {r.id for r in store.save(rows).collect()} == {"r1", "r2", "r3"}
    assert store.stats()["tier_breakdown"] == {"HIGH": 1, "LOW": 1, "UNKNOWN": 1}
    assert [r.id for r in store.list().collect()] == ["r3", "r1", "r2"]
    assert [r.id for r in store.list(search="ANN").collect()] == ["r3", "r1"] and [r.id for r in store.list(tier="low").collect()] == ["r2"] and store.list(tier="all", search=" ").count() == 3
    assert [r.id for r in store.list(search="o%e").collect()] == ["r1"] and [r.id for r in store.list(limit=1, offset=1).collect()] == ["r1"]
    got = {r.id: r for r in store.list().select("id", "audit_json", F.expr("variant_get(audit, '$.a', 'int')").alias("a")).collect()}
    assert got["r1"].a == 1 and got["r2"].a is None and got["r2"].audit_json == "not json" and got["r3"].audit_json == "{}"
    assert store.get("r3").first().overall_score == 0.0 and store.get("zz").isEmpty()
    seen = []
    assert store.delete("r1", seen.append) and not store.delete("r1") and not store.delete("zz") and seen[0]["id"] == "r1"
    assert {r.id for r in store.records().collect()} == {"r2", "r3"} and R.envelope(R.page(store.records()))["count"] == 2
    assert {r.id for r in store.compact(str(tmp_path / "new")).records().collect()} == {"r2", "r3"}
    fresh = store.save(spark.createDataFrame([("New",)], "applicant_name string")).first().id
    assert fresh.startswith("VERIF-") and len(fresh) == 27
    for bad in (0, 201):
        with pytest.raises(ValueError):
            R.checked_page(store.records(), bad)


def test_verification_to_records(spark, tmp_path):
    forms = spark.createDataFrame([("a", "Jane Roe", "1990")], "doc_id string, full_name string, dob string")
    texts = spark.createDataFrame([("a", "front", "Name: Jane Roe\nDOB: 01/02/1990\n"), ("a", "back", "x")], "doc_id string, side string, full_text string")
    store = R.RecordStore(spark, str(tmp_path)).create()
    store.save(verify(forms, texts=texts).records())
    r = store.records().first()
    assert r.has_back_document and json.loads(r.audit_json)["has_back_document"]  # a back on which nothing is found
    assert (r.applicant_name, r.dob, r.tier, r.overall_score) == ("Jane Roe", "1990", "HIGH", 100.0) and json.loads(r.audit_json)["fields"]["dob"]["status"] == "match"


def test_stored_scores_are_the_audits(spark, tmp_path):
    store = R.RecordStore(spark, str(tmp_path)).create()
    store.save(spark.createDataFrame([("a", 85.25), ("b", 0.35), ("c", None)], "id string, overall_score double"))
    assert {r.id: r.overall_score for r in store.records().collect()} == {"a": 85.2, "b": 0.3, "c": 0.0}


def test_writers_get_their_own_ids(spark, tmp_path):
    one, two = R.RecordStore(spark, str(tmp_path)).create(), R.RecordStore(spark, str(tmp_path))
    name = lambda *x: spark.createDataFrame([(n,) for n in x], "applicant_name string")
    first = one.save(name("a", "b"))
    second = two.save(name("c"))
    assert first.count() == 2 and second.count() == 1 and one.records().count() == 3
    assert first.join(one.records(), "id").select("applicant_name").distinct().count() == 2


def test_views(spark):
    d = spark.createDataFrame([("jane roe", "LOW", 49.9), ("", "HIGH", 120.0), (" x", "MEDIUM", 95.0)], "name string, tier string, score double")
    got = d.select(views.initials(F.col("name")).alias("i"), views.chip(F.col("tier")).alias("c"), views.card_class(F.col("score")).alias("k"), views.gauge_offset(F.col("score")).alias("g"), views.label_text(F.col("name"), F.col("score")).alias("l")).collect()
    assert [r.i for r in got] == ["JR", "A", "X"] and [r.c for r in got] == ["Needs Review", "High Match", "Mostly Match"] and [r.k for r in got] == ["low", "high", "high"] and got[1].g == 0 and got[0].l == "JANE ROE (50%)"
    d = spark.createDataFrame([(0.35,), (85.25,), (None,)], "s double")
    assert [r[0] for r in d.select(views.python_round(F.col("s"), 1)).collect()] == [0.3, 85.2, None]
    b = spark.createDataFrame([([5, 5, 10, 10],), ([5, 5, 0, 10],), ([1, 2],), (None,)], "b array<int>")
    assert [r[0] for r in b.select(views.crop_box(F.col("b"), F.lit(12), F.lit(100), 8)).collect()] == [[0, 0, 12, 23], None, None, None]
    turn = spark.createDataFrame([(-80.0,), (80.0,), (0.1,), (10.0,)], "a double")
    assert [r[0] for r in turn.select(views.fold_skew(F.col("a"))).collect()] == [-10.0, 10.0, 0.0, -10.0]
    url = spark.createDataFrame([(bytearray(b"\x89P"),)], "p binary").select(views.data_url(F.col("p"))).first()[0]
    assert url == "data:image/png;base64,iVA="


def test_documents(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"png")
    (tmp_path / "b.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "c.txt").write_bytes(b"no")
    files = D.scan(spark, str(tmp_path))
    assert {(r.doc_id, r.is_pdf) for r in files.collect()} == {("a", False), ("b", True)}
    (tmp_path / "m.json").write_text(json.dumps([{"document_path": str(tmp_path / "a.png"), "submitted": {"name": "x"}}, {"document_path": "/gone.png", "submitted": {}}]))
    entries = D.manifest(spark, str(tmp_path / "m.json"))
    assert [r.doc_id for r in D.present(entries, files).collect()] == ["a"] and entries.count() == 2
    lines = D.ocr_lines(files, lambda: lambda content, page: [([[0, 0], [5, 5]], content.decode("latin1"), 0.5)])
    assert {(r.doc_id, r.text) for r in lines.collect()} == {("a", "png"), ("b", "%PDF-1")}
    assert D.form({"name": " x ", "dob": "  ", "sex": None}) == {"name": "x"}
    d = spark.createDataFrame([(" ", "a ")], "x string, y string")
    assert tuple(D.form_columns(d, ["x", "y"]).first()) == (None, "a")


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    base = {"id": "r1", "timestamp": "2024-05-01T12:00:00", "tier": "HIGH", "overall_score": 1.0}
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(x) for x in (base, base, base | {"id": "r2", "tier": "LOW"})))
    store = R.RecordStore(spark, str(tmp_path / "store")).create()
    ingest.append_to(ingest.landing(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    store.save(spark.createDataFrame([("r3", "HIGH")], "id string, tier string"))
    assert {(r.id, r.tier) for r in store.records().collect()} == {("r1", "HIGH"), ("r2", "LOW"), ("r3", "HIGH")}
    q = ingest.tier_windows(ingest.landing(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
