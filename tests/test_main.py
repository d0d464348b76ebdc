"""The command line."""

from __future__ import annotations

import json

import pytest

from attesta.__main__ import main
from attesta.sources.records import RecordStore


def test_files_in_audits_verdicts_and_records_out(spark, tmp_path):
    (tmp_path / "forms.jsonl").write_text('{"doc_id": 1, "name": "ANNA LEE", "gender": "Female"}\n{"doc_id": 2, "name": "BO CHAN"}\n')
    texts = spark.createDataFrame([(1, "front", "Name: ANNA LEE\nGender: Female\n"), (2, "front", "Name: SOMEBODY ELSE\n"), (2, "back", "zzz")], "doc_id long, side string, full_text string")
    texts.write.parquet(str(tmp_path / "texts"))
    out, store = str(tmp_path / "out"), str(tmp_path / "store")
    main(["verify", "--forms", str(tmp_path / "forms.jsonl"), "--texts", str(tmp_path / "texts"), "--out", out, "--store", store], spark)
    audits = sorted((json.loads(r[0]) for r in spark.read.text(f"{out}/audits").collect()), key=lambda a: -a["overall_score"])
    assert [(a["tier"], a["has_back_document"]) for a in audits] == [("HIGH", False), ("LOW", True)]
    assert audits[0]["fields"]["name"]["status"] == "match" and "policy_notice" in audits[0]
    tiers = {r["doc_id"]: r["tier"] for r in spark.read.parquet(f"{out}/verdicts").collect()}
    assert tiers == {"1": "HIGH", "2": "LOW"}
    assert RecordStore(spark, store).records().count() == 2


def test_documents_come_as_texts_or_tokens():
    for wrong in (["verify", "--forms", "f", "--out", "o"], ["verify", "--forms", "f", "--texts", "t", "--tokens", "t", "--out", "o"], []):
        with pytest.raises(SystemExit):
            main(wrong)
