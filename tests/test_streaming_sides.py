"""Sides that arrive apart: the last version of a document is the batch's result, whatever the order."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attesta.plans.verification import verify
from attesta.streaming import sides as S

SCHEMA = "doc_id string, side string, full_text string, event_time timestamp"
START = datetime(2024, 1, 1)
TEXTS = {
    ("a", "front"): "Name: Jane Roe\nDOB: 01/02/1990\n", ("a", "back"): "Address: 5 Hill Road, Old Town 110001\nDoc ID: ABCDE1234F\n",
    ("b", "front"): "Name: Jon Doe\nDoc ID: ABCDE1234F\nDOB: 03/04/1980\n", ("b", "back"): "nothing to see",
    ("c", "back"): "Address: 7 Main Road\nDOB: 05/06/1970\n", ("d", "front"): "Name: Al Bo\nGender: Male\n",
}


@pytest.fixture(scope="module")
def forms(spark):
    rows = [("a", "Jane Roe", "1990-02-01", "ABCDE1234F", "5 Hill Rd Old Town"), ("b", "John Doe", "1980", "XBCDE1234F", None), ("c", "Kim Lee", "1971-06-05", None, "7 Main Rd"), ("d", "Al Bo", None, "ABCDE1234F", "")]
    return spark.createDataFrame(rows, "doc_id string, name string, dob string, document_id string, address string")


def played(spark, forms, folder, batches, **options):
    """Run a stream over files that come one after the other; the rows that left, in order."""
    (folder / "in").mkdir()
    for i, rows in enumerate(batches):
        path = folder / f"in/{i:03d}.json"
        path.write_text("\n".join(json.dumps({"doc_id": d, "side": s, "full_text": t, "event_time": at.isoformat()}) for d, s, t, at in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in the order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder / "in"))
    out = S.merge_sides_of_stream(stream, forms, **options)
    q = out.writeStream.outputMode("update").format("memory").queryName(f"sides_{random.randrange(1 << 30)}").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        return [r.asDict(recursive=True) for r in spark.table(q.name).collect()]
    finally:
        q.stop()


def batch(spark, forms, texts):
    d = spark.createDataFrame([(d, s, t) for (d, s), t in texts.items()], "doc_id string, side string, full_text string")
    run = verify(forms, texts=d)
    merged = {}
    for r in run.merged.collect():
        merged.setdefault(r["doc_id"], {})[r["field_name"]] = {k: v for k, v in r.asDict().items() if k != "doc_id"}
    return merged, {r["doc_id"]: (r["overall_score"], r["tier"], r["critical_flag"]) for r in run.verdicts.collect()}


def last(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["version"]):
        out[r["doc_id"]] = r
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_any_order_gives_the_batch(spark, forms, tmp_path, seed):
    order = list(TEXTS)
    random.Random(seed).shuffle(order)
    batches = [[(d, s, TEXTS[d, s], START + timedelta(minutes=i))] for i, (d, s) in enumerate(order)]
    if seed:  # sides in one micro-batch, and one that comes twice
        batches = [batches[0] + batches[1] + batches[0], batches[2], batches[3] + batches[4] + batches[5]]
    # a document of no form moves the watermark on, past every wait
    batches += [[("z", "front", "", START + timedelta(hours=5 + i))] for i in range(2)]
    got = last(played(spark, forms, tmp_path, batches))
    merged, verdicts = batch(spark, forms, TEXTS)
    assert set(got) == set("abcd")
    for doc, r in got.items():
        assert {f["field_name"]: f for f in r["fields"]} == merged[doc]
        assert (r["overall_score"], r["tier"], r["critical_flag"]) == verdicts[doc]
        assert r["complete"] == (doc in "ab") and r["version"] == 1


def test_late_sides_and_timeouts(spark, forms, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    front, back = TEXTS["a", "front"], TEXTS["a", "back"]
    tick = lambda h: [("z", "front", "", at(h))]
    batches = [[("a", "front", front, at(0))], tick(1), tick(3), tick(4), [("a", "back", back, at(0))], tick(5), [("a", "back", back, at(5))], tick(40), tick(41)]
    rows = [r for r in played(spark, forms, tmp_path, batches) if r["doc_id"] == "a"]
    assert [(r["version"], r["sides"], r["complete"]) for r in rows] == [(1, ["front"], False), (2, ["back", "front"], True)]
    _, alone = batch(spark, forms, {("a", "front"): front})
    _, both = batch(spark, forms, {("a", "front"): front, ("a", "back"): back})
    assert [(r["overall_score"], r["tier"], r["critical_flag"]) for r in rows] == [alone["a"], both["a"]]


def test_own_weights_and_unknown_forms(spark, forms, tmp_path):
    rows = played(spark, forms, tmp_path, [[("a", "front", TEXTS["a", "front"], START), ("a", "back", "", START), ("nobody", "front", "x", START)]], weights={"name": 1.0, "dob": 0.0, "document_id": 0.0, "gender": 0.0, "address": 0.0})
    assert [(r["doc_id"], r["overall_score"]) for r in rows] == [("a", 100.0)]
