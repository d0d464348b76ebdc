"""Lines by place, extraction results, stored audits as rows, and the branches of the address rule."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import layout, views
from attesta.operators.extract import extract_from_tokens
from attesta.plans import queries
from attesta.sources import records as R

TOKENS = "doc_id string, side string, tok_id int, text string, bbox array<int>, confidence double, line_num int, block_num int"


def tokens(spark, lines, slope=0.0, doc="d", pitch=20):
    rows, n = [], 0
    for i, line in enumerate(lines):
        x = 0
        for word in line.split():
            rows.append((doc, "front", n, word, [x, int(100 + i * pitch + slope * x), 10 * len(word), 16], 90.0, None, 0))
            x, n = x + 10 * len(word) + 10, n + 1
    return spark.createDataFrame(rows, TOKENS)


LINES = ["Name: Jane Roe with a rather long line of words to the right", "DOB: 01/02/1990", "Address: 5 Hill Road, Old Town 110001 and so on to the right edge"]


@pytest.mark.parametrize("slope", [-0.1, -0.04, 0.0, 0.03, 0.1])
def test_tilted_lines(spark, slope):
    got = layout.lines_by_place(tokens(spark, LINES, slope))
    assert [r.full_text for r in layout.full_text(got).collect()] == ["\n".join(LINES) + "\n"]
    assert got.columns == [c.split(" ")[0] for c in TOKENS.split(", ")]


def test_lines_of_odd_pages(spark):
    d = spark.createDataFrame([("a", "front", 0, "x", [5, 5, 10, 10], 1.0, 7, 0), ("b", "front", 0, "y", [0, 0, 0, 0], 1.0, 7, 0), ("b", "front", 1, "z", None, 1.0, 7, 0), ("b", "front", 2, "w", [1, 2, 3, 4], 1.0, 7, 0), ("b", "back", 0, "v", [1, 200, 3, 4], 1.0, 7, 0)], TOKENS)
    got = {(r.doc_id, r.side, r.tok_id): r.line_num for r in layout.lines_by_place(d).collect()}
    assert got == {("a", "front", 0): 0, ("b", "front", 0): None, ("b", "front", 1): None, ("b", "front", 2): 0, ("b", "back", 0): 0}
    # a word that stands higher, and a tall one, are of their line; a column to the right is too
    d = spark.createDataFrame([("a", "f", i, str(i), box, 1.0, None, 0) for i, box in enumerate([[0, 10, 20, 16], [30, 7, 20, 20], [400, 12, 30, 16], [0, 30, 20, 16], [30, 31, 20, 14]])], TOKENS)
    assert [r.line_num for r in layout.lines_by_place(d).orderBy("tok_id").collect()] == [0, 0, 0, 1, 1]
    assert layout.lines_by_place(d.limit(0)).count() == 0


def test_found_lines_are_the_printed_ones(spark, sf_dir):
    d = queries.QUERIES["lines_by_place"](spark, sf_dir)
    rank = d.groupBy("doc_id", "side", "line_num").agg(F.min("printed").alias("a"), F.max("printed").alias("b"))
    assert rank.where("a <> b").count() == 0 and rank.groupBy("doc_id", "side", "a").count().where("count > 1").count() == 0


def test_extraction_view(spark):
    t = layout.lines_by_place(tokens(spark, LINES)).unionByName(layout.lines_by_place(tokens(spark, ["nothing"], doc="e")))
    images = spark.createDataFrame([("d", "front", 640, 480)], "doc_id string, side string, width int, height int")
    got = {r.doc_id: json.loads(r.json) for r in views.extraction_view(extract_from_tokens(t), layout.full_text(t), images, "words").collect()}
    assert got["d"]["image_shape"] == [480, 640] and got["d"]["token_count"] == t.where("doc_id = 'd'").count() and got["d"]["backend_used"] == "words"
    assert set(got["d"]["fields"]) >= {"name", "dob", "address"} and got["d"]["fields"]["dob"]["confidence"] == 90.0
    assert got["e"]["fields"] == {} and "image_shape" not in got["e"] and got["e"]["full_text"] == "nothing\n"


def test_audits_as_rows(spark):
    audit = json.dumps({"fields": {"name": {"status": "match", "score": 99.5, "submitted": "x", "ocr_text": "y", "doc_side": "front", "diff": "d"}, "dob": {"status": 7}}})
    d = spark.createDataFrame([("a", audit), ("b", "not json"), ("c", "{}"), ("e", None), ("f", json.dumps({"fields": [1]}))], "id string, audit_json string")
    got = sorted(((r.id, r.field_name, r.status, r.score, r["diff"], r.audit_text) for r in R.audit_fields(d).collect()), key=str)
    assert ("a", "name", "match", 99.5, "d", None) in got and ("a", "dob", "7", None, None, None) in got
    assert ("b", None, None, None, None, "not json") in got and ("c", None, None, None, None, "{}") in got and ("e", None, None, None, None, None) in got


def test_every_branch_of_the_address_rule_is_met(spark, sf_dir):
    got = {r.branch: r["count"] for r in queries.QUERIES["address_branches"](spark, sf_dir).groupBy("branch").count().collect()}
    assert set(got) == {"same", "words", "order", "least"}
