"""Finding 11: verdicts without the searches and expressions that decide nothing."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import fields, similarity as S
from attesta.plans.verification import verify

WORDS = [
    *"Name: Name - Citizen Full Holder To TO DOB: D0B d.o.b birth Year of Birth YOB Gender: Sex F / Male FEMALE transgender Address: Perm address. Res. C/O d/oRam care house no HNO12 flat plot Rd street verified PORTAL Aadhaar".split(),
    *"01/02/1990 1990-2-1 5 May 1990 1234 5678 9012 1234-5678-9012 123456789012 ABCDE1234F ABC1234567 J 1234567 KA-01 20190001 KA01 110001 700 016 1 id no doc Card mobile help valid enrolment India hNo5".split(),
    "card no: AB-12 34", "id number", "J1234567", "BokamHaritha", "st", "main", ":", ",", ".", "-", "\n", "\n", "\n", "\n\n", "\t", "\x1c", "ſex: M", "İd no", "é", " ", "KA0120190001", "٣٣٣٣ ٣٣٣٣ ٣٣٣٣",
]


def found(text):
    return {n: getattr(fields.Reading(text), n)() for n in fields.FIELD_NAMES}


def test_hints_leave_no_match_out(monkeypatch):
    rng = random.Random(11)
    texts = [rng.choice([" ", "", " ", "\n"]).join(rng.choices(WORDS, k=rng.randrange(1, 14))) for _ in range(4000)]
    texts += [t.encode("ascii", "ignore").decode() for t in texts]
    got = [found(t) for t in texts]
    monkeypatch.setattr(fields.Hinted, "search", lambda self, text: self.pattern.search(text))
    monkeypatch.setattr(fields.Reading, "place_of", lambda self, words, shaped=False: 0)
    monkeypatch.setattr(fields.Reading, "may_have_pin", True)
    assert got == [found(t) for t in texts]
    assert all(sum(g[n] is not None for g in got) > 200 for n in fields.FIELD_NAMES)


def test_texts_that_lack_a_kind_are_not_searched_for_it(monkeypatch):
    class Unsearched:
        def __getattr__(self, name):
            raise AssertionError("searched")

    for rule in (*fields._DOB_RULES[:2], *fields._ID_RULES, *fields._GENDER_RULES):
        monkeypatch.setitem(rule.__dict__, "pattern", Unsearched())
    r = fields.Reading("nothing to see, 12 words\n" * 3)
    assert r.dob() is None and r.document_id() is None and r.gender() is None


def test_a_string_within_the_other_is_not_slid(monkeypatch):
    def slid(*_):
        raise AssertionError("slid")

    monkeypatch.setattr(S, "strands", slid)
    assert S.partial_ratios(["5 hill road", "address 7 main road", "", "a"], ["address 5 hill road", "7 main road", "b", ""]) == [100.0, 100.0, 0.0, 0.0]


@pytest.mark.parametrize("a, b, n", [("abcde", "abXde", 4), ("aa", "aaa", 2), ("abab", "ab", 2), ("", "a", 0), ("xay", "xby", 2), ("same", "same", 4)])
def test_lcs_of_equal_ends(a, b, n):
    assert S.lcs(a, b) == n == S.lcs(b, a)


@pytest.fixture(scope="module")
def run(spark):
    forms = spark.createDataFrame([("a", "Jane Roe", "1990-02-01", "ABCDE1234F", "F", "5 Hill Rd Old Town"), ("b", "Jon Doe", "1980", None, "m", None), ("c", None, None, None, None, None)], "doc_id string, name string, dob string, document_id string, gender string, address string")
    texts = [("a", "front", "Name: Jane Row\nDOB: 01/02/1990\nGender: Female"), ("a", "back", "Address: 5 Hill Road, Old Town 110001\nDoc ID: ABCDE1234F\nDOB: 1/3/1990"), ("b", "back", "Name: Jon Doe\nDOB: 03/04/1981")]
    return verify(forms, texts=spark.createDataFrame(texts, "doc_id string, side string, full_text string"))


def test_verdicts_carry_only_what_they_are_made_of(run):
    assert [f.name for f in run.scored.schema["matches"].dataType.elementType] == ["side", "field_name", "score", "status", "is_critical"]
    short = "transform(matches, m -> struct(m.side, m.field_name, m.score, m.status, m.is_critical))"
    rows = lambda d, m: sorted(map(repr, d.select("doc_id", "has_back", F.expr(m).alias("m")).collect()))
    assert rows(run.scored, short) == rows(run.documents, short)
    by_whole = run._judged(run.documents).select(*run.verdicts.columns)
    assert sorted(map(repr, run.verdicts.collect())) == sorted(map(repr, by_whole.collect()))


def test_a_submitted_date_is_parsed_once(spark, run):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = run.verdicts._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # the formats of a date, once for the document's and once for the submitted one
    assert plan.count("yyyy-M-d") <= 2
