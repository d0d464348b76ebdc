import difflib
import math

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import similarity as S

words = st.text(alphabet="abc de", max_size=14)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _step(row, x, b)
    return row[-1]


def _step(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


@given(words, words)
def test_lcs_and_ratio(a, b):
    assert S.lcs(a, b) == brute_lcs(a, b)
    assert math.isclose(S.ratio(a, b), S.ratio(b, a)) and 0 <= S.ratio(a, b) <= 100


@given(words, words)
def test_scores_are_bounded_and_find_equals(a, b):
    for f in (S.token_sort_ratio, S.token_set_ratio, S.partial_ratio):
        assert -1e-9 <= f(a, b) <= 100 + 1e-9
    assert 0 <= S.jaro_winkler(a, b) <= 1 + 1e-12 and S.jaro_winkler(a, a) == 1
    assert S.partial_ratio(a, a) == 100


def test_known_values():
    assert math.isclose(100 * S.jaro_winkler("johnny doe", "jonathan doe"), 87.7037, abs_tol=1e-3)
    assert math.isclose(S.ratio("johnny doe", "jonathan doe"), 72.727272, abs_tol=1e-5)
    assert S.token_set_ratio("main road", "address 12 main road") == 100 and S.token_set_ratio("", "a") == 0
    assert S.partial_ratio("park street", "42 park street kolkata") == 100
    assert math.isclose(S.jaro_winkler("martha", "marhta"), 0.961111, abs_tol=1e-5) and math.isclose(S.jaro_winkler("dixon", "dicksonx"), 0.813333, abs_tol=1e-5)


def test_token_diff():
    assert S.token_diff("12 Main Rd", "12 Main Road,") == "Road vs Rd"
    assert S.token_diff("a", "a") is None and S.token_diff("A b", "a") == "Missing in OCR: 'b'" and S.token_diff("a", "a b") == "Extra in OCR: 'b'"
    assert S.token_diff("x b y d z", "a b c d e").count(" vs ") == 2
    assert difflib.SequenceMatcher(None, [], []).get_opcodes() == [] and S.token_diff("", "") is None


def test_native_ratio_and_sql(spark):
    pairs = [("johnny doe", "jonathan doe"), ("", ""), ("a", ""), ("abc", "cba"), ("ünï", "uni")]
    d = spark.createDataFrame(pairs, "a string, b string")
    S.register(spark)
    got = d.select("a", "b", S.native_ratio(F.col("a"), F.col("b")).alias("n"), F.expr("ratio(a, b)").alias("u")).collect()
    assert all(math.isclose(r.n, S.ratio(r.a, r.b)) and math.isclose(r.u, r.n) for r in got)
