"""Windows of the partial ratio from one pass over both strings."""

import random
import time

import numpy as np
import pytest

from attesta.functions import similarity as S


def slid(a: str, b: str) -> float:
    """The definition: each window on its own."""
    if not a and not b:
        return 100.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 0.0
    best = max(S.ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))
    return max(best, max(S.ratio(long, short[max(0, i) : i + n]) for i in range(1 - n, n))) if n == len(long) else best


def test_random_pairs():
    rng = random.Random(5)
    text = lambda alphabet, most: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))
    pairs = [(text("ab", 9), text("ab", 9)) for _ in range(700)] + [(text("abcd é", 20), text("abcd é", 40)) for _ in range(300)] + [(text("ab😀", 5), text("ab😀", 60)) for _ in range(200)]
    pairs += [(x[2:7], x) for _, x in pairs[:50]] + [(x, x) for x, _ in pairs[:20]] + [("", ""), ("", "a"), ("a", "")]
    got = S.partial_ratios([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), value in zip(pairs, got, strict=True):
        assert value == pytest.approx(slid(a, b), abs=1e-9), (a, b)
        assert S.partial_ratio(b, a) == pytest.approx(value, abs=1e-9)


def test_strands_count_common_subsequences_of_every_window():
    rng = random.Random(2)
    for _ in range(60):
        a, b = "".join(rng.choices("abc", k=rng.randint(1, 8))), "".join(rng.choices("abc", k=rng.randint(1, 9)))
        starts = S.strands(S._codes([a], -1), S._codes([b], -2))[0]
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                assert S.lcs(a, b[i:j]) == (j - i) - int(np.sum(starts[:j] >= i))


def test_blocks_do_not_change_results(monkeypatch):
    rng = random.Random(3)
    a, b = (["".join(rng.choices("abcde ", k=rng.randint(0, 30))) for _ in range(200)] for _ in range(2))
    want = S.partial_ratios(a, b)
    monkeypatch.setattr(S, "BLOCK_CELLS", 500)
    assert S.partial_ratios(a, b) == want


def test_time_is_linear_in_the_longer_string():
    rng = random.Random(4)
    short = "".join(rng.choices("abcdefgh", k=40))

    def took(n):
        long = "".join(rng.choices("abcdefgh", k=n))
        best = min(_timed(short, long) for _ in range(3))
        return best

    assert took(32_000) < 16 * took(4_000)  # eight times as long


def _timed(a, b):
    began = time.perf_counter()
    S.partial_ratio(a, b)
    return time.perf_counter() - began


def test_scores_are_those_that_the_rules_ask_for():
    pairs = [("main road 5", "main road 5 old town"), ("main road 5", "other street"), ("", ""), ("jane roe", "jane doe")]
    got = S.score_pairs([p[0] for p in pairs], [p[1] for p in pairs], [True, True, True, False])
    assert got["partial"][0] == 100.0 and got["ratio"][0] == 0.0 and got["partial"][1] == 0.0 and got["ratio"][1] == S.ratio(*pairs[1])
    assert [got[n][2] for n in S.SCORES] == [0.0] * 5 and got["jaro_winkler"][3] == 100 * S.jaro_winkler(*pairs[3]) and got["token_set"][3] == 0.0


def test_native_ratio_of_short_and_long_strings(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcd é😀", k=n))
    pairs = [(text(rng.randint(0, 12)), text(rng.randint(0, 12))) for _ in range(60)] + [(text(n), text(m)) for n, m in ((61, 80), (62, 62), (62, 90), (63, 63), (64, 70), (0, 70), (70, 1))]
    d = spark.createDataFrame([*pairs, (None, "a")], "a string, b string")
    got = [r[0] for r in d.select(S.native_ratio(d.a, d.b)).collect()]
    assert got[:-1] == pytest.approx([S.ratio(a, b) for a, b in pairs]) and got[-1] is None
