"""Near dedup where many texts share sketches: what is written, and the classes of brute force."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from attesta.llm import near_dedup

WORDS = [f"w{i}" for i in range(3000)]


def prose(n, seed):
    return [WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n)]


def edited(words, every, seed):
    rng, words = np.random.default_rng(seed), list(words)
    for i in range(int(rng.integers(3, every)), len(words), every):
        words[i] = f"edit{rng.integers(100_000)}"
    return words


def brute_classes(texts):
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    seqs = [near_dedup.items(t.encode()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.near_copies(seqs[i], seqs[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(texts))}


def crowd():
    """Copies of one text, texts of it that are only copies of each other, others that share a passage, and short ones."""
    base, passage, short, texts = prose(200, 1), prose(110, 2), prose(30, 3), []
    for k in range(30):
        texts += [edited(base, 60, 100 + k), passage + prose(60, 200 + k)]
        texts.append([*short[:-1], f"end{k}"] if k % 2 else [*short[:14], *prose(16, 300 + k)])
        if k % 3 == 0:
            texts.append(edited(base, 6, 400 + k))
            texts.append(edited(texts[-1], 90, 500 + k))
    return [" ".join(t) for t in texts]


def classes(spark, monkeypatch, texts):
    made, write = collections.defaultdict(list), near_dedup.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        made[name].append(out.count())
        return out

    monkeypatch.setattr(near_dedup.Scratch, "write", counted)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: r["class_id"] for r in got}, made


def test_few_texts_beside_a_large_component_need_no_pivot(spark, monkeypatch):
    """A bucket of many copies and few others is settled at once: nothing is split, and no more tables are written for it."""
    texts = crowd()
    got, made = classes(spark, monkeypatch, texts)
    assert got == brute_classes(texts)
    assert not made["parts"] and not made["fine"] and sum(map(len, made.values())) <= 30


@pytest.mark.parametrize("small", [0, 20_000])
def test_crowded_buckets_meet_by_finer_sketches_then_pivots(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "FEW", 3)
    monkeypatch.setattr(near_dedup, "SMALL", small)
    texts = crowd()
    got, made = classes(spark, monkeypatch, texts)
    assert got == brute_classes(texts)
    assert made["fine"] and made["parts"]
