"""Word BPE, phrases and tokenizer alignment against brute-force versions and the public libraries."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import alignment, phrases, word_bpe
from attesta.llm.tokens import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "\n", "<|endoftext|>", "a<|startoftext|>B <|endoftext|", "İstanbul ΣΑΣ ßẞ", "日本語 テキスト 한국어", "áé é", "x" * 300, "ha" * 100, "it's WE'RE i'll 'S ''t", "1२٣½ Ⅷ", "tab\tand\x0bvt\x85nel nb em", "😀👍🏽 …—“”", "</w> a</w>b", "\x00\x01\x1c\x1f", "՘₏\U0001fae9 new letters", "▁x <s> <unk> <0x41>", "double  space   three", "a-b_c/d\\e"]


def prose(rng: random.Random, n: int) -> str:
    words = ["the", "The", "of", "data", "lake", "house", "very", "long", "word", "río", "Straße", "a", "b", "c"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", "  ", "\t", ";", "!?"]) for _ in range(n))


def table_rows() -> list[tuple]:
    rng = random.Random(7)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(100 + i, prose(rng, rng.randint(0, 80)), rng.choice(["en", "de", None, "", "x y%"]), None, None) for i in range(120)]
    return rows + [(300, None, "en", "s", 0), (300, "again the same id", None, None, None), (None, "no id the of", "de", "s", 2), (1 << 60, prose(rng, 20_000), "en", "s", 9)] + [(400 + i, "one text of many copies, one text of many copies", "en", "s", 1) for i in range(40)]


ROWS = table_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


@pytest.fixture(scope="module")
def clash(docs):
    return docs.withColumns({c: F.lit("own") for c in ("ids", "decoded", "phrase", "words", "n", "row", "pairs", "groups", "suffix", "a", "l", "rank", "size")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- word BPE


@pytest.fixture(scope="module")
def words_file():
    return vocabulary("word_bpe_49k.json")


def test_ids_and_decoded_texts_are_the_librarys(docs, clash, none, words_file):
    library = Tokenizer.from_file(words_file)
    want = []
    for d, t, *_ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, ids, library.decode(ids, skip_special_tokens=False)))
    for table in (docs, clash):
        same([(r.doc_id, list(r.ids), r.decoded) for r in word_bpe.encode(table).collect()], want)
    assert word_bpe.encode(none).count() == 0


def test_every_token_and_random_words(words_file):
    library, own = Tokenizer.from_file(words_file), word_bpe._Texts(words_file)
    rng = random.Random(1)
    vocab = sorted(library.get_vocab())
    texts = [rng.choice(vocab).replace("</w>", "") + rng.choice(vocab).replace("</w>", " ") + rng.choice(vocab) for _ in range(4000)]
    texts += ["".join(rng.choice("ehinorst") for _ in range(rng.randint(1, 14))) for _ in range(4000)] + ["a" * n for n in range(1, 120)]
    for text, (ids, decoded) in zip(texts, own.encoded(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, np.int32).tolist() == want and decoded == library.decode(want, skip_special_tokens=False), text


def test_shared_prefixes_are_computed_once(words_file, monkeypatch):
    bpe = word_bpe.TrieBpe(words_file)
    states = []
    monkeypatch.setattr(bpe, "_state", lambda path, depth, last, f=bpe._state: states.append(path[:depth]) or f(path, depth, last))
    words = ["information", "informations", "inform", "informal", "in", "zebra"]
    got = bpe.encode_words(words + words)
    assert len(states) == len(set(states))  # no prefix twice; a word's last letter is a symbol of its own
    library = Tokenizer.from_file(words_file)
    assert got == {w: library.encode(w, add_special_tokens=False).ids for w in words}


def test_words_that_are_not_kept(words_file, monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(word_bpe, "CACHED_CHARS", 4)
    own, library = word_bpe._Texts(words_file), Tokenizer.from_file(words_file)
    for texts in (["longer words here", "a b c d e f"], ["longer words here"], ["x" * 5000]):
        for text, (ids, _) in zip(texts, own.encoded(texts), strict=True):
            assert np.frombuffer(ids, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


# --- phrases


def brute_phrases(rows, least, top, max_n=4):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = any(100 * b >= 80 * a for (o, q), b in found.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if not inside:
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])]


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("least", "top"), [(30, 2000), (3, 25), (2, 10_000)])
def test_phrases(docs, least, top):
    want = brute_phrases(ROWS, least, top)
    assert want
    same([tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, least=least, top=top).collect()], want)


def test_phrases_of_odd_tables(docs, clash, none, spark):
    same([tuple(r[c] for c in COLUMNS) for r in phrases.collocations(clash, least=20).collect()], brute_phrases(ROWS, 20, 2000))
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(docs.where("text IS NULL OR text = ''"), least=1).count() == 0
    one = spark.createDataFrame([(1, "same same " * 500, "en", "s", 1)] * 3, DOCS)  # overlaps; one pair has all rows
    same([tuple(r[c] for c in COLUMNS) for r in phrases.collocations(one).collect()], brute_phrases([(1, "same same " * 500, "en")] * 3, 30, 2000))


def test_longer_and_shorter_phrases(docs):
    for n in (2, 3, 5):
        same([tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, max_n=n, least=15).collect()], brute_phrases(ROWS, 15, 2000, n))


def test_broadcast_and_shuffled_parts_agree(docs, monkeypatch):
    want = [tuple(r) for r in phrases.collocations(docs, least=5).collect()]
    for share in (1, 50):
        monkeypatch.setattr(phrases, "COMMON", share)
        same([tuple(r) for r in phrases.collocations(docs, least=5).collect()], want)


def test_stack_counts_prefixes_over_blocks_and_ranges():
    rng = random.Random(3)
    rows = collections.Counter(" ".join([rng.choice(["en", "de"]), *(rng.choice(["a", "b", "ab", "a\x01"]) for _ in range(rng.randint(1, 4)))]) + " " for _ in range(3000))
    want = collections.Counter()
    for s, n in rows.items():
        for k in range(1, 6):
            w = s.split()
            if len(w) >= k:
                want[" ".join(w[:k]), k - 1] += n
    keys = sorted(rows, key=str.encode, reverse=True)
    for least in (1, 40):
        got = collections.Counter()
        cuts = [0, *sorted(rng.sample(range(1, len(keys)), 5)), len(keys)]
        for lo, hi in itertools.pairwise(cuts):  # ranges, each in blocks
            stack = phrases.PrefixStack(4, least)
            for at in range(lo, hi, 7):
                part = keys[at : min(at + 7, hi)]
                stack.push(pa.array(part), np.array([rows[k] for k in part]))
            stack.end()
            for text, k, n in stack.out:
                got[text, k] += n
        assert all(got[key] == n for key, n in want.items() if n >= least or key[1] == 0)
        assert all(n <= want[key] for key, n in got.items())


def test_suffixes_of_a_block_with_many_words():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60_000)}" for _ in range(30_000)), "a b. c"]  # too many words for one number a suffix
    got = phrases.suffix_counts(pa.array(texts), pa.array(["en", "de"]), 4)
    want = collections.Counter()
    for lang, text in zip(("en", "de"), texts, strict=True):
        for piece in text.split("."):
            w = piece.split()
            for i in range(len(w)):
                want[" ".join([lang, *w[i : i + 4]]) + " "] += 1
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == dict(want)


# --- alignment


def brute_alignment(rows):
    a_model, b_model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    a_model.encode_special_tokens = True
    letters, found = word_bpe.byte_letters(), []
    for doc, text, *_ in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        x = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        y = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            found.append((doc, 0, 0, [], ""))
            continue
        ends = [list(itertools.accumulate(map(len, z))) for z in (x, y)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        found.append((doc, len(a), len(b), groups, ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)))
    links = [[(p, q) for ps, qs in groups for p in ps for q in qs] for *_, groups, _ in found]
    counts = collections.Counter(pair for x in links for pair in set(x))
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    return [(doc, na, nb, len(groups), len(x), text, sum(counts[k] == best[k[0]] for k in x), sum(counts[k] for k in x)) for (doc, na, nb, groups, text), x in zip(found, links, strict=True)]


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


def test_alignment(docs, clash, none, monkeypatch):
    want = brute_alignment(ROWS)
    assert any(w[1] for w in want) and any(not w[1] for w in want)
    for table in (docs, clash):
        same([tuple(r[c] for c in ALIGNED) for r in alignment.align(table).collect()], want)
    for share in (1, 40):  # all pairs' counts by a shuffle, and a mixture
        monkeypatch.setattr(alignment, "COMMON", share)
        same([tuple(r[c] for c in ALIGNED) for r in alignment.align(docs).collect()], want)
    assert alignment.align(none).count() == 0


def test_long_groups_count_ids_first(monkeypatch):
    a, b = [1, 2, 1, 3, 1], [9, 9, 8]
    groups = alignment.Groups(a + [4], b + [7], [5, 6], [3, 4])
    want = collections.Counter((p << 32 | q) for p in a for q in b) + collections.Counter([4 << 32 | 7])
    for wide in (4096, 4, 1):
        monkeypatch.setattr(alignment, "WIDE", wide)
        pairs, times = groups.links()
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == dict(want) and list(pairs) == sorted(pairs)
    assert groups.text(alignment.Marked(10)) == "1,2,1,3,1|9,9,8;4|7"


def test_shared_ends():
    rng = random.Random(6)
    for _ in range(200):
        x, y = ([*sorted(rng.sample(range(1, 40), rng.randint(0, 20))), 40] for _ in range(2))
        of_a, of_b = alignment.shared_ends(x, y)
        assert [x[i - 1] for i in of_a] == [y[j - 1] for j in of_b] == sorted(set(x) & set(y))


def test_digest_of_the_query(spark, tmp_path):
    spark.createDataFrame([(1, "Hello world", "en", "s", 1), (2, None, "en", "s", 1)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in alignment.op13_alignment(spark, str(tmp_path)).collect()}
    text = brute_alignment([(1, "Hello world")])[0][5]
    assert got[1].groups_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[2].groups_sha256 == "" and got[2].count_sum == 0
    ids = {r.doc_id: r for r in word_bpe.op11_word_bpe(spark, str(tmp_path)).collect()}
    want = Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode("Hello world", add_special_tokens=False).ids
    assert ids[1].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and ids[1].n_tokens == len(want) and ids[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
