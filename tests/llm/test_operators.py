"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import exact_dedup, language_id, licenses, mixing, near_dedup, packing, quality_model, quality_rules, sharding, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def prose(n: int, seed: int = 0) -> str:
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "so", "ven", "du") for b in ("n", "ra", "st", "lo", "ki", "mer")]
    return " ".join(words[i] + str(j) for i, j in zip(rng.integers(0, len(words), n), rng.integers(0, 50, n), strict=True))


LONG = prose(30_000, 1)
ROWS = [
    (1, "a b  c", "en", "s1", 6), (2, "a\tb c", "en", "s1", 5), (3, None, "de", None, 0), (4, "", "en", "s2", 0), (5, "abc", None, "s2", 3), (6, LONG, "en", "s1", len(LONG)), (7, LONG + " tail", "en", "s2", 1),
    (8, prose(60, 2), "en", "s1", 1), (8, prose(60, 2), "en", "s1", 1), (9, prose(60, 3), "de", "s3", 1), (10, " \n ", None, "s3", 3), (None, "a b c", "en", "s1", 5), (11, "é日本 語\x85x", "fr", "s3", 1), (12, "x", "en", "s4", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns with the names that the operators use themselves."""
    return docs.withColumns({c: F.lit("own") for c in ("size", "key", "node", "seq", "score", "kept", "first_id", "class_id", "group_size", "slot", "copies", "_g", "length", "x", "term")})


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- exact dedup


def brute_groups():
    groups = collections.defaultdict(list)
    for d, t, *_ in ROWS:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d is None, d or 0, d))
    return {k: (sorted(v)[0][3], len(v)) for k, v in groups.items()}


def test_exact_dedup(docs, clash, none):
    want = brute_groups()
    for table in (docs, clash):
        got = rows(exact_dedup.exact_dedup(table))
        assert len(got) == len(ROWS)
        by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
        for r in got:
            assert (r["keep_id"], r["group_size"]) == by_hash[r["text_sha256"]]
    assert rows(exact_dedup.exact_dedup(none)) == []


def test_keep_first_leaves_one_of_each(docs, clash):
    got = exact_dedup.keep_first(clash)
    assert got.columns == clash.columns
    texts = [SPACE.sub("", r["text"] or "") for r in rows(got)]
    assert sorted(texts) == sorted(brute_groups())


def test_stages_keep_columns_of_any_name(docs):
    """Columns named like those that the operators add for a while come through with their own values."""
    names = ("sha256", "SHA256_", "keep_id", "Length", "of", "seq", "first_id", "class_id", "_sha256", "_length", "__seq", "__text", "_k4", "_copy")
    table = docs.withColumns({n: F.lit(n) for n in names})
    for stage in (exact_dedup.keep_first, near_dedup.keep_one, quality_rules.keep_good, mixing.take_mix):
        got = stage(table)
        assert got.columns == table.columns
        assert all(r[n] == n for r in rows(got) for n in names)


def test_extendible_hash_splits_chains_and_spills(tmp_path):
    import pyarrow.fs as pafs

    fs = pafs.LocalFileSystem()
    seg = lambda n: exact_dedup.SegmentFile(fs, str(tmp_path / n), buffer_bytes=256)
    index = exact_dedup.ExtendibleHash(seg("b"), seg("p"), capacity=4, cached=3)
    rng, seen = np.random.default_rng(0), {}
    for i in range(3000):
        data = b"%d" % rng.integers(0, 700)
        key = int(hashlib.md5(data).hexdigest()[:16], 16) if i % 3 else 7  # a third of the keys collide
        g = index.put(key, data)
        assert seen.setdefault((key, data), g) == g
    assert len(set(seen.values())) == len(seen)
    assert index.depth >= 6 and len(index.directory) == 1 << index.depth
    index.close()


@pytest.mark.parametrize("owners", [1, 3, 100, 4096])
def test_directory_follows_the_buckets_whatever_the_owners(tmp_path, owners):
    """One owner's keys share their leading bits; the directory stays within a small factor of the buckets."""
    import pyarrow.fs as pafs

    fs = pafs.LocalFileSystem()
    rng, owner = np.random.default_rng(1), owners // 2
    low, high = -(-(owner << 64) // owners), ((owner + 1) << 64) // owners
    keys = sorted({low + int(x * (high - low)) for x in rng.random(20_000)} - {high})
    assert {k * owners >> 64 for k in keys} == {owner}
    places = [exact_dedup._place(k, owners) for k in keys]
    assert places == sorted(set(places))
    index = exact_dedup.ExtendibleHash(exact_dedup.SegmentFile(fs, str(tmp_path / "b")), exact_dedup.SegmentFile(fs, str(tmp_path / "p")), capacity=64)
    assert [index.put(p, b"%d" % p) for p in places] == list(range(len(places)))
    assert len(index.directory) <= 8 * len(set(index.directory))
    assert [index.put(p, b"%d" % p) for p in places[::37]] == list(range(len(places)))[::37]
    index.close()


def test_many_owners_give_the_same_groups(docs):
    want = sorted(map(str, rows(exact_dedup.duplicate_groups(docs))))
    for owners in (1, 7, 64):
        assert sorted(map(str, rows(exact_dedup.duplicate_groups(docs, owners=owners).coalesce(2)))) == want


def test_bytes_decide_within_a_key(tmp_path):
    import pyarrow.fs as pafs

    fs = pafs.LocalFileSystem()
    index = exact_dedup.ExtendibleHash(exact_dedup.SegmentFile(fs, str(tmp_path / "b")), exact_dedup.SegmentFile(fs, str(tmp_path / "p")), capacity=2)
    assert [index.put(5, x) for x in (b"a", b"b", b"c", b"a", b"c")] == [0, 1, 2, 0, 2]


# --- near dedup


def jaccard(a, b):
    s = [set(zip(*[WORD.findall(t)[i:] for i in range(5)], strict=False)) for t in (a, b)]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def edited(text, every, seed):
    rng, words = np.random.default_rng(seed), text.split(" ")
    for i in range(int(rng.integers(3, every)), len(words), every):
        words[i] = f"edit{rng.integers(1000)}"
    return " ".join(words)


def test_near_dedup_is_the_components_of_links(spark):
    texts = []
    for k in range(12):
        base = prose(300, 100 + k)
        texts += [base, edited(base, 70, k), edited(edited(base, 70, k), 90, k + 50), edited(base, 8, k)]
    texts += [prose(200, 7)] * 3 + [None, "", "one two", "one  two", "two one"]
    got = {r["doc_id"]: r for r in rows(near_dedup.near_duplicates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")))}
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(texts)):
        for j in range(i):
            a, b = (" ".join(WORD.findall(texts[k] or "")) for k in (i, j))
            if a == b or jaccard(a, b) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in range(len(texts))}
    sizes = collections.Counter(find(i) for i in range(len(texts)))
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (i == r["class_id"]) for i, r in got.items())


def test_near_dedup_hot_group_and_chains(spark):
    """Copies that drift: neighbours are similar, the ends are not; one class all the same."""
    text, chain = prose(400, 9), []
    for k in range(40):
        chain.append(text)
        words = text.split(" ")
        words[(k * 37) % 400] = f"drift{k}"
        words[(k * 53 + 5) % 400] = f"shift{k}"
        text = " ".join(words)
    assert jaccard(chain[0], chain[-1]) < 0.8 <= jaccard(chain[0], chain[1])
    got = rows(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")))
    assert {r["class_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_near_dedup_edge_rows(docs, clash, none):
    got = rows(near_dedup.near_duplicates(clash))
    assert len(got) == len(ROWS)
    of = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert of[1] == of[2] == 1 and of[7] == 6 and of[3] == of[4] == of[10] == 3 and of[5] == 5
    assert rows(near_dedup.near_duplicates(none)) == []
    kept = near_dedup.keep_one(clash)
    assert kept.columns == clash.columns and {r["doc_id"] for r in rows(kept)} == {1, 3, 5, 6, 8, 9, 11, 12}


def test_banded_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        a = rng.permutation(60)[:n].astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 6))):
            i, j = rng.integers(0, n, 2)
            if rng.random() < 0.5:
                b[i] = 100 + rng.integers(0, 50)
            else:
                b[[i, j]] = b[[j, i]]
        b = near_dedup.distinct_in_order(b)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        m = table[-1, -1]
        assert near_dedup.similar(a, b) == (m >= 0.8 * (len(a) + len(b) - m) - 1e-9)


def test_order_matters_to_sketches():
    h = near_dedup.shingles(prose(100, 1).encode())
    assert not np.isin(near_dedup.order_sketches(h), near_dedup.order_sketches(h[::-1])).any()
    assert len(near_dedup.order_sketches(near_dedup.shingles(b""))) == 0


def test_near_copies_that_repeat_lines_differently(spark):
    """Pairs that differ in how often a line repeats, and in a few words, against all pairs by brute force."""
    texts = []
    for k in range(8):
        head, line, tail = prose(50, 300 + k), prose(8, 400 + k), prose(50, 500 + k)
        texts += ["\n".join([x, *[line] * n, y]) for x, n, y in ((head, 5, tail), (head, 40, tail), (edited(head, 60, k), 200, tail), (edited(head, 6, k), 10, tail))]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(*(" ".join(WORD.findall(texts[x])) for x in (i, j))) >= 0.8:
                want = [min(want[i], want[j]) if w == max(want[i], want[j]) else w for w in want]
    assert len(set(want)) == 16  # three of four are one class
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert got == dict(enumerate(want))


def brute_classes(texts: list[str]) -> dict[int, int]:
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    seqs = [near_dedup.items(t.encode()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or near_dedup.near_copies(seqs[i], seqs[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(texts))}


def test_near_dedup_splits_buckets_by_what_is_beyond_the_pivot(spark):
    """A large group with members that aren't similar to its original but to each other, and texts that share one passage."""
    base, passage, texts = prose(200, 21), prose(150, 22), []
    for k in range(30):
        texts += [edited(base, 60, 1000 + k), edited(base, 17, 2000 + k)]
        if k % 3 == 0:
            texts.append(edited(texts[-1], 90, 3000 + k))  # a copy of a heavily edited copy
        texts += [f"{passage} {prose(50 + k % 4, 4000 + k)}", " ".join(base.split(" ")[: 200 - 4 * k])]
    want = brute_classes(texts)
    sizes = collections.Counter(want.values())
    assert max(sizes.values()) > 40 and sum(n == 1 for n in sizes.values()) > 20
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert got == want


def test_near_dedup_of_texts_from_shared_paragraphs(spark, monkeypatch):
    """Texts of 12 of 20 paragraphs each: the classes of brute force, and tables that stay in proportion to the sketches."""
    rng, paragraphs = np.random.default_rng(5), [prose(60, 600 + k) for k in range(20)]
    texts = ["\n\n".join(paragraphs[k] for k in np.sort(rng.choice(20, 12, False))) for _ in range(160)]
    made, write = collections.Counter(), near_dedup.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        made[name] = max(made[name], out.count())
        return out

    monkeypatch.setattr(near_dedup.Scratch, "write", counted)
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert got == brute_classes(texts) and 40 < len(set(got.values())) < 160
    assert made["live"] <= 100 * len(texts) and made["pairs"] <= 32 * len(texts) and made["fine"] <= len(texts)


def test_recall_of_near_copies_with_edits_every_10_to_60_words(spark):
    """Words replaced, left out, put in or swapped: copies are found, other texts of the same vocabulary are left alone."""
    texts = []
    for k in range(120):
        rng, every = np.random.default_rng(k), 10 + 50 * k // 119
        words = prose(int(rng.integers(60, 600)), 800 + k).split(" ")
        copy = list(words)
        for at in range(len(copy) - int(rng.integers(1, every)), 0, -every):
            kind = rng.integers(4)
            if kind == 0:
                del copy[at]
            elif kind == 1:
                copy.insert(at, f"new{rng.integers(1000)}")
            elif kind == 2 and at > 1:
                copy[at - 1], copy[at] = copy[at], copy[at - 1]
            else:
                copy[at] = f"edit{rng.integers(1000)}"
        texts += [" ".join(words), " ".join(copy)]
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    found = [got[2 * k + 1] == 2 * k for k in range(120)]
    assert sum(found) >= 0.85 * 120 and sum(found[12:]) >= 0.95 * 108  # the second from 15 words on, where shingles align to 0.5
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(120))


def test_near_copies_are_alignments_of_words():
    rng, seen = np.random.default_rng(3), collections.Counter()
    for trial in range(150):
        a = prose(int(rng.integers(8, 120)), 900 + trial)
        x, y = near_dedup.items(a.encode()), near_dedup.items(edited(a, int(rng.integers(4, 30)), trial).encode())
        longest = near_dedup.common_words(x[1].tolist(), y[1].tolist())
        table = np.zeros((len(x[1]) + 1, len(y[1]) + 1), int)
        for i in range(len(x[1])):
            for j in range(len(y[1])):
                table[i + 1, j + 1] = table[i, j] + 1 if x[1][i] == y[1][j] else max(table[i, j + 1], table[i + 1, j])
        assert longest == table[-1, -1]
        total = len(x[0]) + len(y[0])
        want = longest >= 0.8 * (total - longest) and near_dedup.similar(x[0], y[0], near_dedup.SHARED)
        assert near_dedup.near_copies(x, y) == near_dedup.near_copies(y, x) == want
        seen[want] += 1
    assert min(seen.values()) > 20
    none = near_dedup.items(b"")
    assert not near_dedup.near_copies(none, none) and not near_dedup.near_copies(none, x)


def test_near_copies_of_very_long_texts():
    """A text of 400,000 words against a copy with a changed word in 20, and against one whose second half is another."""
    words = [f"w{i}" for i in np.random.default_rng(1).integers(0, 5000, 400_000)]
    text = near_dedup.items(" ".join(words).encode())
    assert near_dedup.near_copies(text, near_dedup.items(" ".join(w if i % 20 else "x" for i, w in enumerate(words)).encode()))
    assert not near_dedup.near_copies(text, near_dedup.items(" ".join([*words[:200_000], *words[:100_000:-1]]).encode()))


def test_links_share_something_beyond_known_shingles_or_may_be_told_by_size():
    rng = np.random.default_rng(5)
    seen = collections.Counter()
    for _ in range(4000):
        n = int(rng.integers(2, 60))
        p = rng.permutation(200)[:n]

        def vary(x, by):
            x = x[rng.random(len(x)) > by * rng.random()]
            return np.unique(np.concatenate([x, rng.integers(0, 1000, int(len(x) * by * rng.random()) + 1)]))

        a = vary(p, 0.5)
        b = vary(a, 0.25)
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.8:
            continue
        (x, in_a), (y, in_b) = (near_dedup.beyond(t.astype(np.uint64), p.astype(np.uint64), 0.8) for t in (a, b))
        by_size = len(b) <= in_a * 9 / 4 - len(a) + 1e-6 and len(a) <= in_b * 9 / 4 - len(b) + 1e-6
        seen[by_size] += 1
        assert by_size or len(np.intersect1d(x, y))
    assert min(seen.values()) > 50


# --- packing and tokens


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    ours = tokens.ByteBpe(tokens.vocabulary("byte_bpe_50k.tiktoken"), tokens.BYTE_BPE_SPECIAL)
    rng = np.random.default_rng(0)
    parts = [" ", "  ", "\n", "\r\n", "\t", "a", "Bc", " é", "漢", "'s", "1", "12", "!", "　", "\x1c", "\x85", "​", "🙂", "<|endoftext|>"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 25))) for _ in range(2000)] + [t or "" for _, t, *_ in ROWS]
    assert [ours.ids(t) for t in texts] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]  # the library's defaults
    assert any(50256 in ours.ids(t) for t in texts)
    theirs.encode_special_tokens = True
    ordinary = tokens.ByteBpe(tokens.vocabulary("byte_bpe_50k.tiktoken"))
    assert [ordinary.ids(t) for t in texts] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("batch", [1 << 18, 900])
def test_packing_round_trip(spark, clash, none, batch, monkeypatch):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    special = [(20, "<|endoftext|>"), (21, "a <|endoftext|>  b<|endoftext|><|endoftext|>\n"), (22, "<|endoftext|")]
    texts = clash.select("doc_id", "text", "length").unionByName(spark.createDataFrame([(*x, "own") for x in special], "doc_id long, text string, length string"))
    monkeypatch.setattr(packing, "BATCH_TOKENS", batch)
    got = rows(packing.pack(texts, block_tokens=20 * batch))
    ROWS = [*globals()["ROWS"], *special]
    ids = {r[0]: [*theirs.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in ROWS}
    covered = collections.Counter()
    for r in got:
        whole = ids[r["doc_id"]]
        assert r["ids"] == whole[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(whole)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        covered.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
    rows_of = collections.Counter(r[0] for r in ROWS)  # a row that repeats is a document of its own
    assert covered == {(d, k): rows_of[d] for d in ids for k in range(len(ids[d]))}
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append(r)
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces[:-1]]))
        n = sum(r["length"] for r in pieces)
        assert n == 1024 or n & (n - 1) == 0 and n < 1024
    assert rows(packing.pack(none)) == []


def test_best_fill_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 30, rng.integers(1, 6))}
        capacity = int(rng.integers(1, 60))
        sums = {0}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(c + 1)}
        got = packing.best_fill(counts, capacity)
        assert all(0 <= c <= counts[n] for n, c in got.items())
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= capacity)


# --- mixing


def test_waterfilling_targets(spark):
    rng = np.random.default_rng(2)
    for trial in range(4):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 2000, 5 + trial))}
        table = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "_g long, _source string, size long")
        got = {r["_source"]: r["target"] for r in rows(mixing.source_targets(table))}
        weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
        total, stopped = sum(sizes.values()), set()
        while True:
            open_ = [s for s in sizes if s not in stopped]
            left = total - 3 * sum(sizes[s] for s in stopped)
            want = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} | {s: 3 * sizes[s] for s in stopped}
            more = {s for s in open_ if want[s] > 3 * sizes[s]}
            if not more:
                break
            stopped |= more
        assert got == pytest.approx(want)


def test_mixing(spark, docs, clash, none):
    got = rows(mixing.mix(clash))
    assert len(got) == len(ROWS) and sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(docs.repartition(7)))))
    for r, want in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["size"])), sorted(ROWS, key=lambda r: (r[0] or 0, len(WORD.findall(r[1] or "")))), strict=True):
        assert r["size"] == len(WORD.findall(want[1] or "")) and 0 <= r["taken"] <= 3 * r["size"]
    assert rows(mixing.mix(none)) == []
    many = spark.createDataFrame([(i, prose(1 + i * 7 % 90, i), f"s{i % 4}" if i % 3 else "s0") for i in range(3000)], "doc_id long, text string, source string")
    taken = collections.defaultdict(float)
    goal = {}
    for r in rows(mixing.mix(many, carry=("source",))):
        key = r["source"]
        taken[key] += r["taken"]
        goal[key] = r["target"]
    assert all(abs(taken[k] - goal[k]) <= 2 * 90 for k in goal)  # twice the largest document
    again = mixing.take_mix(many)
    assert again.columns == many.columns and again.count() == sum(r["copies"] for r in rows(mixing.mix(many)))


# --- sharding


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 97, 1000):
        for seed in (0, 5):
            assert sorted(sharding.permute(i, n, seed) for i in range(n)) == list(range(n))


def test_sharding(spark, docs, clash, none):
    got = rows(sharding.shard(clash, shards=3))
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert rows(sharding.shard(none)) == []
    big = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for r in rows(sharding.shard(big)):
        p = sharding.permute(r["doc_id"], 2500)
        assert (r["shard"], r["slot"]) == (p % 40, p // 40)


# --- WARC


def test_warc_round_trip(spark):
    page = "<p>" + "é" * 700
    data = [(1, "http://a/1", page), (2, "http://a/2", page), (5, None, page), (3, "http://a/3", "short"), (4, "x\r\nEvil: y", "short"), (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\n\r\n" * 300)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("file", F.lit("own")).repartition(3)
    index, root = warc.write_archive(pages, file_bytes=500)
    got = {r["page_id"]: r for r in rows(warc.read_records(index, root))}
    assert len(got) == len(data) and all(r["whole"] for r in got.values())
    for i, _url, html in data:
        raw = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        again = html == page and i != 5
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if again else ("response", None))
        assert bytes(r["payload"]) == (b"" if again else raw)
    assert got[5]["url"] is None and got[1]["url"] == "http://a/1"
    some = rows(warc.read_records(index.where("page_id IN (3, 8)"), root))
    assert {r["page_id"] for r in some} == {3, 8}
    empty, root = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert rows(warc.read_records(empty, root)) == []


# --- quality rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    hit = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_rules(spark, docs, clash, none):
    rng = np.random.default_rng(0)
    texts = [t for _, t, *_ in ROWS] + [" ".join(rng.choice(["a", "b", "c"], 60)) for _ in range(20)] + [prose(30, 5) + "\n" + prose(30, 5) + "\n\n x|y \n x|y ", "*** $$$ " * 30]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("own"))
    for r in rows(quality_rules.quality_rules(table)):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_counts(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    assert rows(quality_rules.quality_rules(none)) == []
    kept = quality_rules.keep_good(clash)
    assert kept.columns == clash.columns and {r["doc_id"] for r in rows(kept)} <= {6, 7, 8, 9}


def test_fertility_is_what_the_two_libraries_say(spark):
    import math

    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    import base64

    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.vocabulary("byte_bpe_multi_50k.tiktoken"), "rb"))}
    raw = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [prose(80, 1), "漢字 " * 30, "zq\u0378\U000e0001 " * 25, "a" * 3000, "\n\n  x", "1 2 3 4 " * 9, "Привет мир " * 20, ""]
    got = {r["doc_id"]: r for r in rows(quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, t in enumerate(texts):
        ids = pieces.encode(t)
        if not ids:
            assert got[i]["chars_per_token"] is None and not got[i]["kept"]
            continue
        n, counts = len(ids), collections.Counter(ids)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        want = {"chars_per_token": len(t) / n, "chars_per_byte_token": len(t) / len(raw.encode_ordinary(t)), "byte_share": sum(pieces.is_byte(k) for k in ids) / n, "token_entropy": entropy, "n_tokens": n}
        assert {k: got[i][k] for k in want} == pytest.approx(want, abs=1e-9)
        low, high, low_bytes, most_bytes, at_64 = quality_rules.BANDS.get(got[i]["script"], quality_rules.OTHER_BAND)
        fits = low <= want["chars_per_token"] <= high and low_bytes <= want["chars_per_byte_token"] <= high and want["byte_share"] <= most_bytes and entropy >= at_64 + 0.34 * (math.log2(min(n, 1024)) - 6)
        assert got[i]["kept"] == (fits and not got[i]["base_failed"])


def test_scripts():
    assert [quality_rules.main_script(t) for t in ("abc", "привет", "漢字", "12 !", "", "かな")] == ["latin", "cyrillic", "han", "", "", "kana"]


# --- language


def test_viterbi_of_many_is_viterbi_of_each():
    rng = np.random.default_rng(0)
    scores = [rng.normal(0, 3, (int(n), 4)).astype(np.float32) for n in rng.integers(0, 40, 50)]
    for s, path in zip(scores, language_id.viterbi_many(scores, 4.0), strict=True):
        assert path.tolist() == (language_id.viterbi(s, 4.0).tolist() if len(s) else [])


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.normal(0, 3, (5, 3))
        value = lambda p, s=s: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(3), repeat=5), key=value)
        assert value(language_id.viterbi(s, 2.0)) == pytest.approx(value(best))


def test_language_id(spark, none):
    en, de, ru = "the quick brown fox jumps over the lazy dog and then it runs away", "der schnelle braune Fuchs springt über den faulen Hund und läuft dann weg", "быстрая лиса прыгает через ленивую собаку и убегает"
    data = [(i, t, lang) for i in range(60) for t, lang in ((en, "en"), (de, "de"), (ru, "ru"))]
    table = spark.createDataFrame(data + [(900, None, "en"), (901, "123 !?", "de")], "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    model = language_id.train(table)
    mixed = spark.createDataFrame([(1, f"{en} {en} {ru} {de}"), (2, None), (3, ""), (4, "42"), (5, ru), (None, de)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(language_id.identify(mixed, model))}
    assert got[1]["lang_pred"] == "en" and [s["lang"] for s in got[1]["spans"]] == ["en", "ru", "de"]
    assert sum(s["words"] for s in got[1]["spans"]) == len(f"{en} {en} {ru} {de}".split())
    assert got[5]["lang_pred"] == "ru" and got[5]["score"] == 1.0 and got[None]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in (2, 3, 4))
    unsure = model.label(["an", en, f"{en} {ru}"])  # few letters tell little; half of a text is of another language
    assert 1 / 3 < unsure[0]["score"] < unsure[1]["score"] <= 1.0 and unsure[2]["score"] < 0.7
    nothing = language_id.train(none)
    assert rows(language_id.identify(none, nothing)) == [] and {r["lang_pred"] for r in rows(language_id.identify(mixed, nothing))} == {"und"}


# --- quality model


def test_letters_of_any_script_have_a_language(spark):
    learn = [(i, "ສະບາຍດີ ຂອບໃຈ" if i % 2 else "hello thank you friend", "lo" if i % 2 else "en") for i in range(60)]
    odd = [(100, "ខ្មែរ"), (101, "ሰላም ነው"), (102, "ｈｅｌｌｏ"), (103, "µ"), (104, "१२३ ٤٥ 12"), (105, "،؟ !?"), (106, None), (107, "ສະບາຍ"), (108, "hello中文hello")]
    table = spark.createDataFrame(learn + [(i, t, None) for i, t in odd], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rows(language_id.identify(table, language_id.train(table)))}
    assert [got[i]["lang_pred"] == "und" for i in range(100, 109)] == [False] * 4 + [True] * 3 + [False] * 2
    assert got[107]["lang_pred"] == "lo" and got[104]["score"] == 0.0 and got[100]["score"] > 0
    words = language_id.Words(language_id.codes_of("hello中文hello x1"))
    assert (words.starts.tolist(), words.ends.tolist()) == ([0, 5, 7, 13], [5, 7, 12, 15])


def test_word_scores_are_sums_over_grams():
    model_table = np.random.default_rng(3).normal(size=(language_id.CELLS, 3)).astype(np.float32)
    text = "Grün 12 ab,c été"
    words = language_id.Words(language_id.codes_of(text))
    want = np.zeros((words.n, 3))
    codes = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    at = lambda i: codes[i] if 0 <= i < len(codes) else 0
    for w, (a, b) in enumerate(zip(words.starts, words.ends, strict=True)):
        for i in range(a, b):
            if not codes[i]:
                continue
            for k in language_id.GRAMS:  # grams start one place before the letter, single letters at it
                h = k
                for j in range(k):
                    h = (h ^ at(i + j - (k > 1))) * 0x01000193 % (1 << 32)
                    h ^= h >> 13
                want[w] += model_table[h % language_id.CELLS]
    assert language_id.word_scores(words, model_table) == pytest.approx(want, abs=1e-3)


def test_isotonic_is_least_squares_monotone():
    rows_, ones = np.array([4.0, 0, 2, 2, 4]), np.array([1.0, 0, 2, 0, 4])
    at, value = quality_model.isotonic(rows_, ones)
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all() and len(at) == 3


def test_isotonic_is_the_best_rising_fit():
    """Against the max-min formula of isotonic regression."""
    rng = np.random.default_rng(7)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        size = rng.integers(0, 5, n).astype(float)
        size[rng.integers(0, n)] += 1
        ones = np.floor(size * rng.random(n) + rng.random(n) * 0.5)
        at, value = quality_model.isotonic(size, np.minimum(ones, size))
        ones = np.minimum(ones, size)
        mean = lambda a, b: ones[a : b + 1].sum() / size[a : b + 1].sum()
        there = np.flatnonzero(size)
        best = [max(min(mean(a, b) for b in there[there >= i]) for a in there[there <= i]) for i in there]
        blocks = [len(list(g)) for _, g in __import__("itertools").groupby(np.round(best, 9))]
        assert len(at) == len(blocks) and (np.diff(at) > 0).all()
        ends = np.cumsum([0, *blocks])
        for k in range(len(blocks)):
            inside = there[ends[k] : ends[k + 1]]
            assert value[k] == pytest.approx((ones[inside].sum() + 0.5) / (size[inside].sum() + 1))


def test_summed_equations_are_one_dense_ridge(spark):
    """Weights fitted from partition sums against one dense solve over all rows; the features against the Gaussian kernel."""
    rng = np.random.default_rng(11)
    d = len(quality_model.STATISTICS)
    x = rng.normal(size=(400, d)).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    measured = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<float>").repartition(5)
    model = quality_model.fit(measured, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int"))
    learn = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in range(400)])
    assert model.to.mean == pytest.approx(x[learn].mean(axis=0), abs=1e-5)
    z = model.to(x[learn].astype(np.float64))
    ridge = np.eye(z.shape[1]) * (quality_model.RIDGE * learn.sum() + 0.05)
    ridge[-1, -1] = 1e-9
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + ridge, z.T @ y[learn]), rel=1e-6, abs=1e-8)
    wide = quality_model.Map(np.zeros(d), np.ones(d), features=20_000)
    a = rng.normal(size=(20, d))
    kernel = np.exp(-((a[:, None] - a[None]) ** 2).sum(axis=2) / (4.0 * d))
    assert np.abs(wide(a)[:, :-1] @ wide(a)[:, :-1].T - kernel).max() < 0.04


def test_quality_model(spark, docs, none):
    good = [(i, prose(50 + i % 40, i)) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "***" for w in prose(50, i).upper().split())) for i in range(300)]
    table = spark.createDataFrame(good + bad + [(5000, None), (5001, "")], "doc_id long, text string").withColumn("x", F.lit("own"))
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5000, None), (77777, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rows(quality_model.quality(table, labels))}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(i, r) for i, r in got.items() if r["held_out"] and i < 2000]
    assert np.mean([r["predicted"] == (i < 1000) for i, r in held]) > 0.97
    assert rows(quality_model.quality(none, labels)) == []
    assert {r["score"] for r in rows(quality_model.quality(docs, labels.where("false")))} == {0.5}


# --- licences


def brute_licence(text):
    return next((n for n, t in (("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0.")) if text and t in text), None)


def test_licenses(spark, none):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("a/LICENSE", mit), ("a/x.py", "code\nmore"), ("a/b/y.py", None), ("a/b/z.py", f"code here\n{apache}\nmore code words and so on"), ("a/b/c/COPYING", apache), ("a/b/c/d/w.py", ""), ("v.py", "nothing"), ("ab/u.py", "licence to fish"), (None, "text"), ("a/x.py", "again"),
    ]
    table = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string").withColumns({"licence": F.lit("own"), "term": F.lit("own")})
    got = {r["doc_id"]: r for r in rows(licenses.scan(table))}
    assert {i: r["licence"] for i, r in got.items()} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "Apache-2.0", 5: "Apache-2.0", 6: None, 7: None, 8: None, 9: "MIT"}
    assert got[5]["licence_dir"] == "a/b/c" and got[2]["licence_dir"] == "a" and got[3]["origin"] == "notice" and got[2]["origin"] == "inherited"
    assert rows(licenses.scan(none.select("doc_id", F.lit("p").alias("path"), "text"))) == []


def test_licence_similarity_is_the_cosine(spark):
    """Against TF-IDF computed row by row, with document frequencies over all passages and notices."""
    import math

    texts = ["Licensed under the Apache License", "License MIT MIT", "copyright by somebody else entirely", "This work is licensed under CC BY-NC 4.0. terms apply"]
    table = spark.createDataFrame([(i, f"f{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    terms = lambda t: re.findall(licenses.TERM, t.lower())
    notices = [(n, terms(t)) for n, ts in licenses.TEMPLATES.items() for t in ts]
    every = [terms(t) for t in texts] + [t for _, t in notices]
    vocabulary = {t for _, ts in notices for t in ts}
    idf = lambda t: math.log((1 + len(every)) / (1 + (sum(t in e for e in every) if t in vocabulary else 0))) + 1
    vec = lambda ts: {t: ts.count(t) * idf(t) for t in ts}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for r in rows(licenses.scan(table, least=0.0)):
        a = vec(terms(texts[r["doc_id"]]))
        best = max((sum(a[t] * b.get(t, 0) for t in a) / norm(a) / norm(b), n) for n, b in ((n, vec(t)) for n, t in notices))
        assert r["similarity"] == pytest.approx(best[0], abs=1e-6) and r["licence"] == best[1]


def test_a_short_document_does_not_license_its_folder(spark, tmp_path):
    """Half of a document's words or all of them in a notice: its neighbours still have no licence."""
    texts = ["Released under the MIT License.", "few words\nLicensed under the Apache License, Version 2.0.", "an unrelated document", None]
    spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["licence"], r["origin"], r["licence_dir"]) for r in rows(licenses.op7_licenses(spark, str(tmp_path)))}
    assert got == {0: ("MIT", "notice", None), 1: ("Apache-2.0", "notice", None), 2: (None, None, None), 3: (None, None, None)}


def test_licences_do_not_depend_on_corpus_size(spark):
    """Notices within longer sentences, whole or with a word missing, beside few passages and beside many."""
    wanted = {
        "Code licensed under the Apache License, Version 2.0.": "Apache-2.0", "Text licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This project is released under the MIT License.": "MIT",
        "Zyxwv, the 3.7 release of Qwert, is released under the MIT License. Nothing more.": "MIT", "The text of a page and of its list is licensed under Apache License, Version 2.0.": "Apache-2.0",
        "The text of a page has a licence somewhere.": None,
    }
    for n in (40, 4000):
        rows_ = [(i, f"f{i}", t) for i, t in enumerate(wanted)] + [(100 + i, f"g{i}", f"The text of a page and of its list {i} is of unknown licence.") for i in range(n)]
        got = {r["doc_id"]: r["licence"] for r in rows(licenses.scan(spark.createDataFrame(rows_, "doc_id long, path string, text string")))}
        assert [got[i] for i in range(len(wanted))] == list(wanted.values()) and sum(v is not None for v in got.values()) == 5


def test_each_licence_header_has_its_own_licence(spark):
    """Headers as they stand in source files, wrapped and behind comment marks, and titles of licence texts."""
    gnu = "# This {0} is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {1}General Public License as published by\n# the Free Software Foundation, either version {2} of the License, or\n# (at your option) any later version.\n#\n# This {0} is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU {1}General Public License for more details.\n#\n# You should have received a copy of the GNU {1}General Public License\n# along with this {0}.  If not, see <https://www.gnu.org/licenses/>."
    bsd = "Copyright (c) 2019, Somebody\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n{0}\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    third = "\n3. Neither the name of {0} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    files = [
        ("GPL-3.0", gnu.format("program", "", "3")), ("GPL-2.0", gnu.format("program", "", "2")), ("GPL-2.0", gnu.format("program", "", "2").replace("software:", "software;").replace("Foundation,", "Foundation;")),
        ("AGPL-3.0", gnu.format("program", "Affero ", "3")), ("LGPL-3.0", gnu.format("program", "Lesser ", "3")), ("LGPL-2.1", gnu.format("library", "Lesser ", "2.1")),
        ("BSD-2-Clause", bsd.format("")), ("BSD-3-Clause", bsd.format(third.format("the copyright holder"))), ("BSD-3-Clause", bsd.format(third.format("Example Industries"))),
        ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\nmore"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991"),
        ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007"), ("Apache-2.0", "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/"),
        ("Apache-2.0", "// Copyright 2020 A\n// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License."), ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
        ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell"),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ]
    for more in (0, 1500):
        table = [(i, f"d{i}/x.py", f"{t}\n\nimport zyx{i}\ncall(zyx{i})\n") for i, (_, t) in enumerate(files)] + [(100 + i, f"e{i}/y.py", f"copyright line {i} of nobody") for i in range(more)]
        got = {r["doc_id"]: r["licence"] for r in rows(licenses.scan(spark.createDataFrame(table, "doc_id long, path string, text string")))}
        assert [(got[i], t) for i, (_, t) in enumerate(files)] == files


def test_one_label_is_the_whole_best_path():
    import numpy as np

    from attesta.llm import language_id as LI

    rng = np.random.default_rng(5)
    told = 0
    for trial in range(2000):
        n, langs = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        own = rng.normal(0, rng.choice([0.5, 2, 5]), (n, langs)).astype(np.float32)
        own[:, trial % langs] += np.float32(rng.choice([0, 1, 3]))
        if trial % 5 == 0:
            own = np.round(own)  # ties
        want, label = LI.viterbi(own, 8.0), LI.one_label(own, 8.0)
        told += label is not None
        assert label is None or (want == label).all()
        assert (LI.viterbi_many([own, own[:0]], 8.0)[0] == want).all()
    assert told > 500
