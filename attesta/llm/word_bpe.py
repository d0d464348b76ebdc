"""Word-level BPE over a trie of distinct words.

The tokens of a word are those of its first part and one more: if the encoding
of a prefix is known by its last token, the prefix' encoding is followed back
from there, token by token. So the state of a prefix is one token: among the
tokens that the prefix ends with, the only one that may stand behind the state
of what comes before it. Two tokens may stand side by side if no merge of the
vocabulary would have joined their inner ends before the tokens were complete.

Distinct words, sorted, with the depth at which each leaves the one before, are
a trie in depth-first order. Going through it, the states of a shared prefix
are computed once for all words that start with it.
"""

from __future__ import annotations

import array
import json
import math
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import table
from .tokens import vocabulary

# Fixed values of the public vocabulary: the pattern that words are found by, and the mark at the end of a word's last token.
_CONTRACTED = r"'s|'t|'re|'ve|'m|'ll|'d"
WORDS = regex.compile(_CONTRACTED + r"|\p{L}+|\p{N}|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+")
ASCII_WORDS = re.compile(_CONTRACTED + r"|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Characters outside the scripts in which all editions of Unicode agree on letters and digits.
ODD = re.compile(r"[^\x00-ԯא-תء-يअ-हḀ-⁯₠-₿℀-⯿　-鿯가-힣＀-￯\U0001f300-\U0001f64f]")
#: Words whose encodings a task keeps, and the longest of them.
CACHED_WORDS, CACHED_CHARS = 400_000, 200
#: Tokens of a batch on its way out.
BATCH_TOKENS = 1 << 18
_LAST = 256  # a word's last byte is another symbol than the same byte within


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes are numbered from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieBpe:
    """Encodes distinct words with a vocabulary file that gives merges and an end-of-word mark.

    Inside, a word is a string of symbols: a character for each byte, and
    another one for a last byte.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, letters = whole["model"], byte_letters()
        mark = model["end_of_word_suffix"]
        self.text = {i: s for s, i in model["vocab"].items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}

        def symbols(token: str) -> str:
            last = token.endswith(mark) and len(token) > len(mark)
            codes = [letters[c] for c in (token.removesuffix(mark) if last else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + _LAST * last)

        tokens = {symbols(s): i for s, i in model["vocab"].items()}
        self.size = {i: len(s) for s, i in tokens.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            pair, made = (model["vocab"][left], model["vocab"][right]), model["vocab"][left + right]
            if made in self.parts or max(self.rank.get(p, -1) for p in pair) >= rank:
                raise ValueError("every token must have one merge, after those of its parts")
            self.parts[made], self.rank[made], self.joined[pair] = pair, rank, rank
        self._spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._fits: dict[tuple[int, int], bool] = {}
        # a token that its own merges never complete is no state
        sound = {i for i in self.size if i not in self.parts}
        for made, (left, right) in self.parts.items():  # in order of rank
            if left in sound and right in sound and self._no_merge_before(left, right, self.rank[made]):
                sound.add(made)
        self.tokens = {s: i for s, i in tokens.items() if i in sound}
        #: By the last four symbols of a token: how long such tokens are, longest first.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for token in self.tokens:
            if len(token) > 3:
                self.lengths[token[-4:]] = tuple(sorted({*self.lengths.get(token[-4:], ()), len(token)}, reverse=True))

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at the token's end (side 1) or start (0) as it is put together, each with the rank of the merge that takes it in."""
        known = self._spines[side]
        if token not in known:
            out: list[tuple[int, float]] = [(token, math.inf)]
            while out[-1][0] in self.parts:
                whole = out[-1][0]
                out.append((self.parts[whole][side], self.rank[whole]))
            known[token] = out
        return known[token]

    def _no_merge_before(self, left: int, right: int, limit: float) -> bool:
        """Whether nothing joins across the border before rank ``limit``; of merges of one rank the leftmost is first."""
        for x, x_goes in self._spine(left, 1):
            for y, y_goes in self._spine(right, 0):
                rank = self.joined.get((x, y))
                if rank is not None and rank < limit and rank < x_goes and rank <= y_goes:
                    return False
        return True

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= 1 << 20:
                self._fits.clear()
            known = self._fits[key] = self._no_merge_before(left, right, math.inf)
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word."""
        named = {}
        for word in words:
            data = word.encode().decode("latin-1")
            named[data[:-1] + chr(ord(data[-1]) + _LAST)] = word
        paths = sorted(named)
        last = [-1] * (1 + max(map(len, paths), default=0))  # by depth: the state of the path's prefix
        out, before = {}, ""
        for path in paths:
            for depth in range(len(os.path.commonprefix((before, path))) + 1, len(path) + 1):
                last[depth] = self._state(path, depth, last)
            ids, depth = [], len(path)
            while depth:
                ids.append(last[depth])
                depth -= self.size[last[depth]]
            out[named[path]] = ids[::-1]
            before = path
        return out

    def _state(self, path: str, depth: int, last: list[int]) -> int:
        long = self.lengths.get(path[depth - 4 : depth], ()) if depth > 3 else ()
        for n in (*long, 3, 2, 1):
            if n <= depth:
                token = self.tokens.get(path[depth - n : depth])
                if token is not None and (n == depth or self.fits(last[depth - n], token)):
                    return token
        raise ValueError("the vocabulary lacks a byte")


def words_of(text: str) -> list[str]:
    """Words as the public vocabulary's file finds them: canonical composition, lower case, white space dropped."""
    if text.isascii():
        return ASCII_WORDS.findall(text.lower())
    # lower case goes by the character: a sigma at a word's end is like any other
    return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


@lru_cache(maxsize=1)
def _texts(path: str) -> _Texts:
    """One for a worker: its tasks share the vocabulary and the words that it knows."""
    return _Texts(path)


class _Texts:
    """Encodes and decodes texts; a word's ids and decoded tokens are kept as the bytes and text that are joined."""

    def __init__(self, path: str):
        self.bpe, self.letters = TrieBpe(path), byte_letters()
        self.library = Tokenizer.from_file(path)
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[bytes, str]] = {}

    def _learn(self, words: set[str]) -> dict[str, tuple[bytes, str]]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        text = self.bpe.text
        made = {w: (array.array("i", ids).tobytes(), " ".join([text[i] for i in ids])) for w, ids in self.bpe.encode_words(words - self.known.keys()).items()}
        self.known |= {w: x for w, x in made.items() if len(w) <= CACHED_CHARS}
        return self.known if self.known.keys() >= made.keys() else self.known | made

    def encoded(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids, decoded) of each text; the distinct words of all the texts are encoded together."""
        cut, distinct = [], set()
        for text in texts:
            parts = [[p] if i % 2 else self.words(p) for i, p in enumerate(self.added.split(text) if "<|" in text else [text])]
            distinct.update(*parts[::2])
            cut.append(parts)
        known = self._learn(distinct)
        special = {s: (array.array("i", [i]).tobytes(), s) for s, i in self.bpe.special.items()}
        for parts in cut:
            got = [(special if i % 2 else known)[w] for i, words in enumerate(parts) for w in words]
            yield b"".join([x[0] for x in got]), " ".join([x[1] for x in got])

    def words(self, text: str) -> list[str]:
        """``words_of``; texts with letters that libraries class by their edition of Unicode are cut by the file's own parts."""
        if not ODD.search(text):
            return words_of(text)
        whole = self.library.normalizer.normalize_str(text)
        return [bytes(self.letters[c] for c in piece).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]


def _encoder(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _texts(path)

        def out(ids: list, ids_bytes: list[bytes], decoded: list[str]) -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(x) // 4 for x in ids_bytes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids_bytes), np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

        for batch in batches:
            ids, column, at = batch.column(0).to_pylist(), batch.column(1), 0
            while at < len(batch):
                some, size, first = [], 0, at
                while at < len(batch) and size < 4 * BATCH_TOKENS:  # texts of a batch are taken by their size: they may be long
                    some.append(column[at].as_py() or "")
                    size += len(some[-1])
                    at += 1
                got = list(texts.encoded(some))
                yield out(ids[first:at], [x[0] for x in got], [x[1] for x in got])

    return rows


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): each text's token ids and what the vocabulary decodes them to.

    The ids are those of the ``tokenizers`` library without special tokens of
    its own; where a text holds an added token's string, that is the token.
    ``decoded`` joins the tokens' texts by spaces, as that library does for a
    file without a decoder. One narrow pass: nothing is shuffled, a task holds
    some texts (one, if it is long), and each distinct word of them is encoded
    once. Null and empty texts have no ids and decode to the empty text; rows
    that repeat an id are texts of their own; an empty table gives no rows;
    other columns are ignored.
    """
    path = path or vocabulary("word_bpe_49k.json")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_encoder(path), "doc_id long, ids array<int>, decoded string")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("ids")
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
