"""Collocations by Suffix-sigma: one shuffle of truncated suffixes counts phrases of every length.

Every word of a piece of text starts a suffix, cut to ``max_n`` words; its first
1, 2, ... words are all the phrases that start there. Suffixes are dealt out by
ranges of language and first word (of the next words too where one word, or a
pair of them, is more than a task's share) and sorted in reverse order, so that
all occurrences of a phrase come in a row and one stack of open prefixes counts
every length in one pass. Only the prefixes that are open at the two ends of a
range can go on in the next one: they leave as parts, and parts of a phrase are
added up and held against the threshold afterwards. Each range is small work
whatever the words: equal suffixes of a block of texts are one row with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

MAX_N = 4
LEAST = 30
TOP = 2000
#: A phrase inside a longer candidate goes if the longer one has this share (in hundredths) of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: What ends a piece of text (fixed values), and white space between words.
ENDS = r"[.,;:!?\x0A-\x0D]"
#: Bytes of text that are cut into suffixes and counted at a time.
BLOCK_BYTES = 8 << 20
#: Rows that the stack takes at a time.
STACK_ROWS = 1 << 18
#: A part of phrases is broadcast if more than one word in so many starts it: so many parts of each length at most.
COMMON = 10_000


# --- map side: suffixes of a block of texts ----------------------------------


def _marked(lang: str) -> str:
    """A language as a word without white space; an empty one is a lone per cent sign."""
    return quote(lang, safe="") or "%"


def _joined(*parts: pa.Array | str) -> pa.Array:
    text = pa.large_string()
    return pc.binary_join_element_wise(*[pa.scalar(p, text) if isinstance(p, str) else p for p in parts], pa.scalar("", text))


def suffix_counts(texts: pa.Array, langs: pa.Array, max_n: int) -> pa.RecordBatch:
    """(suffix, n) of the distinct truncated suffixes of a block of texts, in order.

    A suffix is its language and its words, each with a space behind it. Words
    become numbers in the order of their bytes, so equal suffixes are found, and
    put in order, by sorting numbers.
    """
    marked = pc.replace_substring_regex(pc.ascii_lower(texts.cast(pa.large_string())), ENDS, " . ")
    words = pc.ascii_split_whitespace(_joined(marked, " . "))
    of_text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    flat = words.flatten()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    flat, of_text = flat.filter(pa.array(there)), of_text[there]
    coded = flat.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    w = rank[coded.indices.to_numpy()]
    stop = pc.index(names, ".").as_py() + 1  # every text ends with one
    w[w == stop] = 0
    starts = np.flatnonzero(w)
    padded = np.concatenate([w, np.zeros(max_n, np.int64)])
    lang = langs.dictionary_encode()
    columns, going = [lang.indices.to_numpy()[of_text[starts]].astype(np.int64)], np.ones(len(starts), bool)
    for k in range(max_n):
        going &= padded[starts + k] > 0
        columns.append(np.where(going, padded[starts + k], 0))
    # fold the columns into one number that sorts like the row; before it would overflow, numbers give way to their ranks
    key, size, base = columns[0], len(lang.dictionary), len(names) + 1
    for c in columns[1:]:
        if size * base >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key, size = key * base + c, size * base
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    tagged = pa.array([_marked(x) + " " for x in lang.dictionary.to_pylist()], pa.large_string())
    parts = [tagged.take(pa.array(columns[0][first]))]
    spaced = pa.concat_arrays([pa.array([""], pa.large_string()), _joined(names, " ")])
    parts += [spaced.take(pa.array(c[first])) for c in columns[1:]]
    return pa.RecordBatch.from_arrays([_joined(*parts).cast(pa.string()), pa.array(n.astype(np.int64))], names=["suffix", "n"])


def _suffixes(max_n: int, block_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(block).combine_chunks()
            out = suffix_counts(whole.column(1).combine_chunks(), whole.column(0).combine_chunks(), max_n)
            for at in range(0, len(out), STACK_ROWS):
                yield out.slice(at, STACK_ROWS)

        for batch in batches:
            ends, at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64), 0
            while at < len(batch):  # a block closes with the text that fills it, however long that is
                before = int(ends[at - 1]) if at else 0
                upto = min(int(np.searchsorted(ends, before + block_bytes - size)) + 1, len(batch))
                block.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1]) - before
                at = upto
                if size >= block_bytes:
                    yield from counted()
                    block, size = [], 0
        if block:
            yield from counted()

    return rows


# --- reduce side: one stack of open prefixes ----------------------------------


class PrefixStack:
    """Counts of the prefixes of suffixes that come in reverse order.

    Level k of the stack is the open prefix of k words (level 0: the language
    alone) with its count. A block of rows is pushed at once: where a row
    differs from the one before in its first k words, level k closes and opens
    anew, and the counts between two such rows are a prefix's. The stack itself
    enters the next block as its first row, which counts for each level what
    that level holds. Prefixes under ``least`` are left out, unless they touch
    an end of the range and may go on in another one.
    """

    def __init__(self, max_n: int, least: int):
        self.levels, self.least = max_n + 1, least
        self.last: str | None = None
        self.held = [0] * self.levels
        self.edge = [True] * self.levels
        self.out: list[tuple[str, int, int]] = []

    def push(self, suffixes: pa.Array, counts: np.ndarray) -> None:
        carried = self.last is not None
        if carried:
            suffixes = pa.concat_arrays([pa.array([self.last], suffixes.type), suffixes])
            counts = np.concatenate([[0], counts])
        words = pc.split_pattern(suffixes, " ")
        at = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode().indices.to_numpy()
        size = np.diff(at) - 1  # behind the last space there is an empty string
        new = np.zeros(len(counts), bool)
        new[0] = True
        for k in range(self.levels):
            code = np.full(len(counts), -1, np.int64)
            code[size > k] = coded[at[:-1][size > k] + k]
            new[1:] |= code[1:] != code[:-1]
            if carried:
                counts[0] = self.held[k]
            starts = np.flatnonzero(new)
            sums, real = np.add.reduceat(counts, starts), code[starts] >= 0
            leaves = real & ((sums >= self.least) | (k == 0))
            leaves[0] |= real[0] & self.edge[k]
            leaves[-1] = False  # the last one stays open
            for i in np.flatnonzero(leaves):
                self._leave(suffixes[int(starts[i])].as_py(), k, int(sums[i]))
            self.held[k] = int(sums[-1]) if real[-1] else 0
            self.edge[k] &= len(starts) == 1
        self.last = suffixes[len(suffixes) - 1].as_py()

    def _leave(self, suffix: str, k: int, n: int) -> None:
        self.out.append((" ".join(suffix.split(" ", k + 1)[: k + 1]), k, n))

    def end(self) -> None:
        """What is open at the end of a range leaves whatever its count."""
        for k, n in enumerate(self.held):
            if n:
                self._leave(self.last, k, n)

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        head = [x.split(" ", 1) for x, _, _ in rows]
        arrays = [pa.array(["" if h[0] == "%" else unquote(h[0]) for h in head], pa.string()), pa.array([h[1] if len(h) > 1 else "" for h in head], pa.string()), pa.array([k for _, k, _ in rows], pa.int32()), pa.array([n for _, _, n in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "words", "n"])


def _prefixes(max_n: int, least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, waiting, size = PrefixStack(max_n, least), [], 0

        def push() -> None:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            stack.push(whole.column(0).combine_chunks(), whole.column(1).to_numpy())

        for batch in batches:
            if len(batch):
                waiting.append(batch)
                size += len(batch)
            if size >= STACK_ROWS:
                push()
                waiting, size = [], 0
                yield stack.take()
        if waiting:
            push()
        stack.end()
        yield stack.take()

    return rows


# --- the operator --------------------------------------------------------------


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, words, n): how often each phrase of 1 to ``max_n`` words occurs, from ``least`` on.

    Texts are lower-cased (A-Z), cut at ``ENDS`` into pieces and those at spaces
    and tabs into words; a null language is ``und``, a null text empty.
    Occurrences may overlap. The row with 0 words counts all words of a
    language. A part of a phrase that is counted is counted too, for it occurs
    at least as often.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    suffixes = texts.mapInArrow(_suffixes(max_n, block_bytes), "suffix string, n long")
    ranges = suffixes.repartitionByRange(n, "suffix").sortWithinPartitions(F.desc("suffix"))
    parts = ranges.mapInArrow(_prefixes(max_n, least), "lang string, phrase string, words int, n long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("words") == 0) | (F.col("n") >= least))


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _looked_up(parts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``parts`` (lang, part, ...) with ``f``, the part's count.

    Thousands of phrases may share a part such as a common word. Parts that one
    word in ``COMMON`` starts are broadcast: of each length there are at most
    ``COMMON``. The others belong to few phrases each and are joined by a shuffle.
    """
    f = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    common = F.col("f") * F.lit(COMMON).cast("decimal(10,0)") > F.lit(total).cast("decimal(19,0)")
    known = parts.join(F.broadcast(f.where(common)), ["lang", "part"], "left")
    rest = known.where("f IS NULL").drop("f").join(f.where(~common), ["lang", "part"])
    return known.where("f IS NOT NULL").unionByName(rest)


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, covered: int = COVERED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``max_n`` words.

    ``a`` is the phrase's count; of its cuts into two parts with counts ``l``
    and ``r`` the one with the least score floor(2000000 a / (l + r)) counts,
    the first of equal ones. A phrase that lies inside a longer one which has
    ``covered`` hundredths of its occurrences goes. Ranked by score, count and
    the phrase's bytes. ``n`` counts the language's words.

    Whole texts are read, nothing is capped; memory of a task is a block of
    texts (the longest text at least) or a block of suffixes. A language of
    which all rows are is spread over all tasks like any other: ranges split
    it, and the ranking first takes the best of many small shares. Rows that
    repeat an id are texts of their own; an empty table, or texts without a
    phrase that is frequent enough, give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    counts = materialize(phrase_counts(docs, max_n, least, text_col, lang_col), "phrases")
    sizes = counts.where("words = 0").select("lang", F.col("n").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    part = lambda from_, n: F.array_join(F.slice(F.split("phrase", " "), from_, n), " ")
    cuts = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), (part(1, F.lit(k)) if side == "l" else part(k + 1, F.col("words") - k)).alias("part")) for k in range(1, max_n) for side in "lr"]
    rows = found.select("lang", "phrase", "a", F.explode(F.filter(F.array(*[F.when(F.col("words") > k, c) for k, c in zip([k for k in range(1, max_n) for _ in "lr"], cuts, strict=True)]), lambda c: c.isNotNull())).alias("c")).select("lang", "phrase", "a", "c.*")
    held = _looked_up(rows, counts.where(f"words BETWEEN 1 AND {max_n - 1}"), total)
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    wide = held.groupBy("lang", "phrase", "a").agg(*[of(k, s).alias(f"{s}{k}") for k in range(1, max_n) for s in "lr"])

    def cut(k: int) -> Column:
        l, r = F.col(f"l{k}"), F.col(f"r{k}")
        score = F.expr(f"CAST({SCALE} * CAST(a AS DECIMAL(19,0)) DIV (CAST(l{k} AS DECIMAL(19,0)) + CAST(r{k} AS DECIMAL(19,0))) AS BIGINT)")
        return F.when(l.isNotNull() & r.isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))

    scored = wide.select("lang", "phrase", "a", F.array_min(F.filter(F.array(*[cut(k) for k in range(1, max_n)]), lambda c: c.isNotNull())).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    inner = [F.when((F.col("words") > m) & (F.col("words") >= s + m - 1), part(s, F.lit(m))) for m in range(2, max_n) for s in range(1, max_n - m + 2)]
    over = found.where("words > 2").select("lang", F.explode(F.array_distinct(F.filter(F.array(*inner), lambda x: x.isNotNull()))).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    inside = 100 * _exact(F.col("b")) >= covered * _exact(F.col("a"))
    kept = scored.join(over, ["lang", "phrase"], "left").where(~F.coalesce(inside, F.lit(False))).drop("b")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*best)
    kept = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return kept.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("size").alias("n"), "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same in SQL, by joins of word positions."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS words, array_to_string(w[i:i+{k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, MAX_N + 1)
    )
    inner = " UNION ALL ".join(f"SELECT lang, array_to_string(w[{s}:{s + m - 1}], ' ') AS phrase, a AS b FROM found WHERE words = {n}" for n in range(3, MAX_N + 1) for m in range(2, n) for s in range(1, n - m + 2))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {k} AS k, array_to_string(w[1:{k}], ' ') AS p, array_to_string(w[{k + 1}:], ' ') AS q FROM found WHERE words > {k}" for k in range(1, MAX_N))
    return f"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
    sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}),
    found AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
    cuts AS ({cuts}),
    scored AS (SELECT c.*, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = p JOIN f y ON y.lang = c.lang AND y.phrase = q),
    least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    over AS (SELECT lang, phrase, max(b) AS b FROM ({inner}) GROUP BY ALL),
    kept AS (SELECT s.* FROM least s LEFT JOIN over o ON o.lang = s.lang AND o.phrase = s.phrase WHERE NOT coalesce(100::HUGEINT * b >= {COVERED}::HUGEINT * a, false)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT r.lang, rank, phrase, a, l, r.r AS r, n, score FROM ranked r JOIN sizes USING (lang) WHERE rank <= {TOP}"""


OP12_SQL = _oracle()
