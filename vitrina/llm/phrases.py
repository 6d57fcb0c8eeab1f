"""Phrase collocation mining over a vertically partitioned suffix tree of words.

The suffixes of all pieces of text, cut after ``max_words`` words, make a tree for
each language; a node's frequency is the total of the leaves below it.

1. Word prefixes are counted. One that begins more than an eighth of ``budget``
   suffixes is extended by a word and counted again, until none is too frequent or
   the prefix is a whole leaf.
2. Prefixes are dealt by hash to groups, so many that a group gets half a budget of
   suffixes on average. As no prefix is above an eighth, a group stays near that.
3. Every block of documents sorts its suffixes, counts equal ones, and sends each
   group its part as one compressed row. A group builds its subtrees on its own: the
   sorted leaves, cut into nodes wherever the first d words change, with sums of leaf
   counts. A node below its group's prefix is complete there; the prefixes above
   have their counts from step 1.

Frequencies of candidates and of their parts then meet by equi-joins on the phrase,
in which a very frequent part is spread by a salt.

What moves: one compressed row per block and group that meet (never more rows than
distinct suffixes of blocks), word and heavy-prefix counts with map-side sums, and
the phrases of at least ``min_count`` occurrences. Broadcast: 64-bit hashes of the
heavy prefixes, at most ``8 * words / budget`` for each length (``budget`` is a
parameter, to be raised with executor memory); a clash of two hashes only lets a
prefix be extended without need, and the same one in all tasks. The driver collects
these hashes and one total.

Defined cases: a null or empty text has no words; a null language is ``und``; ids
are not read, so repeated rows count each time; words of any length are kept whole;
a very long text is a block of its own; ties are settled by the contract's order;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, mix64, read_table

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2_000
#: Suffixes that a group holds in memory, about 150 bytes each at the peak.
BUDGET = 1_500_000
#: Characters whose suffixes are sorted at once.
BLOCK_CHARS = 6_000_000
#: Rows that a frequent part of phrases is spread over in the joins.
SALTS = 16

#: A-Z lowered, a tab is a space, and every mark that ends a piece is a line feed.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


class Words:
    """Numbers of the words of a block, from 1; 0 stands between pieces."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count(1).__next__)
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        number = self.number.__getitem__
        out = [0]
        for piece in text.translate(PLAIN).split(b"\n"):
            if ws := piece.split():
                out += map(number, ws)
                out.append(0)
        self.parts.append(np.array(out, np.int32))

    def suffixes(self, depth: int) -> np.ndarray:
        """Rows of ``depth`` word numbers for each word of the block; 0 behind the end of its piece."""
        line = np.concatenate([*self.parts, np.zeros(depth, np.int32)])
        at = np.flatnonzero(line)
        out = np.empty((len(at), depth), np.int32)
        out[:, 0] = line[at]
        for d in range(1, depth):
            out[:, d] = np.where(out[:, d - 1] > 0, line[at + d], 0)
        return out

    def strings(self) -> pa.Array:
        """Words by number; number 0 is the empty word."""
        return pa.array([b"", *self.number], pa.binary())

    def hashes(self, lang: bytes) -> np.ndarray:
        import xxhash

        seed = xxhash.xxh3_64_intdigest(lang)
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in (b"", *self.number)), np.uint64, len(self.number) + 1)


def sorted_rows(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with how often each occurs (or the sum of its ``counts``)."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    top = int(rows.max()) + 1
    if top ** rows.shape[1] < 2**63:
        key = rows[:, 0].astype(np.int64)
        for d in range(1, rows.shape[1]):
            key = key * top + rows[:, d]
        order = np.argsort(key)
    else:
        order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
    if counts is None:
        return rows[new], np.diff(np.r_[new, len(rows)])
    return rows[new], np.add.reduceat(counts[order], new)


def joined(strings: pa.Array, rows: np.ndarray) -> pa.Array:
    """Phrases of rows of word numbers, space-joined; 0 ends a row."""
    out = strings.take(pa.array(rows[:, 0]))
    for d in range(1, rows.shape[1]):
        more = rows[:, d] > 0
        if not more.any():
            break
        longer = pc.binary_join_element_wise(out, strings.take(pa.array(rows[:, d])), pa.scalar(b" ", pa.binary()))
        out = pc.if_else(pa.array(more), longer, out)
    return out


def prefix_hashes(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of the first 1, 2, ... words of each row, by column."""
    out = np.empty(rows.shape, np.uint64)
    out[:, 0] = mix64(hashes[rows[:, 0]])
    for d in range(1, rows.shape[1]):
        out[:, d] = mix64(out[:, d - 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[rows[:, d]])
    return out


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[dict[bytes, Words]]:
    """Words of (lang, text) rows by language, ``chars`` bytes of text at a time."""
    held: dict[bytes, Words] = {}
    size = 0
    for batch in batches:
        langs, texts = (batch.column(k).cast(pa.binary()) for k in (0, 1))
        for k in range(batch.num_rows):
            lang, text = langs[k].as_py(), texts[k].as_py()
            if size and size + len(text) > chars:
                yield held
                held, size = {}, 0
            if lang not in held:
                held[lang] = Words()
            held[lang].add(text)
            size += len(text)
    if held:
        yield held


def _strings(values: Sequence[bytes] | pa.Array) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string()) if not isinstance(values, pa.Array) else values.cast(pa.string())


def prefix_counts(texts: DataFrame, depth: int, heavy: Sequence[np.ndarray], block_chars: int) -> DataFrame:
    """(lang, phrase, f, hash) of the prefixes of ``depth`` words in (lang, text) rows whose shorter prefixes are all heavy."""
    sent = texts.sparkSession.sparkContext.broadcast(list(heavy))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = sent.value
        for block in blocks(batches, block_chars):
            for lang, words in block.items():
                rows = words.suffixes(depth)
                rows = rows[rows[:, -1] > 0]
                hashes = words.hashes(lang)
                for d, known in enumerate(heavy):
                    if not len(rows):
                        break
                    rows = rows[among(prefix_hashes(hashes, rows[:, : d + 1])[:, d], known)]
                rows, counts = sorted_rows(rows)
                if not len(rows):
                    continue
                found = prefix_hashes(hashes, rows)[:, -1].view(np.int64)
                langs = pa.array([lang.decode()] * len(rows))
                table = pa.Table.from_arrays([langs, _strings(joined(words.strings(), rows)), pa.array(counts, pa.int64()), pa.array(found)], names=["lang", "phrase", "f", "hash"])
                yield from table.to_batches(max_chunksize=10_000)

    counted = texts.mapInArrow(task, "lang string, phrase string, f long, hash long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.max("hash").alias("hash"))


def dealt(texts: DataFrame, depth: int, heavy: Sequence[np.ndarray], groups: int, block_chars: int) -> DataFrame:
    """(group, lang, leaves): the suffixes of each block, by group of their prefixes."""
    sent = texts.sparkSession.sparkContext.broadcast(list(heavy))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        heavy = sent.value
        compress = zstandard.ZstdCompressor(level=1).compress
        for block in blocks(batches, block_chars):
            for lang, words in block.items():
                rows, counts = sorted_rows(words.suffixes(depth))
                if not len(rows):
                    continue
                found = prefix_hashes(words.hashes(lang), rows)
                of, open_ = found[:, 0], np.ones(len(rows), bool)
                for d, known in enumerate(heavy):
                    open_ &= among(found[:, d], known)  # a prefix that is not heavy is not extended
                    of = np.where(open_ & (rows[:, d + 1] > 0), found[:, d + 1], of)
                    open_ &= rows[:, d + 1] > 0
                group = (of % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")  # leaves of a group stay in order
                group, rows, counts = group[order], rows[order], counts[order]
                lines = pc.binary_join_element_wise(joined(words.strings(), rows), pa.scalar(b"", pa.binary()), pa.scalar(b"\n", pa.binary()))
                at, text = np.frombuffer(lines.buffers()[1], np.int32)[: len(rows) + 1], lines.buffers()[2].to_pybytes()
                starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                ends = np.r_[starts[1:], len(group)]
                for a in range(0, len(starts), 64):
                    parts = [text[at[s] : at[e] - 1] for s, e in zip(starts[a : a + 64], ends[a : a + 64], strict=True)]
                    sizes = [counts[s:e].astype("<u4").tobytes() for s, e in zip(starts[a : a + 64], ends[a : a + 64], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group[starts[a : a + 64]]), pa.array([lang.decode()] * len(parts)), pa.array([compress(p) for p in parts], pa.binary()), pa.array([compress(c) for c in sizes], pa.binary())],
                        names=["group", "lang", "leaves", "counts"],
                    )

    return texts.mapInArrow(task, "group long, lang string, leaves binary, counts binary")


def subtrees(parts: DataFrame, depth: int, heavy: Sequence[np.ndarray], min_count: int) -> DataFrame:
    """(lang, phrase, words, f) of the nodes of two words and more that are complete in their group."""
    sent = parts.sparkSession.sparkContext.broadcast(list(heavy))
    names = ["lang", "phrase", "words", "f"]

    def nodes(lang: str, leaves: list[bytes], counts: np.ndarray, heavy: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        split = pc.split_pattern(pa.array(leaves, pa.large_binary()), b" ")
        lengths = pc.list_value_length(split).to_numpy()
        coded = pc.dictionary_encode(split.flatten())
        rows = np.zeros((len(leaves), depth), np.int32)
        rows[np.arange(depth) < lengths[:, None]] = coded.indices.to_numpy() + 1
        strings = pa.concat_arrays([pa.array([b""], pa.large_binary()), coded.dictionary]).cast(pa.binary())
        rows, counts = sorted_rows(rows, counts)
        words = Words()
        words.number = dict.fromkeys(strings.to_pylist()[1:])
        found = prefix_hashes(words.hashes(lang.encode()), rows)
        extended = np.ones(len(rows), bool)  # all shorter prefixes are heavy: the node is spread over groups
        new = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
        for d in range(1, depth):
            extended &= among(found[:, d - 1], heavy[d - 1]) if d - 1 < len(heavy) else False
            new = new | np.r_[True, rows[1:, d] != rows[:-1, d]]
            starts = np.flatnonzero(new)
            totals = np.add.reduceat(counts, starts)
            spread = extended[starts] & among(found[starts, d], heavy[d]) if d < len(heavy) else np.zeros(len(starts), bool)
            kept = (rows[starts, d] > 0) & (totals >= min_count) & ~spread
            if kept.any():
                at = starts[kept]
                phrases = joined(strings, rows[at, : d + 1])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), _strings(phrases), pa.array(np.full(len(at), d + 1, np.int32)), pa.array(totals[kept].astype(np.int64))], names=names)

    def build(group: pa.Table) -> pa.Table:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        out = []
        for lang in sorted(set(group["lang"].to_pylist())):
            here = group.filter(pc.equal(group["lang"], lang))
            leaves = [x for blob in here["leaves"] for x in decompress(blob.as_py()).split(b"\n")]
            counts = np.concatenate([np.frombuffer(decompress(blob.as_py()), "<u4") for blob in here["counts"]]).astype(np.int64)
            out += nodes(lang, leaves, counts, sent.value)
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])
        return pa.Table.from_batches(out, schema)

    return parts.groupBy("group").applyInArrow(build, "lang string, phrase string, words int, f long")


def frequencies(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, budget: int = BUDGET, block_chars: int = BLOCK_CHARS, text_col: str = "text", lang_col: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``max_words`` words that occur ``min_count`` times, and (lang, n)."""
    texts = docs.where(F.length(text_col) > 0).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = checkpoint(prefix_counts(texts, 1, [], block_chars))
    total = words.agg(F.sum("f")).first()[0] or 0
    limit = max(1, budget // 8)
    known = [words.select("lang", "phrase", F.lit(1).alias("words"), "f").where(F.col("f") >= min_count)]
    heavy: list[np.ndarray] = []
    counted = words
    for depth in range(1, max_words):
        found = np.sort(np.array([r.hash for r in counted.where(F.col("f") > limit).select("hash").collect()], np.int64).view(np.uint64))
        if not len(found):
            break
        heavy.append(found)
        if depth + 1 < max_words:
            counted = checkpoint(prefix_counts(texts, depth + 1, heavy, block_chars))
            spread = counted.join(counted.where(F.col("f") > limit).select("hash").distinct(), "hash", "left_semi")
            known.append(spread.where(F.col("f") >= min_count).select("lang", "phrase", F.lit(depth + 1).alias("words"), "f"))
    groups = max(1, -(-2 * total // budget))
    parts = dealt(texts, max_words, heavy, groups, block_chars)
    found = subtrees(parts, max_words, heavy, min_count)
    for other in known:
        found = found.union(other)
    return checkpoint(found), words.groupBy("lang").agg(F.sum("f").alias("n"))


def score_of(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in whole numbers of up to 38 digits."""
    return F.expr(f"CAST({a} AS DECIMAL(18,0)) * 1000000 * CAST({a} AS DECIMAL(13,0)) div (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0)))")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int | None = TOP, budget: int = BUDGET, block_chars: int = BLOCK_CHARS, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of two words and more, best first; ``top`` a language."""
    counts, totals = frequencies(docs, min_count, max_words, budget, block_chars, text_col, lang_col)
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a")).withColumn("ws", F.split("phrase", " "))
    cuts = candidates.select(
        "lang", "phrase", "words", "a", "ws", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("ws", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
        (F.abs(F.xxhash64("phrase") % SALTS)).alias("salt"),
    )

    def parts(name: str, as_: str) -> DataFrame:
        spread = counts.where(F.col("words") < max_words).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(as_))
        return spread.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))

    for name, as_ in (("first", "l"), ("rest", "r")):
        on = (F.col("lang") == F.col("_lang")) & (F.col(name) == F.col("_phrase")) & (F.col("salt") == F.col("_salt"))
        cuts = cuts.join(parts(name, as_), on).drop("_lang", "_phrase", "_salt", name)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = cuts.withColumn("score", score_of("a", "l", "r")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best")).select("lang", "phrase", "best.*")
    places = F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)
    inner = (
        candidates.where("words > 2")
        .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("at", F.explode(places))
        .select("lang", F.array_join(F.slice("ws", F.col("at"), F.col("m")), " ").alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("_longer"))
        .select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "_longer")
    )
    inside = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (100 * wide("_longer") >= 50 * wide("a"))
    kept = scored.join(inner, inside, "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # the best of a language are among the best of its parts
        for some in (max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 8):
            part = W.partitionBy("lang", F.abs(F.xxhash64("phrase") % some)).orderBy(*order)
            kept = kept.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = totals.select(F.col("lang").alias("_lang"), "n")
    return ranked.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two and three words of each language."""
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH p AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, m AS words, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, {MAX_WORDS} + 1)) AS m) WHERE len(ws) >= m
), f AS MATERIALIZED (
  SELECT lang, words, phrase, COUNT(*) AS f FROM g GROUP BY ALL HAVING COUNT(*) >= {MIN_COUNT}
), n AS (
  SELECT lang, CAST(SUM(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1
), k AS (
  SELECT lang, phrase, words, a, ws, unnest(range(1, words)) AS k FROM c
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[: k.k], ' ')
  JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1 :], ' ')
), b AS (
  SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, phrase, MAX(a) AS a FROM (
    SELECT lang, a, unnest(list_transform(range(1, words - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase
    FROM c, (SELECT unnest(range(2, {MAX_WORDS})) AS m) WHERE words > m
  ) GROUP BY ALL
), o AS (
  SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.a IS NULL OR 100 * i.a < 50 * b.a
)
SELECT o.lang, ROW_NUMBER() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= {TOP}
"""
