"""Best-fit packing of documents into sequences of a fixed capacity.

Documents become token ids and an end mark; only a document longer than the
capacity is cut, into whole pieces behind a first one that takes the remainder.
Every piece then needs a place in a sequence, and there are at most ``capacity``
different lengths. So the plan is made on the count of each length alone:

1. Exact complements. From the longest length down, what is missing to the
   capacity is looked up among single lengths, sums of pairs and sums of triples
   that are in stock. A combination that fills the gap exactly is consumed as often
   as its scarcest length allows, all at once.
2. Best fit. What is left goes, longest first, into the sequences with the
   tightest gap that takes it, or opens new ones; again whole counts at a time.

Pieces are numbered by length (a count inside a task, plus prefix sums of the
counts per task), and the n-th piece of a length takes the n-th place planned for
that length. No piece is ever compared with another.

What moves: the tokens never do. Each piece is a row of numbers that is written
to the checkpoint folder once (so that numbers and plan agree if an executor is
lost) and joined with the counts of its task and length. The driver takes one
count a length and sends the runs of the plan: at most a few thousand patterns
of at most sqrt(2 * capacity) lengths, whatever the table holds.

Defined cases: a null or empty text is the end mark alone; ids may be null or
repeated, as every row is packed by its place in the table; a very long text is
encoded by one call (memory in proportion to that text) and its pieces are rows
of their own; an empty table gives no rows; columns not asked for are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PATTERN, byte_symbols, default_vocabulary
from .common import checkpoint, field, read_table

CAPACITY = 2048
#: Id that ends a document.
END_ID = 0
#: Characters whose pieces make a batch of the result (a longer text goes alone).
CHARS_A_BATCH = 200_000


class Encoder:
    """Ids of texts as the tokenizers library gives them, from one of its files.

    A byte-level BPE file whose ids are in the order of its merges is the same thing as a
    file of ranks, and the faster tiktoken encodes it; texts that its pattern engine
    refuses (hundreds of thousands of white-space characters in a row) and other files
    go to the library.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = self._ranked(json.loads(vocabulary))

    @staticmethod
    def _ranked(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = plain and spec.get("normalizer") is None and spec.get("post_processor") is None
        plain = plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        plain = plain and not any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not plain:
            return None
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        strings = {s: i for s, i in model["vocab"].items() if s not in special}
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if len(strings) != 256 + len(merged) or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or merged[:1] and merged[0] < 256:
            return None
        import tiktoken

        ranks = {bytes(map(byte_of.__getitem__, s)): i for s, i in strings.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        if self.fast:
            try:
                return self.fast.encode(text, allowed_special="all")
            except ValueError:  # the pattern engine's stack
                pass
        return self.library.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(the columns of ``keep``, piece, start, length, ids) of every document.

    ids: binary, little-endian unsigned 32-bit integers. ``vocabulary``: path of a
    file of the tokenizers library, read by the driver and sent to the tasks.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    added = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields = [*(field(docs, c) for c in keep), *added]
    names, last = [f.name for f in fields], len(keep)

    def cut(tokens: list[int]) -> list[tuple[int, bytes]]:
        data = np.array([*tokens, end_id], "<u4")
        first = (len(data) - 1) % capacity + 1
        starts = [0, *range(first, len(data), capacity)]
        return [(a, data[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(sent.value)

        def coded(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            cuts = [cut(encode(t)) for t in texts]
            rows = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
            kept = part.select(list(range(last))).take(pa.array(rows)).columns if last else []
            flat = [x for c in cuts for x in c]
            place = [k for c in cuts for k in range(len(c))]
            columns = [pa.array(place, pa.int32()), pa.array([a for a, _ in flat], pa.int64()), pa.array([len(b) // 4 for _, b in flat], pa.int64()), pa.array([b for _, b in flat], pa.binary())]
            return pa.RecordBatch.from_arrays([*kept, *columns], names=names)

        for batch in batches:
            texts, size, start = [], 0, 0
            for k in range(batch.num_rows):
                text = batch.column(last)[k].as_py() or ""
                if texts and size + len(text) > CHARS_A_BATCH:
                    yield coded(batch.slice(start, len(texts)), texts)
                    texts, size, start = [], 0, k
                texts.append(text)
                size += len(text)
            if texts:
                yield coded(batch.slice(start, len(texts)), texts)

    return docs.select(*keep, text_col).mapInArrow(task, T.StructType(fields))


class Stock:
    """Pieces left of each length, with an index of the sums that two of them can reach."""

    def __init__(self, counts: np.ndarray, parts: int = 3, plenty_first: bool = True):
        self.left = counts.copy()
        self.parts, self.plenty_first = parts, plenty_first
        there = (counts > 0).astype(np.float64)
        #: Sums of two lengths. Stock only shrinks, so an entry found empty stays so.
        self.sums = np.convolve(there, there)[: len(counts)] > 0.5

    def pair(self, total: int) -> tuple[int, ...] | None:
        """A pair with this sum: the one of which most is left, or the one with the longest length."""
        if total < 2 or not self.sums[total]:
            return None
        small = np.arange(1, total // 2 + 1)
        most = np.minimum(self.left[small], self.left[total - small])
        if total % 2 == 0:
            most[-1] = self.left[total // 2] // 2
        best = int((most if self.plenty_first else most > 0).argmax())
        if most[best] < 1:
            self.sums[total] = bool((self.left[small] > 0)[(self.left[total - small] > 0)].any())
            return None
        return total - best - 1, best + 1

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """Up to three lengths in stock that fill the gap exactly."""
        if gap == 0:
            return ()
        if self.left[gap] > 0:
            return (gap,)
        if self.parts < 2:
            return None
        if two := self.pair(gap):
            return two
        if self.parts < 3:
            return None
        longest = np.flatnonzero(self.left[: gap - 1] > 0)[::-1] if gap > 2 else ()
        for one in longest:
            if self.sums[gap - one]:
                self.left[one] -= 1
                two = self.pair(gap - int(one))
                self.left[one] += 1
                if two:
                    return (int(one), *two)
        return None

    def take(self, lengths: Sequence[int]) -> int:
        """Consume the combination as often as the stock allows; the number of times."""
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(self.left[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.left[x] -= times * n
        return times


Patterns = list[tuple[int, list[tuple[int, int]]]]


def fill_exactly(counts: np.ndarray, capacity: int, parts: int, plenty_first: bool) -> Patterns:
    """Exact complements of up to ``parts`` lengths first, then best fit."""
    stock = Stock(counts, parts, plenty_first)
    full: Patterns = []
    for length in range(capacity, 0, -1):
        while stock.left[length]:
            stock.left[length] -= 1
            rest = stock.filling(capacity - length)
            stock.left[length] += 1
            whole = None if rest is None else (length, *rest)
            if whole is None or not (times := stock.take(whole)):
                break
            full.append((times, [(x, whole.count(x)) for x in sorted(set(whole), reverse=True)]))
    return full + best_fit(stock.left, capacity)


def plan(counts: Sequence[int], capacity: int = CAPACITY) -> Patterns:
    """Patterns (times, [(length, how many of it), ...]) that place ``counts[n]`` pieces of length n.

    Taking triples early can use up short lengths that other gaps need, so plans of
    up to one, two and three parts are made and the one with the fewest sequences stays.
    """
    stock = np.asarray(counts, np.int64)
    made = [fill_exactly(stock, capacity, parts, plenty) for parts in (3, 2, 1) for plenty in (True, False)]
    return min(made, key=lambda patterns: sum(times for times, _ in patterns))


def best_fit(counts: np.ndarray, capacity: int) -> Patterns:
    """Best fit of whole counts, longest first: like pieces go into like sequences together."""
    open_: dict[int, Patterns] = {}  # by gap
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                gap, times, runs = capacity, left, []
            else:
                times, runs = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            each = min(gap // length, max(1, left))  # the tightest gap for the next of them is where the last one went
            use = min(times, left // each)
            if use < times and runs:
                open_.setdefault(gap, []).append((times - use, runs))
            open_.setdefault(gap - each * length, []).append((use, [*runs, (length, each)]))
            left -= use * each
    return [pattern for patterns in open_.values() for pattern in patterns]


def runs_of(patterns: Patterns) -> dict[int, np.ndarray]:
    """By length: columns (first piece number, how many a sequence, first sequence, offset) of the planned runs."""
    taken: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, runs in patterns:
        offset = 0
        for length, each in runs:
            start = taken.get(length, 0)
            found.setdefault(length, []).append((start, each, sequence, offset))
            taken[length] = start + times * each
            offset += length * each
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def numbered(frame: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``frame`` with ``_task`` and ``_nth``: the place of a row among those of its length in its task. Checkpointed."""
    fields = [*frame.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_nth", T.LongType())]
    names = [f.name for f in fields]
    at = frame.columns.index(length_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = batch.column(at).to_numpy(zero_copy_only=False)
            if len(lengths) and not 0 < lengths.min() <= lengths.max() <= capacity:
                raise ValueError(f"lengths must be from 1 to {capacity}")
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            first = np.searchsorted(ordered, ordered, "left")
            nth = np.empty(len(lengths), np.int64)
            nth[order] = seen[ordered] + np.arange(len(lengths)) - first
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), me, np.int32)), pa.array(nth)], names=names)

    return checkpoint(frame.mapInArrow(task, T.StructType(fields)))


def place(frame: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``frame`` (any rows with a length of 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    rows = numbered(frame, capacity, length_col)
    per_task = rows.groupBy(F.col("_task").alias("_t"), F.col(length_col).alias("_l")).agg(F.count("*").alias("_n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("_l").agg(F.sum("_n").alias("n")).collect():  # one row a length: at most ``capacity``
        counts[r["_l"]] = r["n"]
    sent = frame.sparkSession.sparkContext.broadcast(runs_of(plan(counts, capacity)))
    before = W.partitionBy("_l").orderBy("_t").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_task.select("_t", "_l", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(offsets, (F.col("_task") == F.col("_t")) & (F.col(length_col) == F.col("_l")))
    ranked = joined.select(*frame.columns, (F.col("_before") + F.col("_nth")).alias("_rank"))
    fields = [*frame.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    names = [f.name for f in fields]
    at = frame.columns.index(length_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planned = sent.value
        for batch in batches:
            lengths = batch.column(at).to_numpy(zero_copy_only=False)
            ranks = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                here = lengths == length
                runs, rank = planned[int(length)], ranks[here]
                start, each, first, shift = runs[np.searchsorted(runs[:, 0], rank, "right") - 1].T
                sequence[here] = first + (rank - start) // each
                offset[here] = shift + (rank - start) % each * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(task, T.StructType(fields))


def sequences(placed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves; a group is at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", ids_col)))
    joined = F.aggregate(F.transform(parts, lambda p: p[ids_col]), F.unhex(F.lit("")), lambda a, x: F.concat(a, x))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document, with a digest of its ids."""
    found = pieces(read_table(spark, sf_dir, "documents"))
    digests = found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(digests)
