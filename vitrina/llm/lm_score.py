"""Language-model scores from a weighted backoff automaton.

The training documents' n-grams up to ``ORDER`` become the automaton. Its states
are the contexts seen in training (none, a word, ...); a state's arc for a word
it was followed by carries log10 of the smoothed probability and leads to the
longest context that ends with the word; its failure arc carries the log10 share
left to words not seen there and leads to the context without its first word.
The state without context has an arc for every word. Probabilities are
interpolated: with c the n-gram's count, d its context's and m = STRENGTH * d **
POWER, p = (c + m * lower p) / (d + m), and (c + ADD) / (N + ADD * (V + 1)) at the
bottom; so each state's probabilities, unknown words together, add up to 1. A
text's score is the sum of the arcs of one walk, left to right from the start
symbol's state, which carries the state from token to token: its arc for the next
token, or failure arcs until a state has one. A block's texts are walked side by
side, one token of each at a time.

The model grows with the corpus, so no task holds it. Documents are dealt into
blocks of about ``BLOCK_CHARS``. A block sends the hashes of its distinct n-grams
with their training counts to buckets by hash (packed: a row holds a block's
hashes for one bucket); a bucket adds up the counts over all blocks and answers
each block with the totals of just the hashes it sent. A block then has the arcs
its own texts can take, and scores them. Sorted hashes go as differences, under 6
bytes each, and a block's texts as compressed parts; both lose nothing. N-grams of any frequency cost one hash a
block, so hot words need no care; blocks and buckets are dealt by hash.

Defined cases: a null or empty text has one token, the end; a very long text
makes a block of its own size (its n-grams are held in memory, and its walk is as
long as it has tokens); rows with null ids are trained on; repeated rows count as often as they stand; without training
tokens every word has the same base probability, ADD / (ADD * 1) = 1; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, field, fold, mix64, read_table, words

FOLDS, HELD_OUT = 10, 0
ORDER = 3
ADD = 0.1
STRENGTH, POWER = 4.0, 0.85
BLOCK_CHARS = 8_000_000
BLOCKS_A_BUCKET = 2
_END, _START = np.uint64(0xE5D), np.uint64(0x57A27)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """The n-grams of a block of texts.

    ``grams[n - 1]`` has the hash of the n-gram that ends at each token. The
    start symbol stands before a text's first token; an n-gram that would reach
    further back is the same as the longest one that does not, so it is left out
    by ``whole[n - 1]``.
    """

    def __init__(self, texts: list[str | None], hashes: WordHash, order: int):
        tokens = [np.append(hashes.of(words(t)), _END) for t in texts]
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        flat = np.concatenate(tokens)
        at = np.arange(len(flat)) - np.repeat(self.starts, self.lengths)
        self.grams, self.whole = [flat], [np.ones(len(flat), bool)]
        for n in range(2, order + 1):
            context = np.concatenate([[_START], self.grams[-1][:-1]])
            context[self.starts] = _START
            self.grams.append(mix64(context * _FACTOR + flat))
            self.whole.append(at >= n - 2)

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes of the n-grams and, as a word, the start symbol; each token's place among them)."""
        found, places = np.unique(np.append(self.grams[n - 1], _START if n == 1 else self.grams[n - 1][:1]), return_inverse=True)
        return found, places[:-1].astype(np.int32)


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Places where each bucket's hashes start, in sorted hashes; and the end."""
    limits = np.array([(b << 64) // n for b in range(n)], np.uint64)
    return np.append(np.searchsorted(hashes, limits), len(hashes))


def _squeezed(raw: bytes) -> bytes:
    """The length of ``raw``, and ``raw`` by zstd."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _expanded(squeezed: bytes) -> bytes:
    return pa.decompress(squeezed[8:], int.from_bytes(squeezed[:8], "little"), codec="zstd", asbytes=True) if squeezed else b""


def _packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each; larger ones follow as 64-bit numbers."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return _squeezed(small.tobytes() + counts[counts >= 255].astype(np.int64).tobytes())


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    packed = _expanded(packed)
    counts = np.frombuffer(packed, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, np.int64, offset=n)
    return counts


def _packed_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, all lowest bytes first: the high ones are zero or small, and take next to no space."""
    return _squeezed(np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked_hashes(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_expanded(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (block, rows): compressed Arrow streams of the other columns, one for each block of a batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("block")
            blocks, starts = np.unique(table.column("block").to_numpy(), return_index=True)
            table, packed = table.drop_columns("block"), []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                    out.write_table(table.slice(start, end - start).combine_chunks())
                packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "rows"])

    return rows.mapInArrow(task, "block int, rows binary")


def _rows(dealt: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x.as_py()).read_all() for x in dealt.column("rows"))


_SENT = "bucket int, n int, block int, hashes binary, counts binary"
_ANSWER = "block int, n int, bucket int, counts binary, tokens long, types long"


def count_ngrams(rows: DataFrame, n_buckets: int, order: int) -> DataFrame:
    """Answers (block, n, bucket, counts, tokens, types) to every block. ``rows``: those of ``_dealt``, with text and train.

    tokens and types: of the training words the bucket counted, in its answer for n = 1, which every block gets.
    """

    def send(table: pa.Table) -> pa.Table:
        block, table = table.column("block")[0].as_py(), _rows(table)
        own = Block(table.column("text").to_pylist(), WordHash(), order)
        train = np.array(table.column("train").to_pylist(), bool)
        weight = np.repeat(train, own.lengths)
        out = {name: [] for name in ("bucket", "n", "block", "hashes", "counts")}
        for n in range(1, order + 1):
            found, places = own.distinct(n)
            counts = np.bincount(places, weight & own.whole[n - 1], len(found)).astype(np.int64)
            if n == 1:
                counts[np.searchsorted(found, _START)] += train.sum()
            cuts = _buckets(found, n_buckets)
            for b in range(n_buckets) if n == 1 else np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                part = slice(cuts[b], cuts[b + 1])
                for name, value in zip(out, (b, n, block, _packed_hashes(found[part]), _packed(counts[part]))):
                    out[name].append(value)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})

    def add(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        ns, blocks = table.column("n").to_numpy(), table.column("block").to_numpy()
        out, tokens, types = [], 0, 0
        for n in np.unique(ns).tolist():
            at = np.flatnonzero(ns == n)
            own = table.take(pa.array(at)).sort_by("block")
            hashes = [_unpacked_hashes(x.as_py()) for x in own.column("hashes")]
            counts = [_unpacked(x.as_py(), len(h)) for x, h in zip(own.column("counts"), hashes)]
            found, places = np.unique(np.concatenate(hashes), return_inverse=True)
            totals = np.bincount(places, np.concatenate(counts), len(found)).astype(np.int64)
            if n == 1:
                seen = (totals > 0) & (found != _START)
                tokens, types = int(totals[seen].sum()), int(seen.sum())
            ends = np.cumsum([len(h) for h in hashes])
            for block, part in zip(own.column("block").to_pylist(), np.split(totals[places], ends[:-1])):
                out.append((block, n, bucket, _packed(part), tokens if n == 1 else 0, types if n == 1 else 0))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        names = ("block", "n", "bucket", "counts", "tokens", "types")
        return pa.table({name: pa.array(values, kind) for name, values, kind in zip(names, zip(*out), kinds)})

    return rows.groupBy("block").applyInArrow(send, _SENT).groupBy("bucket").applyInArrow(add, _ANSWER)


class Automaton:
    """The part of the model that a block's texts can reach.

    A token's n-gram of order n is the arc from the state of its context (the
    n - 1 tokens before it). Arcs and states are numbered per order; ``arc[n]``
    holds log10 weights, nan where training has no such arc, ``fail[n]`` the
    weights of the failure arcs out of the arcs' states, nan where training has
    no such state.
    """

    def __init__(self, counts: list[np.ndarray], contexts: list[np.ndarray], lower: list[np.ndarray], tokens: int, types: int):
        p = (counts[0] + ADD) / (tokens + ADD * (types + 1))
        self.arc, self.fail = [np.log10(p)], [np.zeros(len(p))]
        for n in range(1, len(counts)):
            c, d, below = counts[n], contexts[n].astype(float), p[lower[n]]
            m = STRENGTH * np.maximum(d, 1) ** POWER
            p = np.where(d > 0, (c + m * below) / (d + m), below)
            self.arc.append(np.where(c > 0, np.log10(p), np.nan))
            self.fail.append(np.where(d > 0, np.log10(m / (d + m)), np.nan))

    def walk(self, places: list[np.ndarray], whole: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each text: the weights of the arcs it takes, added up on the way.

        ``places[n]`` is the number of each token's arc of order n + 1. The state carried
        by a text is how many of the words before the token it remembers (which these
        are, the text says). A state that training never saw gives way to the next
        shorter one at no cost; one without an arc for the token, at that of its failure
        arc. The arc taken leads to the context one word longer, ``order`` - 1 at most.
        """
        order = len(places)
        by = np.argsort(-lengths, kind="stable")  # those still walking come first
        first, left = starts[by], -lengths[by]
        state = np.full(len(by), min(1, order - 1))  # the start symbol is behind each text
        score = np.zeros(len(by))
        for step in range(int(lengths.max()) if len(lengths) else 0):
            n = int(np.searchsorted(left, -step, "left"))
            at, now, total = first[:n] + step, state[:n], score[:n]
            for k in range(order - 1, 0, -1):
                here = np.flatnonzero(now == k)
                token = at[here]
                fail = np.where(whole[k][token], self.fail[k][places[k][token]], np.nan)
                seen = ~np.isnan(fail)
                stuck = seen & np.isnan(self.arc[k][places[k][token]])
                total[here[stuck]] += fail[stuck]
                now[here[~seen | stuck]] = k - 1
            for k in range(order):
                here = np.flatnonzero(now == k)
                total[here] += self.arc[k][places[k][at[here]]]
            np.minimum(now + 1, order - 1, out=now)
        out = np.empty(len(by))
        out[by] = score
        return out


def score(docs: DataFrame, train, order: int = ORDER, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``train``: column that is true for the rows to learn from.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_chars))
    n_buckets = max(1, -(-n_blocks // BLOCKS_A_BUCKET))
    # dealt by place in the table, so rows that are equal in all columns spread as well
    rows = _dealt(rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")))
    answers = count_ngrams(rows, n_buckets, order)
    schema = T.StructType([
        T.StructField("doc_id", field(docs, id_col).dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def weigh(dealt: pa.Table, answer: pa.Table) -> pa.Table:
        texts = _rows(dealt)
        own = Block(texts.column("text").to_pylist(), WordHash(), order)
        answer = answer.sort_by([("n", "ascending"), ("bucket", "ascending")])
        ns, packed = answer.column("n").to_pylist(), answer.column("counts")
        tokens, types = (sum(answer.column(c).to_pylist()) for c in ("tokens", "types"))
        counts, places, contexts, lower = [], [], [], []
        start = 0
        for n in range(1, order + 1):
            found, at = own.distinct(n)
            cuts = _buckets(found, n_buckets)
            sizes = [int(x) for x in np.diff(cuts) if x or n == 1]
            mine = [packed[i].as_py() for i, x in enumerate(ns) if x == n]
            counts.append(np.concatenate([_unpacked(x, k) for x, k in zip(mine, sizes)]))
            if n == 1:
                start = int(counts[0][np.searchsorted(found, _START)])
                contexts.append(np.zeros(len(found)))
                lower.append(np.zeros(len(found), np.int32))
            else:
                # of each n-gram: the count of its context, and its last n - 1 tokens
                before = np.concatenate([[0], counts[-2][places[-1]][:-1]])
                before[own.starts] = start if n == 2 else 0
                seen = np.zeros(len(found), np.int64)
                below = np.zeros(len(found), np.int32)
                seen[at], below[at] = before, places[-1]
                contexts.append(seen)
                lower.append(below)
            places.append(at)
        model = Automaton(counts, contexts, lower, tokens, types)
        total = lambda x: np.add.reduceat(x, own.starts)
        n_rows = texts.num_rows
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pa.array([not x for x in texts.column("train").to_pylist()], pa.bool_()),
            "n_tokens": pa.array(own.lengths), "n_known": pa.array(total((counts[0] > 0)[places[0]].astype(np.int64))),
            "train_tokens": pa.array(np.full(n_rows, tokens, np.int64)), "base_score": pa.array(total(model.arc[0][places[0]])),
            "score": pa.array(model.walk(places, own.whole, own.starts, own.lengths)),
        })

    # the same rows by block as those that were counted: their shuffle is used twice
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weigh, schema)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    return scored.withColumn("doc_id", F.col("doc_id").cast("bigint"))
