"""BPE encoding and decoding with a public vocabulary file.

Each piece of text (GPT-2 pattern) starts as a doubly linked list of byte
symbols. Adjacent pairs wait in a priority queue ordered by merge rank, then by
place. The pair at the head is merged, its new neighbours are queued, and queue
entries whose pair no longer stands at that place are stale and skipped. So a
piece of n bytes costs O(n log n). Decoding concatenates vocabulary strings.

Work is per document: no shuffle, and the vocabulary file (fixed size) is the
only thing sent to tasks.

Defined cases: a null or empty text has no ids and decodes to the empty text;
rows are independent, so repeated rows give repeated results; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, read_table

#: How byte-level BPE files split text before merging; a fixed value of the format.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file (JSON of the tokenizers library)."""

    def __init__(self, vocabulary: str, remembered: int = 400_000):
        import regex

        spec = json.loads(vocabulary)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.start = [vocab[c] for c in symbols]
        self.shift = max(vocab.values()).bit_length()
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << self.shift | vocab[right]] = (rank, vocab[left + right])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: bytes(map(byte_of.__getitem__, s)) for s, i in vocab.items()}
        self.strings.update({i: s.encode() for s, i in self.special.items()})
        self.pieces = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.remembered, self.known = remembered, {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        shift, merges = self.shift, self.merges
        ids = [self.start[b] for b in piece]
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for at in range(n - 1):
            if found := merges.get(ids[at] << shift | ids[at + 1]):
                queue.append((found[0], at))
        heapq.heapify(queue)
        while queue:
            rank, at = heapq.heappop(queue)
            right = after[at]
            if right >= n or ids[at] < 0:
                continue  # stale: no longer a pair
            found = merges.get(ids[at] << shift | ids[right])
            if not found or found[0] != rank:
                continue  # stale: another pair stands there now
            ids[at], ids[right] = found[1], -1
            after[at] = then = after[right]
            if then < n:
                before[then] = at
                if found := merges.get(ids[at] << shift | ids[then]):
                    heapq.heappush(queue, (found[0], at))
            if (left := before[at]) >= 0 and (found := merges.get(ids[left] << shift | ids[at])):
                heapq.heappush(queue, (found[0], left))
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> bytes:
        packed = array("I", self.merge(piece.encode())).tobytes()
        if len(piece) <= 64:  # merges of common pieces are remembered, for a bounded number of them
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, piece = self.known, self.piece
        out = []
        for k, part in enumerate(self.parts(text) if self.parts else [text]):
            if k % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out += [known.get(p) or piece(p) for p in self.pieces(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        found = array("I")
        found.frombytes(ids)
        return b"".join(map(self.strings.__getitem__, found)).decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(the columns of ``keep``, ids, decoded) of every row.

    ids: binary, little-endian unsigned 32-bit integers; decoded: the text that
    the ids stand for. ``vocabulary``: path of a byte-level BPE file, read by
    the driver (a fixed file of about 1.5 MB) and sent to the tasks.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [*(field(docs, c) for c in keep), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    names = [f.name for f in fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [codec.encode(x.as_py() or "") for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())], names=names
                )

    return docs.select(*keep, text_col).mapInArrow(task, T.StructType(fields))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of all documents."""
    coded = encode(read_table(spark, sf_dir, "documents"))
    return coded.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
