"""Conversation structure repair by weighted interval parsing.

A conversation should read ``(s?(ua)+)?`` in role initials. Its rows are the leaves
of a parse with the edits keep, rerole, delete and insert. The grammar is in
Chomsky normal form: a nonterminal X[p,q] stands for "what makes a sequence that
ended in p end in q" (p, q: nothing, system, user, assistant), with the rules
X[p,q] -> X[p,r] X[r,q]. A span's cell holds the least (cost, audit) of each
X[p,q]; insertions, which cover no row, enter as the closure of their rules before
every row and at the end. Cells are combined bottom-up by span length (1, 2, 4, ...).

One split a span is enough: the nonterminals are pairs of states, so every split of
a span gives the same cell. Ties can be settled inside a cell, because two audits
of the same rows, ends and cost are never a prefix of one another (the longer one
would have more insertions and cost more).

Scale. Equal rows of a turn are counted, not copied, and the first row of each
(role, text) is found by a grouped minimum, both pre-aggregated. Rows are then dealt
by ranges of (conversation, turn), so a conversation of any length is spread over
tasks. A conversation that begins and ends inside a range is repaired right there.
The first and last of a range and those of more than ``CHUNK_ROWS`` rows leave their
task as chunks: their letters (one byte a row) are parsed along the conversation,
the chunks get their share of the audit, each writes its text, and these are hashed
in order. Only that last step (a SHA-256 is sequential) and the audit (one byte a
row) are serial in one conversation, and both are streamed.

Defined cases: null roles and texts are one space; a null conversation id is a
conversation of its own; null turns come first and count for no gap; rows of one
turn stand in order of a digest of role and text; an empty role has no initial and
can't be kept as it is; a very long text is a chunk of its own; a conversation whose
rows all went has zeros, an empty audit and the hash of the empty text; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows and characters of a conversation that are handled at once.
CHUNK_ROWS = 512
CHUNK_CHARS = 1_000_000
SPACE = " \t\n\x0b\x0c\r"

#: States: what the sequence so far ends in. 0: nothing, 1: system, 2: user, 3: assistant.
N = 4
NEXT = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
FINAL = (0, 3)
Cell = tuple  # of N * N entries (cost, audit) or None


def least(*options):
    return min((x for x in options if x is not None), default=None)


def combined(left: Cell, right: Cell) -> Cell:
    """X[p,q] -> X[p,r] X[r,q], the least for each p, q."""
    out = []
    for p in range(0, N * N, N):
        row = [(x, r * N) for r in range(N) if (x := left[p + r]) is not None]
        for q in range(N):
            best = None
            for (cost, audit), r in row:
                y = right[r + q]
                if y is not None:
                    cost += y[0]
                    if best is None or cost < best[0]:
                        best = (cost, audit + y[1])
                    elif cost == best[0]:
                        best = min(best, (cost, audit + y[1]))
            out.append(best)
    return tuple(out)


def _closure() -> Cell:
    """Insertions of any number of user and assistant rows."""
    cell = [(0, "") if p == q else None for p in range(N) for q in range(N)]
    for p, q in (*NEXT["u"], *NEXT["a"]):
        cell[p * N + q] = (INSERT, "I")
    cell = tuple(cell)
    for _ in range(2):  # paths of up to four steps: longer ones repeat a state
        cell = combined(cell, cell)
    return cell


CLOSURE = _closure()


def _leaf(letter: str) -> Cell:
    """Edits of one row, insertions before it included.

    ``d``: must be deleted; else the role's initial (``o``: none of s, u, a), in
    upper case if the row is truncated.
    """
    options: dict[tuple[int, int], tuple[int, str]] = {(p, p): (DELETE, "D") for p in range(N)}
    if letter != "d":
        extra = TRUNCATED if letter.isupper() else 0
        for role in "sua":
            for step in NEXT[role]:
                keep = (KEEP + extra, "K") if letter.lower() == role else None
                rerole = (REROLE + extra, "R") if role != "s" else None
                if found := least(keep, rerole):
                    options[step] = found
    return combined(CLOSURE, tuple(options.get((p, q)) for p in range(N) for q in range(N)))


LEAF = {letter: _leaf(letter) for letter in "suaoSUAOd"}


def parsed(cells: list[Cell]) -> Cell:
    """The cell of the whole span, from the cells of neighbouring spans, by span length."""
    while len(cells) > 1:
        cells = [combined(cells[k], cells[k + 1]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


@lru_cache(100_000)
def _short(letters: str) -> Cell:
    return parsed([LEAF[c] for c in letters])


def cell_of(letters: str) -> Cell:
    """The cell of a span of rows; spans of 16 rows are remembered."""
    return parsed([_short(letters[k : k + 16]) for k in range(0, len(letters), 16)])


def solution(cell: Cell) -> tuple[int, str]:
    """Least (cost, audit) that makes a whole conversation."""
    ended = combined(cell, CLOSURE)
    return least(*(ended[q] for q in FINAL))


def repaired(audit: str, rows: Iterator[tuple[str, str]], made: int = 0, system: int = 0) -> list[str]:
    """``role:text`` of the rows that the audit leaves; ``made`` rows (``system``: 1 if the first is one) stand before."""
    out = []
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "K":
            role = "user" if (made - system) % 2 == 0 else "assistant"
        elif made == 0 and role[:1] == "s":
            system = 1
        made += 1
        out.append(f"{role}:{text}")
    return out


class Chunk:
    """Consecutive rows of one conversation: letters, what they hold, and counts."""

    def __init__(self, conv):
        self.conv, self.rows, self.letters, self.chars = conv, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role: str, text: str, is_first: bool, times: int) -> None:
        initial = role[:1]
        content = text.rstrip(SPACE)
        if not content:
            letter, self.blank = "d", self.blank + times
        else:
            self.duplicate += times - is_first
            letter = "d"
            if is_first:
                letter = initial if initial in ("s", "u", "a") else "o"
                if content[-1] not in ".!?":
                    letter, self.truncated = letter.upper(), self.truncated + 1
        self.letters.append(letter + "d" * (times - 1))
        self.rows.append((role, text) if letter != "d" else (None, None))
        self.rows += [(None, None)] * (times - 1)
        self.chars += len(text) + len(role) + times
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += times - 1
        self.last = initial
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def full(self) -> bool:
        return len(self.rows) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = [("conv_id", "long"), *((c, "long") for c in COUNTS), ("audit", "string"), ("repaired_sha256", "string")]
CHUNK = [
    ("part", "int"), ("chunk", "long"), ("letters", "string"), ("roles", "array<string>"), ("texts", "array<string>"),
    ("low", "long"), ("high", "long"), ("distinct", "long"), ("first", "string"), ("last", "string"),
]


def _schema(columns) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in columns)


def _batch(rows: list[tuple], columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(columns)], names=[c for c, _ in columns])


def _in_batches(rows: Iterator[tuple], columns, size: Callable[[tuple], int] = lambda r: 1, limit: int = 2_000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= limit:
            yield _batch(held, columns)
            held, weight = [], 0
    if held:
        yield _batch(held, columns)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1_000):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 1_000).columns), strict=True)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) after damage; a row that goes is left with times 0 and nothing else."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(~gone, F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"),
        F.when(~gone, F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("times"),
    )


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def _in_order(rows: DataFrame) -> DataFrame:
    """Distinct rows of each turn with their number, the first of each (role, text) marked, by ranges of conversation and turn."""
    keyed = rows.withColumn("key", _digest(F.col("role"), F.col("text")))
    firsts = keyed.where("times > 0").groupBy("conv_id", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"))
    none = F.lit(None).cast("string")
    marks = firsts.select("conv_id", F.col("at.turn").alias("turn"), "key", none.alias("role"), none.alias("text"), F.lit(0).cast("bigint").alias("times"), F.lit(True).alias("is_first"))
    both = keyed.select("conv_id", "turn", "key", "role", "text", "times", F.lit(False).alias("is_first")).union(marks)
    merged = both.groupBy("conv_id", "turn", "key").agg(F.max("role").alias("role"), F.max("text").alias("text"), F.sum("times").alias("times"), F.max("is_first").alias("is_first"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key").asc_nulls_first()]
    return merged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "times", "is_first")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A result for each conversation inside the range, chunks of the others."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def chunk_row(number: int, c: Chunk) -> tuple:
        counts = (None, c.blank, c.duplicate, c.truncated, c.illegal, None)
        roles, texts = ([r[k] for r in c.rows] for k in (0, 1))
        return (c.conv, *counts, None, None, part, number, "".join(c.letters), roles, texts, c.low, c.high, c.distinct, c.first, c.last)

    def done(c: Chunk) -> tuple:
        cost, audit = solution(cell_of("".join(c.letters))) if c.rows else (0, "")
        gaps = 0 if c.low is None else c.high - c.low + 1 - c.distinct
        text = "\n".join(repaired(audit, iter(c.rows)))
        return (c.conv, gaps, c.blank, c.duplicate, c.truncated, c.illegal, cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), *[None] * len(CHUNK))

    def rows() -> Iterator[tuple]:
        now, inner, number = None, False, 0  # inner: the conversation begins in this range and is not yet chunked
        for conv, turn, role, text, times, is_first in _records(batches):
            if now is not None and now.conv != conv:
                yield done(now) if inner else chunk_row(number, now)
                now, inner, number = Chunk(conv), True, number + 1
            elif now is None:
                now = Chunk(conv)
            while times:  # equal rows may be many; the first of them carries the mark
                if now.full():
                    yield chunk_row(number, now)
                    now, inner, number = Chunk(conv), False, number + 1
                some = min(times, CHUNK_ROWS)
                now.add(turn, role, text, is_first, some)
                times, is_first = times - some, False
        if now is not None:
            yield chunk_row(number, now)

    yield from _in_batches(rows(), [*RESULT, *CHUNK], lambda r: 1 + sum(len(t or "") for t in r[13] or ()) // 500)


SPINE_IN = ("conv_id", "part", "chunk", "letters", "blank", "duplicate", "truncated", "illegal", "low", "high", "distinct", "first", "last")
SPINE = [("conv_id", "long"), ("part", "int"), ("chunk", "long"), ("piece", "string"), ("made", "long"), ("system", "long"), *((c, "long") for c in COUNTS)]


def _spine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation in order -> the share of the audit of each; the counts stand at the last."""

    def finish(chunks: list[tuple]) -> Iterator[tuple]:
        cells, totals, low, high, distinct, last = [], [0, 0, 0, 0], None, None, 0, None
        for c in chunks:
            if c[3]:
                cells.append(cell_of(c[3]))
                totals = [a + b for a, b in zip(totals, c[4:8], strict=True)]
                totals[3] += last is not None and last + c[11] not in ("su", "ua", "au")
                last = c[12]
            if c[8] is not None:
                distinct += c[10] - (c[8] == high)
                low, high = c[8] if low is None else low, c[9]
        cost, audit = solution(parsed(cells)) if cells else (0, "")
        gaps = 0 if low is None else high - low + 1 - distinct
        at = made = system = 0
        for k, c in enumerate(chunks):
            end = len(audit) if k == len(chunks) - 1 else at
            if k < len(chunks) - 1:
                left = len(c[3])
                while left:
                    left -= audit[end] != "I"
                    end += 1
            piece = audit[at:end]
            counts = (gaps, *totals, cost) if k == len(chunks) - 1 else [None] * 6
            yield (*c[:3], piece, made, system, *counts)
            if made == 0 and (kept := len(piece) - piece.count("D")):
                first = len(piece) - len(piece.lstrip("D"))
                system = int(piece[first] == "K" and c[3][first].lower() == "s")
                made = kept
            else:
                made += len(piece) - piece.count("D")
            at = end

    def rows() -> Iterator[tuple]:
        held: list[tuple] = []
        for record in _records(batches):
            if held and held[0][0] != record[0]:
                yield from finish(held)
                held = []
            held.append(record)
        if held:
            yield from finish(held)

    yield from _in_batches(rows(), SPINE, lambda r: 1 + len(r[3]) // 100)


TEXT_IN = ("conv_id", "part", "chunk", "roles", "texts", "piece", "made", "system", *COUNTS)
TEXT = [("conv_id", "long"), ("part", "int"), ("chunk", "long"), ("lines", "string"), ("piece", "string"), *((c, "long") for c in COUNTS)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's repaired text; null if it leaves no row."""

    def rows() -> Iterator[tuple]:
        for conv, part, chunk, roles, texts, piece, made, system, *counts in _records(batches):
            lines = repaired(piece, zip(roles, texts, strict=True), made, system)
            yield conv, part, chunk, "\n".join(lines) if lines else None, piece, *counts

    yield from _in_batches(rows(), TEXT, lambda r: 1 + len(r[3] or "") // 500)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a conversation's chunks in order -> its result; the last chunk brings the counts."""

    def rows() -> Iterator[tuple]:
        digest, audit, empty = hashlib.sha256(), [], True
        for conv, _, _, lines, piece, *counts in _records(batches):
            audit.append(piece)
            if lines is not None:
                digest.update(("" if empty else "\n").encode() + lines.encode("utf-8", "surrogatepass"))
                empty = False
            if counts[-1] is not None:
                yield conv, *counts, "".join(audit), digest.hexdigest()
                digest, audit, empty = hashlib.sha256(), [], True

    yield from _in_batches(rows(), RESULT, lambda r: 1 + len(r[7]) // 500)


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text, times): gaps, faults, cost, audit, hash."""
    ranges = checkpoint(_in_order(rows).mapInArrow(_ranges, _schema([*RESULT, *CHUNK])))
    order = ("conv_id", "part", "chunk")
    chunks = ranges.where("part IS NOT NULL")

    def along(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id").sortWithinPartitions(*order)

    spine = along(chunks.select(*SPINE_IN)).mapInArrow(_spine, _schema(SPINE))
    shares = spine.select(*(F.col(c).alias(f"s_{c}") for c, _ in SPINE))
    same = F.col("conv_id").eqNullSafe(F.col("s_conv_id")) & (F.col("part") == F.col("s_part")) & (F.col("chunk") == F.col("s_chunk"))
    joined = chunks.select(*order, "roles", "texts").join(shares, same).select(*(F.col(c if c in (*order, "roles", "texts") else f"s_{c}").alias(c) for c in TEXT_IN))
    long = along(joined.mapInArrow(_texts, _schema(TEXT))).mapInArrow(_hashed, _schema(RESULT))
    return ranges.where("part IS NULL").select(*(c for c, _ in RESULT)).union(long)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the fixed rule and repaired."""
    return repair(damaged(read_table(spark, sf_dir, "conversations")))


def _more(value: str, cost, letter: str) -> str:
    return f"printf('%09d', CAST(left({value}, 9) AS BIGINT) + {cost}) || substr({value}, 10) || '{letter}'"


def _inserted(c: Sequence[str]) -> tuple[str, str]:
    """States 2 and 3 after insertions, as SQL over the four states' columns."""
    two = f"list_min([{c[2]}, {_more(c[0], INSERT, 'I')}, {_more(c[1], INSERT, 'I')}, {_more(c[3], INSERT, 'I')}])"
    return two, f"list_min([{c[3]}, {_more(two, INSERT, 'I')}])"


#: One state after the other instead of spans: (cost, audit) as text, so that the least text is the least pair.
_BEFORE = ("x0", "x1", "y2", "y3")
_STEP = {
    0: [_more("x0", DELETE, "D")],
    1: [_more("x1", DELETE, "D"), f"CASE WHEN may AND i = 's' THEN {_more('x0', 'extra', 'K')} END"],
    2: [_more("y2", DELETE, "D"), *(f"CASE WHEN may THEN CASE WHEN i = 'u' THEN {_more(v, 'extra', 'K')} ELSE {_more(v, f'{REROLE} + extra', 'R')} END END" for v in ("x0", "x1", "y3"))],
    3: [_more("y3", DELETE, "D"), f"CASE WHEN may THEN CASE WHEN i = 'a' THEN {_more('y2', 'extra', 'K')} ELSE {_more('y2', f'{REROLE} + extra', 'R')} END END"],
}
_NOW = tuple(f"p.x{k}" for k in range(N))
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

ORACLE_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), k AS (
  SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM r
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0
), o AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(role) || ':' || role || text)) AS pos, left(role, 1) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM d
), s AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    LAG(i) OVER (PARTITION BY conv_id ORDER BY pos) AS previous FROM o
), l AS MATERIALIZED (
  SELECT *, fault IS NULL OR fault = 'truncated' AS may, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra FROM s
), f AS (
  SELECT conv_id, CAST(COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS BIGINT) AS gaps, COUNT(*) FILTER (WHERE fault = 'blank') AS blank,
    COUNT(*) FILTER (WHERE fault = 'duplicate') AS duplicate, COUNT(*) FILTER (WHERE fault = 'truncated') AS truncated,
    COUNT(*) FILTER (WHERE pos > 1 AND previous || i NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY conv_id
), p AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS x0, CAST(NULL AS VARCHAR) AS x1, CAST(NULL AS VARCHAR) AS x2, CAST(NULL AS VARCHAR) AS x3 FROM l
  UNION ALL
  SELECT conv_id, pos, {", ".join(f"list_min([{', '.join(_STEP[k])}])" for k in range(N))}
  FROM (SELECT l.conv_id, l.pos, l.i, l.may, l.extra, p.x0, p.x1, {_inserted(_NOW)[0]} AS y2, {_inserted(_NOW)[1]} AS y3
        FROM p JOIN l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.pos = p.pos + 1)
), e AS (
  SELECT p.conv_id, list_min([p.x0, {_inserted(_NOW)[1]}]) AS best FROM p JOIN (SELECT conv_id, MAX(pos) AS pos FROM l GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.pos = p.pos
), c AS (
  SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM e
), a AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS j FROM c WHERE audit <> ''
), b AS (
  SELECT *, COUNT(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS pos, COUNT(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS made FROM a
), u AS (
  SELECT b.conv_id, b.made, b.edit, CASE WHEN b.edit = 'I' THEN '' ELSE l.text END AS text, l.role, l.i,
    MAX(CASE WHEN b.made = 1 AND b.edit = 'K' AND l.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY b.conv_id) AS system
  FROM b JOIN l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.pos = GREATEST(b.pos, 1) WHERE b.edit <> 'D'
), t AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (made - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY made) AS text FROM u GROUP BY conv_id
)
SELECT g.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
  COALESCE(cost, 0) AS cost, COALESCE(audit, '') AS audit, sha256(COALESCE(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id
"""
