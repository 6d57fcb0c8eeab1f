"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is cut into pieces that end after a line break or sentence mark (together
they are the whole text). A piece's SHA-256 gives eight 32-bit numbers, and its
weight is the rounded root of its length. The fingerprint is a vector of 9 +
``LANES`` sums over the pieces, each modulo 2^32:

- the eight numbers: equal multisets of pieces, in whatever order, have equal
  sums, and different ones differ but for hash collisions;
- the weights;
- for each of the first ``LANES`` bits of the digest, the weights of the pieces
  that have the bit set. Twice this less the weights is a sum of plus and minus
  signs, so the squared difference of two such vectors estimates the characters
  in pieces that only one text has: likeness is 1 - |a - b|^2 / (|a|^2 + |b|^2),
  cut to 0..1, and 1 for equal sums.

Sums commute, so pieces are inserted by ``plus`` and deleted by ``minus``
without seeing the rest of the text.

Everything is DataFrame functions over one row's arrays; the fingerprint needs no
shuffle. The next document by id comes from one shuffle of the texts: quantiles
of the ids (at most ``MAX_GROUPS``, so their size is bounded) cut the ids into
ranges, the first row of each range is also sent to the range before (the very
first to the last), and a window inside a range sees each row's successor.

Defined cases: null text is the empty text (one empty piece); a null id sorts
first; rows of equal id stand in order of text; the last row's successor is the
first row, a single row's is itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table

#: A piece: up to and with line breaks, sentence marks and spaces that follow one, or what is left at the end.
PIECE = r"[^\n.!?]*[\n.!?][\n.!?\x20]*|[^\n.!?]+"
EXACT, LANES = 8, 64
MAX_GROUPS = 65_536
_M32 = 1 << 32
#: Bits 0 and 32: one product adds a weight to two lanes, whose sums stay below 2^32 for texts under 4 GB.
_PAIR = (1 << 32) + 1


def pieces(text: Column) -> Column:
    """array<struct<h: array of eight 32-bit numbers, bits: first 64 bits of the digest, weight>>"""
    found = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    hashed = F.transform(
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(""))),
        lambda p: F.struct(F.sha2(p, 256).alias("digest"), F.round(F.sqrt(F.length(p).cast("double"))).cast("bigint").alias("weight")),
    )
    number = lambda d, k: F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("bigint")
    numbers = F.transform(hashed, lambda p: F.struct(F.array(*(number(p.digest, k) for k in range(EXACT))).alias("h"), p.weight.alias("weight")))
    return F.transform(numbers, lambda p: F.struct(p.h.alias("h"), F.shiftleft(p.h[0], 32).bitwiseOR(p.h[1]).alias("bits"), p.weight.alias("weight")))


def vector(text: Column) -> Column:
    """Fingerprint vector of a text: array<bigint> of EXACT + 1 + LANES numbers."""
    zero = F.lit(0).cast("bigint")

    def of(found: Column) -> Column:
        def total(term) -> Column:
            return F.aggregate(found, zero, lambda a, p: a + term(p))

        def number(k: int) -> Column:
            return total(lambda p: p.h[k]).bitwiseAND(F.lit(_M32 - 1))

        def pair(c: int) -> Column:
            return total(lambda p: p.weight * F.shiftright(p.bits, c).bitwiseAND(F.lit(_PAIR)))

        exact = [number(k) for k in range(EXACT)]
        weight = total(lambda p: p.weight)
        pairs = [pair(c) for c in range(LANES // 2)]
        lanes = F.flatten(F.transform(F.array(*pairs), lambda x: F.array(x.bitwiseAND(F.lit(_M32 - 1)), F.shiftrightunsigned(x, 32))))
        return F.concat(F.array(*exact), F.array(weight), lanes)

    # the pieces are bound once and used by every sum
    return F.element_at(F.transform(F.array(pieces(text)), of), 1)


def plus(a: Column, b: Column) -> Column:
    """Fingerprint of the pieces of both."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(_M32)))


def minus(a: Column, b: Column) -> Column:
    """Fingerprint of a without the pieces of b."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(_M32)))


def as_text(v: Column) -> Column:
    """Eight hexadecimal digits for each sum."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of what two texts have in common, by characters; 0 to 1."""
    weight = lambda v: F.element_at(v, EXACT + 1)
    lanes = lambda v: F.slice(v, EXACT + 2, LANES)
    pairs = F.zip_with(
        F.transform(lanes(a), lambda x: (2 * x - weight(a)).cast("double")),
        F.transform(lanes(b), lambda x: (2 * x - weight(b)).cast("double")),
        lambda x, y: F.struct(x.alias("x"), y.alias("y")),
    )
    estimate = F.aggregate(
        pairs,
        F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s")),
        lambda acc, p: F.struct((acc.d + (p.x - p.y) * (p.x - p.y)).alias("d"), (acc.s + p.x * p.x + p.y * p.y).alias("s")),
        lambda acc: F.when(acc.s > 0, F.greatest(F.lit(0.0), 1 - acc.d / acc.s)).otherwise(F.lit(0.0)),
    )
    return F.when(F.slice(a, 1, EXACT) == F.slice(b, 1, EXACT), F.lit(1.0)).otherwise(estimate)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_group: int = 1_000) -> DataFrame:
    """(doc_id, text, v, next_text, next_v): each row with its fingerprint vector, and its successor by
    ascending id, the first row after the last."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least = -(1 << 63)
    rows = rows.withColumn("at", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least)))
    n = rows.count()
    parts = max(1, min(MAX_GROUPS, -(-n // rows_per_group)))
    shares = [k / parts for k in range(1, parts)]
    first, cuts = rows.agg(F.min("at"), F.percentile_approx("at", shares, max(10_000, 4 * parts)) if shares else F.array().cast("array<bigint>")).first()
    starts = sorted({first, *(cuts or [])} - {None})
    if not starts:
        v = vector(F.col("text"))
        return rows.select("doc_id", "text", v.alias("v"), F.col("text").alias("next_text"), v.alias("next_v"))
    # each start is an id of the table; the group of an id is the number of starts up to it, found by halving
    halves = [1 << k for k in range(len(starts).bit_length() - 1, -1, -1)]
    table = F.array(*(F.lit(x).cast("bigint") for x in starts))
    group = F.aggregate(
        F.array(*map(F.lit, halves)),
        F.lit(0),
        lambda at, half: F.when(
            (at + half <= len(starts)) & (F.col("at") >= F.element_at(table, F.least(at + half, F.lit(len(starts))))), at + half
        ).otherwise(at),
    )
    last = len(starts)
    before = F.when(F.col("group") == 1, last).otherwise(F.col("group") - 1)
    own = F.struct(F.col("group").alias("group"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("group"), F.lit(True).alias("guest"))
    placed = (
        rows.withColumn("group", group)
        .withColumn("v", vector(F.col("text")))
        .withColumn("in", F.explode(F.when(F.col("at") == F.element_at(table, F.col("group")), F.array(own, guest)).otherwise(F.array(own))))
        .select("doc_id", "at", "text", "v", "in.group", "in.guest")
    )
    order = W.partitionBy("group").orderBy("guest", "at", "text")
    following = F.lead(F.struct("text", "v")).over(order)
    found = placed.withColumn("following", following).where("NOT guest")
    return found.select("doc_id", "text", "v", F.col("following.text").alias("next_text"), F.col("following.v").alias("next_v"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    rows = with_next(read_table(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    start = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    rows = rows.withColumn("edited", F.concat(start, F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", "v", "next_v", F.sha2("edited", 256).alias("edited_sha256"), vector(F.col("edited")).alias("e"))
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("v")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("e")).alias("near_edited"),
        likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )


def _oracle() -> str:
    digest = lambda k: f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT)"
    exact = ", ".join(f"CAST(SUM(h{k}) % {_M32} AS BIGINT) AS s{k}" for k in range(EXACT))
    lanes = ", ".join(f"CAST(SUM(CASE WHEN (h{1 - j // 32} >> {j % 32}) & 1 = 1 THEN w ELSE 0 END) AS BIGINT) AS l{j}" for j in range(LANES))
    order = [j for c in range(LANES // 2) for j in (c, c + 32)]
    all_ = [f"s{k}" for k in range(EXACT)] + ["r"] + [f"l{j}" for j in order]
    text = lambda t: " || ".join(f"lpad(lower(hex({t}.{c})), 8, '0')" for c in all_)
    sign = lambda t, j: f"CAST(2 * {t}.l{j} - {t}.r AS DOUBLE)"
    diff = lambda a, b: " + ".join(f"({sign(a, j)} - {sign(b, j)}) * ({sign(a, j)} - {sign(b, j)})" for j in order)
    norm = lambda a, b: " + ".join(f"({sign(t, j)} * {sign(t, j)})" for j in order for t in (a, b))
    same = lambda a, b: " AND ".join(f"{a}.s{k} = {b}.s{k}" for k in range(EXACT))
    like = lambda a, b: (
        f"CASE WHEN {same(a, b)} THEN 1.0::DOUBLE WHEN {norm(a, b)} > 0 THEN GREATEST(0.0::DOUBLE, 1.0::DOUBLE - ({diff(a, b)}) / ({norm(a, b)})) ELSE 0.0::DOUBLE END"
    )
    return f"""
WITH o AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER (ORDER BY doc_id NULLS FIRST, COALESCE(text, '')) AS n, doc_id, COALESCE(text, '') AS t FROM documents
), x AS (
  SELECT a.n, a.doc_id, a.t, b.n AS m, b.t AS u, CAST(length(a.t) AS BIGINT) AS n_chars
  FROM o a JOIN o b ON b.n = CASE WHEN a.n = (SELECT MAX(n) FROM o) THEN 1 ELSE a.n + 1 END
), e AS MATERIALIZED (
  SELECT *, substr(t, 1, n_chars - n_chars // 2) || substr(u, 1, n_chars // 2) AS edited FROM x
), p AS MATERIALIZED (
  SELECT n, 0 AS kind, unnest(CASE WHEN t = '' THEN [''] ELSE regexp_extract_all(t, '{PIECE}') END) AS p FROM e
  UNION ALL SELECT n, 1, unnest(CASE WHEN edited = '' THEN [''] ELSE regexp_extract_all(edited, '{PIECE}') END) FROM e
), h AS (
  SELECT n, kind, CAST(round(sqrt(length(p))) AS BIGINT) AS w, sha256(p) AS d FROM p
), g AS MATERIALIZED (
  SELECT n, kind, w, {", ".join(f"{digest(k)} AS h{k}" for k in range(EXACT))} FROM h
), f AS MATERIALIZED (
  SELECT n, kind, {exact}, CAST(SUM(w) AS BIGINT) AS r, {lanes} FROM g GROUP BY n, kind
)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, {text("v")} AS fingerprint, {text("c")} AS edited_fingerprint,
  {like("v", "c")} AS near_edited, {like("v", "y")} AS near_next
FROM e JOIN f v ON v.n = e.n AND v.kind = 0 JOIN f c ON c.n = e.n AND c.kind = 1 JOIN f y ON y.n = e.m AND y.kind = 0
"""


ORACLE_SQL = _oracle()
