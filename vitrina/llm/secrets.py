"""Secret scans: fixed patterns, and character Markov models for the rest.

Three patterns give the base spans (``assign``, ``access``, ``hex``). Other runs
of ``RUN`` characters are judged by two first-order character models, of random
strings and of ordinary identifiers: a run whose log-likelihood ratio reaches
``LLR_LIMIT`` becomes a ``random`` span; where base spans lie on it, its parts
outside them do.

The models are trained on labelled samples: the values of base spans are random
strings, the runs of at least ``SAMPLE_LENGTH`` characters outside them are
ordinary identifiers. The random model is half the learnt one and half uniform,
so keys unlike those seen count as random too; the other is a twentieth uniform,
so a rare pair, as in a path, weighs little. Training reads all documents: equal
samples are counted before the shuffle, then their character pairs are, and the
driver gets the counts of at most 67 x 67 pairs of either kind.

Everything is DataFrame functions. Places of matches come from the lengths of
the pieces between them, summed by blocks. Scanning needs no shuffle.

Defined cases: null text is the empty text and has no span; very long texts are
scanned whole (work in proportion to their length, and to the square of the
number of matches over 256); spans of equal start go by kind; repeated rows
repeat; without any sample the random model is uniform and so is the other, so
nothing is added; an empty table gives an empty result; other columns are
ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, read_table, running_totals

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short fail as a whole, so a least length finds the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
SAMPLE_LENGTH = 8
SAMPLE = rf"[A-Za-z0-9+/_=-]{{{SAMPLE_LENGTH},}}"
LLR_LIMIT = 12.0
MARK = "[SECRET]"

_SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def _places(text: Column, pattern: str, kind: int) -> Column:
    """All matches as structs (start, end, kind, value), code points."""
    none = F.array().cast(_SPAN)

    def placed(m: Column) -> Column:
        gaps = F.slice(m.gaps, F.lit(1), F.size(m.found))
        steps = F.zip_with(gaps, m.found, lambda b, f: (F.length(b) + F.length(f)).cast("bigint"))
        starts = F.zip_with(running_totals(steps), gaps, lambda s, b: s + F.length(b))
        return F.zip_with(
            starts, m.found, lambda s, f: F.struct(s.alias("start"), (s + F.length(f)).alias("end"), F.lit(kind).alias("kind"), f.alias("value"))
        )

    def split(found: Column) -> Column:
        pieces = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))
        return F.when(F.size(found) > 0, bind(pieces, placed)).otherwise(none)

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), split)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, kind by kind."""
    none = F.array().cast(_SPAN)
    assigned = F.filter(_places(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s.value, ASSIGN, 2)) >= 6)
    access = F.when(F.contains(text, F.lit("AKIA")), _places(text, ACCESS, 1)).otherwise(none)
    return F.concat(assigned, access, _places(text, HEX, 2))


def _outside(runs: Column, base: Column) -> Column:
    """The parts of the runs that no base span covers."""
    none = F.array().cast(_SPAN)

    def part(run: Column, start: Column, end: Column) -> Column:
        value = F.substring(run.value, (start - run.start + 1).cast("int"), (end - start).cast("int"))
        one = F.struct(start.alias("start"), end.alias("end"), run.kind.alias("kind"), value.alias("value"))
        return F.when(start < end, F.array(one)).otherwise(none)

    def parts(run: Column) -> Column:
        on_it = F.array_sort(F.filter(base, lambda o: (o.start < run.end) & (run.start < o.end)))
        first = F.struct(run.start.alias("at"), none.alias("out"))
        step = lambda acc, o: F.struct(F.greatest(acc.at, o.end).alias("at"), F.concat(acc.out, part(run, acc.at, o.start)).alias("out"))
        cut = F.aggregate(on_it, first, step, lambda acc: F.concat(acc.out, part(run, acc.at, run.end)))
        return F.when(F.size(on_it) > 0, cut).otherwise(F.array(run))

    return F.flatten(F.transform(runs, parts))


class Model:
    """Log-likelihood ratio of every pair of characters, random against ordinary."""

    def __init__(self, random: dict[str, int], ordinary: dict[str, int], smoothing: float = 0.5):
        n = len(ALPHABET)

        def learnt(counts: dict[str, int]) -> list[list[float]]:
            rows = [[counts.get(a + b, 0) + smoothing for b in ALPHABET] for a in ALPHABET]
            return [[x / sum(row) for x in row] for row in rows]

        if not ordinary:
            self.ratio = [0.0] * (n * n)
            return
        r, o = learnt(random), learnt(ordinary)
        self.ratio = [math.log((0.5 * r[i][j] + 0.5 / n) / (0.95 * o[i][j] + 0.05 / n)) for i in range(n) for j in range(n)]

    def llr(self, value: Column) -> Column:
        """Log-likelihood ratio of a run of characters of the alphabet."""
        table = F.array(*map(F.lit, self.ratio))
        place = lambda i: F.position(F.substring(value, i, F.lit(1)), F.lit(ALPHABET))
        n = F.length(value)

        def total(codes: Column) -> Column:
            ratios = F.zip_with(
                F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda x, y: F.element_at(table, (x - 1) * len(ALPHABET) + y)
            )
            return F.aggregate(ratios, F.lit(0.0), lambda acc, x: acc + x)

        return bind(F.transform(F.sequence(F.lit(1), n), place), total)


def _pairs(values: DataFrame) -> DataFrame:
    """(pair, n) of the characters of column ``value`` weighted by column ``n``."""
    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1))
    pairs = values.where(F.length("value") > 1).select("n", "value", at.alias("at"))
    return pairs.groupBy(F.substring("value", F.col("at"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Models from the labelled samples of all documents."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    values = [F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)]
    values += [F.regexp_extract_all("text", F.lit(pattern), F.lit(0)) for pattern in (ACCESS, HEX)]
    random = rows.select(F.explode(F.concat(*values)).alias("value")).select(F.regexp_replace("value", r"\.", "").alias("value"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = rows.select(F.explode(F.regexp_extract_all(rest, F.lit(SAMPLE), F.lit(0))).alias("value"))
    counts = [{r["pair"]: r["n"] for r in _pairs(x.groupBy("value").agg(F.count("*").alias("n"))).collect()} for x in (random, ordinary)]
    return Model(*counts)


def scan(docs: DataFrame, model: Model, text_col: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with a column of spans: array of structs (start, end, kind, value), by start, then kind.

    ``kind`` is a place in KINDS; ends are exclusive; both in code points.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    likely = F.filter(_places(text, RUN, 3), lambda s: model.llr(s.value) >= LLR_LIMIT)
    every = bind(base_spans(text), lambda base: F.concat(base, _outside(likely, base)))
    by_place = lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1).otherwise(a.kind - b.kind)
    return docs.withColumn(spans, F.array_sort(every, by_place))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with each secret replaced by MARK; overlapping spans become one. ``n_chars`` follows, if there is one."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def merged(spans: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            longer = F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"))
            new = F.struct(s.start.alias("start"), s.end.alias("end"))
            return F.when(
                (F.size(acc) > 0) & (last.end > s.start),
                F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer)),
            ).otherwise(F.concat(acc, F.array(new)))

        return F.aggregate(spans, F.array().cast(kind), step)

    def masked(m: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(m, lambda s: s.end))
        cut = lambda start, end: F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
        kept = F.zip_with(m, F.slice(ends, F.lit(1), F.size(m)), lambda s, end: F.concat(cut(end, s.start), F.lit(MARK)))
        return F.concat(F.array_join(kept, ""), cut(F.element_at(ends, -1), F.length(text)))

    text = F.col("text")
    scanned = scan(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).withColumn("text", F.col("row").getField(text_col)), model)
    clean = F.when(F.size("spans") > 0, bind(merged(F.col("spans")), masked)).otherwise(text)
    rows = scanned.withColumn("clean", clean)
    names = {text_col: F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    return rows.select(*((names[c] if c in names else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = read_table(spark, sf_dir, "documents")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s.kind < 3)
    count = lambda kind: F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")
    return scan(docs.select("doc_id", "text"), train(docs)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(spans).alias("spans"),
    )
