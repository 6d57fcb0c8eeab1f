"""URL filters: host rules, then a weighted URL vocabulary.

A rule (host, path) fits its host and all subdomains when the url's path starts
with the rule's; the longest fitting rule decides. Other urls are judged by
their words: one Aho-Corasick pass over the lower-cased url counts strict and
soft terms that stand between non-alphanumerics (or the ends). One strict term
rejects; so do ``SOFT_TERMS`` or more distinct soft terms whose weights add up to
``SOFT_LIMIT``.

The vocabulary is a parameter: (term, weight) pairs, weight 0 for a strict term,
from code or from a file of lines ``term<TAB>weight``. The default one is made of
stems and the endings of their kind. Rules and terms are sent with the tasks (at
most ``MAX_TERMS``, checked), a task builds the automaton once, and urls are judged
row by row, without a shuffle.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and is judged by its words (none: allow); a very long url is read whole;
of rules that fit, none are equally long, as rules are distinct; repeated rows
repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, read_table

#: (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Stems by weight (0: strict), and the endings that make terms of them.
STEMS = {
    0: "adult casino escort hentai malware phishing porn sex spam viagra warez xxx",
    3: "bet crack gambl keygen lotter nude pill poker torrent",
    2: "cam date dating jackpot loan pharmac prize slot win",
    1: "ad bonus cheap click credit deal discount farm free gift hot promo sale track",
}
ENDINGS = {0: "", 3: " s ing er ers y ies", 2: " s ing ner ners y ies", 1: " s es er ing"}


def default_vocabulary() -> dict[str, int]:
    """Weight of each term, 0 for strict ones."""
    return {stem + ending: weight for weight, stems in STEMS.items() for stem in stems.split() for ending in ENDINGS[weight].split(" ")}


def read_vocabulary(path: str) -> dict[str, int]:
    """Terms of a file (read by the driver): lines ``term<TAB>weight``; blank lines and those after # don't count."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if line.strip() and not line.startswith("#")]
    return {term.strip().lower(): int(weight) for term, weight in rows}


SOFT_LIMIT, SOFT_TERMS = 4, 2
MAX_TERMS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name in sorted(rules, key=lambda r: len(r[1])):  # the longest last, so it decides
        own, slash, start = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def term_hits(url: Column, vocabulary: Mapping[str, int]) -> Column:
    """struct(strict: strict hits, soft: distinct soft terms hit, weight: their weight)."""
    terms = {term: int(weight) for term, weight in vocabulary.items() if term}
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    if any(weight < 0 for weight in terms.values()):
        raise ValueError("weights can't be negative")

    @F.pandas_udf("strict int, soft int, weight int")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            automaton.add_word(term, (term, weight))
        automaton.make_automaton()
        bound = lambda s, at: not 0 <= at < len(s) or not (s[at].isascii() and s[at].isalnum())
        for urls in batches:
            hits = []
            for url in urls:
                n_strict, found = 0, {}
                for last, (term, weight) in automaton.iter(url) if terms else ():
                    if bound(url, last + 1) and bound(url, last - len(term)):
                        if weight:
                            found[term] = weight
                        else:
                            n_strict += 1
                hits.append((n_strict, len(found), sum(found.values())))
            yield pd.DataFrame(hits, columns=["strict", "soft", "weight"], dtype="int32")

    return judged(lower_ascii(F.coalesce(url, F.lit(""))))


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary: Mapping[str, int] | None = None, soft_limit: int = SOFT_LIMIT, soft_terms: int = SOFT_TERMS
) -> DataFrame:
    """(page_id, host, path, rule, strict, soft, weight, verdict) of every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    hits = term_hits(F.col("url"), default_vocabulary() if vocabulary is None else vocabulary)
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), hits.alias("hits"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    by_words = F.when((F.col("hits.strict") > 0) | ((F.col("hits.soft") >= soft_terms) & (F.col("hits.weight") >= soft_limit)), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), "hits.*", F.coalesce(says, by_words).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages."""
    return judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    low = "translate(COALESCE(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda r: f"(host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in rules) + " END"
    terms = ", ".join(f"('{term}', {weight})" for term, weight in default_vocabulary().items())
    # terms are alphanumeric, so a term between other characters is a whole run
    return f"""
WITH v AS (SELECT * FROM (VALUES {terms}) t(term, weight)
), u AS (
  SELECT ROW_NUMBER() OVER () AS r, page_id, {low} AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT r, BOOL_OR(weight = 0) AS strict, COUNT(*) FILTER (weight > 0) AS soft, SUM(weight) AS weight
  FROM (SELECT DISTINCT r, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS term FROM u) JOIN v USING (term) GROUP BY r
), p AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), j AS (
  SELECT p.*, {case(1)} AS rule, {case(0)} AS says, COALESCE(h.strict OR (h.soft >= {SOFT_TERMS} AND h.weight >= {SOFT_LIMIT}), FALSE) AS words FROM p LEFT JOIN h USING (r)
)
SELECT page_id, host, path, rule, COALESCE(says, CASE WHEN words THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""


ORACLE_SQL = _oracle()
