from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vitrina.llm import url_filter as uf

CASES = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme casino", "", "", None, "block"),
    ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://a.example.net/fr/x", "a.example.net", "/fr/x", "net/", "block"),
    ("http://a.example.net", "a.example.net", "", None, "allow"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
    ("x://org/fr/casino://y/", "org", "/fr/casino://y/", "org/fr/", "allow"),
    ("https://free-bets.example.com/a", "free-bets.example.com", "/a", None, "block"),
    ("https://free-free.example.com/a", "free-free.example.com", "/a", None, "allow"),
    ("https://casinos.example.com/a", "casinos.example.com", "/a", None, "allow"),
    ("https://x.example.com/CASINO", "x.example.com", "/CASINO", None, "block"),
    ("https://h.com?x/y", "h.com", "", None, "allow"),
    ("https://free-click.example.com/a", "free-click.example.com", "/a", None, "allow"),
    ("https://free-loans.example.com/poker", "free-loans.example.com", "/poker", None, "block"),
    ("https://poker.example.com/a", "poker.example.com", "/a", None, "allow"),
]


@pytest.mark.parametrize("url,host,path,rule,verdict", CASES)
def test_case(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string")
    r = uf.judge(pages).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_repeats_nulls_and_empty(spark):
    pages = spark.createDataFrame([(None, None), (1, "http://a/b"), (1, "http://a/b")], "page_id long, url string").withColumn("rule", F.lit("x"))
    assert uf.judge(pages).count() == 3
    assert uf.judge(pages.where("false")).count() == 0


def test_too_many_terms():
    with pytest.raises(ValueError):
        uf.term_hits(F.lit("x"), {f"t{k}": 1 for k in range(uf.MAX_TERMS + 1)})
    with pytest.raises(ValueError):
        uf.term_hits(F.lit("x"), {"t": -1})


def test_weights_change_verdicts(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/apple-pear"), (2, "http://a/apple"), (3, "http://a/plum.fig?x=kiwi"), (4, "http://a/nut")], "page_id long, url string")
    verdicts = lambda v, **options: [r.verdict for r in uf.judge(pages, vocabulary=v, **options).orderBy("page_id").collect()]
    light = {"apple": 1, "pear": 2, "plum": 1, "fig": 1, "kiwi": 1}
    assert verdicts(light) == ["allow"] * 4
    assert verdicts(light | {"apple": 2}) == ["block", "allow", "allow", "allow"]
    assert verdicts(light | {"apple": 9, "nut": 0}) == ["block", "allow", "allow", "block"]
    assert verdicts(light, soft_limit=3) == ["block", "allow", "block", "allow"]
    assert verdicts({}) == ["allow"] * 4
    file = tmp_path / "terms.tsv"
    file.write_text("# terms\nApple\t2\npear\t2\n\nnut\t0\n")
    assert verdicts(uf.read_vocabulary(str(file))) == ["block", "allow", "allow", "block"]


def test_vocabulary_is_weighted():
    weights = uf.default_vocabulary()
    assert set(weights.values()) == {0, 1, 2, 3} and len(weights) > 120
    assert all(term.isascii() and term.isalnum() and term == term.lower() for term in weights)
