import math
import re

import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from sensorloom.llm import queries, url_filter

URLS = [
    "https://A.Example.ORG/en/1?x=1", "http://example.org/es/3", "https://x.com/fr/1", "http://x.com/de/9#top",
    "https://b.net/de/9", "ftp://org/", "http://notorg/x", "http://example.org", "no scheme", "", None,
    "a://b://c/d", "http://m.example.org/en/2", "http://Ä.org/p", "http://h.org/" + "p" * 30_000,
]


def parts(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]


def rule_of(host, path):
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_rules_and_parts_equal_the_definition(spark):
    model = url_filter.train(queries.labelled_urls(spark))
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in url_filter.judge(rows, queries.RULES, model).collect():
        host, path = parts(URLS[r["page_id"]])
        rule = rule_of(host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule.name if rule else None)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["p_block"] >= 0.5 else "allow")


def test_the_model_tells_unseen_hosts(spark):
    model = url_filter.train(queries.labelled_urls(spark))
    urls = ["https://casino-win.example.edu/en/5", "https://shop.cheap-pills.example.edu/fr/8",
            "https://museum-shop.example.edu/en/5", "https://thehe.example.net/de/8"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(rows, [], model).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_precision_and_recall_on_names_held_out(spark):
    """Each name is judged by a model that has seen none of its URLs."""
    names = F.regexp_extract("url", r"([^/.]+)\.example", 1)
    rows = queries.labelled_urls(spark).withColumn("fold", F.pmod(F.crc32(names), F.lit(4))).withColumn("page_id", F.monotonically_increasing_id()).cache()
    hits = wrong = missed = 0
    for fold in range(4):
        model = url_filter.train(rows.where(F.col("fold") != fold))
        judged = url_filter.judge(rows.where(F.col("fold") == fold), [], model).join(rows.select("page_id", "blocked"), "page_id")
        got = {(r["blocked"], r["verdict"]): r["count"] for r in judged.groupBy("blocked", "verdict").count().collect()}
        hits, wrong, missed = hits + got.get((1, "block"), 0), wrong + got.get((0, "block"), 0), missed + got.get((1, "allow"), 0)
    # Measured: precision 0.97, recall 0.67; a third of the blocked names share too little with the others.
    assert hits / (hits + wrong) >= 0.9 and hits / (hits + missed) >= 0.6


def test_probability_equals_the_definition(spark):
    """N-grams hashed in plain Python with the model's own hash, weights summed by hand."""
    model = url_filter.train(queries.labelled_urls(spark))
    hashing = HashingTF(numFeatures=url_filter.FEATURES)
    for r in url_filter.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), [], model).collect():
        grams = set()
        for tag, part in zip("hp", parts(URLS[r["page_id"]])):
            closed = f"^{part}$"
            grams |= {f"{tag}:{closed[i : i + n]}" for n in url_filter.GRAMS for i in range(len(closed) - n + 1)}
        score = model.intercept + sum(model.coefficients[i] for i in {hashing.indexOf(g) for g in grams})
        assert r["p_block"] == pytest.approx(1 / (1 + math.exp(-score)), abs=1e-9)


@pytest.mark.parametrize("rows, share", [([], 0.0), ([("http://a/b", 1)], 1.0), ([(None, 1), ("http://a/b", 0)], 0.0)])
def test_without_both_labels_there_is_only_a_share(spark, rows, share):
    assert url_filter.train(spark.createDataFrame(rows, "url string, blocked int")) == share
    urls = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert url_filter.judge(urls, [], share).first()["verdict"] == ("block" if share else "allow")


def test_empty_table(spark):
    urls = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(urls, queries.RULES, url_filter.train(queries.labelled_urls(spark))).count() == 0
