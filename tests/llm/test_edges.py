"""Every operator on odd rows and on empty tables: no crash, a row a document, columns as they were."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, lm_scoring, mixing, near_duplicates, quality_model, robust_rules, sharding, substring_dedup, url_rules
from tidemark.sources.paths import shared_folder

ITEMS = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 0, 0), (None, 1, 0), (6, None, None), (99, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "a b c d e f g"), (4, "a b c d e f g")], ITEMS)


def judges(labels, items):
    return {
        "lm": lm_scoring.score,
        "near": near_duplicates.judge,
        "substring": substring_dedup.judge,
        "quality": lambda d: quality_model.score(d, labels),
        "mixing": lambda d: mixing.schedule(d, {"s": 2}, 100),
        "line": line_dedup.judge,
        "bench": lambda d: decontamination.judge(d, items),
        "robust": robust_rules.judge,
    }


NAMES = list(judges(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(odd_docs, labels, items, name):
    got = judges(labels, items)[name](odd_docs)
    assert got.count() == odd_docs.count()
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in odd_docs.collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(odd_docs, labels, items, name):
    assert judges(labels, items)[name](odd_docs.limit(0)).count() == 0


def test_empty_side_tables(odd_docs, labels, items):
    assert decontamination.judge(odd_docs, items.limit(0)).where("contaminated").count() == 0
    scores = [r.score for r in quality_model.score(odd_docs, labels.limit(0)).collect()]
    assert set(scores) == {0.0, 0.5}


def cleaners(labels, items):
    return {
        "near": near_duplicates.one_of_each,
        "substring": substring_dedup.clean,
        "line": line_dedup.clean,
        "quality": lambda d: quality_model.keep_good(d, labels),
        "bench": lambda d: decontamination.clean(d, items),
        "mixing": lambda d: mixing.interleaved(d, {"s": 2}, 100),
    }


@pytest.mark.parametrize("name", list(cleaners(None, None)))
def test_cleaners_keep_the_columns(odd_docs, labels, items, name):
    clean = cleaners(labels, items)[name]
    got = clean(odd_docs)
    assert got.dtypes == odd_docs.dtypes
    assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in odd_docs.collect()}
    assert clean(odd_docs.limit(0)).count() == 0


def test_one_of_each_of_odd_rows(odd_docs):
    got = near_duplicates.one_of_each(odd_docs)
    # All wordless rows stay (null, null, empty, blank, marks), one of the long pair, and doc 5 of the equal short ones.
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "4", "5", "7", "None"]


def test_shards_of_odd_rows_and_none(spark, odd_docs):
    for k, rows in enumerate((odd_docs, odd_docs.limit(0))):
        store = sharding.ShardTable(spark, f"{shared_folder(spark)}/test-odd-{k}-{id(rows)}", sharding.Tiers(arrival_rows=2, target_bytes=1 << 20, least_runs=2))
        store.append(rows)
        store.compact()
        got = store.read()
        assert got.dtypes == rows.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://Sub.COM/en/x?q#f", "ftp://x.example.com/en/77", "http://example.net/de/8", "http://a.net/de/9", "http://com?en/", "http://notcom/en/", "http://a..org/es/", "http://b.bad.test/x"]
    pages = spark.createDataFrame([(i, u, "h", "z") for i, u in enumerate(urls)] + [(None, urls[4], None, None)] * 2, "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), (None, "/", "block"), ("com", "/en/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("bad.test", "")], "host string, path string")
    got = {r.page_id: r for r in url_rules.judge(pages, rules, listed).collect()}
    assert [got[i].verdict for i in range(len(urls))] == ["allow"] * 4 + ["block", "allow", "block", "allow", "allow", "allow", "block", "block"]
    assert (got[4].host, got[4].path, got[4].rule) == ("sub.com", "/en/x", "com/en/")
    assert (got[5].rule, got[7].rule, got[11].rule, got[11].by) == ("example.com/en/7", "net/de/", None, "list")
    assert url_rules.judge(pages, rules, listed).count() == len(urls) + 2
    assert url_rules.judge(pages.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


def test_mixing_empty_parts_are_refused(spark):
    with pytest.raises(ValueError):
        mixing.period(spark, {"a": 0})
    assert mixing.period(spark, {"*": 1}).select(F.sum("at")).first()[0] == 0
