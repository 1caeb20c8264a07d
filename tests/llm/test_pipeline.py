"""The pipeline against its operators applied one by one."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.conftest import prose
from tidemark.llm import decontamination, near_duplicates, quality_model
from tidemark.llm.common import written
from tidemark.sources.paths import fresh


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.collect()}
    scores = {r.doc_id: r.predicted for r in quality_model.score(docs, labels).collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, at, sf_dir)
        assert new.dtypes == docs.dtypes
        if name == "quality":
            assert ids(new) == {d for d, p in scores.items() if p}
        elif name == "near_duplicates":
            assert ids(new) == {r.doc_id for r in near_duplicates.judge(at).where("kept").collect()}
        elif name == "decontamination":
            assert ids(new) == {r.doc_id for r in decontamination.judge(at, items).where("NOT contaminated").collect()}
        else:
            assert ids(new) == ids(at)
        at = written(new, f"test-{name}")
    want = ids(at)
    assert 0 < len(want) < docs.count()
    last = corpus_pipeline.run(spark, sf_dir)
    assert ids(last) == want == ids(corpus_pipeline.STAGES[-1][1](spark, at, sf_dir))


def _folder(spark, docs, labels, items):
    """A folder of tables as a run reads them."""
    path = fresh(spark, "tables")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_over_odd_rows(spark, odd_docs, make_docs):
    good = [prose(k, 120).capitalize() for k in range(40)]
    junk = [" ".join(w + "###$$$" for w in prose(500 + k, 90).split()) for k in range(20)]
    docs = odd_docs.unionByName(make_docs([(100 + k, t) for k, t in enumerate(good + junk)]))
    docs = docs.unionByName(docs.where("doc_id IN (100, 101)")).unionByName(make_docs([(None, prose(900, 150))]))
    # Nearly the same as another, and one that holds an item.
    docs = docs.unionByName(make_docs([(300, good[3] + " some more"), (301, prose(901, 100) + " " + prose(77, 40) + " " + prose(902, 100))]))
    labels = [(100 + k, int(k < 40), 0) for k in range(60)] + [(None, 1, 0), (1, None, 0), (2, 0, 0)]
    got = corpus_pipeline.run(spark, _folder(spark, docs, labels, [(1, prose(77, 40)), (None, None), (1, "")]))
    assert got.columns == ["doc_id", "shard", "rows", "bytes", "tier", "version"]
    ids = sorted(str(r.doc_id) for r in got.collect())
    assert len(ids) == len(set(ids))  # also of the null ids one text stays
    assert set(ids) - {"4", "5", "None"} == {str(100 + k) for k in range(40)}


def test_run_over_empty_tables(spark, odd_docs):
    assert corpus_pipeline.run(spark, _folder(spark, odd_docs.limit(0), [], [])).count() == 0
    # Without labels no text reaches the score that is asked for.
    assert corpus_pipeline.run(spark, _folder(spark, odd_docs, [], [])).count() == 0
