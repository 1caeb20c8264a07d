"""The shared folder and what is written in it."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from tidemark.sources import paths


def fake(master, setting=None):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master=master, applicationId="app-1", getConf=lambda: SimpleNamespace(get=lambda key: setting))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_only_local_masters_may_leave_the_shared_folder_unset():
    assert paths.shared_folder(fake("local[2]")) == paths.LOCAL_SHARED
    assert paths.shared_folder(fake("spark://a:7077", "hdfs://shared/")) == "hdfs://shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        paths.shared_folder(fake("spark://a:7077"))


def test_an_application_writes_into_its_own_folder():
    assert paths.scratch(fake("local[2]")) == f"{paths.LOCAL_SHARED}/tidemark/app-1"


def test_written_tables_are_read_again_and_cleared(spark, monkeypatch):
    monkeypatch.setattr(paths, "scratch", lambda s: f"{paths.shared_folder(s)}/tidemark/test-clear")
    rows = paths.written(spark.range(5), "rows")
    assert rows.count() == 5 and "Parquet" in rows._jdf.queryExecution().toString() or rows.inputFiles()
    paths.clear(spark)
    assert not paths.exists(spark, paths.scratch(spark))


def test_a_folder_is_published_once(spark, tmp_path):
    for n in (3, 7):
        spark.range(n).write.parquet(f"{tmp_path}/new{n}")
    there = f"{tmp_path}/a/b/table"
    assert paths.publish(spark, f"{tmp_path}/new3", there) and not paths.publish(spark, f"{tmp_path}/new7", there)
    assert spark.read.parquet(there).count() == 3
    assert paths.folders(spark, str(tmp_path), 2) == ["a/b"] and paths.folders(spark, f"{tmp_path}/none", 1) == []
    assert paths.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
