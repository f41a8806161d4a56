"""Staged tables: what is dropped, what stays, and where they may be."""

import os
from types import SimpleNamespace

import pytest
from quantloom import shared


def test_tables_of_a_block_go_but_for_those_taken_out(spark):
    with shared.temporary(spark) as made:
        _, gone = shared.stage_table(spark.range(3), "a")
        kept, path = shared.stage_table(spark.range(4), "b")
        made.remove(path)
    assert not os.path.exists(gone) and kept.count() == 4
    shared.drop_table(spark, path)
    assert not os.path.exists(path)


def test_tables_go_when_a_block_fails(spark):
    with pytest.raises(ValueError), shared.temporary(spark):
        _, path = shared.stage_table(spark.range(3), "c")
        raise ValueError
    assert not os.path.exists(path)


@pytest.mark.parametrize(("master", "named", "ok"), [("local", None, True), ("local[4]", None, True), ("local-cluster[2,1,1024]", None, False), ("spark://x:7077", None, False), ("yarn", "hdfs:///shared/", True)])
def test_a_cluster_must_name_its_folder(master, named, ok):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))
    if ok:
        assert shared.shared_dir(session) == (named or shared._FALLBACK).rstrip("/")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(session)


def test_a_smaller_arrow_bound_stays(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for given, want in (("100", "100"), ("10000", "512"), ("0", "512")):
        spark.conf.set(key, given)
        shared.bound_arrow_batches(spark)
        assert spark.conf.get(key) == want
    spark.conf.set(key, before)
