"""Staged tables and scratch folders."""

import threading

import pytest

from hubwright.session import scratch, stage_table, staged_path


def test_scratch_removes_what_was_staged_inside(spark):
    kept = stage_table(spark.range(3))
    with scratch(spark):
        outer = stage_table(spark.range(5))
        with scratch(spark):
            inner = stage_table(spark.range(7))
            assert inner.count() == 7
        assert outer.count() == 5
        with pytest.raises(Exception, match="FILE|does not exist|No such"):
            inner.collect()
    assert kept.count() == 3


def test_threads_have_scratch_folders_of_their_own(spark):
    paths = []
    with scratch(spark):
        thread = threading.Thread(target=lambda: paths.append(staged_path(spark)))
        thread.start()
        thread.join()
        own = staged_path(spark)
    assert own.rsplit("/", 1)[0] != paths[0].rsplit("/", 1)[0]
    assert own.rsplit("/", 2)[0] == paths[0].rsplit("/", 1)[0]
