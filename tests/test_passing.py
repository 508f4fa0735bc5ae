"""Scratch tables of steps that nobody reads afterwards."""

from __future__ import annotations

import os

import pytest

from lectern.operators import graph


def test_tables_of_passing_steps_go(spark):
    def place(df) -> str:
        return os.path.dirname(df.inputFiles()[0].removeprefix("file:").replace("///", "/"))

    kept = graph.written(spark.range(3))
    with graph.passing(spark):
        gone = place(graph.written(spark.range(3)))
        with graph.passing(spark):
            inner = place(graph.written(spark.range(2)))
        assert os.path.exists(gone) and not os.path.exists(inner)
    assert not os.path.exists(gone) and kept.count() == 3
    with pytest.raises(ValueError), graph.passing(spark):
        gone = place(graph.written(spark.range(3)))
        raise ValueError
    assert not os.path.exists(gone)
    later = graph.written(spark.range(3))
    assert later.count() == 3 and os.path.exists(place(later))
