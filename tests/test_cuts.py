"""Tables of ``cut``: what a block leaves, and what stays readable after it."""

from __future__ import annotations

import os

import pytest

from nightjar.operators import corpus


def _tables(spark):
    root = corpus.scratch_root(spark).removeprefix("file:")
    return {x for x in os.listdir(root) if x.startswith("nightjar-cut-")}


def test_block_removes_its_tables(spark):
    before = _tables(spark)
    with corpus.cuts():
        rows = corpus.cut(spark.range(10))
        kept = corpus.cut(rows.selectExpr("id * 2 AS id"), keep=True)
        assert len(_tables(spark) - before) == 2
    assert len(_tables(spark) - before) == 1
    assert sorted(r.id for r in kept.collect()) == list(range(0, 20, 2))


def test_block_removes_its_tables_after_an_error(spark):
    before = _tables(spark)
    with pytest.raises(ValueError), corpus.cuts():
        corpus.cut(spark.range(3))
        raise ValueError
    assert _tables(spark) == before
    corpus.cut(spark.range(1))  # outside a block tables stay
    assert len(_tables(spark) - before) == 1
