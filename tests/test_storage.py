"""Intermediate tables and their removal."""

from pathlib import Path

import pytest

from shelfmark.storage import materialize, tables_removed


def test_tables_of_a_block_are_removed(spark):
    before = materialize(spark.range(3))
    with tables_removed(spark) as paths:
        lasting = materialize(spark.range(4), keep=True)
        kept = materialize(spark.range(5))
        assert kept.count() == 5 and len(paths) == 1
    assert before.count() == 3 and lasting.count() == 4 and not Path(paths[0].removeprefix("file:")).exists()
    with pytest.raises(Exception):
        kept.count()


def test_tables_are_removed_after_a_failure(spark):
    with pytest.raises(ValueError), tables_removed(spark) as paths:
        materialize(spark.range(2))
        raise ValueError
    assert len(paths) == 1 and not Path(paths[0].removeprefix("file:")).exists()
