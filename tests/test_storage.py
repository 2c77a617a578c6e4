"""Written tables and their scopes."""

import os

import pytest

from foldwise.operators.storage import materialize, scratch


def place(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_scopes_remove_what_is_not_kept(spark):
    before = materialize(spark.range(3))
    with scratch(spark) as kept:
        gone = place(materialize(spark.range(5)))
        with scratch(spark) as held:
            inner = place(materialize(spark.range(7)))
            found = held(spark.range(9))
        assert not os.path.exists(inner) and found.count() == 9
        result = kept(found)
        within = place(found)
    assert not os.path.exists(gone) and not os.path.exists(within)
    assert before.count() == 3 and result.count() == 9


def test_a_scope_that_fails_cleans_up_too(spark):
    with pytest.raises(ValueError):
        with scratch(spark):
            path = place(materialize(spark.range(5)))
            raise ValueError("stop")
    assert not os.path.exists(path)
