"""Tables in the shared folder and the scopes that drop them."""

import os

import pytest

from tilewright import scratch


def there(df):
    return os.path.exists(df._tilewright_path.removeprefix("file://"))


def test_scopes_drop_what_is_not_kept(spark):
    make = lambda n: scratch.materialize(spark.range(n), "t")
    free = make(1)
    with scratch.temporary() as outer:
        a = make(2)
        with scratch.temporary() as inner:
            b, c, d = make(3), make(4), make(5)
            assert inner.keep(b) is b
            scratch.drop(d)
            assert not there(d)
        assert there(a) and there(b) and not there(c)
        outer.keep(a)
    assert there(a) and not there(b) and there(free)
    assert a.count() == 2 and free.count() == 1
    scratch.drop(a)
    scratch.drop(None)
    scratch.drop(spark.range(3))  # no table of ours
    assert not there(a)


def test_a_failing_scope_drops_too(spark):
    with pytest.raises(RuntimeError), scratch.temporary():
        lost = scratch.materialize(spark.range(3), "t")
        raise RuntimeError
    assert not there(lost)
