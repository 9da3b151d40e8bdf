"""The commit log: snapshots, writers in each other's way, revisions."""

import os

import pytest

from tidemark.sources import sinks
from tidemark.sources.commits import CommitLog, Refused, Revisions


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_two_writers_from_one_snapshot(spark, tmp_path):
    """One retries on what the other left; no row is doubled, nothing of the first try stays."""
    store, calls = CommitLog(spark, str(tmp_path / "t")), []
    assert store.read() is None and store.append(spark.range(3)) == 1

    def fill(old):
        calls.append(store.last())
        if len(calls) == 1:
            assert store.append(spark.range(3, 5)) == 2
        return spark.range(8).join(old, "id", "left_anti")

    assert store.change(fill) == 3 and calls == [1, 2]
    assert ids(store.read()) == list(range(8))
    assert [ids(store.read(k)) for k in (1, 2)] == [[0, 1, 2], [0, 1, 2, 3, 4]]
    assert len(os.listdir(tmp_path / "t" / "data")) == 3
    with pytest.raises(LookupError):
        store.read(9)


def test_a_reader_keeps_its_snapshot_while_the_table_is_replaced(spark, tmp_path):
    store = CommitLog(spark, str(tmp_path / "t"))
    store.append(spark.range(4))
    old = store.read()
    assert store.replace(spark.range(10, 12)) == 2
    assert ids(old) == [0, 1, 2, 3] and ids(store.read()) == [10, 11]
    store.append(spark.range(12, 13))
    assert store.compact() == 4 and store.entry(4)["since"] == 4 and ids(store.read()) == [10, 11, 12]


def test_a_failed_commit_leaves_the_table(spark, tmp_path):
    store = CommitLog(spark, str(tmp_path / "t"))
    store.append(spark.range(2))
    with pytest.raises(Exception, match="no"):
        store.replace(spark.range(1).selectExpr("raise_error('no') AS id"))
    with pytest.raises(Refused):
        store.append(spark.range(1).selectExpr("id AS other"))
    assert store.last() == 1 and ids(store.read()) == [0, 1]
    assert store.clean() == 0 and store.clean(-5) >= 1 and ids(store.read()) == [0, 1]


def test_batches_of_a_writer_count_once(spark, tmp_path):
    store = CommitLog(spark, str(tmp_path / "t"))
    for batch in (0, 0, 1, 0, 1):
        store.change(lambda _, b=batch: spark.range(b, b + 1), writer="w", batch=batch)
    assert ids(store.read()) == [0, 1]


def test_revisions_of_a_key(spark, tmp_path):
    store = Revisions(spark, str(tmp_path / "r"), ["k"])
    make = lambda *rows: spark.createDataFrame(rows, "k long, v string, w long")
    assert store.current() is None
    assert store.deliver(make((1, "a", 1), (2, None, 2), (None, "n", 0), (1, "a", 1))) == 1
    assert store.deliver(make((1, "a", 1), (2, None, 2), (None, "n", 0))) == 1
    assert store.deliver(make((1, "b", 1), (2, None, None), (None, "n", 0), (3, "c", 3))) == 2
    assert store.deliver(make((1, "a", 1), (2, None, None), (None, "n", 0), (3, "c", 3))) == 3
    got = sorted((r["k"] or 0, r["revision"], r["v"], r["w"]) for r in store.current().collect())
    assert got == [(0, 1, "n", 0), (1, 3, "a", 1), (2, 2, None, None), (3, 1, "c", 3)]
    assert store.log.read().count() == 7
    for bad in (make((1, "z", 1)), make((1, "a", 1), (1, "b", 1), (2, None, 2), (None, "n", 0), (3, "c", 3))):
        with pytest.raises(Refused):
            store.deliver(bad)
    assert store.deliver(make((3, "d", 3)), within="k = 3") == 4
    assert store.deliver(make(), within="k > 9") == 4


def test_presets_of_one_revision(spark, tmp_path):
    """Of two that read the same revision one is refused, even if both read before either wrote."""
    store = sinks.Presets(spark, str(tmp_path / "p"))
    store.write("x", {"a": 1})
    other = sinks.Presets(spark, str(tmp_path / "p"))
    other.read = lambda name, old=store.read("x"): old
    assert store.write("x", {"a": 2}, 1) == 2
    with pytest.raises(ValueError):
        other.write("x", {"a": 3}, 1)
    assert store.read("x")["settings"] == {"a": 2}
