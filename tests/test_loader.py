"""Batches are of bounded size, hold every row once, are two at most at a time, and go on where they stopped."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from loculus.sources import loader


@pytest.fixture(scope="module")
def written(spark):
    rows = spark.range(0, 1000, 1, 5).filter("id < 400 OR id >= 600").select("id", F.concat(F.lit("q"), "id").alias("text"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("odd"))
    return rows, loader.write_batches(rows, 64)


def ids(batches):
    return [x for b in batches for x in b["id"].to_pylist()]


def test_every_row_once_in_order(spark, written):
    rows, path = written
    batches = list(loader.BatchLoader(spark, path))
    assert [b.num_rows for b in batches] == [64, 64, 64, 8] * 4  # one of five tasks has none
    assert ids(batches) == [r["id"] for r in rows.collect()]
    assert batches[0].column_names == ["id", "text", "odd"] and batches[0]["text"][3].as_py() == "q3" and batches[0]["odd"].null_count == 42


def test_two_batches_at_most(spark, written, monkeypatch):
    held, most = set(), 0
    load, number = loader.BatchLoader.load, itertools.count()

    class Held:
        def __init__(self, table):
            self.table, self.k = table, next(number)
            held.add(self.k)

        def __del__(self):
            held.discard(self.k)

    monkeypatch.setattr(loader.BatchLoader, "load", lambda self, *at: Held(load(self, *at)))
    for batch in loader.BatchLoader(spark, written[1]):
        most = max(most, len(held))
        assert batch.table.num_rows <= 64
        del batch
    assert 1 <= most <= 2


@pytest.mark.parametrize("stop", [1, 4, 7, 16])
def test_goes_on_where_it_stopped(spark, written, stop):
    rows, path = written
    first = loader.BatchLoader(spark, path)
    before = ids(itertools.islice(first, stop))
    after = ids(loader.BatchLoader(spark, path, first.position))
    assert before + after == [r["id"] for r in rows.collect()]


def test_no_rows(spark):
    empty = loader.write_batches(spark.range(0), 10)
    assert list(loader.BatchLoader(spark, empty)) == []
    with pytest.raises(ValueError, match="at least one"):
        loader.write_batches(spark.range(3), 0)
