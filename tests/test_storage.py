"""Written tables, their removal, and broadcasts of a checked size."""

import os

import pytest
from pyspark.sql import functions as F

from shelfspark import storage


def joined(df, side):
    return df.join(side.withColumnRenamed("id", "k"), F.col("id") == F.col("k"))._jdf.queryExecution().optimizedPlan().toString()


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    side = storage.materialize(spark.range(1000), "side")
    assert "broadcast" in joined(spark.range(10), storage.small_side(side))
    assert "broadcast" not in joined(spark.range(10), storage.small_side(side, 999))
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 100)
    assert "broadcast" not in joined(spark.range(10), storage.small_side(side))


def test_settled_keeps_its_result_alone(spark):
    outer = storage.materialize(spark.range(5), "outer")
    seen = []

    def build():
        seen.append(storage.materialize(outer, "inner"))
        return storage.settled(spark, lambda: storage.materialize(seen[0].select((F.col("id") * 2).alias("id")), "deeper"), "middle")

    out = storage.settled(spark, build, "result")
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8] and outer.count() == 5
    assert not os.path.exists(seen[0].inputFiles()[0].removeprefix("file://")) if seen[0].inputFiles() else True
    with pytest.raises(Exception, match="(?i)not.*exist|file"):
        seen[0].collect()


WRITING = ["upsert_books", "upsert_status", "cover_quads", "indexed_search_author", "stored_answers", "answers_by_isbn", "observed_books", "inserted_ids", "affected_counts"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", WRITING)
def test_queries_leave_no_scratch(spark, name):
    """Of all that a query writes below the shared folder only its result stays."""
    from shelfspark.plans import QUERIES
    from shelfspark.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(set(os.listdir(folder)) - before) == 1
