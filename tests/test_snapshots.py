"""Versions of a table: upserts, deletes, pinned readers, failed writes and rival writers."""

import pytest
from pyspark.sql import functions as F

from docloom.sources import snapshots

SCHEMA = "suite string, tier int, n long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_versions(spark, tmp_path):
    with pytest.raises(ValueError, match="no table"):
        snapshots.Table(spark, f"file://{tmp_path}/t", ("suite", "tier"))
    t = snapshots.Table(spark, f"file://{tmp_path}/t", ("suite", "tier"), SCHEMA)
    assert rows(t.read()) == []
    assert t.upsert(frame(spark, [("a", 0, 1), ("a", 0, 2), ("b", 1, 3), (None, 1, 4)])) == 1
    pinned = t.read(1)
    assert t.upsert(frame(spark, [("a", 0, 9), (None, 1, 5), ("c", None, 6)])) == 2
    assert rows(t.read()) == rows(frame(spark, [("a", 0, 9), ("b", 1, 3), (None, 1, 5), ("c", None, 6)]))
    assert t.delete(frame(spark, [("b", 1, 0), ("c", None, 0), ("zz", 1, 0)])) == 3
    assert rows(t.read()) == rows(frame(spark, [("a", 0, 9), (None, 1, 5)]))
    assert rows(pinned) == rows(frame(spark, [("a", 0, 1), ("a", 0, 2), ("b", 1, 3), (None, 1, 4)])) and rows(t.read(2)) != rows(t.read(3))
    assert t.compact() == 4 and rows(t.read()) == rows(t.read(3)) and t.versions() == [0, 1, 2, 3, 4]
    assert t.upsert(frame(spark, [("b", 1, 7)])) == 5 and rows(t.read()) == rows(frame(spark, [("a", 0, 9), ("b", 1, 7), (None, 1, 5)]))
    again = snapshots.Table(spark, f"file://{tmp_path}/t", ("suite", "tier"))
    assert rows(again.read()) == rows(t.read())
    with pytest.raises(ValueError, match="no version 9"):
        t.read(9)
    with pytest.raises(ValueError, match="n bigint -> string"):
        t.upsert(frame(spark, [("a", 0, 1)]).withColumn("n", F.col("n").cast("string")))


def test_failed_and_rival_writes_leave_the_version(spark, tmp_path):
    t = snapshots.Table(spark, f"file://{tmp_path}/t", ("suite", "tier"), SCHEMA)
    t.upsert(frame(spark, [("a", 0, 1)]))
    bad = frame(spark, [("a", 0, 2)]).withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("long"))
    with pytest.raises(Exception, match="no"):
        t.upsert(bad)
    assert t.versions() == [0, 1] and rows(t.read()) == [("a", 0, 1)]
    rival = snapshots.Table(spark, f"file://{tmp_path}/t", ("suite", "tier"))
    assert rival.upsert(frame(spark, [("a", 0, 3)]), base=1) == 2
    with pytest.raises(snapshots.Conflict):
        t.upsert(frame(spark, [("a", 0, 4)]), base=1)
    assert t.versions() == [0, 1, 2] and rows(t.read()) == [("a", 0, 3)]
    assert t.upsert(frame(spark, [("a", 0, 4)])) == 3 and rows(t.read()) == [("a", 0, 4)]
