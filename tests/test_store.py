"""The keyed store: last writes, damage, null keys, switches, and joins by bucket."""

import pytest

from docloom.operators import adapters
from docloom.sources import store


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


def test_last_sound_write_counts(spark):
    s = store.open_store(spark, buckets=4)
    store.append(s, frame(spark, [("a", "1"), ("b", "1"), ("b", "2"), (None, "x"), ("c", None)]), at=1)
    store.append(s, frame(spark, [("a", "0"), ("d", "1")]), at=2)
    assert sorted(map(tuple, store.current(s).collect())) == [("a", "0"), ("b", "2"), ("d", "1")]
    bad = spark.createDataFrame([("a", "9", 3, "no"), ("e", "9", 3, None)], "key string, value string, at long, proof string")
    bad.write.mode("append").format("parquet").bucketBy(4, "key").sortBy("key").option("path", s.path).saveAsTable(s.table)
    spark.catalog.refreshTable(s.table)
    assert sorted(map(tuple, store.current(s).collect())) == [("a", "0"), ("b", "2"), ("d", "1")]
    again = store.open_store(spark, s.path, 4)  # another session's view of the same files
    assert store.current(again).count() == 3
    small = store.compact(s)
    assert spark.table(small.table).count() == 3 and store.current(small).count() == 3


def test_probe_does_not_shuffle_the_store(spark):
    s = store.open_store(spark, buckets=4)
    store.append(s, frame(spark, [(f"k{i}", str(i)) for i in range(200)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = frame(spark, [("k1", ""), ("zz", "")]).select("key")
        joined = wanted.join(store.current(s), "key", "left")
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("== Initial Plan ==")[0]
    assert "SelectedBucketsCount: 4 out of 4" in final and final.count("Exchange hashpartitioning") == 1


def test_through_store(spark):
    s = store.open_store(spark, buckets=4)
    store.append(s, frame(spark, [("a", "old"), ("b", "old")]), at=1)
    calls = spark.sparkContext.accumulator(0)
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 9), ("c", 4), (None, 6), (None, 5), ("d", 7)], "key string, n long")

    def compute(missing):
        def run(rows):
            for r in rows:
                calls.add(len(r))
                r = r[r["key"] != "d"]
                yield r.assign(value=r["n"].astype(str))[["key", "value"]]

        return missing.mapInPandas(run, "key string, value string")

    got = store.through_store(wanted, s, compute)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, "old", True), ("b", 2, "old", True), ("a", 3, "old", True), ("c", 9, "4", False), ("c", 4, "4", False), (None, 6, "5", False), (None, 5, "5", False), ("d", 7, None, False)], key=str)
    assert got.count() == 8 and calls.value == 3  # one call a missing key, however often the results are read
    assert sorted(map(tuple, store.current(s).collect())) == [("a", "old"), ("b", "old"), ("c", "4")]
    fresh = store.through_store(wanted, s, compute, read=False, write=False)
    assert {(x.key, x.value, x.hit) for x in fresh.collect()} == {("a", "1", False), ("b", "2", False), ("c", "4", False), (None, "5", False), ("d", None, False)}
    assert store.current(s).where("key = 'a'").first().value == "old"
    broken = store.Store(spark, "nowhere.none", "file:///proc/none", 4)
    with pytest.raises(Exception):
        store.append(broken, frame(spark, [("q", "1")]))
    assert store.through_store(wanted.limit(0), s, compute).count() == 0


def test_a_failed_write_leaves_the_results(spark, monkeypatch):
    s = store.open_store(spark, buckets=2)
    monkeypatch.setattr(store, "append", lambda *_: 1 / 0)
    got = store.through_store(frame(spark, [("a", "x")]).select("key"), s, lambda m: m.selectExpr("key", "'v' AS value"))
    assert [tuple(x) for x in got.collect()] == [("a", "v", False)] and store.current(s).count() == 0


def test_through_cache_takes_repeated_and_null_keys(spark):
    wanted = frame(spark, [("a", ""), ("b", ""), ("a", ""), (None, "")]).select("key")
    calls = spark.sparkContext.accumulator(0)

    def compute(missing):
        def run(rows):
            for r in rows:
                calls.add(len(r))
                yield r.assign(value="made")[["key", "value"]]

        return missing.mapInPandas(run, "key string, value string")

    results, new = adapters.through_cache(wanted, frame(spark, [("b", "1"), ("b", "2")]), compute)
    assert sorted(map(tuple, results.collect()), key=str) == sorted([("a", "made", False), ("a", "made", False), ("b", "2", True), (None, "made", False)], key=str)
    assert new.count() == 2 and results.count() == 4 and calls.value == 2
