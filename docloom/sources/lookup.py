"""Tables sorted by id, looked up by a few ids, and counted without reading rows.

A table is written in ranges of its id, with a Parquet Bloom filter on the id,
and beside it a list of files with their first and last id and row count. A
look-up opens the files whose range holds an id that is asked for; within them
Parquet's own statistics and filters leave out groups of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of one look-up that are compared one by one with the files' ranges on the driver.
MOST = 100_000


def write_sorted(rows: DataFrame, path: str, key: str, files: int = 64) -> None:
    """Write ``rows`` in about ``files`` ranges of ``key`` (null keys first), and the list of files."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(files, key).sortWithinPartitions(key)
    dealt.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    listed = stored.groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))
    listed.coalesce(1).write.parquet(f"{path}/files")


def count(spark: SparkSession, path: str) -> int:
    """Rows of the table, from its list of files."""
    return spark.read.parquet(f"{path}/files").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def look_up(spark: SparkSession, path: str, key: str, ids: list) -> DataFrame:
    """The rows of the given ids, at most ``MOST``; ids that the table lacks and null find nothing."""
    wanted = sorted({x for x in ids if x is not None})
    if len(wanted) > MOST:
        raise ValueError(f"a look-up takes {MOST} ids at most; join the table with more")
    listed = spark.read.parquet(f"{path}/files")
    asked = spark.createDataFrame([(x,) for x in wanted], f"id_ {listed.schema['low'].dataType.simpleString()}")
    files = listed.join(F.broadcast(asked), (F.col("id_") >= F.col("low")) & (F.col("id_") <= F.col("high")), "left_semi").select("file")
    places = [r["file"] for r in files.collect()]
    schema = spark.read.parquet(f"{path}/rows").schema if listed.limit(1).count() else None
    if not places:
        return spark.read.schema(schema).parquet(f"{path}/rows").limit(0) if schema else spark.createDataFrame([], asked.schema)
    return spark.read.schema(schema).parquet(*places).where(F.col(key).isin(wanted))
