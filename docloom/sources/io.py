"""Sources and sinks: page texts, JSON and YAML files, and partition-wise upserts."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, sha256): whole text files."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents by a given schema; an unreadable one is a row with ``unreadable`` set."""
    made = spark.read.schema(StructType([*StructType.fromDDL(schema).fields, StructField("_corrupt", StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    return made.withColumn("unreadable", F.col("_corrupt").isNotNull()).drop("_corrupt")


def read_yaml_rows(spark: SparkSession, path: str, schema: str, section: str) -> DataFrame:
    """Rows of a small hand-kept YAML list (registries, question sets), read on the driver."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    rows = (yaml.safe_load(text[0]) or {}).get(section, []) if text else []
    fields = StructType.fromDDL(schema).names
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)


def read_yaml_lists(spark: SparkSession, path: str, schema: str, section: str, required: tuple[str, ...] = ()) -> DataFrame:
    """(suite, row, fields of ``schema``..., error): the entries of YAML lists, each file (or folder ``suite=...``) a suite of its own.

    Files are found and read by Spark, one a row, and parsed in tasks. The rows of
    a file count from 0. An entry that is no mapping, lacks a field of
    ``required`` (or has it null) or has one of another type is a row with an
    error and what could be read; a file that can't be parsed, or whose section
    is no list, is one row without a number. Other fields are left out.
    """
    import yaml

    fields = StructType.fromDDL(schema).fields
    kinds = {"string": (str,), "boolean": (bool,), "int": (int,), "bigint": (int,), "double": (float, int)}

    def fits(kind: str, v) -> bool:
        if kind.startswith("array<"):
            return isinstance(v, list) and all(x is None or fits(kind[6:-1], x) for x in v)
        return isinstance(v, kinds[kind]) and (kind == "boolean" or not isinstance(v, bool))

    unknown = [f.dataType.simpleString() for f in fields if re.sub(r"^(array<)*|>*$", "", f.dataType.simpleString()) not in kinds]
    if unknown:
        raise ValueError(f"types that YAML entries can't have here: {', '.join(unknown)}")

    def entry(own) -> tuple[list, str | None]:
        if not isinstance(own, dict):
            return [None] * len(fields), "no mapping"
        values, wrong = [], []
        for f in fields:
            v = own.get(f.name)
            if v is None:
                wrong += [f"{f.name} is missing"] if f.name in required else []
            elif not fits(f.dataType.simpleString(), v):
                wrong.append(f"{f.name} is no {f.dataType.simpleString()}")
                v = None
            values.append(float(v) if v is not None and f.dataType.simpleString() == "double" else v)
        return values, "; ".join(wrong) or None

    def run(batches):
        for batch in batches:
            for suite, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                none = [None] * len(fields)
                try:
                    whole = yaml.safe_load(content.decode())
                    listed = (whole or {}).get(section) or []
                    if not isinstance(listed, list):
                        raise ValueError(f"{section} is no list")
                    rows = [(suite, k, *values, error) for k, own in enumerate(listed) for values, error in [entry(own)]]
                except Exception as wrong:  # noqa: BLE001  a broken file is a row
                    rows = [(suite, None, *none, f"unreadable: {type(wrong).__name__}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow.types)], names=arrow.names)

    out = StructType([StructField("suite", StringType()), StructField("row", IntegerType()), *fields, StructField("error", StringType())])
    arrow = to_arrow_schema(out)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    folder = F.regexp_extract("path", r"/suite=([^/]+)/", 1)
    return files.select(F.when(folder != "", folder).otherwise(name).alias("suite"), "content").mapInArrow(run, out)


def pages_to_text(pages: DataFrame, doc: str, number: str, text: str) -> DataFrame:
    """(doc, text, pages): pages in order, each under its marker."""
    part = F.concat(F.lit("\n--- PAGE "), F.col(number).cast("string"), F.lit(" ---\n\n"), F.coalesce(text, F.lit("")))
    return pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), part.alias("t")))).alias("p")).select(doc, F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"), F.size("p").alias("pages"))


def pages_digest(pages: DataFrame, doc: str, number: str, text: str) -> DataFrame:
    """(doc, digest, pages): MD5 of the text that :func:`pages_to_text` makes, whatever its size.

    Pages are sorted on disk and stream through the digest, so no text of a
    document is held. A digest is one chain: a document's pages pass one task.
    """
    part = F.concat(F.lit("\n--- PAGE "), F.col(number).cast("string"), F.lit(" ---\n\n"), F.coalesce(text, F.lit("")))
    rows = pages.select(F.col(doc).cast("string").alias("doc"), F.col(number).alias("n"), part.alias("t"))

    def run(batches):
        held = None  # (document, digest so far, pages, whether a text came)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1].hexdigest()], pa.string()), pa.array([held[2]], pa.int64())], names=["doc", "digest", "pages"])

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(2), strict=True):
                d, t = d.as_py(), t.as_py()
                if held is None or held[0] != d:
                    if held is not None:
                        yield row()
                    held = [d, hashlib.md5(usedforsecurity=False), 0, False]
                held[2] += 1
                if t is not None:
                    held[1].update((("\n" if held[3] else "") + t).encode())
                    held[3] = True
        if held is not None:
            yield row()

    made = rows.repartition("doc").sortWithinPartitions("doc", "n", "t").mapInArrow(run, "doc string, digest string, pages long")
    return made.select(F.col("doc").alias(doc), "digest", "pages")


def html_text(c):
    """Visible text of a page: scripts, styles and tags removed, common entities decoded, spaces single."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return F.btrim(F.regexp_replace(c, r"[ \t\r\n\x0B\f]+", " "))


def upsert(chunks: DataFrame, path: str, keys: tuple[str, ...] = ("document_id", "version")) -> None:
    """Replace the partitions of the documents' versions that ``chunks`` holds; others stay.

    Of several rows of one point the one of the smallest content is kept, then
    of the smallest digest of its other columns.
    """
    columns = [c for c in chunks.columns if c != "point_id"]
    least = F.min_by(F.struct(*columns), F.struct("content", F.xxhash64(*columns)))
    single = chunks.groupBy("point_id").agg(least.alias("r")).select("point_id", "r.*").select(*chunks.columns)
    single.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def schema_differences(have: DataFrame, want: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """(column, type there, type wanted) of the columns that a stored table and its next content do not share."""
    there, wanted = dict(have.dtypes), dict(want.dtypes)
    return [(c, there.get(c), wanted.get(c)) for c in sorted(there.keys() | wanted.keys()) if there.get(c) != wanted.get(c)]


def replace_table(rows: DataFrame, path: str, recreate: bool = False) -> None:
    """Write ``rows`` over the table at ``path``; with another schema only if ``recreate`` says so.

    The check reads no rows and runs before anything is deleted.
    """
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not recreate and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        found = schema_differences(spark.read.parquet(path), rows)
        if found:
            raise ValueError(f"the table at {path} has another schema: " + ", ".join(f"{c} {a} -> {b}" for c, a, b in found))
    rows.write.mode("overwrite").parquet(path)


def metadata_manifest(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row a version of a document: its header fields with ``checksums`` of its texts and ``processing`` (status, chunk_count).

    ``documents`` has document_id, version, raw, extracted and cleaned besides
    its header fields; a version without chunks has the status ``empty``.
    """
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    counts = chunks.groupBy("document_id", "version").agg(F.count("*").alias("n_"))
    made = documents.join(counts, ["document_id", "version"], "left").withColumn("n_", F.coalesce("n_", F.lit(0).cast("long")))
    header = [c for c in documents.columns if c not in ("raw", "extracted", "cleaned")]
    return made.select(
        *header, F.struct(digest("raw").alias("raw_sha256"), digest("extracted").alias("extracted_sha256"), digest("cleaned").alias("cleaned_sha256")).alias("checksums"),
        F.struct(F.when(F.col("n_") > 0, "processed").otherwise("empty").alias("status"), F.col("n_").alias("chunk_count")).alias("processing"))


def delete_document(spark: SparkSession, path: str, document_id: str, version: str | None = None) -> None:
    """Remove a document's partition (or one version's)."""
    at = f"{path}/document_id={document_id}" + (f"/version={version}" if version else "")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
