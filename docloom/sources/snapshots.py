"""Tables of immutable files: each change is a new version, made visible by one rename.

A commit writes its rows and the keys of the groups that it replaces or deletes
under a name of its own, then a list of all commits of the new version. The list
takes the version's number by a rename that fails if another writer has taken
it. A row counts in a version if its commit is the last of the version that
names its group. Readers of a version see the same rows for good.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.sources.io import schema_differences

#: The column of stored rows and keys that holds the place of their commit.
COMMIT = "commit_"


class Conflict(RuntimeError):
    """Another writer made the version first; nothing of this write is visible."""


class Table:
    """A table in a folder, its rows in groups by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], schema: str | None = None):
        """Opens the table at ``path``, or makes an empty one of ``schema`` as version 0."""
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)
        jvm = spark.sparkContext._jvm
        self._path, self._options, self._utf8 = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options, jvm.java.nio.charset.StandardCharsets.UTF_8
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(f"{self.path}/versions")):
            if schema is None:
                raise ValueError(f"no table at {self.path}")
            self._publish(0, {"schema": schema, "commits": []})

    def _publish(self, version: int, content: dict) -> int:
        """The list of a version, under its number by one rename that does not overwrite."""
        waiting = self._path(f"{self.path}/waiting/{uuid.uuid4().hex}")
        out = self._fs.create(waiting)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        place = self._path(f"{self.path}/versions/{version:012d}")
        self._fs.mkdirs(place.getParent())
        none = self.spark.sparkContext._gateway.new_array(self._options.Rename, 0)
        try:
            self._files.rename(waiting, place, none)
        except Exception as taken:
            self._fs.delete(waiting, False)
            if self._fs.exists(place):
                raise Conflict(f"version {version} of {self.path} was made by another writer") from taken
            raise
        return version

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._path(f"{self.path}/versions")))

    def _content(self, version: int | None) -> tuple[int, dict]:
        version = self.versions()[-1] if version is None else version
        place = f"{self.path}/versions/{version:012d}"
        if not self._fs.exists(self._path(place)):
            raise ValueError(f"no version {version} of {self.path}")
        return version, json.loads(self.spark.read.text(place, wholetext=True).first()[0])

    def _stored(self, kind: str, commits: list[str], schema: StructType) -> DataFrame:
        read = self.spark.read.schema(StructType([*schema.fields]).add(COMMIT, "long"))
        return read.parquet(*[f"{self.path}/{kind}/{c}" for c in commits]) if commits else self.spark.createDataFrame([], StructType([*schema.fields]).add(COMMIT, "long"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        _, content = self._content(version)
        schema = StructType.fromDDL(content["schema"])
        groups = StructType([schema[c] for c in self.keys])
        last = self._stored("keys", content["commits"], groups).groupBy(*self.keys).agg(F.max(COMMIT).alias("last_"))
        last = last.withColumnsRenamed({c: f"{c}_k" for c in self.keys})
        same = F.col(COMMIT) == F.col("last_")
        for c in self.keys:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_k"))
        return self._stored("rows", content["commits"], schema).join(last, same, "left_semi").select(*schema.names)

    def _commit(self, base: int | None, rows: DataFrame | None, groups: DataFrame) -> int:
        version, content = self._content(base)
        schema = StructType.fromDDL(content["schema"])
        place = len(content["commits"])
        name = uuid.uuid4().hex
        stamp = F.lit(place).cast("long").alias(COMMIT)
        rows = self.spark.createDataFrame([], schema) if rows is None else rows
        rows.select(*schema.names, stamp).write.parquet(f"{self.path}/rows/{name}")
        groups.select(*self.keys, stamp).write.parquet(f"{self.path}/keys/{name}")
        return self._publish(version + 1, content | {"commits": [*content["commits"], name]})

    def upsert(self, rows: DataFrame, base: int | None = None) -> int:
        """A version after ``base`` (the latest) in which the groups of ``rows`` hold these rows alone."""
        _, content = self._content(base)
        found = schema_differences(self.spark.createDataFrame([], StructType.fromDDL(content["schema"])), rows)
        if found:
            raise ValueError(f"the table at {self.path} has another schema: " + ", ".join(f"{c} {a} -> {b}" for c, a, b in found))
        return self._commit(base, rows, rows.select(*self.keys).distinct())

    def delete(self, groups: DataFrame, base: int | None = None) -> int:
        """A version without the groups that ``groups`` names."""
        return self._commit(base, None, groups.select(*self.keys).distinct())

    def compact(self) -> int:
        """A version of the same rows in one commit; older versions stay as they are."""
        version, content = self._content(None)
        rows, name = self.read(version), uuid.uuid4().hex
        stamp = F.lit(0).cast("long").alias(COMMIT)
        rows.select("*", stamp).write.parquet(f"{self.path}/rows/{name}")
        rows.select(*self.keys).distinct().select("*", stamp).write.parquet(f"{self.path}/keys/{name}")
        return self._publish(version + 1, content | {"commits": [name]})
