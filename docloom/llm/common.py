"""Helpers shared by the corpus operators: shared-folder tables and components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset a temporary folder is chosen and
    remembered in the session, on a local master only: executors elsewhere
    would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        found = spark.conf.get("docloom.shared.dir", None) or "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("docloom.shared.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs only the tasks it ran, as readers find whole files.
    Files lie under the application's id, so that they can be removed with it.
    Shuffle files of the write are of no more use and are removed at its end
    (a session setting, which holds for other writes that begin meanwhile too).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` in this application; other files stay."""
    spark = df.sparkSession
    own = f"/docloom/{spark.sparkContext.applicationId}/"
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own in path:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores behind it until none of ``columns`` is so called."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, m, others): the smallest and all neighbours ``b`` of each ``a`` in ``edges(a, b)``.

    A node has few neighbours as ``a`` (its bands, or the pairs of blocks it was
    in); as ``b`` it may have any number.
    """
    return edges.where("a <> b").groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("others"))


def connected_components(near: DataFrame, rounds: int = 80) -> DataFrame:
    """(node, component) for every node of a written table of :func:`neighbours`; component is the smallest node reached.

    A node is tied to its smallest neighbour, and its other neighbours to that
    one, so that a group keeps little more than an edge a node. Each round gives
    a node the smallest label among its neighbours, then the label of its label,
    so that paths halve; rounds end when no label falls. Both steps join tables
    that were just written, with partly summed minima: a node with very many
    neighbours is split by skew handling and is never one row or one task's
    group. Labels stay in tables; the driver sees one count.
    """
    tied = near.select(F.explode("others").alias("a"), F.col("m").alias("b")).where("a <> b")
    pairs = near.select("a", F.col("m").alias("b")).unionByName(tied)
    links = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        lowest = links.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("n_")).agg(F.min("label").alias("m"))
        lower = materialize(labels.join(lowest, F.col("node") == F.col("n_"), "left").select("node", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("fell")), "labels")
        fell = lower.where("fell").limit(1).count()
        drop_table(labels)
        labels = lower.drop("fell")
        if not fell:
            drop_table(links)
            return labels.withColumnRenamed("label", "component")
        jump = labels.select(F.col("node").alias("n_"), F.col("label").alias("l_"))
        labels = materialize(labels.join(jump, F.col("label") == F.col("n_")).select("node", F.col("l_").alias("label")), "labels")
        drop_table(lower)
    raise RuntimeError("components did not settle")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each index reaches through pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_classes(reps: DataFrame, found: DataFrame) -> DataFrame:
    """Classes of equal items with their links and components, as a written table.

    ``reps`` has (key, first_id, copies, some), a row a class; ``found`` (a, b,
    links): linked items of class ``a`` that one task counted, and a class ``b``
    that is reachable from it. Adds n_links (copies of the own class included),
    component_id (the component's smallest id, null ids last) and first_key (the
    class of that id). Classes that are not ``some`` have neither.
    """
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    near = materialize(neighbours(found), "near")
    component = connected_components(near)
    known = reps.join(links, F.col("key") == F.col("a"), "left").join(component, F.col("key") == F.col("node"), "left")
    known = materialize(known.select("key", "first_id", "copies", "some", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("component", "key").alias("component")), "known")
    first = known.groupBy(F.col("component").alias("c_")).agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("f"))
    first = materialize(first.select("c_", F.col("f.first_id").alias("component_id"), F.col("f.key").alias("first_key")), "first")
    out = materialize(known.join(first, F.col("component") == F.col("c_")).select(
        "key", "first_id", "copies", F.when(F.col("some"), F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("some"), F.col("component_id")).alias("component_id"), "first_key", "some",
    ), "classes")
    for used in (near, component, known, first):
        drop_table(used)
    return out
