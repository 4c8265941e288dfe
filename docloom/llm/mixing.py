"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; the budget's threshold lies in one
bucket of each source, and only that boundary bucket is split again, until a
bucket is a single hash value. Documents are then kept by comparing their hash
with their source's threshold: nothing is sorted, and the thresholds of a
smaller budget select a subset of a larger one's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import drop_table, fresh, materialize, text_of

#: Hash bits, and the bits that each refinement resolves.
BITS, STEP = 60, 10
#: Rows of each source in the last join are dealt over so many keys.
SALTS = 64
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, LF, VT, FF and CR."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_hash(id_col: Column, text: Column) -> Column:
    """60 bits of MD5 over id and text: equal rows, equal hashes, on any run."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), F.md5(text))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def in_order(df: DataFrame, by: list[Column], sums: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 1) in the order ``by``, and for each of ``sums`` its total ``before`` the row.

    Rows are dealt by ranges of the order and written, so that their parts stay
    as they are. A row's place is its place in its part and what the parts
    before it hold; only the parts' totals, a row a part, pass one task.
    """
    names = [f"by_{k}" for k in range(len(by))]
    dealt = df.withColumns(dict(zip(names, by, strict=True))).repartitionByRange(*names).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "ordered")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    parts = each.select(F.col("part").alias("part_"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"from_{c}") for c in ("n", *(f"sum_{c}" for c in sums))])
    own = Window.partitionBy("part").orderBy(*names)
    above = own.rowsBetween(Window.unboundedPreceding, -1)
    # A row a part of the shuffle before: as few as the session's shuffle partitions.
    placed = dealt.join(F.broadcast(parts), F.col("part") == F.col("part_"))
    before = {f"before_{c}": F.col(f"from_sum_{c}") + F.coalesce(F.sum(c).over(above), F.lit(0)) for c in sums}
    return placed.withColumns({"rank": F.col("from_n") + F.row_number().over(own), **before}).select(*df.columns, "rank", *before)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    The budget is ``share`` of all words; sources in code point order, null
    last, weigh ``weights`` in turn. A target above ``cap`` times its source's
    size stops there and the excess goes to the others by weight: in the order
    of size by weight the capped sources are a prefix, so running sums give the
    level at which the rest stand. Both orders are made by :func:`in_order`, so
    sources may be as many as hosts; the driver sees three sums.
    """
    num, den = share
    named = [F.col("source").isNull(), F.col("source")]
    w = F.lit(None).cast("long")
    for k, x in enumerate(weights):
        w = F.when(F.pmod(F.col("rank") - 1, F.lit(len(weights))) == k, F.lit(x).cast("long")).otherwise(w)
    weighed = in_order(totals, named, []).withColumn("w", w).drop("rank")
    ranked = materialize(in_order(weighed, [F.col("source_size") / F.col("w"), *named], ["source_size", "w"]), "ranked")
    whole = ranked.agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).first()
    level = ranked.withColumns({"up": num * (whole["s"] or 0) - den * cap * F.col("before_source_size"), "down": den * ((whole["w"] or 0) - F.col("before_w"))})
    level = level.withColumn("open", F.col("w") * F.col("up") <= cap * F.col("source_size") * F.col("down"))
    at = level.where("open").agg(F.min(F.struct("rank", "up", "down")).alias("at")).select("at.*").first()
    full = (cap * F.col("source_size")).cast("double")
    if at is None or at["rank"] is None:
        return ranked.select("source", "source_size", full.alias("target"))
    uncapped = (F.col("w") * F.lit(at["up"])).cast("double") / F.lit(float(at["down"]))
    return ranked.select("source", "source_size", F.when(F.col("rank") >= at["rank"], uncapped).otherwise(full).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, full, below): every document counts ``full``
    times, those with a hash under ``below`` once more."""
    aim = targets.where("source_size > 0").select("source", F.floor(F.col("target") / F.col("source_size")).cast("long").alias("full"), "target", "source_size")
    aim = aim.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    bound = aim.select(F.col("source").alias("at"), "rest", F.lit(0).cast("long").alias("inside"), F.lit(0).cast("long").alias("base"))
    shift = BITS
    while shift > 0:
        rows = sized.withColumn("outer", F.shiftright("h", shift))
        shift -= STEP
        hist = (
            rows.join(bound, F.col("source").eqNullSafe(F.col("at")) & (F.col("outer") == F.col("inside")))
            .groupBy("source", F.shiftright("h", shift).alias("prefix"))
            .agg(F.sum("size").alias("s"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        )
        w = Window.partitionBy("source").orderBy("prefix")
        bound = (
            hist.withColumn("upto", F.col("base") + F.sum("s").over(w))
            .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("s") <= F.col("rest")))
            .select(F.col("source").alias("at"), "rest", F.col("prefix").alias("inside"), (F.col("upto") - F.col("s")).alias("base"), "upto")
        )
        last, bound = bound, bound.drop("upto")
    nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("base"))
    cut = last.select(F.col("at").alias("s2"), (F.col("inside") + nearer.cast("long")).alias("below"))
    return targets.join(aim.select(F.col("source").alias("s1"), "full"), F.col("source").eqNullSafe(F.col("s1")), "left").join(
        cut, F.col("source").eqNullSafe(F.col("s2")), "left"
    ).select("source", "source_size", "target", F.coalesce("full", F.lit(0).cast("long")).alias("full"), F.coalesce("below", F.lit(0).cast("long")).alias("below"))


def _cuts(docs: DataFrame, text: str, source: str, id_col: str, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> tuple[DataFrame, DataFrame]:
    """(rows with size and hash, thresholds), both as written tables."""
    t = text_of(text)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(t).alias("size"), row_hash(F.col(id_col), t).alias("h"))
    sized = materialize(sized, "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, materialize(thresholds(sized, source_targets(totals, weights, share, cap)), "cuts")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of ``docs``.

    A row is taken ``copies`` times (0 to ``cap``), whole. Per source the words
    taken differ from the target by at most half the words of the rows that
    share one hash value (one document, unless rows repeat). Null text: no
    words. Null source: a source of its own, last. Rows of equal id and text
    go together. An empty table gives an empty result. Other columns of ``docs``
    are not read. The same rows give the same mix in any order and partitioning.
    """
    sized, cuts = _cuts(docs, text, source, id_col, weights, share, cap)
    dealt = cuts.select(F.col("source").alias("cut_source"), "source_size", "target", "full", "below", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("cut_salt"))
    copies = F.col("full") + (F.col("h") < F.col("below")).cast("long")
    return (
        sized.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
        .join(dealt, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("salt") == F.col("cut_salt")))
        .select("doc_id", "source", "size", "source_size", "target", F.least(copies, F.lit(cap).cast("long")).alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mixed(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it; columns stay as they are, whatever their names.

    Rows are joined with the thresholds by source and salt, so a hot source is
    dealt over many keys; Spark broadcasts the thresholds while their file is
    under its own limit, which leaves the texts where they lie.
    """
    sized, cuts = _cuts(docs, text, source, id_col, weights, share, cap)
    drop_table(sized)
    h, cut_source, cut_salt, full, below, copy = fresh(docs.columns, "h", "cut_source", "cut_salt", "full", "below", "copy")
    dealt = cuts.select(F.col("source").alias(cut_source), F.col("full").alias(full), F.col("below").alias(below), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(cut_salt))
    rows = docs.withColumn(h, row_hash(F.col(id_col), text_of(text)))
    joined = rows.join(dealt, F.col(source).eqNullSafe(F.col(cut_source)) & (F.pmod(h, F.lit(SALTS)).cast("int") == F.col(cut_salt)))
    copies = F.least(F.col(full) + (F.col(h) < F.col(below)).cast("long"), F.lit(cap).cast("long"))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: sizes, targets and words taken, a row a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM t),
l AS (
  SELECT *, row_number() OVER o AS k,
         3 * sum(s) OVER () - 4 * coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up,
         2 * (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS down
  FROM w WINDOW o AS (ORDER BY s / w, source ASC NULLS LAST)),
a AS (SELECT k, up, down FROM l WHERE w * up <= 2 * s * down ORDER BY k LIMIT 1),
g AS (
  SELECT l.source, l.s, CASE WHEN l.k >= a.k THEN CAST(l.w * a.up AS DOUBLE) / CAST(a.down AS DOUBLE) ELSE CAST(2 * l.s AS DOUBLE) END AS target
  FROM l, a),
f AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS fulls FROM g),
c AS (
  SELECT d.doc_id, d.size, d.h, f.s, f.target, f.fulls, f.target - f.fulls * f.s AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, s AS source_size, target,
       CAST(size * least(2, fulls + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
