"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word 5-grams. Equal texts form a class, of which one
document takes part. Classes that share a band hash of MinHash values may be
similar: those that such bands join form a cluster. A cluster of more than a
block is split by the smallest class that a class shares a band with, and only
blocks with a band in common meet. Each meeting compares MinHash values a few at
a time, drops pairs once the posterior probability of reaching the threshold
falls below a tolerance, and verifies the rest on the whole sets. Links are
counted and joined into components; pairs are never rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import add_columns, blocks
from docloom.llm.common import connected_components, drop_table, fresh, link_classes, materialize, neighbours, roots, text_of

GRAM, THRESHOLD = 5, 0.8
#: MinHash values in a band and bands: a pair at the threshold misses all bands with probability 2e-5.
ROWS, BANDS = 6, 36
VALUES = ROWS * BANDS
#: Values compared at a time, and the posterior probability under which a pair is dropped.
STEP, TOLERANCE = 16, 1e-5
#: Classes and characters of a block.
BLOCK, BLOCK_CHARS = 512, 1_000_000
#: Characters and pairs of the meetings that are compared in one go, and characters whose words are hashed in one go. They only bound memory.
GATHER_CHARS, GATHER_PAIRS, HASHED = 1_000_000, 1 << 18, 1 << 19
_BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """Whether each code point is a letter, a digit or an underscore (the regular expression ``\\w``)."""
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)


def word_hashes(code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each word, from running sums."""
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + HASHED)))
        low, n = int(start[a]), int(stop[b - 1] - start[a])
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[:1] = 1
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(code[low : low + n].astype(np.uint64) + np.uint64(1)) * inverse, out=sums[1:])
        out[a:b] = _mix((sums[stop[a:b] - low] - sums[start[a:b] - low]) * power[start[a:b] - low])
        a = b
    return out


def shingles(texts: list[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(flat 64-bit hashes of word n-grams with repeats, how many each text has).

    Words are runs of word characters in lower case. A text of fewer words is
    one n-gram; a text without words has none.
    """
    lowered = [t.lower() for t in texts]
    ends = (np.array([len(t) for t in lowered], np.int64) + 1).cumsum()
    code = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    del lowered
    inside = np.zeros(len(code) + 2, np.int8)
    inside[1:-1] = _word_characters()[code]
    edge = np.diff(inside)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(texts)).astype(np.int64)
    h = word_hashes(code, start, stop)
    del code, inside, edge
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    begin = size.cumsum() - size
    at = np.repeat(begin, count) + (np.arange(count.sum()) - np.repeat(count.cumsum() - count, count))
    length = np.repeat(np.minimum(size, n), count)
    out = np.full(len(at), 0x1234567, np.uint64) + length.astype(np.uint64)
    for k in range(n):
        more = length > k
        step = _mix(out * np.uint64(_BASE) + h[np.minimum(at + k, max(0, len(h) - 1))]) if len(h) else out
        out = np.where(more, step, out)
    return out, count


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(11)
    return g.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), g.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def signatures(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """MinHash values (texts, VALUES); texts without n-grams have zeros."""
    out = np.zeros((VALUES, len(count)), np.uint32)
    some = np.flatnonzero(count)
    if len(some):
        start = (count.cumsum() - count)[some]
        low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
        mult, add = _seeds()
        for k in range(VALUES):
            out[k, some] = np.minimum.reduceat(low * mult[k] + (high ^ add[k]), start)
    return out.T


def bands(sig: np.ndarray) -> np.ndarray:
    """Band hashes (texts, BANDS), different bands apart."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
    for k in range(ROWS):
        out = _mix(out * np.uint64(_BASE) + s[:, :, k])
    return out.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest matches with which a pair stays.

    Under a uniform prior the similarity after m matches of n is Beta(m + 1,
    n - m + 1); its chance of being over the threshold is that of at most m hits
    in n + 1 draws.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def similar_pairs(sig: np.ndarray, flat: np.ndarray, count: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Those of the index pairs ``i, j`` with similarity of ``threshold`` or more.

    ``flat`` has each text's distinct n-gram numbers, ``count`` how many.
    """
    size_ok = np.minimum(count[i], count[j]) >= np.maximum(threshold * np.maximum(count[i], count[j]) - 1e-9, 1)
    i, j = i[size_ok], j[size_ok]
    hits = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        part = slice(k * STEP, (k + 1) * STEP)
        hits += (sig[i, part] == sig[j, part]).sum(1, dtype=np.int32)
        stay = hits >= least
        i, j, hits = i[stay], j[stay], hits[stay]
    if not len(i):
        return i, j
    end = count.cumsum()
    start, mark = end - count, np.zeros(int(flat.max()) + 1, bool)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    shared = np.zeros(len(i), np.int64)
    cut = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    for a, b in zip(cut, np.append(cut[1:], len(i)), strict=True):
        own = flat[start[i[a]] : end[i[a]]]
        mark[own] = True
        n = count[j[a:b]]
        at = np.repeat(start[j[a:b]] - (n.cumsum() - n), n) + np.arange(n.sum())
        shared[a:b] = np.add.reduceat(mark[flat[at]].astype(np.int64), n.cumsum() - n)
        mark[own] = False
    ok = shared >= threshold * (count[i] + count[j] - shared) - 1e-9
    return i[ok], j[ok]


def partners(meeting: np.ndarray, left: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of each meeting: left against right rows, or every two rows of one block.

    Rows are sorted by meeting, left ones first; ``same`` tells whether a row's meeting is of one block.
    """
    n = len(meeting)
    stop = np.searchsorted(meeting, meeting, side="right")
    lefts = np.bincount(meeting[left], minlength=int(meeting.max(initial=-1)) + 1)
    low = np.where(same, np.arange(n) + 1, np.searchsorted(meeting, meeting) + lefts[meeting])
    width = np.where(left, np.maximum(stop - low, 0), 0)
    i = np.repeat(np.arange(n), width)
    return i, np.repeat(low - (width.cumsum() - width), width) + np.arange(len(i))


def link_meetings(rows: list[tuple], n: int, threshold: float) -> tuple[list[bytes], list[bytes | None], list[int]]:
    """(key, null, linked documents) of the classes of some meetings that have a link, and (label, root label, 0) of the labels that links join.

    ``rows``: (number of the meeting, whether it is of one block, whether the row
    is on the right, key, copies, text, label), each class once a meeting and
    side. Classes of one label are known to be connected, so that links give an
    edge for each label that they join, not for each class.
    """
    rows.sort(key=lambda r: (r[0], r[2], r[3]))
    meeting, same, right = (np.array([r[k] for r in rows], t) for k, t in ((0, np.int64), (1, bool), (2, bool)))
    keys, weight = [r[3] for r in rows], np.array([r[4] for r in rows], np.float64)
    h, count = shingles([r[5] for r in rows], n)
    sig = signatures(h, count)
    _, number = np.unique(h, return_inverse=True)
    del h
    span = int(number.max(initial=0)) + 1
    pair = np.unique(np.repeat(np.arange(len(rows)), count) * span + number)
    owner, flat = np.divmod(pair, span)
    count = np.bincount(owner, minlength=len(rows)).astype(np.int64)
    i, j = similar_pairs(sig, flat, count, *partners(meeting, ~right, same), threshold)
    links = np.bincount(i, weights=weight[j], minlength=len(rows)) + np.bincount(j, weights=weight[i], minlength=len(rows))
    some = np.flatnonzero(links)
    labels = sorted({r[6] for r in rows})
    at = {x: k for k, x in enumerate(labels)}
    label = np.array([at[r[6]] for r in rows], np.int64)
    root = roots(len(labels), label[i], label[j])
    joined = np.flatnonzero(root != np.arange(len(labels))).tolist()
    return (
        [keys[x] for x in some] + [labels[x] for x in joined],
        [None] * len(some) + [labels[root[x]] for x in joined],
        links[some].astype(np.int64).tolist() + [0] * len(joined),
    )


def _linked(batches, n: int, threshold: float):
    """Streams (cluster, x, y, right, key, copies, label, text) sorted by meeting (cluster, x, y); some meetings are compared at a time."""
    held, number, rows, own, seen, chars, pairs = None, 0, [], [], set(), 0, 0

    def ended():
        """Takes in the meeting that ended, if both of its sides have come."""
        nonlocal number, chars, pairs, own, seen
        rights = sum(r[2] for r in own)
        if len(own) > 1 and (held[1] == held[2] or 0 < rights < len(own)):
            rows.extend(own)
            number, chars = number + 1, chars + sum(len(r[5]) for r in own)
            pairs += len(own) * (len(own) - 1) // 2 if held[1] == held[2] else rights * (len(own) - rights)
        own, seen = [], set()

    def compared():
        nonlocal number, chars, pairs, rows
        out = link_meetings(rows, n, threshold)
        number, chars, pairs, rows = 0, 0, 0, []
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["a", "b", "links"])

    for batch in batches:
        for part in blocks(batch, 7):
            for c, x, y, r, k, w, label, t in zip(*(col.to_pylist() for col in part.columns), strict=True):
                if (c, x, y) != held:
                    ended()
                    if chars >= GATHER_CHARS or pairs >= GATHER_PAIRS:
                        yield compared()
                    held = c, x, y
                if (r, k) not in seen:  # a repeated row has one part in it
                    seen.add((r, k))
                    own.append((number, x == y, r, k, w, t, label))
    ended()
    if rows:
        yield compared()


def _blocks(reps: DataFrame, near: DataFrame, cluster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, meet), both written: each class's group and part in its cluster, and which groups meet.

    ``placed`` has (key, first_id, copies, cluster, group, part). A cluster that
    fits a block is one group. In others, classes are grouped by their star (the
    smallest class that they share a band with, or themselves); a star of more
    than a block is a group of several parts. ``meet`` has (cluster, group,
    other, parts of the other), for each group itself and for groups with a band
    in common. A band's groups are gathered once each, however many classes they hold.
    """
    star = F.least("key", F.coalesce("m", F.col("key")))
    known = cluster.withColumnRenamed("node", "key").join(reps.select("key", "first_id", "copies", "chars"), "key").join(near.select(F.col("a").alias("key"), "m"), "key", "left")
    known = materialize(known.select("key", "first_id", "copies", "chars", F.col("component").alias("cluster"), star.alias("star")), "clusters")
    blocks_of = lambda n, chars: F.greatest(F.ceil(n / BLOCK), F.ceil(chars / BLOCK_CHARS), F.lit(1)).cast("int")
    stars = materialize(known.groupBy("cluster", "star").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")), "stars")
    total = stars.groupBy("cluster").agg(blocks_of(F.sum("n"), F.sum("chars")).alias("groups"))
    # Every class of a cluster of one block lies in group 0; the join below is for the others.
    load = stars.join(total, "cluster").where("groups > 1").withColumn("parts", blocks_of(F.col("n"), F.col("chars")))
    load = load.select("cluster", "star", "parts", F.when(F.col("parts") > 1, F.xxhash64("star")).otherwise(F.pmod(F.xxhash64("star"), F.col("groups")) + 1).alias("group"))
    load = materialize(load, "load")
    part = F.pmod(F.xxhash64(F.lit("part"), "key"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = known.join(load, ["cluster", "star"], "left").select("key", "first_id", "copies", "cluster", F.coalesce("group", F.lit(0).cast("long")).alias("group"), part.alias("part"))
    placed = materialize(placed, "placed")
    sized = load.groupBy("cluster", "group").agg(F.max("parts").alias("parts"))
    bands = placed.where("group <> 0").select("key", "cluster", "group").join(reps.select("key", "bands"), "key").select("cluster", "group", F.explode("bands").alias("band"))
    sets = bands.groupBy("cluster", "band").agg(F.sort_array(F.collect_set("group")).alias("all")).where(F.size("all") > 1).select("cluster", "all").distinct()
    other = sets.select("cluster", "all", F.explode("all").alias("group")).select("cluster", "group", F.explode("all").alias("other")).where("group <> other").distinct()
    apart = other.join(sized.select("cluster", F.col("group").alias("other"), "parts"), ["cluster", "other"]).select("cluster", "group", "other", "parts")
    own = sized.select("cluster", "group", F.col("group").alias("other"), "parts")
    meet = materialize(apart.unionByName(own), "meet")
    for used in (known, stars, load):
        drop_table(used)
    return placed, meet


def join(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = GRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(classes, rows) of a self join on Jaccard similarity of word n-grams.

    ``classes`` has a row for each distinct text: key, first_id (its smallest
    id), copies, n_links (documents linked directly to one of its documents,
    its other copies included), component_id (smallest id reachable by links)
    and first_key (the text of that document). ``rows`` has (id, key) of every
    row. Texts without words link with equal texts only. Empty texts link with
    nothing, so each such row is its own component (component_id is then null in
    ``classes`` and the row's id in :func:`near_duplicates`). Null ids come last: a component has a null id
    only if all its ids are null. Repeated rows count as copies. An empty table
    gives empty results. Extra columns are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text")).withColumn("key", F.unhex(F.md5("text")))

    def make(values, _):
        h, count = shingles(values.to_pylist(), n)
        made = bands(signatures(h, count))
        width = np.where(count > 0, BANDS, 0)
        return [pa.ListArray.from_arrays(pa.array(np.append(0, width.cumsum()).astype(np.int32)), pa.array(made[count > 0].reshape(-1)))]

    rows = materialize(add_columns(base.withColumn("chars", F.length("text").cast("long")), "text", "bands array<long>", make, keep=["id", "key", "chars"]), "rows")
    # Two rows of one key have equal bands and lengths, so any of them will do.
    reps = materialize(rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("chars").alias("chars"), F.first("bands").alias("bands")), "reps")
    hashed = reps.select("key", F.explode("bands").alias("band"))
    shared = materialize(hashed.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("low")).where("n > 1").select(F.col("band").alias("band_"), "low"), "shared")
    near = materialize(neighbours(hashed.join(shared, F.col("band") == F.col("band_")).select(F.col("key").alias("a"), F.col("low").alias("b"))), "near")
    cluster = connected_components(near)
    placed, meet = _blocks(reps, near, cluster)

    # A class goes to each meeting of its part; classes of one group meet there, too.
    alone = placed.where("group = 0").select("key", "first_id", "copies", "cluster", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(False).alias("right"))
    several = placed.where("group <> 0").join(meet, ["cluster", "group"]).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    several = several.withColumns({"own": F.struct("group", "part"), "its": F.struct(F.col("other").alias("group"), F.col("q").alias("part"))})
    place = lambda c: F.xxhash64(c["group"], c["part"])
    several = several.select("key", "first_id", "copies", "cluster", place(F.least("own", "its")).alias("x"), place(F.greatest("own", "its")).alias("y"), (F.col("own") > F.col("its")).alias("right"))

    def compared(meetings: DataFrame, name: str) -> DataFrame:
        # Shuffled at every size: what is joined grows with the documents, so a plan that broadcasts it holds for small ones only.
        members = base.join(meetings.withColumnsRenamed({"key": "k_", "first_id": "f_"}).hint("merge"), (F.col("key") == F.col("k_")) & F.col("id").eqNullSafe(F.col("f_")))
        dealt = members.select("cluster", "x", "y", "right", "key", "copies", "label", "text").repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
        made = dealt.mapInArrow(lambda batches: _linked(batches, n, threshold), "a binary, b binary, links long")
        return materialize(made.groupBy("a", "b").agg(F.sum("links").alias("links")), name)

    # Blocks by themselves first: the classes that they connect are one label when blocks meet each other.
    within = compared(alone.unionByName(several.where("x = y")).withColumn("label", F.col("key")), "within")
    label = within.where("b IS NOT NULL").select(F.col("a").alias("l_"), F.col("b").alias("label"))
    across = several.where("x <> y").join(label, F.col("key") == F.col("l_"), "left").withColumn("label", F.coalesce("label", "key")).drop("l_")
    across = compared(across, "across")
    found = within.unionByName(across)

    ids = reps.select("key", "first_id", "copies", (F.col("chars") > 0).alias("some"))
    out = link_classes(ids, found)
    for used in (reps, shared, near, cluster, placed, meet, within, across):
        drop_table(used)
    return out, rows.select("id", "key")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copies, n_links, component_id, kept), a row for each row of ``docs``.

    ``class_id`` is the smallest id with the same text; ``kept`` marks the
    document with its component's smallest id (repeated rows alike). See
    :func:`join` for nulls, ties and empty texts.
    """
    classes, rows = join(docs, text, id_col, n, threshold)
    return rows.join(classes.withColumnRenamed("key", "k_"), F.col("key") == F.col("k_")).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("some"), F.col("first_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("some"), F.col("copies")).otherwise(1).cast("long").alias("copies"),
        "n_links",
        F.when(F.col("some"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("some"), F.col("id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("first_key"))).otherwise(F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of repeated rows, one).

    Rows with an empty text all stay. Columns and their order stay, whatever
    their names.
    """
    classes, _ = join(docs, text, id_col, n, threshold)
    key, number, absent = fresh(docs.columns, "key", "number", "absent")
    keyed = docs.withColumns({key: F.unhex(F.md5(text_of(text))), number: F.coalesce(F.col(id_col).cast("string"), F.lit("")), absent: F.col(id_col).isNull()})
    chosen = classes.where("some and key = first_key").select(F.col("key").alias(key), F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias(number), F.col("first_id").isNull().alias(absent))
    # Joined by text and id, so that copies of one text lie apart; repeated rows meet without another shuffle.
    kept = keyed.join(chosen.hint("merge"), [key, number, absent], "left_semi").dropDuplicates([key, number, absent])
    return kept.select(*docs.columns).unionByName(docs.where(text_of(text) == ""))


def query(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, with links and components."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
