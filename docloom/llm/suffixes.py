"""Exact substring dedup with suffix arrays built by linear grouping.

A byte goes when it lies in a string of ``length`` bytes that also starts in a
document with a smaller id. Every such string is dealt by its anchor, the
smallest hash among its grams, so equal strings meet in one bucket: neighbouring
strings with one anchor form a stretch. Hashes only bring stretches together.
Every stretch whose anchor occurs in several documents is spelled out, and
stretches of equal bytes are one suffix class. Where classes of an anchor may
share a string, their suffixes are sorted: Lyndon-prefix groups are made in
descending order with previous-smaller pointers, and each group's order is then
emitted in one ascending pass.

An anchor with very many stretches, found in a sample, meets nowhere: its
stretches stay with their documents, and its strings are dealt one by one by a
digest of 128 bits, each reduced to its smallest owner in a group of documents
first. Equal strings are one suffix class there, and nothing is sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, text_of

#: Bytes of a removed string at least, and of the gram whose hash is its anchor.
LENGTH, GRAM = 50, 20
#: Bytes of text that one block or one group of documents holds, anchors of a bucket, bytes of stretches of a sorting task and of one suffix array.
BLOCK, BUCKET, TASK, SORTED = 2 << 20, 1_500_000, 1 << 20, 1 << 15
#: Rows whose stretches are compared with their owners at a time.
SLICE = 1 << 15
#: Stretches from which an anchor is dealt by strings, and the share of rows in which they are counted. Both only spread the work.
HOT, SHARE = 1 << 13, 1 / 64
#: Strings of hot anchors that a task reduces.
STRINGS = 1 << 20
LAST = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15


def suffix_array(s: list[int]) -> list[int]:
    """Suffixes of ``s`` in ascending order; its last symbol is the only smallest one."""
    n = len(s)
    # Groups of suffixes by first symbol; a group is known by its first place.
    size_of = [0] * (max(s) + 2)
    for c in s:
        size_of[c + 1] += 1
    first = size_of[:]
    for c in range(1, len(first)):
        first[c] += first[c - 1]
    free, sa, place, group, size = first[:], [0] * n, [0] * n, [0] * n, [0] * n
    for i, c in enumerate(s):
        k = free[c]
        free[c] = k + 1
        sa[k], place[i], group[i] = i, k, first[c]
        size[first[c]] += 1
    prev, count = [-1] * n, [0] * n
    end = n
    while end > 0:
        start = group[sa[end - 1]]
        own = sa[start:end]
        if len(own) > 1:
            own.sort()
        # The nearest suffix to the left that is in a lower group.
        hit = []
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                if not count[j]:
                    hit.append(j)
                count[j] += 1
        if hit:
            # Suffixes that this group continues more often are greater: they leave the upper end of their group first.
            most = 1
            for j in hit:
                if count[j] > most:
                    most = count[j]
            if most == 1:
                rounds = (hit,)
            else:
                by: dict[int, list[int]] = {}
                for j in hit:
                    by.setdefault(count[j], []).append(j)
                rounds = [by[c] for c in sorted(by, reverse=True)]
            for moved in rounds:
                for j in moved:
                    g = group[j]
                    size[g] -= 1
                    k, p = g + size[g], place[j]
                    other = sa[k]
                    sa[p], place[other] = other, p
                    sa[k], place[j] = j, k
                    count[j] = 0
                for j in moved:
                    g = group[j]
                    new = g + size[g]
                    group[j] = new
                if len(moved) == 1:
                    size[group[moved[0]]] = 1
                else:
                    for j in moved:
                        size[group[j]] += 1
        end = start
    # Each suffix, in ascending order, emits those that it is the next smaller one of.
    out, done = [-1] * n, [False] * n
    at = list(range(n))
    out[0], done[n - 1] = n - 1, True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[at[g]] = j
            at[g] += 1
            done[j] = True
            j = prev[j]
    return out


def repeated(strings: list[bytes], owner: np.ndarray, length: int) -> np.ndarray:
    """For each start in each distinct string, one after another, the smallest owner of the ``length`` bytes there."""
    sizes = np.array([len(x) for x in strings], np.int64)
    flat = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8)
    sa = np.array(suffix_array((flat.astype(np.int64) + 2).tolist() + [0])) if len(flat) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], (sizes + 1).cumsum()])[:-1]
    count = sizes - length + 1
    starts = np.repeat(begin - (count.cumsum() - count), count) + np.arange(count.sum())
    who = np.full(len(flat) + 1, -1, np.int64)
    who[starts] = np.repeat(np.arange(len(strings)), count)
    order = sa[who[sa] >= 0]
    rows = np.lib.stride_tricks.sliding_window_view(flat, length)
    new = np.ones(len(order), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    low = np.minimum.reduceat(owner[who[order]], np.flatnonzero(new))
    least = np.zeros(len(flat) + 1, np.int64)
    least[order] = low[new.cumsum() - 1]
    return least[starts]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Stretches:
    """Stretches of a block of texts: document, first start, bytes, anchor and its place in the stretch."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        n, window = len(data), length - gram + 1
        self.doc = self.start = self.size = self.at = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n < length:
            return
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        value = _mix(np.arange(1, 257, dtype=np.uint64))[data]
        value *= inverse
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        del value, inverse
        # Position in the low bits: of equal hashes the leftmost is the least. The cut is the same in all blocks, so equal strings have one anchor.
        bits = np.uint64(32)
        g = _mix((sums[gram:] - sums[:-gram]) * power[: n - gram + 1])
        key = ((g >> bits) << bits) | np.arange(len(g), dtype=np.uint64)
        low, k = key, 1
        while k * 2 <= window:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        rest = window - k
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        begin = sizes.cumsum() - sizes
        doc = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
        inside = np.arange(len(at)) + length <= (begin + sizes)[doc]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        edge = np.flatnonzero((new | np.append(True, ~inside[:-1])) & inside)
        stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        self.doc, first = doc[edge], edge
        self.start, self.size = first - begin[self.doc], stop - first + length
        self.anchor, self.at = g[at[edge]], at[edge] - first


def packed(rows: np.ndarray) -> bytes:
    """Values as bytes, the first bytes of all of them first: what is alike in many values lies together, so shuffles and tables compress it."""
    return rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _blocks(batches, column: int):
    """Arrow batches cut to about BLOCK bytes of a column."""
    from docloom.llm.arrow import blocks

    for batch in batches:
        yield from blocks(batch, column, BLOCK)


# What a mark tells: a removed span, a stretch to spell and sort, a stretch of a hot anchor, or a string's owner (least in ord, digest in th, start and size).
GONE, SORT, FAR, OWNER = range(4)
#: The place that says that a stretch's anchor is hot; others are at most 200.
FAR_AT = 255
STRING = np.dtype([("a", "<u8"), ("b", "<u8"), ("ord", "<i8")])
MARKS = "part int, marks binary"
MARK = np.dtype([("ord", "<i8"), ("th", "<i8"), ("start", "<u4"), ("size", "<u4"), ("anchor", "<u4"), ("at", "<u1"), ("sort", "<u1")])


def _counted(length: int, gram: int):
    """(text) to the anchors of each block and their stretches."""

    def run(batches):
        for part in _blocks(batches, 0):
            anchor, n = np.unique(Stretches(part.column(0).cast(pa.binary()).to_pylist(), length, gram).anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n, pa.int64())], names=["anchor", "n"])

    return run


def _anchored(length: int, gram: int, buckets: int, hot: np.ndarray):
    """(ord, th, text) to a row for each block and bucket, of packed stretches; those of hot anchors go to any bucket."""

    def run(batches):
        for part in _blocks(batches, 2):
            ords, ths = part.column(0).to_numpy(), part.column(1).to_numpy()
            s = Stretches(part.column(2).cast(pa.binary()).to_pylist(), length, gram)
            bucket = ((s.anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            if len(hot) and len(bucket):
                far = np.isin(s.anchor, hot)
                bucket[far] = _part(ords[s.doc[far]] + s.start[far], ths[s.doc[far]], buckets)
                s.at[far] = FAR_AT
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
            names, cols = [], [[] for _ in range(7)]
            for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True) if len(order) else ():
                x = order[a:b]
                docs, local = np.unique(s.doc[x], return_inverse=True)
                names.append(int(bucket[x[0]]))
                for col, v in zip(cols, (ords[docs], ths[docs], local.astype(np.uint32), s.start[x].astype(np.uint32), s.size[x].astype(np.uint16), s.anchor[x].astype(np.uint32), s.at[x].astype(np.uint8)), strict=True):
                    col.append(packed(v))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["bucket", "ords", "ths", "doc", "start", "size", "anchor", "at"])

    return run


def _grouped(batches):
    """(key, rows) of rows sorted by their first column."""
    held, rows = None, []
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != held:
                if rows:
                    yield held, rows
                held, rows = key, []
            rows.append(row)
    if rows:
        yield held, rows


def _dealt(marks: np.ndarray, parts: int, part: np.ndarray | None = None):
    """Packed marks by the group of documents that they belong to."""
    if not len(marks):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["part", "marks"])
    part = _part(marks["ord"], marks["th"], parts) if part is None else part
    order = np.lexsort((marks["ord"], part))
    cut = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(order))
    return pa.RecordBatch.from_arrays([pa.array([int(part[order[a]]) for a in cut], pa.int32()), pa.array([packed(marks[order[a:b]]) for a, b in zip(cut, ends, strict=True)], pa.binary())], names=["part", "marks"])


def _part(ord_: np.ndarray, th: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(ord_.astype(np.uint64) ^ _mix(th.view(np.uint64))) % np.uint64(parts)).astype(np.int64)


def _judged(parts: int):
    """Stretches of a bucket to marks: those whose anchor occurs in several documents, and those of hot anchors."""

    def run(batches):
        for _, rows in _grouped(batches):
            arrays = [[unpacked(r[k], t) for r in rows] for k, t in enumerate((np.int64, np.int64, np.uint32, np.uint32, np.uint16, np.uint32, np.uint8))]
            ords = np.concatenate([o[d] for o, d in zip(arrays[0], arrays[2], strict=True)])
            ths = np.concatenate([o[d] for o, d in zip(arrays[1], arrays[2], strict=True)])
            start, size, anchor, at = (np.concatenate(arrays[k]) for k in (3, 4, 5, 6))
            near, far = np.flatnonzero(at != FAR_AT), np.flatnonzero(at == FAR_AT)
            if len(near):
                near = near[np.argsort(anchor[near], kind="stable")]
                a, o = anchor[near], ords[near]
                new = np.append(True, a[1:] != a[:-1])
                first = np.flatnonzero(new)
                near = near[(np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first))[new.cumsum() - 1]]
            yield _dealt(_marked(ords, ths, start, size, anchor, at, np.append(near, far), np.repeat([SORT, FAR], [len(near), len(far)])), parts)

    return run


def _marked(ords, ths, start, size, anchor, at, x, kinds) -> np.ndarray:
    marks = np.zeros(len(x), MARK)
    marks["ord"], marks["th"], marks["start"], marks["size"], marks["anchor"], marks["at"], marks["sort"] = ords[x], ths[x], start[x], size[x], anchor[x], at[x], kinds
    return marks


def _marks(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, MARK), *(unpacked(x, MARK) for x in table.column("marks").to_pylist())])


def _by_document(table: pa.Table, marks: np.ndarray):
    """(row, its marks) for each document of a group."""
    order = np.lexsort((marks["th"], marks["ord"]))
    marks = marks[order]
    keys = np.stack([marks["ord"], marks["th"]], axis=1) if len(marks) else np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(marks) else np.zeros(0, np.int64)
    at = {(int(keys[a, 0]), int(keys[a, 1])): (a, b) for a, b in zip(cut, np.append(cut[1:], len(marks)), strict=True)} if len(marks) else {}
    for row, key in enumerate(zip(table.column("ord").to_pylist(), table.column("th").to_pylist(), strict=True)):
        a, b = at.get(key, (0, 0))
        yield row, marks[a:b]


def _digests(flat: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``length`` bytes at each start."""
    a, b = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    rows = np.lib.stride_tricks.sliding_window_view(flat, length) if len(starts) else None
    for s in range(0, len(starts), SLICE):
        part = slice(s, s + SLICE)
        padded = np.zeros((len(a[part]), -(-length // 8) * 8), np.uint8)
        padded[:, :length] = rows[starts[part]]
        words = padded.view("<u8").T
        for w, v in zip(words, words[::-1], strict=True):
            a[part] = _mix((a[part] ^ w) + np.uint64(_BASE))
            b[part] = _mix((b[part] + v) * np.uint64(_BASE) + np.uint64(1))
    return a, b


def _strings(docs: pa.Table, found: np.ndarray, length: int):
    """Stretches of hot anchors, once for repeated rows, and for each string in them: its stretch, start and two hashes."""
    texts = docs.column("text").cast(pa.binary()).to_pylist()
    picked, begin, seen, at = [found[:0]], [np.zeros(0, np.int64)], set(), 0
    for row, own in _by_document(docs, found):
        key = (int(own["ord"][0]), int(own["th"][0])) if len(own) else None
        if key is not None and key not in seen:
            seen.add(key)
            picked.append(own)
            begin.append(np.full(len(own), at))
        at += len(texts[row])
    own = np.concatenate(picked)
    count = own["size"].astype(np.int64) - length + 1
    kind = np.repeat(np.arange(len(own)), count)
    place = own["start"].astype(np.int64)[kind] + np.arange(len(kind)) - (count.cumsum() - count)[kind]
    return own, kind, place, *_digests(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(begin)[kind] + place, length)


def _owned(a: np.ndarray, b: np.ndarray, ord_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each class of equal strings in it, class of each): the first has the smallest owner."""
    order = np.lexsort((ord_, b, a))
    x, y = a[order], b[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(order)]
    return order, np.flatnonzero(new), new.cumsum() - 1


def _spelled_far(docs: pa.Table, found: np.ndarray, length: int, tasks: int, far_tasks: int) -> list[tuple[int, bytes, bytes]]:
    """The distinct strings of a group's hot anchors with their smallest owner there, packed by task."""
    if not len(found):
        return []
    own, kind, _, a, b = _strings(docs, found, length)
    ords = own["ord"][kind]
    order, first, _ = _owned(a, b, ords)
    x = order[first]
    made = np.zeros(len(x), STRING)
    made["a"], made["b"], made["ord"] = a[x], b[x], ords[x]
    task = (made["a"] % np.uint64(far_tasks)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(task[order]) != 0)[: len(order)])
    group = np.int32(docs.column("part")[0].as_py()).tobytes()
    return [(tasks + int(task[order[i]]), b"", group + packed(made[order[i:j]])) for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True)]


def _owners(rows: list[list[bytes]], parts: int):
    """Strings of hot anchors from all groups to what a group must be told: owners smaller than its own."""
    made = np.concatenate([unpacked(r[1][4:], STRING) for r in rows])
    part = np.repeat([int(np.frombuffer(r[1], np.int32, 1)[0]) for r in rows], [(len(r[1]) - 4) // STRING.itemsize for r in rows])
    order, first, of = _owned(made["a"], made["b"], made["ord"])
    least = made["ord"][order[first]][of]
    told = least < made["ord"][order]
    x = order[told]
    marks = np.zeros(len(x), MARK)
    marks["ord"], marks["th"], marks["sort"] = least[told], made["a"][x].view(np.int64), OWNER
    marks["start"], marks["size"] = made["b"][x] & np.uint64(0xFFFFFFFF), made["b"][x] >> np.uint64(32)
    return _dealt(marks, parts, part[x])


def _gone_far(docs: pa.Table, found: np.ndarray, told: np.ndarray, length: int) -> np.ndarray:
    """Marks of what is removed of a group's stretches of hot anchors."""
    own, kind, place, a, b = _strings(docs, found, length)
    n = len(kind)
    a, b = np.append(a, told["th"].view(np.uint64)), np.append(b, told["start"].astype(np.uint64) | told["size"].astype(np.uint64) << np.uint64(32))
    ords = np.append(own["ord"][kind], told["ord"])
    order, first, of = _owned(a, b, ords)
    hit = np.zeros(len(ords), bool)
    hit[order] = ords[order] > ords[order[first]][of]
    hit = hit[:n]
    same = np.append(False, kind[1:] == kind[:-1])[:n]
    head = np.flatnonzero(hit & ~(np.append(False, hit[:-1])[:n] & same))
    tail = np.flatnonzero(hit & ~np.append(hit[1:] & same[1:], False)[:n])
    made = own[kind[head]]
    made["start"], made["size"], made["sort"] = place[head], place[tail] - place[head] + length, GONE
    return made


def _spelled(tasks: int, far_tasks: int, length: int):
    """The bytes of the stretches to sort, packed and compressed by sorting task, and the strings of hot anchors."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        found = _marks(marks)
        far = _spelled_far(docs, found[found["sort"] == FAR], length, tasks, far_tasks) if docs.num_rows else []
        near = _near(docs, found[found["sort"] == SORT])
        if not far:
            return near
        made = pa.table([pa.array([r[0] for r in far], pa.int32()), pa.array([r[1] for r in far], pa.binary()), pa.array([r[2] for r in far], pa.binary())], names=near.column_names)
        return pa.concat_tables([near, made])

    def _near(docs: pa.Table, found: np.ndarray) -> pa.Table:
        texts = docs.column("text").cast(pa.binary()).to_pylist()
        picked, data, seen = [], [], set()
        for row, own in _by_document(docs, found):
            key = (int(own["ord"][0]), int(own["th"][0])) if len(own) else None
            if key is None or key in seen:  # repeated rows spell alike
                continue
            seen.add(key)
            picked.append(own)
            data += [texts[row][s : s + n] for s, n in zip(own["start"].tolist(), own["size"].tolist(), strict=True)]
        names = ["task", "marks", "data"]
        if not picked:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=names)
        picked = np.concatenate(picked)
        task = (_mix(picked["anchor"].astype(np.uint64)) % np.uint64(tasks)).astype(np.int64)
        order = np.argsort(task, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(task[order]) != 0))
        ends = np.append(cut[1:], len(order))
        return pa.table([
            pa.array([int(task[order[a]]) for a in cut], pa.int32()), pa.array([packed(picked[order[a:b]]) for a, b in zip(cut, ends, strict=True)], pa.binary()),
            pa.array([pa.compress(b"".join([data[i] for i in order[a:b].tolist()]), codec="zstd", asbytes=True) for a, b in zip(cut, ends, strict=True)], pa.binary()),
        ], names=names)

    return run


def _related(classes: dict[bytes, list[int]], place: list[int], length: int, gram: int) -> tuple[list[tuple[bytes, list[int]]], list[list[int]]]:
    """An anchor's stretches that can share ``length`` bytes with another one, and the rows of those that can't but occur twice.

    Such bytes hold the anchor, ``l`` bytes before it and the rest behind it.
    With ``l`` rounded down to a step, stretches that agree with no other around
    the anchor for any ``l`` share nothing.
    """
    span = length - gram
    step = max(1, span // 6)
    sides = [(x, max(0, span - x - step + 1)) for x in range(0, span + 1, step)]
    seen: dict[tuple[int, bytes], int] = {}
    own = []
    for x, rows in classes.items():
        keys = {(k, x[at - before : at + gram + behind]) for at in {place[i] for i in rows} for k, (before, behind) in enumerate(sides) if before <= at and at + gram + behind <= len(x)}
        own.append(keys)
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
    related, alone = [], []
    for keys, (x, rows) in zip(own, classes.items(), strict=True):
        if any(seen[key] > 1 for key in keys):
            related.append((x, rows))
        elif len(rows) > 1:
            alone.append(rows)
    return related, alone


def _sorted(length: int, gram: int, parts: int):
    """Spelled stretches to marks of what is removed, by suffix arrays over the distinct ones."""

    def run(batches):
        for _, rows in _grouped(batches):
            if not rows[0][0]:
                yield _owners(rows, parts)
                continue
            each = [unpacked(r[0], MARK) for r in rows]
            data, at = b"".join([pa.decompress(r[1], int(m["size"].sum()), codec="zstd", asbytes=True) for r, m in zip(rows, each, strict=True)]), 0
            marks = np.concatenate(each)
            groups: dict[int, dict[bytes, list[int]]] = {}
            sizes, order, place = marks["size"].tolist(), marks["ord"].tolist(), marks["at"].tolist()
            for i, (anchor, n) in enumerate(zip(marks["anchor"].tolist(), sizes, strict=True)):
                groups.setdefault(anchor, {}).setdefault(data[at : at + n], []).append(i)
                at += n
            out: list[np.ndarray] = []
            single: list[tuple[int, int, int]] = []
            held: list[tuple[bytes, list[int]]] = []
            ords = marks["ord"].copy()

            def flush(held=held, out=out, ords=ords):
                if not held:
                    return
                rows, copies = np.array([i for _, own in held for i in own], np.int64), np.array([len(own) for _, own in held])
                own_ords, kind = ords[rows], np.repeat(np.arange(len(held)), copies)
                least = repeated([x for x, _ in held], np.minimum.reduceat(own_ords, copies.cumsum() - copies), length)
                count = np.array([len(x) for x, _ in held]) - length + 1
                begin = count.cumsum() - count
                for s in range(0, len(rows), SLICE):
                    part = slice(s, s + SLICE)
                    n = count[kind[part]]
                    end = n.cumsum()
                    inside = np.arange(n.sum()) - np.repeat(end - n, n)
                    hit = least[np.repeat(begin[kind[part]], n) + inside] < np.repeat(own_ords[part], n)
                    before, after = np.append(False, hit[:-1]), np.append(hit[1:], False)
                    before[end - n] = after[end - 1] = False
                    a, b = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
                    out.append(np.stack([np.repeat(rows[part], n)[a], inside[a], inside[b]], axis=1))
                held.clear()

            held_bytes = 0
            for classes in groups.values():
                related, alone = _related(classes, place, length, gram) if len(classes) > 1 else ([], list(classes.values()))
                for own in alone:
                    least = min([order[i] for i in own])
                    single += [(i, 0, sizes[i] - length) for i in own if order[i] > least]
                held += related
                held_bytes += sum(len(x) + 1 for x, _ in related)
                if held_bytes >= SORTED:
                    flush()
                    held_bytes = 0
            flush()
            i, a, b = np.concatenate([*out, np.array(single, np.int64).reshape(-1, 3)]).T
            if len(i):
                made = marks[i].copy()
                made["start"] += a.astype(np.uint32)
                made["size"] = (b - a + length).astype(np.uint32)
                made["sort"] = 0
                yield _dealt(made, parts)

    return run


def _cut(length: int):
    """Documents with their removed spans and the bytes that stay."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        found = _marks(marks)
        far = found[found["sort"] == FAR]
        told = found[found["sort"] == OWNER]
        found = found[found["sort"] == GONE]
        if len(far):
            found = np.concatenate([found, _gone_far(docs, far, told, length)])
        return _spans(docs, found)

    return run


def _spans(docs: pa.Table, found: np.ndarray) -> pa.Table:
    texts = docs.column("text").cast(pa.binary()).to_pylist()
    spans, kept = [], []
    for row, own in _by_document(docs, found):
        text = texts[row]
        if not len(own):
            spans.append([])
            kept.append(text)
            continue
        order = np.argsort(own["start"], kind="stable")
        a, b = own["start"][order].astype(np.int64), (own["start"].astype(np.int64) + own["size"])[order]
        reach = np.maximum.accumulate(b)
        new = np.append(True, a[1:] > reach[:-1])
        first, last = a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
        spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(first, last, strict=True)])
        at, parts = 0, []
        for x, y in zip(first.tolist(), last.tolist(), strict=True):
            parts.append(text[at:x])
            at = y
        kept.append(b"".join([*parts, text[at:]]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table([docs.column("id"), docs.column("text"), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "text", "spans", "kept"])


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, text, spans, kept) for each row: removed byte ranges, and the bytes that stay, joined.

    Texts are taken as UTF-8 bytes, null as empty; spans are maximal. Rows of
    one id are not smaller than each other; a null id is larger than all others.
    Repeated rows each get their row. Texts under ``length`` bytes stay whole.
    An empty table gives an empty result; other columns are not read. Ids that
    are no integers are an error.
    """
    if not 0 < gram < length or length - gram > 200:
        raise ValueError("0 < gram < length <= gram + 200")
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} is no integer column")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text).alias("text"))
    # 48 bits tell apart the texts of repeated ids.
    base = base.withColumns({"ord": F.coalesce("id", F.lit(LAST)), "th": F.shiftrightunsigned(F.xxhash64("text"), 16)})
    total = base.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts, buckets = max(1, -(-total // (2 * BLOCK))), max(1, -(-total // (8 * BUCKET)))
    tasks = max(1, -(-total // (4 * TASK)))

    packed = "bucket int, ords binary, ths binary, doc binary, start binary, size binary, anchor binary, at binary"
    # Few anchors are hot: no more than all stretches divided by HOT.
    hot, n_hot = np.zeros(0, np.uint64), 0
    if total >= HOT:
        counts = base.sample(SHARE, seed=7) if SHARE < 1 else base
        counts = counts.select("text").mapInArrow(_counted(length, gram), "anchor long, n long")
        rows = counts.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT * SHARE).collect()
        hot, n_hot = np.array([r["anchor"] for r in rows], np.int64).view(np.uint64), int(sum(r["n"] for r in rows) / SHARE)
    far_tasks = max(1, -(-min(total, n_hot * (length - gram + 1)) // STRINGS))
    anchored = base.select("ord", "th", "text").mapInArrow(_anchored(length, gram, buckets, hot), packed)
    dealt = anchored.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    judged = materialize(dealt.mapInArrow(_judged(parts), MARKS), "judged")

    # The group of a document: the same mix of id and text hash as in the tasks.
    rows = base.select("id", "ord", "th", "text")

    def grouped(batches):
        for b in batches:
            part = _part(b.column(1).to_numpy(), b.column(2).to_numpy(), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *b.columns], names=["part", *b.schema.names])

    held = rows.mapInArrow(grouped, "part int, id long, ord long, th long, text string")
    spelled = held.groupBy("part").cogroup(judged.groupBy("part")).applyInArrow(_spelled(tasks, far_tasks, length), "task int, marks binary, data binary")
    sorting = spelled.repartition(tasks + far_tasks if len(hot) else tasks, "task").sortWithinPartitions("task")
    found = materialize(sorting.mapInArrow(_sorted(length, gram, parts), MARKS), "sorted")
    marks = judged.unionByName(found)
    out = held.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_cut(length), "id long, text string, spans array<struct<start:long,stop:long>>, kept binary")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """What exact substring dedup removes from every document, with a digest of what stays."""
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return out.select(
        F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
