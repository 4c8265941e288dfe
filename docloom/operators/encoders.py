"""A small encoder of its own: dense vectors and learned term weights from one pass over the tokens.

A token's vector is the mean of fixed random vectors of its subwords; its state
adds a share of its neighbours'. The dense vector of a text is the mean of its
states. The lexical head is a linear map of a state with a ReLU; a term weighs
the most that it does at any of its places. The head is fitted on labelled pairs
of a query and a passage.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.search import terms

#: Length of a state, rows of the table of subword vectors, and a neighbour's share.
DIM, BUCKETS, SHARE = 32, 4096, 0.25
#: Pairs that a head is fitted on, at most, and tokens whose vectors a task remembers.
SAMPLE, REMEMBERED = 2000, 100_000
#: Tokens whose states a task holds at once (one text at least), and tokens whose subwords it looks up at once.
TOKENS, LOOKED_UP = 1 << 16, 4096


#: Remainders of CRC-32, a byte each.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ 0xEDB88320, CRC >> 1).astype(np.uint32)


def _buckets(marked: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams of each token, their buckets in the order of the grams) of tokens in ASCII with their marks, all at once."""
    size = np.array([len(m) for m in marked])
    byte = np.concatenate([np.frombuffer(b"".join(marked), np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    of = np.repeat(np.arange(len(size)), size)
    left = np.repeat(size.cumsum(), size) - np.arange(len(of))  # bytes from a place to its token's end
    three = byte[:-3] << 24 | byte[1:-2] << 16 | byte[2:-1] << 8
    key = of << 33 | three << 1
    whole = np.flatnonzero(size > 4)  # shorter ones are grams themselves
    first = (size.cumsum() - size)[whole]
    key = np.unique(np.concatenate([key[left > 2], (key | byte[3:] << 1)[left > 3], key[first] | byte[first + 3] << 1 | 1]))
    c = np.full(len(key), 0xFFFFFFFF, np.uint32)
    for shift in (25, 17, 9, 1):
        b = (key >> shift & 255).astype(np.uint32)
        c = np.where(b > 0, CRC[(c ^ b) & 255] ^ (c >> 8), c)
    c ^= 0xFFFFFFFF
    c[np.flatnonzero(key & 1)] = [zlib.crc32(marked[k]) for k in whole.tolist()]
    return np.bincount(key >> 33, minlength=len(size)), c % BUCKETS


class Encoder:
    """States of tokens; the same in every task."""

    def __init__(self, seed: int = 11):
        self.table = np.random.default_rng(seed).standard_normal((BUCKETS, DIM)) / DIM**0.5
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, DIM))

    def made(self, tokens: list[str]) -> np.ndarray:
        """For each token the mean of the vectors of the token and its runs of three and four characters, ends marked."""
        if not all(map(str.isascii, tokens)):
            grams = []
            for t in tokens:
                m = f"<{t}>"
                own = {m, *(m[k : k + n] for n in (3, 4) for k in range(len(m) - n + 1))}
                grams.append([zlib.crc32(g.encode()) % BUCKETS for g in sorted(own)])
            n, bucket = np.array([len(g) for g in grams]), np.array([x for g in grams for x in g])
        else:
            n, bucket = _buckets([f"<{t}>".encode() for t in tokens])
        return np.add.reduceat(self.table[bucket], n.cumsum() - n) / n[:, None]

    def vectors(self, names: list[str]) -> np.ndarray:
        """A row each of distinct tokens; it is made once while it is remembered."""
        if len(self.known) + len(names) > REMEMBERED:
            self.known, self.rows = {}, np.empty((0, DIM))
        new = [t for t in names if t not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *(self.made(new[k : k + LOOKED_UP]) for k in range(0, len(new), LOOKED_UP))])
        return self.rows[[self.known[t] for t in names]]

    def coded(self, names: list[str], code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Unit states, a row a token, of texts of ``sizes`` tokens one after the other; ``code`` is each token's place in ``names``."""
        if not len(code):
            return np.zeros((0, DIM))
        own = self.vectors(names)[code]
        side = SHARE * own
        inner = np.repeat(np.arange(len(sizes)), sizes)
        inner = (inner[1:] == inner[:-1])[:, None]
        own[1:] += side[:-1] * inner
        own[:-1] += side[1:] * inner
        own /= np.maximum(np.linalg.norm(own, axis=1), 1e-12)[:, None]
        return own

    def states(self, tokens: list[str]) -> np.ndarray:
        """Unit states of one text, a row a token."""
        names = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
        return self.coded(list(names), np.array([names[t] for t in tokens], np.int64), np.array([len(tokens)]))

    def dense(self, tokens: list[str]) -> np.ndarray:
        """The unit mean of the states; zero for a text without tokens."""
        mean = self.states(tokens).sum(0)
        n = np.linalg.norm(mean)
        return mean / n if n else mean


def pooled(states: np.ndarray, tokens: list[str], w: np.ndarray, b: float) -> dict[str, tuple[float, int]]:
    """(largest weight, its place) of each term whose weight is over 0."""
    weight = states @ w + b
    out: dict[str, tuple[float, int]] = {}
    for k, (t, x) in enumerate(zip(tokens, weight.tolist(), strict=True)):
        if x > out.get(t, (0.0, 0))[0]:
            out[t] = x, k
    return out


class Head:
    """Weights of a lexical head."""

    def __init__(self, w: np.ndarray, b: float, shift: float = 0.0):
        self.w, self.b, self.shift = w, b, shift

    def weights(self, encoder: Encoder, tokens: list[str]) -> dict[str, float]:
        made = pooled(encoder.states(tokens), tokens, self.w, self.b)
        return {t: r for t, (x, _) in made.items() if (r := round(x, 6)) > 0}


def fit(pairs: list[tuple[list[str], list[str], int]], epochs: int = 12, rate: float = 0.1, seed: int = 3) -> Head:
    """A head by logistic loss on pairs of token lists and labels.

    A pair's logit is the product of its postings by the roots of their numbers
    of terms, less a shift. Every term starts with the weight 1.
    """
    encoder = Encoder()
    made = [(encoder.states(q), q, encoder.states(p), p, y) for q, p, y in pairs]
    w, b, shift, r = np.zeros(DIM), 1.0, 0.5, np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in r.permutation(len(made)).tolist():
            sq, q, sp, p, y = made[k]
            a, c = pooled(sq, q, w, b), pooled(sp, p, w, b)
            scale = 4 / max(1, len(a) * len(c)) ** 0.5
            shared = a.keys() & c.keys()
            logit = scale * sum(a[t][0] * c[t][0] for t in shared) - shift
            off = rate / (1 + epoch) ** 0.5 * (y - 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            step = sum((c[t][0] * sq[a[t][1]] + a[t][0] * sp[c[t][1]] for t in sorted(shared)), np.zeros(DIM))
            w, b = w + off * scale * step, b + off * scale * sum(a[t][0] + c[t][0] for t in shared)
            shift -= off
    return Head(w, float(b), float(shift))


def fit_head(pairs: DataFrame, sample: int = SAMPLE) -> Head:
    """A head fitted on at most ``sample`` rows of ``pairs(query, passage, label)``, those of the smallest hashes."""
    drawn = pairs.where("query IS NOT NULL AND passage IS NOT NULL AND label IS NOT NULL").withColumn("h_", F.xxhash64("query", "passage", "label")).orderBy("h_", "query", "passage", "label").limit(sample)
    rows = drawn.select(terms(F.col("query")).alias("q"), terms(F.col("passage")).alias("p"), F.col("label").cast("int").alias("y")).collect()
    return fit([(list(r.q), list(r.p), r.y) for r in rows])


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``TOKENS`` tokens, one text at least."""
    ends, a = sizes.cumsum(), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, side="right")))
        yield a, b
        a = b


def _texts(texts: pa.ListArray) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(first text, distinct tokens, each token's place among them, tokens of each text) by parts of a column of token lists."""
    for a, b in _parts(pc.list_value_length(texts).to_numpy()):
        own = texts.slice(a, b - a)
        word = own.flatten().dictionary_encode()
        yield a, word.dictionary, word.indices.to_numpy().astype(np.int64), pc.list_value_length(own).to_numpy().astype(np.int64)


def head_postings(docs: DataFrame, key: str, head: Head, text: str = "text") -> DataFrame:
    """(key, term, weight): as :func:`docloom.operators.search.postings`, with the head's weights. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            for a, names, code, sizes in _texts(batch.column(1)):
                weight = encoder.coded(names.to_pylist(), code, sizes) @ head.w + head.b
                at = np.repeat(np.arange(len(sizes)), sizes) << 32 | code
                order = np.lexsort((-weight, at))
                order = order[np.diff(at[order], prepend=-1) != 0]  # the largest weight of each term of a text
                order = order[np.round(weight[order], 6) > 0]
                columns = [batch.column(0).take(pa.array(a + (at[order] >> 32))), names.take(pa.array(code[order])), pa.array(np.round(weight[order], 6))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "term", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    split = docs.where(F.col(key).isNotNull()).select(key, terms(F.coalesce(text, F.lit(""))).alias("t_"))
    found = split.mapInArrow(run, f"`{key}` {kind}, term string, weight double")
    return found.groupBy(key, "term").agg(F.max("weight").alias("weight"))


def dense_encoder(text: Column) -> Column:
    """A column of unit vectors of texts, by Arrow batches; no tokens, the zero vector."""

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder()
        for texts in batches:
            out = np.zeros((len(texts), DIM))
            for a, names, code, sizes in _texts(texts):
                some = np.flatnonzero(sizes)
                if len(some):
                    mean = np.add.reduceat(encoder.coded(names.to_pylist(), code, sizes), (sizes.cumsum() - sizes)[some])
                    n = np.linalg.norm(mean, axis=1)[:, None]
                    out[a + some] = mean / np.where(n == 0, 1, n)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * DIM, pa.int32()), pa.array(out.ravel()))

    return encode(terms(F.coalesce(text, F.lit(""))))
