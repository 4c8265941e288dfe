"""Phrase collocations by double-array tries of candidates.

Texts are first written as numbers of words, and words are counted. A pair of words that are frequent, and a triple of pairs
that are, is a candidate; small bitmaps of what is frequent, which let through too
much but never too little, keep the others from the shuffle. Candidates are dealt
into shards. Each shard's trie is broadcast, and a task moves the states of all
positions of a block of text on by one word at a time; accepted states are
counted by shard and summed.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.arrow import blocks
from docloom.llm.common import drop_table, materialize, text_of

#: Least count of a candidate, candidates a language returns, and the share of its count (percent) at which a longer one replaces it.
LEAST, TOP, SHARE = 10, 2000, 50
#: Candidates of one trie: bounds what is broadcast at once (about 60 bytes each).
SHARD = 1 << 19
#: Bits of a bitmap of frequent words or pairs (a power of two); more of them than bits only let more candidates through.
BITS = 1 << 26
#: Bytes of text that a task counts at once, and words that it remembers.
BLOCK, MEMORY = 6 << 20, 1 << 18
#: Parts of the pairs (a power of two) that are shuffled one after another, which bounds the disk that they take.
PARTS = 2
#: Rows of a batch of candidates that a task hands on.
ROWS = 1 << 16
#: Seeds of the hash that stands for a word, tried in turn until all words of the corpus differ.
SEEDS = 8

# What ends a piece of text.
STOPS = re.compile(rb"[.,;:!?\n-\r]+")
#: Stands for the end of a piece or document; no byte of UTF-8 text.
EDGE = b"\xff"


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed) - (1 << 63)


class Words(dict):
    """Numbers of words in the order they are met; :meth:`hash` has the words' hashes. Number 0 is the edge of a piece."""

    def __init__(self, seed: int):
        super().__init__({EDGE: 0})
        self.seed, self._hash = seed, array("q", [0])

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self._hash)
        self._hash.append(word_hash(word, self.seed))
        return n

    def hash(self) -> np.ndarray:
        return np.frombuffer(self._hash.tobytes(), np.int64)


def flat_words(texts: pa.Array, words: Words) -> np.ndarray:
    """Numbers of the words of all texts, with an edge behind each piece and text."""
    split: list[bytes] = []
    for t in texts:
        split += STOPS.sub(b" \xff ", t.as_buffer().to_pybytes().lower()).split()
        split.append(EDGE)
    return np.fromiter(map(words.__getitem__, split), np.int32, len(split))


def encoded(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, words, hashes, flat): blocks of texts of one language, as numbers of the block's words; number 0 is the edge of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(seed), {}, 0

        def done():
            h, met = words.hash(), np.array(list(words), object)
            for lang, parts in held.items():
                flat = np.concatenate(parts)
                seen = np.zeros(len(h), bool)
                seen[flat] = True
                used = np.flatnonzero(seen)
                number = np.zeros(len(h), np.uint16 if len(used) <= 1 << 16 else np.int32)
                number[used] = np.arange(len(used))
                own = pa.array([b"", *met[used[1:]]], pa.binary()).cast(pa.string())
                yield _batch([[lang], pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), [h[used].tobytes()], [number[flat].tobytes()]], [pa.string(), None, pa.binary(), pa.binary()], ["lang", "words", "hashes", "flat"])

        for batch in batches:
            for own in blocks(batch, 1):
                langs = own.column(0).to_pylist()
                edges = np.flatnonzero([True, *(a != b for a, b in zip(langs, langs[1:], strict=False))]).tolist() + [len(langs)]
                for a, b in zip(edges, edges[1:], strict=False):
                    held.setdefault(langs[a], []).append(flat_words(own.column(1)[a:b], words))
                size += own.column(1).nbytes
                if size >= BLOCK or len(words) > MEMORY:
                    yield from done()
                    held, size = {}, 0
                    if len(words) > MEMORY:
                        words = Words(seed)
        if held:
            yield from done()

    return materialize(texts.mapInArrow(run, "lang string, words array<string>, hashes binary, flat binary"), "encoded")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, hashes of the words, numbers) of the blocks of :func:`encoded`."""
    for batch in batches:
        for lang, hashes, flat in zip(*(batch.column(c) for c in ("lang", "hashes", "flat")), strict=True):
            h = np.frombuffer(hashes.as_buffer(), np.int64)
            yield lang.as_py(), h, np.frombuffer(flat.as_buffer(), np.uint16 if len(h) <= 1 << 16 else np.int32).astype(np.int32)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def count_words(coded: DataFrame) -> DataFrame:
    """(lang, h, word, f): occurrences of every word, with its hash."""

    def run(batches):
        for batch in batches:
            for k, (lang, h, flat) in enumerate(_blocks([batch])):
                n = np.bincount(flat, minlength=len(h))[1:]
                if len(n):
                    yield _batch([pa.repeat(lang, len(n)), h[1:], batch.column("words")[k].values[1:], n], [pa.string(), pa.int64(), pa.string(), pa.int64()], ["lang", "h", "word", "f"])

    return coded.mapInArrow(run, "lang string, h long, word string, f long").groupBy("lang", "h", "word").agg(F.sum("f").alias("f"))


def words_counted(texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(:func:`encoded`'s table, written table of :func:`count_words`, seed): with the first seed by which no two words of the corpus have one hash."""
    for seed in range(SEEDS):
        coded = encoded(texts, seed)
        counted = materialize(count_words(coded), "words")
        if not counted.groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b").limit(1).count():
            return coded, counted, seed
        drop_table(coded)
        drop_table(counted)
    raise RuntimeError("words share hashes under every seed")


def mixed_bits(*parts: np.ndarray, bits: int) -> np.ndarray:
    """Places in a bitmap for sequences of hashes."""
    out = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        out = (out ^ p.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return (out & np.uint64(bits - 1)).astype(np.int64)


def bitmap(frequent: DataFrame, columns: list[str]):
    """A broadcast bitmap with the places of all rows of ``frequent`` set: ``BITS`` bits, whatever the number of rows."""
    bits = BITS

    def run(batches):
        for batch in batches:
            at = np.unique(mixed_bits(*[c.to_numpy() for c in batch.columns], bits=bits))
            cell, bit = at >> 6, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(at) else []
            if len(at):
                yield _batch([cell[first], np.bitwise_or.reduceat(bit, first).view(np.int64)], [pa.int64(), pa.int64()], ["cell", "bits"])

    cells = frequent.select(*columns).mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    made = np.zeros(bits >> 6, np.int64)
    got = cells.toArrow()  # a row of 16 bytes for every 64 bits at most
    made[got.column("cell").to_numpy()] = got.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(made)


def has(held: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """Whether the places of the sequences are set."""
    at = mixed_bits(*parts, bits=len(held) << 6)
    return (held[at >> 6] >> (at & 63)) & 1 == 1


def lang_hash(lang: str, seed: int) -> int:
    return word_hash(b"\xff" + lang.encode(), seed)


def _pairs(flat: np.ndarray, h: np.ndarray, lang: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers) of the pairs of frequent words in one piece: first word times 2^32 and second word."""
    good = has(frequent, np.full(len(h), lang), h)
    good[0] = False
    ok = good[flat]
    at = np.flatnonzero(ok[:-1] & ok[1:])
    return at, flat[at].astype(np.int64) << 32 | flat[at + 1]


def _capped(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    value, n = np.unique(key, return_counts=True)
    return value, np.minimum(n, least)


def pair_candidates(coded: DataFrame, frequent, seed: int, least: int) -> DataFrame:
    """(lang, h1, h2): pairs of frequent words that occur ``least`` times, from counts that tasks cap there; each part a written table."""
    made = [materialize(_pair_part(coded, frequent, seed, least, part), "pairs") for part in range(PARTS)]
    out = made[0]
    for other in made[1:]:
        out = out.unionByName(other)
    return out


def _pair_part(coded: DataFrame, frequent, seed: int, least: int, part: int) -> DataFrame:
    parts = PARTS

    def run(batches):
        for lang, h, flat in _blocks(batches):
            key, n = _capped(_pairs(flat, h, lang_hash(lang, seed), frequent.value)[1], least)
            mine = mixed_bits(h[key >> 32], h[key & 0xFFFFFFFF], bits=parts) == part
            key, n = key[mine], n[mine]
            for a in range(0, len(key), ROWS):
                own = key[a : a + ROWS]
                yield _batch([pa.repeat(lang, len(own)), h[own >> 32], h[own & 0xFFFFFFFF], n[a : a + ROWS]], [pa.string(), *[pa.int64()] * 3], ["lang", "h1", "h2", "n"])

    found = coded.drop("words").mapInArrow(run, "lang string, h1 long, h2 long, n long")
    return found.groupBy("lang", "h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n")


def triple_candidates(coded: DataFrame, frequent, pairs, seed: int, least: int) -> DataFrame:
    """(lang, h1, h2, h3): triples whose two pairs are frequent and that occur ``least`` times."""

    def run(batches):
        for lang, h, flat in _blocks(batches):
            at, key = _pairs(flat, h, lang_hash(lang, seed), frequent.value)
            value, inverse = np.unique(key, return_inverse=True)
            good = has(pairs.value, np.full(len(value), lang_hash(lang, seed)), h[value >> 32], h[value & 0xFFFFFFFF])
            keep = good[inverse]
            at, inverse = at[keep], inverse[keep]
            both = np.flatnonzero(at[1:] == at[:-1] + 1) if len(at) else at
            key, n = _capped(inverse[both] << 32 | flat[at[both] + 2], least)
            for a in range(0, len(key), ROWS):
                own = key[a : a + ROWS]
                pair = value[own >> 32]
                yield _batch([pa.repeat(lang, len(own)), h[pair >> 32], h[pair & 0xFFFFFFFF], h[own & 0xFFFFFFFF], n[a : a + ROWS]], [pa.string(), *[pa.int64()] * 4], ["lang", "h1", "h2", "h3", "n"])

    found = coded.drop("words").mapInArrow(run, "lang string, h1 long, h2 long, h3 long, n long")
    return found.groupBy("lang", "h1", "h2", "h3").agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n")


class Trie:
    """A double-array trie of sequences of symbols: from state s, digit c leads to ``base[s] + c`` where ``check`` there is s.

    ``accept`` has the number of the sequence that ends in a state, or -1; the
    root is state 0. Symbols are places in the sorted ``symbols``, and each is
    read as two digits, so that a state has few children close to each other
    and the array is little larger than its states.
    """

    def __init__(self, sequences: list[np.ndarray]):
        """``sequences``: an array of rows of hashes for each length; numbers run on from one to the next."""
        self.symbols = np.unique(np.concatenate([s.ravel() for s in sequences]))
        self.digits = max(1, math.ceil(len(self.symbols) ** 0.5))
        coded = [np.searchsorted(self.symbols, s) for s in sequences]
        coded = [np.stack(np.divmod(s, self.digits), 2).reshape(len(s), 2 * s.shape[1]) for s in coded]
        deep = max((s.shape[1] for s in coded), default=0)
        # Nodes level by level: each is its parent's node and a symbol.
        at = [np.zeros(len(s), np.int64) for s in sequences]
        parents, symbols, end, n = [np.array([-1])], [np.array([-1])], {}, 1
        for level in range(deep):
            live = [k for k, s in enumerate(coded) if s.shape[1] > level]
            key = np.concatenate([at[k] << 32 | coded[k][:, level] for k in live])
            value, node = np.unique(key, return_inverse=True)
            parents.append(value >> 32)
            symbols.append(value & 0xFFFFFFFF)
            for k, own in zip(live, np.split(node + n, np.cumsum([len(at[k]) for k in live])[:-1]), strict=True):
                at[k] = own
            n += len(value)
        first = 0
        accept = np.full(n, -1, np.int64)
        for own in at:
            accept[own] = first + np.arange(len(own))
            first += len(own)
        self._place(np.concatenate(parents), np.concatenate(symbols), accept)

    def _place(self, parent: np.ndarray, symbol: np.ndarray, accept: np.ndarray) -> None:
        """Give every node its slot: the nodes of most children first, the others in rounds of random bases, a slot for one node."""
        n, width = len(parent), self.digits
        order = np.argsort(parent[1:], kind="stable") + 1
        owner, count = np.unique(parent[order], return_counts=True)
        begin = count.cumsum() - count
        size = 2 * n + 64
        used = np.zeros(size + width, bool)
        base, slot = np.zeros(n, np.int64), np.zeros(n, np.int64)
        used[0] = True  # the root's own slot
        r = np.random.default_rng(1)
        small = count <= 8
        for k in np.flatnonzero(~small)[np.argsort(-count[~small], kind="stable")].tolist():
            own = symbol[order[begin[k] : begin[k] + count[k]]]
            while True:
                tried = r.integers(1, size, 256)
                fit = ~used[tried[:, None] + own].any(1)
                if fit.any():
                    b = int(tried[fit.argmax()])
                    break
                size += size // 8  # crowded: the array grows
                used = np.concatenate([used, np.zeros(max(0, size + width - len(used)), bool)])
            used[b + own] = True
            base[owner[k]] = b
        left = np.flatnonzero(small)
        while len(left):
            b = r.integers(1, size, len(left))
            row = np.repeat(np.arange(len(left)), count[left])
            child = order[np.repeat(begin[left] - (count[left].cumsum() - count[left]), count[left]) + np.arange(len(row))]
            want = b[row] + symbol[child]
            bad = used[want]
            first = np.zeros(len(want), bool)
            first[np.unique(want, return_index=True)[1]] = True
            free = np.bincount(row, weights=bad | ~first, minlength=len(left)) == 0
            used[want[free[row]]] = True
            base[owner[left[free]]] = b[free]
            left = left[~free]
            if len(left) > 0 and free.mean() < 0.01:
                size += size // 8
                used = np.concatenate([used, np.zeros(max(0, size + width - len(used)), bool)])
        slot[1:] = base[parent[1:]] + symbol[1:]
        self.base, self.check, self.accept = np.zeros(len(used), np.int32), np.full(len(used), -1, np.int32), np.full(len(used), -1, np.int32)
        self.base[slot], self.accept[slot] = base, accept
        self.check[slot[1:]] = slot[parent[1:]]

    def _read(self, state: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.base[state] + digit
        on = np.flatnonzero(self.check[to] == state)
        return on, to[on]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places whose state goes on, their next states)."""
        some = np.flatnonzero(symbol >= 0)
        high, low = np.divmod(symbol[some], np.int32(self.digits))
        first, half = self._read(state[some], high)
        second, after = self._read(half, low[first])
        return some[first[second]], after

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of hashes, -1 for those of none."""
        at = np.minimum(np.searchsorted(self.symbols, hashes), len(self.symbols) - 1)
        return np.where(self.symbols[at] == hashes, at, -1).astype(np.int32)

    def add_counts(self, flat: np.ndarray, start: int, got: np.ndarray, deep: int) -> None:
        """Add to ``got`` how often each sequence begins with ``start`` and goes on through ``flat``, an array of symbols: all positions move on together."""
        on, state = self.step(np.zeros(1, np.int32), np.array([start], np.int32))
        if not len(on):
            return
        at, state = np.arange(len(flat), dtype=np.int32), np.full(len(flat), state[0], np.int32)
        for level in range(deep):
            inside = np.flatnonzero(at + level < len(flat))
            at, state = at[inside], state[inside]
            on, state = self.step(state, flat[at + level])
            at = at[on]
            done = self.accept[state]
            got += np.bincount(done[done >= 0], minlength=len(got))


def shard_trie(own: pa.Table, seed: int) -> tuple[Trie | None, np.ndarray, list[str]]:
    """(trie, numbers, languages) of one shard's candidates: the language's place and the symbols of each, -1 for none."""
    if not own.num_rows:
        return None, np.empty((0, 4), np.int32), []
    lang = own.column("lang").combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    code = lang.indices.to_numpy()
    three = own.column("h3").is_valid().to_numpy()
    order = np.argsort(three, kind="stable")
    pairs = int((~three).sum())
    h = [own.column(c).fill_null(0).to_numpy()[order] for c in ("h1", "h2", "h3")]
    first = np.array([lang_hash(x, seed) for x in names], np.int64)[code[order]]
    trie = Trie([np.stack([x[:pairs] for x in (first, h[0], h[1])], 1), np.stack([x[pairs:] for x in (first, *h)], 1)])
    symbols = [trie.codes(x) for x in h]
    symbols[2][:pairs] = -1
    return trie, np.stack([code[order].astype(np.int32), *symbols], 1), names


def count_phrases(coded: DataFrame, candidates: DataFrame, seed: int) -> DataFrame:
    """(lang, h1, h2, h3, a), a written table: exact occurrences of the candidates (h3 null for pairs).

    Candidates are dealt by hash into shards of ``SHARD``; the driver holds one
    shard and its trie at a time, and each shard goes once over the blocks.
    """
    spark = coded.sparkSession
    key = F.xxhash64("lang", "h1", "h2", "h3")
    shards = max(1, -(-candidates.count() // SHARD))
    out = None
    for shard in range(shards):
        trie, numbers, names = shard_trie(candidates.where(F.pmod(key, F.lit(shards)) == shard).toArrow(), seed)
        if not names:
            continue
        sent = spark.sparkContext.broadcast((trie, numbers, names))

        def run(batches, sent=sent):
            trie, numbers, names = sent.value
            start = {x: int(trie.codes(np.array([lang_hash(x, seed)]))[0]) for x in names}
            got = np.zeros(len(numbers), np.int64)
            for lang, h, flat in _blocks(batches):
                if lang in start:
                    codes = trie.codes(h)
                    codes[0] = -1
                    trie.add_counts(codes[flat], start[lang], got, 3)
            at = np.flatnonzero(got)
            for k in np.array_split(at, -(-len(at) // 50_000)) if len(at) else ():
                lang, *h = numbers[k].T
                yield _batch([[names[i] for i in lang.tolist()], trie.symbols[h[0]], trie.symbols[h[1]], pa.array(trie.symbols[h[2]], mask=h[2] < 0), got[k]], [pa.string(), *[pa.int64()] * 4], ["lang", "h1", "h2", "h3", "a"])

        made = coded.drop("words").mapInArrow(run, "lang string, h1 long, h2 long, h3 long, a long").groupBy("lang", "h1", "h2", "h3").agg(F.sum("a").alias("a"))
        made = materialize(made, "phrases")
        sent.destroy()
        out = made if out is None else out.unionByName(made)
    return out if out is not None else candidates.select("*", F.lit(0).cast("long").alias("a")).limit(0)


def score(a, l, r):
    """floor(1000000 * a * a / (l * r)) in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    over = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)")
    return F.call_function("div", over, wide(l) * wide(r)).cast("long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    A-Z count as a-z; texts are cut into pieces at stops and line ends, pieces
    into words at spaces and tabs. Phrases within one piece that occur ``least``
    times are candidates; each is scored by the cut that scores lowest. A pair
    that lies in a triple of ``share`` percent of its count is dropped. Null
    languages are ``und``; null and empty texts have no words; repeated rows
    count each; very long texts are whole; ties go by count, then by the bytes
    of the phrase; an empty table gives an empty result; other columns are not
    read.
    """
    texts = _texts(docs, text, lang)
    coded, counted, seed = words_counted(texts)
    n = materialize(counted.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    frequent = counted.where(F.col("f") >= least)
    hashed = F.udf(lambda x: lang_hash(x, seed), "long")
    langs = materialize(n.select("lang", hashed("lang").alias("lh")), "langs")
    if langs.groupBy("lh").count().where("count > 1").limit(1).count():
        raise RuntimeError("languages share a hash")
    with_lang = lambda df: df.join(langs, "lang")
    words = bitmap(with_lang(frequent), ["lh", "h"])
    twos = pair_candidates(coded, words, seed, least)
    pairs = bitmap(with_lang(twos), ["lh", "h1", "h2"])
    threes = triple_candidates(coded, words, pairs, seed, least)
    candidates = materialize(twos.withColumn("h3", F.lit(None).cast("long")).unionByName(threes), "candidates")
    words.destroy()
    pairs.destroy()
    drop_table(twos)
    phrases = count_phrases(coded, candidates, seed)
    drop_table(candidates)
    drop_table(coded)
    two, three = phrases.where("h3 IS NULL").drop("h3"), phrases.where("h3 IS NOT NULL")
    longer = three.select("lang", "h1", "h2", "a").unionByName(three.select("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    most = longer.groupBy("lang", "h1", "h2").agg(F.max("a").alias("most"))
    kept = two.join(most, ["lang", "h1", "h2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
    word = lambda k: frequent.select("lang", F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
    pair = lambda i, j: two.select("lang", F.col("h1").alias(f"h{i}"), F.col("h2").alias(f"h{j}"), F.col("a").alias(f"f{i}{j}"))
    scored2 = kept.join(word(1), ["lang", "h1"]).join(word(2), ["lang", "h2"])
    scored2 = scored2.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    joined = three.join(pair(1, 2), ["lang", "h1", "h2"]).join(pair(2, 3), ["lang", "h2", "h3"]).join(word(1), ["lang", "h1"]).join(word(3), ["lang", "h3"]).join(word(2).drop("f2"), ["lang", "h2"])
    joined = joined.withColumns({"s1": score(F.col("a"), F.col("f1"), F.col("f23")), "s2": score(F.col("a"), F.col("f12"), F.col("f3"))})
    front = F.col("s1") <= F.col("s2")
    scored3 = joined.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(front, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(front, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = scored2.unionByName(scored3).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """The collocations of all documents, by language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS i, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, i, generate_subscripts(x, 1) AS j, unnest(x) AS piece FROM (SELECT lang, i, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS x FROM d)),
w AS (SELECT lang, i, j, generate_subscripts(x, 1) AS k, unnest(x) AS word FROM (SELECT lang, i, j, regexp_extract_all(piece, '[^\x20\x09]+') AS x FROM p)),
g AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY i, j ORDER BY k)),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
m AS (SELECT lang, w1, w2, max(a) AS most FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
c2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, a, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
       FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2 LEFT JOIN m ON m.lang = f2.lang AND m.w1 = f2.w1 AND m.w2 = f2.w2
       WHERE most IS NULL OR 100 * most < 50 * a),
b3 AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.a, x.f AS l1, yz.a AS r1, xy.a AS l2, z.f AS r2,
              CAST(1000000::HUGEINT * f3.a * f3.a // (x.f::HUGEINT * yz.a) AS BIGINT) AS s1, CAST(1000000::HUGEINT * f3.a * f3.a // (xy.a::HUGEINT * z.f) AS BIGINT) AS s2
       FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 z ON z.lang = f3.lang AND z.w1 = f3.w3
       JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2 JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3),
c AS (SELECT * FROM c2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM b3),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
