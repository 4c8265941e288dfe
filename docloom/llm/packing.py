"""Packing token sequences by concatenating and cutting.

The first pass encodes the texts and sums tokens within each partition; prefix
sums over the partitions' totals give every document its place in one stream of
all tokens. The second pass cuts that stream at multiples of the sequence length.
A window that no partition holds whole is put together from boundary records.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm.arrow import blocks
from docloom.llm.common import materialize, text_of

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 4096, 2
#: Tokens of words that a task remembers; beyond it the memory starts anew.
MEMORY = 1 << 21
#: Words that the library is asked for in one text.
JOINED = 32
#: Partitions whose totals are summed in one group of the second prefix sum.
FAN = 1024

# How the vocabulary's file splits lower-case text of ASCII and the letters of Latin-1 into words, what is left to the library, and its mark of a word's end.
WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\x09-\x0d\x20a-z0-9\xdf-\xf6\xf8-\xff]+")
OTHER = re.compile(r"[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]|<\|")
LAST = "</w>"


def default_vocabulary() -> str:
    """The word BPE of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Numbers of words; a word that was not met before gets the next one and waits in ``new``."""

    new: list[str]

    def __init__(self, known: dict):
        super().__init__(known)
        self.new = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Ids of texts as ``tokenizers`` gives them, each followed by the end id.

    Words are encoded one by one in this vocabulary, so equal words are encoded
    once, many in one text, cut at the tokens that end a word. Where a text has
    characters whose rules are the library's (or what may be a special token),
    the stretches between spaces, tabs and line feeds that have them go to the
    library whole: nothing spans white space.
    """

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.end = Tokenizer.from_file(path), end
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[n for token, n in vocabulary.items() if token.endswith(LAST)]] = True
        self.stored = np.dtype("<u2" if max(len(self.last) - 1, end) < 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.words = Words({None: 0})
        self.flat, self.start, self.count = np.array([self.end], np.int32), np.array([0]), np.array([1])

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of each text's)."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for own in ids for i in own), np.int32, int(count.sum())), count

    def _add(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + count.cumsum() - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])

    def _learn(self, new: list[str]) -> None:
        other = np.array([not w.isascii() and OTHER.search(w) is not None or "<|" in w for w in new])
        plain = [w for w, o in zip(new, other.tolist(), strict=True) if not o]
        flat, _ = self._each([" ".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)])
        ends = np.flatnonzero(self.last[flat])
        if other.any() or len(ends) != len(plain):  # or a vocabulary without marks
            self._add(*self._each(new))
        else:
            self._add(flat, np.diff(np.append(-1, ends)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if len(self.flat) + len(self.words) > MEMORY:
            self._forget()
        words: list[str | None] = []
        ends = np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            if "<|" in t or not t.isascii() and OTHER.search(t):
                for own in t.replace("\n", " ").replace("\t", " ").split(" "):
                    if OTHER.search(own):
                        words.append(own)
                    else:
                        words += WORDS.findall(own.lower())
            else:
                words += WORDS.findall(t.lower())
            words.append(None)
            ends[k] = len(words)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.new:
            self._learn(self.words.new)
            self.words.new = []
        count = self.count[at]
        last = count.cumsum()
        total = int(last[-1]) if len(last) else 0
        flat = self.flat[np.repeat(self.start[at] - (last - count), count) + np.arange(total)]
        return flat, np.diff(np.append(0, last[ends - 1]))


@functools.cache
def encoder(path: str, end: int) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path, end)


def prefix_sums(totals: DataFrame, part: str = "part", total: str = "total") -> DataFrame:
    """(part, base): what the parts before each part hold, from (part, total).

    Groups of parts are summed first, and sums run over groups, then over the
    parts of each group, so that no window holds more than a small share.
    """
    grouped = totals.withColumn("group_", F.floor(F.col(part) / FAN))
    earlier = Window.orderBy("group_").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("group_").agg(F.sum(total).alias("s_")).select(F.col("group_").alias("g_"), F.coalesce(F.sum("s_").over(earlier), F.lit(0)).alias("from_"))
    own = Window.partitionBy("group_").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.withColumn("own_", F.coalesce(F.sum(total).over(own), F.lit(0)))
    return within.join(groups, F.col("group_") == F.col("g_")).select(part, (F.col("from_") + F.col("own_")).cast("long").alias("base"))


def encoded(docs: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, ids, tokens, position) of each row, as a written table: ``position`` counts the tokens before the row's in one stream of all.

    ``ids`` are little-endian bytes, two an id where the vocabulary has no more
    than 65,536 ids, else four. Rows follow each other as they lie in partitions, partitions by number. The
    order is written with the ids, so a lost task changes nothing behind it.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            for own in blocks(batch, 1):
                flat, count = encode(own.column(1).to_pylist())
                ends = count.cumsum()
                raw, width = flat.astype(encode.stored).tobytes(), encode.stored.itemsize
                ids = pa.array([raw[width * (b - n) : width * b] for n, b in zip(count.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), ids, pa.array(count), pa.array(np.full(len(count), part, np.int64)), pa.array(seen + ends - count)], names=["doc_id", "ids", "tokens", "part", "before"])
                seen += int(ends[-1])

    schema = StructType([StructField("doc_id", kind), *StructType.fromDDL("ids binary, tokens long, part long, before long").fields])
    coded = materialize(docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema), "encoded")
    base = materialize(prefix_sums(coded.groupBy("part").agg(F.sum("tokens").alias("total"))), "bases")
    # A row a partition of the scan: Spark broadcasts the written table while it is under its own limit.
    placed = coded.join(base.withColumnRenamed("part", "part_"), F.col("part") == F.col("part_"))
    return placed.select("doc_id", "ids", "tokens", (F.col("base") + F.col("before")).alias("position"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids one after another, tokens and position of the rows of a batch (columns ids, tokens, position at 1, 2, 3)."""
    raw, tokens = b"".join(batch.column(1).to_pylist()), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(raw, f"<u{len(raw) // max(1, int(tokens.sum()))}" if raw else "<u4").astype("<u4")
    return flat, tokens, batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(flat: np.ndarray, tokens: np.ndarray, position: np.ndarray, length: int):
    """Pieces of documents between multiples of ``length``: (row, start in the row, piece's length, sequence, offset there, start in ``flat``)."""
    first, last = position // length, (position + tokens - 1) // length
    row = np.repeat(np.arange(len(tokens)), last - first + 1)
    n = (last - first + 1).cumsum()
    sequence = np.arange(len(row)) - np.repeat(n - (last - first + 1), last - first + 1) + first[row]
    begin = np.maximum(sequence * length, position[row])
    stop = np.minimum((sequence + 1) * length, (position + tokens)[row])
    start = begin - position[row]
    return row, start, stop - begin, sequence, begin - sequence * length, (tokens.cumsum() - tokens)[row] + start


def pieces(coded: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces into which :func:`encoded`'s documents are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in blocks(batch, 1):
                flat, tokens, position = _arrays(own)
                row, start, size, sequence, offset, at = _cut(flat, tokens, position, length)
                view = memoryview(flat.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                columns = [own.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, size, crc, tokens[row], sequence, offset))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return coded.select("doc_id", "ids", "tokens", "position").mapInArrow(run, StructType([coded.schema["doc_id"], *(StructField(c, LongType()) for c in names)]))


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row a piece of a row of ``docs``.

    Every text is encoded whole, followed by ``end``, and the texts lie one
    behind the other; sequence s holds tokens s * length and on. All sequences
    are full but the last, so at most ``length`` - 1 tokens are padding in all.
    Null and empty texts are the end id alone. Repeated rows are packed each;
    null ids stay null; very long texts go through many sequences; an empty
    table gives an empty result; other columns are not read.
    """
    return pieces(encoded(docs, text, id_col, vocabulary, end), length)


def sequences(coded: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, tokens): the sequences themselves, from :func:`encoded`'s table.

    Windows that lie in one stretch of rows come whole from it. The others leave
    boundary records, which alone are shuffled; the records of one window hold no
    more than ``length`` tokens together. ``tokens`` counts those that are not
    padding; a last sequence of 1, 2, 4, 8 ... tokens is not padded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = np.empty(0, "<u4"), 0  # tokens of an open window, and the stream's place behind them

        def made(parts: list[np.ndarray], places: list[int]) -> pa.RecordBatch:
            places = np.array(places, np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)), pa.array(np.concatenate(parts).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(places // length), pa.array(places % length), ids], names=["sequence_id", "offset", "ids"])

        for batch in batches:
            for own in blocks(batch, 1):
                flat, tokens, position = _arrays(own)
                first = np.flatnonzero(np.append(True, position[1:] != (position + tokens)[:-1]))  # where the stream jumps
                edges = np.append(first, len(tokens))
                begins = (tokens.cumsum() - tokens)[first].tolist() + [len(flat)]
                parts, places = [], []
                for k, (a, b) in enumerate(zip(begins, begins[1:], strict=False)):
                    run_ids, place = flat[a:b], int(position[edges[k]])
                    if len(held) and at != place:
                        parts.append(held)
                        places.append(at - len(held))
                        held = held[:0]
                    run_ids, place = np.concatenate([held, run_ids]), place - len(held)
                    cuts = np.arange(place - place % length + length, place + len(run_ids) + 1, length) - place
                    for x, y in zip(np.append(0, cuts).tolist(), cuts.tolist(), strict=False):
                        parts.append(run_ids[x:y])
                        places.append(place + x)
                    rest = int(cuts[-1]) if len(cuts) else 0
                    held, at = run_ids[rest:], place + len(run_ids)
                if parts:
                    yield made(parts, places)
        if len(held):
            yield made([held], [at - len(held)])

    cut = materialize(coded.select("doc_id", "ids", "tokens", "position").mapInArrow(run, "sequence_id long, offset long, ids array<int>"), "windows")
    whole = cut.where(F.size("ids") == length).select("sequence_id", "ids")
    bounds = cut.where(F.size("ids") < length).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("r"))
    joined = whole.unionByName(bounds.select("sequence_id", F.flatten(F.transform("r", lambda x: x["ids"])).alias("ids")))
    size = F.size("ids")
    full = F.when(F.bit_count(size) == 1, size).otherwise(length)
    return joined.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), full - size)).alias("ids"), size.alias("tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
