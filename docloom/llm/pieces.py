"""SentencePiece byte-pair encoding and decoding in vectorised merge rounds.

A text's symbols lie in flat numpy arrays. Each round finds the best pair of
every word (segmented minimum of pair ranks), merges its leftmost, not
overlapping occurrences at once and compacts the arrays, until no word has a
pair left. Words are the stretches that no piece crosses; equal words are merged
once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import add_columns
from docloom.llm.common import text_of

SPACE = "\u2581"
NONE = np.int32(2**31 - 1)
#: Words whose ids a task remembers; beyond that it starts anew.
REMEMBERED = 200_000


def default_model() -> str:
    """The public 32k BPE model of this installation."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, pair ranks and byte pieces of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a BPE model without text normalisation is needed")
        kind = proto.SentencePiece if hasattr(proto, "SentencePiece") else pb.ModelProto.SentencePiece
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        pieces = [p.piece for p in proto.pieces]
        self.n = len(pieces)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.byte_id = np.full(256, -1, np.int32)
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
        surface = []
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                surface.append(bytes([value]))
            elif p.type == kind.UNKNOWN:
                surface.append(" \u2047 ".encode())
            else:
                surface.append(p.piece.replace(SPACE, " ").encode() if p.type != kind.CONTROL else b"")
        self.is_byte = np.zeros(self.n, bool)
        self.is_byte[self.byte_id[self.byte_id >= 0]] = True
        self.starts_space = np.array([s.startswith(SPACE) for s in pieces])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.width = np.array([len(s) for s in surface], np.int64)
        self.offset = np.concatenate([[0], self.width.cumsum()])[:-1]
        # A character has its piece's id, or n + code point where it has none.
        chars = {c for s in normal for c in s}
        self.inside = {c for s in normal if len(s) > 1 for c in s}
        self.char = np.arange(self.n, self.n + 0x110000, dtype=np.int32)
        for c in chars & normal.keys():
            self.char[ord(c)] = normal[c]
        symbol = lambda s: normal[s] if s in normal else (self.n + ord(s) if len(s) == 1 else None)
        order = {x: r for r, x in enumerate(sorted({-proto.pieces[i].score for i in normal.values()}))}
        keys, ranks, made = [], [], []
        for s, i in normal.items():
            for k in range(1, len(s)):
                a, b = symbol(s[:k]), symbol(s[k:])
                if a is not None and b is not None:
                    keys.append((a << 21) | b)
                    ranks.append(order[-proto.pieces[i].score])
                    made.append(i)
        self._table(np.array(keys, np.int64), np.array(ranks, np.int32), np.array(made, np.int32))
        apart = "".join(c for c in "\n\t\r" if c not in self.inside)
        self.words = re.compile(f"{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+|[{apart}]" if apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        if any(SPACE in s.lstrip(SPACE) for s in normal):
            raise ValueError("a piece crosses a word's start")

    def _table(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """An open hash table of pairs, probed with whole arrays at once."""
        self.bits = max(10, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.made = np.zeros(size, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]] = keys[left[first]]
            self.rank[slot[first]] = ranks[left[first]]
            self.made[slot[first]] = made[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair (NONE where the vocabulary has none)."""
        key = (a.astype(np.int64) << 21) | b
        slot = self._slot(key)
        found = self.keys[slot]
        rank, made = self.rank[slot], self.made[slot]
        miss = found != key
        rank[miss] = NONE
        todo = np.flatnonzero(miss & (found >= 0))
        while len(todo):
            slot = (slot[todo] if len(slot) == len(key) else slot) + 1
            slot &= len(self.keys) - 1
            found = self.keys[slot]
            hit = found == key[todo]
            rank[todo[hit]] = self.rank[slot[hit]]
            made[todo[hit]] = self.made[slot[hit]]
            more = ~hit & (found >= 0)
            todo, slot = todo[more], slot[more]
            if len(todo) == len(key):
                break
        return rank, made


def _leftmost(cand: np.ndarray) -> np.ndarray:
    """Of each run of overlapping candidates the first, third, ... position."""
    at = np.flatnonzero(cand)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    run = np.arange(len(at)) - np.flatnonzero(new)[new.cumsum() - 1]
    return at[run % 2 == 0]


def merge_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, number of ids of each word)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    word = np.repeat(np.arange(len(words), dtype=np.int64), size)
    sym = v.char[flat]
    done_sym, done_word = [], []

    def ranked(s, w):
        rank, made = np.full(len(s), NONE, np.int32), np.zeros(len(s), np.int32)
        if len(s) > 1:
            rank[:-1], made[:-1] = v.pairs(s[:-1], s[1:])
            rank[:-1][w[1:] != w[:-1]] = NONE
        return rank, made

    rank, made = ranked(sym, word)
    while len(sym):
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        length = np.diff(np.append(start, len(sym)))
        best = np.minimum.reduceat(rank, start)
        over = np.repeat(best == NONE, length)
        if over.any():  # compaction: finished words leave
            done_sym.append(sym[over])
            done_word.append(word[over])
            stay = ~over
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            length, best = length[best != NONE], best[best != NONE]
            if not len(sym):
                break
        low = np.repeat(best, length)
        at = _leftmost(rank == low)

        def merged(at):
            s, gone = sym.copy(), np.zeros(len(sym), bool)
            s[at] = made[at]
            gone[at + 1] = True
            stay = ~gone
            near = np.zeros(len(sym), bool)
            near[at] = True
            new_s, new_w, new_r, new_m, new_near = s[stay], word[stay], rank[stay], made[stay], near[stay]
            touch = new_near.copy()
            touch[:-1] |= new_near[1:]
            t = np.flatnonzero(touch)
            last = t == len(new_s) - 1
            t = t[~last]
            if last.any():
                new_r[-1] = NONE
            r, m = v.pairs(new_s[t], new_s[t + 1])
            r[new_w[t] != new_w[t + 1]] = NONE
            new_r[t], new_m[t] = r, m
            return new_s, new_w, new_r, new_m, t, low[stay]

        out = merged(at)
        t, below = out[4], out[5]
        # A pair made by a merge may come before the word's other merges: then only its leftmost is done now.
        early = np.unique(out[1][t][out[2][t] <= below[t]])
        if len(early):
            first = np.ones(len(at), bool)
            first[1:] = word[at][1:] != word[at][:-1]
            held = np.isin(word[at], early) & ~first
            if held.any():
                out = merged(at[~held])
        sym, word, rank, made = out[:4]
    sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
    word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    sym, word = sym[order], word[order]
    alone = np.flatnonzero(sym >= v.n)
    if len(alone):  # characters outside the vocabulary become their UTF-8 bytes
        chars = [chr(c - v.n).encode() for c in sym[alone].tolist()]
        fallback = (v.byte_id >= 0).all()
        times = np.ones(len(sym), np.int64)
        times[alone] = [len(c) for c in chars] if fallback else 1
        ends = times.cumsum()
        wide = np.repeat(sym, times)
        word = np.repeat(word, times)
        if fallback:
            mark = np.repeat(sym >= v.n, times)
            wide[mark] = v.byte_id[np.frombuffer(b"".join(chars), np.uint8)]
        else:
            wide[ends[alone] - 1] = v.unknown
        sym = wide
    return sym, np.bincount(word, minlength=len(words)).astype(np.int64)


class Encoder:
    """Encodes blocks of texts; remembers a bounded number of words."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text)."""
        v, words, per = self.v, [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                found = v.words(v.prefix + t.replace(" ", SPACE))
                per[k] = len(found)
                words += found
        if len(self.index) > REMEMBERED:
            self.forget()
        new = [w for w in set(words) if w not in self.index]
        if new:
            ids, count = merge_words(new, v)
            self.start = np.concatenate([self.start, len(self.ids) + count.cumsum() - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        ends = count.cumsum()
        flat = self.ids[np.repeat(self.start[at] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bound = np.concatenate([[0], ends])[np.concatenate([[0], per.cumsum()])]
        return flat, np.diff(bound)


def _slow(ids: list[int], v: Vocabulary) -> str:
    """A text whose byte pieces are not UTF-8: each stray byte is U+FFFD, as the library has it."""
    out, run = [], b""

    def flush(run: bytes) -> str:
        made, k = "", 0
        while k < len(run):
            for n in (1, 2, 3, 4):
                try:
                    made += run[k : k + n].decode()
                    break
                except UnicodeDecodeError:
                    continue
            else:
                made, n = made + "\ufffd", 1
            k += n
        return made

    for i in ids:
        piece = v.surface[v.offset[i] : v.offset[i] + v.width[i]].tobytes()
        if v.is_byte[i]:
            run += piece
            continue
        out += [flush(run), piece.decode()]
        run = b""
    text = "".join([*out, flush(run)])
    first = _first(np.array(ids), v)
    return text[1:] if v.prefix and first is not None and v.starts_space[first] else text


def _first(ids: np.ndarray, v: Vocabulary) -> int | None:
    """The first id that is not a control piece."""
    if len(ids) and v.width[ids[0]]:
        return ids[0]
    seen = np.flatnonzero(v.width[ids])
    return ids[seen[0]] if len(seen) else None


def decode_flat(ids: np.ndarray, count: np.ndarray, v: Vocabulary) -> list[str]:
    """The text of each stretch of ``count`` ids."""
    width = v.width[ids]
    ends = width.cumsum()
    total = int(ends[-1]) if len(ends) else 0
    data = v.surface[np.repeat(v.offset[ids] - (ends - width), width) + np.arange(total)].tobytes()
    edge = np.concatenate([[0], ends])[np.concatenate([[0], count.cumsum()])]
    begin = np.concatenate([[0], count.cumsum()])
    out = []
    for k in range(len(count)):
        a, b = int(edge[k]), int(edge[k + 1])
        first = _first(ids[begin[k] : begin[k + 1]], v)
        if v.prefix and first is not None and v.starts_space[first]:
            a += 1
        try:
            out.append(data[a:b].decode())
        except UnicodeDecodeError:
            out.append(_slow(ids[begin[k] : begin[k + 1]].tolist(), v))
    return out


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``ids array<int>``: the pieces of each whole text.

    As the library encodes, without begin or end ids and without sampling. Null
    and empty texts have no ids. Equal texts have equal ids; an empty table
    gives an empty table. A column named as ``ids`` is replaced.
    """
    path = model or default_model()

    def make(values, encoder):
        flat, count = encoder(values.fill_null("").to_pylist())
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], count.cumsum()]).astype(np.int32)), pa.array(flat.astype(np.int32)))]

    return add_columns(df.withColumn(text, text_of(text)), text, f"`{ids}` array<int>", make, keep, lambda: Encoder(path))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the text that ``ids`` stand for.

    Null and empty lists give the empty text; byte pieces that are not UTF-8
    give U+FFFD. A column named as ``text`` is replaced.
    """
    path = model or default_model()

    def make(values, v):
        values = values.cast(pa.list_(pa.int32()))
        count = pa.compute.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = values.flatten().to_numpy(zero_copy_only=False)
        return [pa.array(decode_flat(flat, count, v), pa.string())]

    return add_columns(df, ids, f"`{text}` string", make, keep, lambda: Vocabulary(path))


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with what :func:`encode` gives of each text and :func:`decode` of that, both by one worker a task.

    Nulls, empty and repeated texts, empty tables and columns of these names are as there.
    """
    path = model or default_model()

    def make(values, encoder):
        flat, count = encoder(values.fill_null("").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], count.cumsum()]).astype(np.int32)), pa.array(flat.astype(np.int32)))
        return [lists, pa.array(decode_flat(flat, count, encoder.v), pa.string())]

    return add_columns(df.withColumn(text, text_of(text)), text, f"`{ids}` array<int>, `{decoded}` string", make, keep, lambda: Encoder(path))


def query(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode(encode(docs.select("doc_id", "text"), keep=["doc_id"]))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
