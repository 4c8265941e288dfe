"""Packing against the tokenizer library and one plain stream."""

import random
import zlib
from collections import namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_vocabulary())


def plain(library, texts):
    return [e.ids + [packing.END] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_library(library, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 4000)  # forgets now and then
    r = random.Random(1)
    letters = [*"abS's  \n\t\r\x0b\x1c\x85\xa0 é́ͅſKİΣσ½²٣中가ᄀ09_!?.😀‍﻿\x00", "<|endoftext|>", "'ll", "'RE", "<|startoftext|>", "<|", *"Àßÿ×÷ºÅ"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    encode, got = packing.Encoder(packing.default_vocabulary()), []
    for k in range(0, len(texts), 100):
        flat, count = encode(texts[k : k + 100])
        got += [x.tolist() for x in np.split(flat, count.cumsum()[:-1])]
    assert got == plain(library, texts)


def test_pieces_and_sequences(spark, library):
    r = random.Random(2)
    texts = [" ".join(r.choice(("lorem", "x9", "déjà", "a-b")) for _ in range(r.choice((0, 1, 5, 40)))) for _ in range(120)]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(7, texts[7], "x", 1)] * 2 + [(None, None, None, 2), (500, "word " * 900, "y", 3), (501, None, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part long").repartition(7)
    coded = packing.encoded(docs)
    Row = namedtuple("Row", "doc_id ids tokens position")
    stream = {x.position: Row(x.doc_id, np.frombuffer(x.ids, "<u2").tolist(), x.tokens, x.position) for x in coded.collect()}
    assert [p + stream[p].tokens for p in sorted(stream)][:-1] == sorted(stream)[1:] and min(stream) == 0
    key = lambda i, ids: (-1 if i is None else i, ids)
    assert sorted(key(x.doc_id, x.ids) for x in stream.values()) == sorted(key(i, ids) for (i, *_), ids in zip(rows, plain(library, [t for _, t, *_ in rows]), strict=True))
    whole = [i for p in sorted(stream) for i in stream[p].ids]
    for length in (16, 64, len(whole), len(whole) + 1):
        got = packing.pieces(coded, length).collect()
        assert sum(x.length for x in got) == len(whole)
        for x in got:
            at = x.sequence_id * length + x.offset
            ids = np.array(whole[at : at + x.length], "<u4")
            assert 0 <= x.offset and x.offset + x.length <= length and zlib.crc32(ids.tobytes()) == x.ids_crc32
            own = stream[at - x.start]
            assert own.doc_id == x.doc_id and own.tokens == x.doc_tokens and own.ids[x.start : x.start + x.length] == ids.tolist()
        made = {x.sequence_id: x for x in packing.sequences(coded, length, pad=9).collect()}
        assert sorted(made) == list(range(-(-len(whole) // length)))
        for s, x in made.items():
            own = whole[s * length : (s + 1) * length]
            assert x.tokens == len(own) and x.ids[: len(own)] == own
            assert len(x.ids) == (len(own) if len(own) & (len(own) - 1) == 0 else length) and set(x.ids[len(own) :]) <= {9}


def test_prefix_sums_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 4)
    totals = spark.createDataFrame([(k, k * k + 1) for k in (0, 1, 3, 4, 5, 11, 12, 40)], "part long, total long")
    got = {x.part: x.base for x in packing.prefix_sums(totals).collect()}
    want, seen = {}, 0
    for k in (0, 1, 3, 4, 5, 11, 12, 40):
        want[k] = seen
        seen += k * k + 1
    assert got == want


def test_empty_table_and_query(spark, library):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert packing.pack(none).count() == 0 and packing.sequences(packing.encoded(none)).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: ids for d, ids in zip(docs, plain(library, [d.text for d in docs]), strict=True)}
    got = QUERIES["op11_packing"](spark, SF)
    assert {c for c, t in got.dtypes if c != "doc_id"} == {"start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and {t for _, t in got.dtypes} == {"bigint"}
    rows = got.collect()
    for x in rows:
        ids = want[x.doc_id]
        assert x.doc_tokens == len(ids) and zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32
    assert sum(x.length for x in rows) == sum(map(len, want.values()))
    filled = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("o")).collect()
    assert sum(x.n < packing.LENGTH for x in filled) <= 1 and all(x.o == 0 for x in filled)
