"""The word-id cache of packing gives the library's ids through evictions and for odd strings."""

import struct
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import common, packing

TEXTS = ["É.É", "a<|endoftext|>b", "İstanbul ﬁ ét don't DON'T, 12,5 x's", "", "  \t\n ", "×÷ ªº µ ÿ. ß,", "The the THE, the. (the) the###", "x" * 200 + " y"]


def test_ids_through_evictions(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 8)
    words = packing.WordIds(public_tokenizers.path(packing.VOCABULARY))
    for text in TEXTS + [f"word{i} Same, other{i % 3}" for i in range(40)] + TEXTS:
        ids = words.tok.encode(text, add_special_tokens=False).ids
        assert words.ids(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_words_take_little_room():
    words = packing.WordIds(public_tokenizers.path(packing.VOCABULARY))
    words.ids("warm up")
    texts = [" ".join(f"{k:07d},".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(i, i + 20_000)) for i in range(0, 100_000, 20_000)]
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    try:
        for text in texts:
            words.ids(text)
        room = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    print(words.n, room)
    assert words.n > 200_000 and room < 120 * words.n


def test_each_end_id_is_its_own():
    words = packing.WordIds(public_tokenizers.path(packing.VOCABULARY))
    for end in (2, 5, 2):
        ids, n = words.some(pa.array(["a b", ""]), end)
        assert ids[-1] == end and ids[n[0] - 1] == end


@pytest.mark.parametrize(("own", "within"), [("10000", "1000"), ("0", "1000"), ("7", "7")])
def test_texts_go_to_python_in_small_batches(spark, own, within):
    before = spark.conf.get(common.BATCH_ROWS)
    spark.conf.set(common.BATCH_ROWS, own)
    try:
        with common.text_batches(spark):
            assert spark.conf.get(common.BATCH_ROWS) == within
            most = spark.range(3000, numPartitions=1).mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([len(x)])], ["n"]) for x in it), "n long").agg(F.max("n")).first()[0]
        assert most == int(within) and spark.conf.get(common.BATCH_ROWS) == own
    finally:
        spark.conf.set(common.BATCH_ROWS, before)
