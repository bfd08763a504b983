"""Packing: shortest-pack-first over the histogram of lengths, then patterns joined back to the pieces by rank."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_batches
from .token_counts import load_tokenizer

VOCABULARY, END_ID, LIMIT = "word_bpe_49k.json", 2, 4096
#: Words and ids in the table after which it starts anew.
CACHED_WORDS, CACHED_IDS = 1_000_000, 1 << 24
#: Bytes of text whose words are looked up together, and words merged in one call.
SPAN_BYTES, CALL_WORDS = 1 << 21, 4096
#: The name in the table that stands for the end of a text; no word, as words hold no blanks.
ENDING = " "
#: Pieces that the table's words may lie in before they are put together.
CHUNKS = 64
#: Lines that are words of ASCII and Latin-1 letters with punctuation after them: two pre-tokens, whatever the library's Unicode version.
PLAIN = re.compile(r"^([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%*&)\]]*)$", re.M)


class WordIds:
    """Ids of words, in one array of numbers that grows. The vocabulary drops white space and no pre-token reaches over a blank or line feed, so a text's ids are those of its words in turn.

    A word has a code, and a code a run of the array. Words of many texts are split, told apart and looked up together, so
    that the Python side sees each new word once. The table's words lie in Arrow arrays, in the order of their codes, and
    are held against the different words of the texts at hand, so that a word takes some dozens of bytes and no Python object.
    Memory is bounded: when the table has too many words or ids, it starts anew with the words of the texts at hand, so
    frequent words stay.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.tok = load_tokenizer(path)
        self.reset()
        blanks = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
        form |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blanks, as_bytes]}}
        self.merger = type(self.tok).from_str(json.dumps(form))
        vocab, suffix = self.tok.get_vocab(with_added_tokens=False), form["model"].get("end_of_word_suffix") or ""
        self.last = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        if suffix:
            self.last[[i for w, i in vocab.items() if w.endswith(suffix)]] = True

    def reset(self) -> None:
        self.words, self.endings = [pa.array([""])], {}
        self.pool, self.used = np.zeros(1 << 20, "<u4"), 0
        self.start, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 1

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New words with their ids in turn, so many each."""
        self.put(words, self.used + np.cumsum(sizes) - sizes, sizes)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def put(self, words: list[str], start: np.ndarray, size: np.ndarray) -> None:
        """New words whose ids the array already has."""
        while self.n + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.start[self.n : self.n + len(words)] = start
        self.size[self.n : self.n + len(words)] = size
        self.words.append(pa.array(words, pa.string()))
        self.n += len(words)

    def find(self, words: pa.Array, chunk: int = 0) -> np.ndarray:
        """The codes of different words, -1 for those that the table hasn't from this chunk on."""
        codes, before = np.full(len(words), -1, np.int64), sum(map(len, self.words[:chunk]))
        at = pc.index_in(pa.chunked_array(self.words[chunk:], pa.string()), value_set=words)
        codes[at.drop_null().to_numpy()] = before + np.flatnonzero(at.is_valid().to_numpy())
        return codes

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the codes in turn, how many each code has)."""
        start, size = self.start[codes], self.size[codes]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        return self.pool[np.repeat(start - upto + size, size) + np.arange(total)], size

    def merge(self, parts: list[str]) -> None:
        """Learn lower-case pre-tokens, merged many at a time: the token that ends one is marked in the vocabulary."""
        for k in range(0, len(parts), CALL_WORDS):
            some = parts[k : k + CALL_WORDS]
            ids = np.array(self.merger.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                self.add(some, ids, np.diff(ends, prepend=0))
            else:  # a vocabulary that marks no ends
                self.whole(some)

    def whole(self, words: list[str]) -> None:
        """Learn any words, by the library's full way."""
        for k in range(0, len(words), CALL_WORDS):
            some = words[k : k + CALL_WORDS]
            found = [e.ids for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
            self.add(some, np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)))

    def learn(self, words: pa.Array) -> np.ndarray:
        """Put new words into the table; their codes. A plain word is lower-cased and cut from its punctuation, as the library does, so that its forms are merged once."""
        chunk = len(self.words)
        plain = PLAIN.findall(pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py())
        stems = [s.lower() for s, _ in plain]
        parts = list(dict.fromkeys(chain(stems, (p for _, p in plain))))
        codes = self.find(pa.array(parts, pa.string()))
        new = codes < 0
        codes[new] = self.n + np.arange(new.sum())
        self.merge([parts[k] for k in np.flatnonzero(new)])
        code = dict(zip(parts, codes.tolist(), strict=True))
        forms = [(s + p, code[low], code[p]) for low, (s, p) in zip(stems, plain, strict=True) if p or s != low]
        bare = [x for x in forms if not x[2]]
        first = np.array([x[1] for x in bare], np.int64)
        self.put([x[0] for x in bare], self.start[first], self.size[first])
        cut = [x for x in forms if x[2]]
        ids, sizes = self.gather(np.array([x[1:] for x in cut], np.int64).ravel())
        self.add([x[0] for x in cut], ids, sizes.reshape(-1, 2).sum(axis=1))
        codes = self.find(words, chunk)
        if len(rest := np.flatnonzero(codes < 0)):
            codes[rest] = self.n + np.arange(len(rest))
            self.whole(words.take(pa.array(rest)).to_pylist())
        return codes

    def some(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts in turn, each followed by end_id if there is one; their numbers). At least one text."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        each = words.dictionary.cast(pa.string())
        if self.n + len(each) > CACHED_WORDS or self.used > CACHED_IDS:
            self.reset()
        if len(self.words) > CHUNKS:
            self.words = [pa.concat_arrays(self.words)]
        number = self.find(each)
        if len(new := np.flatnonzero(number < 0)):
            number[new] = self.learn(each.take(pa.array(new)))
        index = number[words.indices.to_numpy()]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if end_id is not None:
            if end_id not in self.endings:
                self.endings[end_id] = self.n
                self.add([ENDING], np.array([end_id], "<u4"), np.array([1]))
            index = np.insert(index, bounds[1:], self.endings[end_id])
            bounds = bounds + np.arange(len(bounds))
        ids, size = self.gather(index)
        upto = np.r_[0, np.cumsum(size)]
        return ids, np.diff(upto[bounds])

    def ids(self, text: str) -> bytes:
        """The ids of one text, as little-endian unsigned 32-bit numbers."""
        return b"".join(ids.tobytes() for ids, _ in self.spans(pa.array([text])))

    def spans(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """some() of so many texts at a time that the arrays stay small; a text that is longer by itself is read in spans that end at blanks and comes alone."""
        size = np.maximum(pc.binary_length(texts).to_numpy(zero_copy_only=False), 1)
        upto, at = np.cumsum(size), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SPAN_BYTES, "right")))
            if size[at] <= SPAN_BYTES:
                yield self.some(texts[at:to], end_id)
            else:
                to = at + 1
                found = [self.some(pa.array([part]))[0] for part in self.cut(texts[at].as_py())] + ([] if end_id is None else [np.array([end_id], "<u4")])
                yield np.concatenate(found), np.array([sum(map(len, found))])
            at = to

    def cut(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SPAN_BYTES:
            cut = max(text.rfind(" ", at, at + SPAN_BYTES), text.rfind("\n", at, at + SPAN_BYTES))
            if cut <= at:
                ends = [k for k in (text.find(" ", at + SPAN_BYTES), text.find("\n", at + SPAN_BYTES)) if k >= 0]
                cut = min(ends, default=len(text))
            yield text[at:cut]
            at = cut + 1
        yield text[at:]


_words: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids binary, doc_tokens): the ids of every text and end_id, cut into pieces of limit ids and a rest.

    A null or empty text has end_id alone. Each row of docs is cut by itself, rows with an equal or null id too. Texts are
    read in spans of SPAN_BYTES, so a very long one takes its ids' room and a span's, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = WordIds(path)
        for x in batches:
            done = 0
            for ids, n in _words[path].spans(x.column("text"), end_id):
                pieces = -(-n // limit)
                row = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * limit
                length = np.minimum(limit, n[row] - start)
                ends = pa.py_buffer(np.r_[0, np.cumsum(length) * 4].astype(np.int32))
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                own = x.column("id").slice(done, len(n)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([own, pa.array(start), pa.array(length), data, pa.array(n[row])], ["id", "start", "length", "ids", "doc_tokens"])
                done += len(n)

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long")


def packing_patterns(histogram: dict[int, int], limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packs: lengths are placed longest first, each into the open packs with the most room left.

    If none has room, new packs are opened in bulk, each filled with as many pieces of the length as it holds: that is where
    the pieces would go one by one, as the pack just opened is then the only one with room.
    Packs with the same room and contents are one entry with a count, so the work depends on limit and on the number of
    different lengths, not on the number of documents.
    """
    import heapq

    open_packs: dict[int, list[list]] = {limit: []}
    heap: list[int] = []

    def put(count: int, lengths: tuple[int, ...], room: int) -> None:
        if not open_packs.get(room):
            open_packs[room] = []
            heapq.heappush(heap, -room)
        open_packs[room].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not open_packs.get(-heap[0]):
                heapq.heappop(heap)
            room = -heap[0] if heap else 0
            if room < length:
                each = limit // length
                for count, n in ((left // each, each), (1, left % each)):
                    if count and n:
                        put(count, (length,) * n, limit - n * length)
                break
            pack = open_packs[room][-1]
            take = min(left, pack[0])
            pack[0] -= take
            if not pack[0]:
                open_packs[room].pop()
            put(take, (*pack[1], length), room - length)
            left -= take
    return [(count, lengths) for packs in open_packs.values() for count, lengths in packs if count]


def pattern_slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, sequence_from, offset): which ranks among the pieces of a length go where."""
    ranks: dict[int, int] = {}
    slots, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            r = ranks.get(n, 0)
            slots.append((n, r, r + count, sequence, offset))
            ranks[n] = r + count
            offset += n
        sequence += count
    return slots


def pack(pieces: DataFrame, limit: int = LIMIT, length_col: str = "length", order_cols: tuple[str, ...] = ("id", "start"), salts: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset (long): sequences of limit tokens at most, each filled from offset 0 without gaps.

    pieces should be a written table: it is read twice. length_col must lie in 1..limit (rows with a null, zero or longer
    length get a null place). The driver sees the histogram of lengths, limit rows at most, and the slots that follow from
    it. Pieces of one length are ranked in salts by a hash of order_cols, whose sizes give each salt its first rank, so
    a very common length is spread over tasks; ties in order_cols are ranked in any order, each has its own place.
    Columns of pieces named sequence_id or offset are replaced; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    fits = F.col(length_col).between(1, limit)
    histogram = {r[0]: r[1] for r in pieces.where(fits).groupBy(F.col(length_col).cast("long")).count().collect()}
    slots = pattern_slots(packing_patterns(histogram, limit))
    salts = salts or max(64, sum(histogram.values()) // 100_000)
    table = spark.createDataFrame(pd.DataFrame(slots or [(0, 0, 0, 0, 0)], columns=["n", "rank_from", "rank_to", "sequence_from", "at"]), "n long, rank_from long, rank_to long, sequence_from long, at long")
    salted = pieces.withColumns({"__n": F.col(length_col).cast("long"), "__salt": F.pmod(F.xxhash64(*order_cols), F.lit(salts))})
    sizes = salted.where(fits).groupBy("__n", "__salt").agg(F.count("*").alias("size"))
    first = F.sum("size").over(Window.partitionBy("__n").orderBy("__salt")) - F.col("size")
    chunks = sizes.withColumn("base", first).select(F.col("__n").alias("n"), F.col("__salt").alias("salt"), "base", "size")
    parts = chunks.join(table, "n").where("base < rank_to AND base + size > rank_from").select("n", "salt", (F.col("rank_from") - F.col("base")).alias("low"), (F.col("rank_to") - F.col("base")).alias("high"), "sequence_from", "at")
    ranked = salted.withColumn("__r", F.row_number().over(Window.partitionBy("__n", "__salt").orderBy(*order_cols)) - 1)
    placed = ranked.join(parts, (F.col("__n") == F.col("n")) & (F.col("__salt") == F.col("salt")) & (F.col("__r") >= F.col("low")) & (F.col("__r") < F.col("high")), "left")
    return placed.select(*pieces.columns, (F.col("sequence_from") + F.col("__r") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, written; places of the pieces by (id, start) with a checksum of the ids) of docs."""
    with text_batches(docs.sparkSession):
        pieces = materialize(token_pieces(docs, path, limit, end_id))
    return pieces, pack(pieces.select("id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), limit)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, n_tokens): the packed sequences themselves, one row each, limit ids at most."""
    both = pieces.select("id", "start", "ids").join(places.select("id", "start", "length", "sequence_id", "offset"), ["id", "start"])
    rows = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return both.groupBy("sequence_id").agg(rows.alias("parts"), F.sum("length").alias("n_tokens")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), "n_tokens")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    _, places = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return places.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op1_packing": op1_packing}
