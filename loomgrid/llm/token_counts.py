"""Exact token counts of a byte-level BPE, with a shortcut for pre-tokens that are proven to be one token."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: How a byte-level BPE of this family splits text before merging: a fixed value of the format.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_CHARS, CACHED_WORDS = 48, 300_000


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 characters stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven_whole_tokens(path: str) -> list[str]:
    """The vocabulary's strings that the library encodes, standing alone, as exactly their own one token.

    Strings that are not whole UTF-8 or that the pre-token split would cut are left out, so for each of the rest a
    pre-token equal to it counts one. The number of strings is bounded by the vocabulary.
    """
    import regex

    tok, stand = load_tokenizer(path), byte_alphabet()
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    split, found = regex.compile(PRE_TOKENS), []
    for piece, i in sorted(tok.get_vocab(with_added_tokens=False).items()):
        try:
            text = bytes(stand[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if text not in special and (m := split.match(text)) and m.end() == len(text):
            found.append((text, i))
    out = []
    for k in range(0, len(found), 4096):
        part = found[k : k + 4096]
        out += [t for (t, i), e in zip(part, tok.encode_batch([t for t, _ in part], add_special_tokens=False), strict=True) if e.ids == [i]]
    return out


class Counter(dict):
    """Token counts by run: a run is white space and the word after it. -1 marks a run that can't stand on its own.

    A text is cut where a single blank or line feed follows a character that isn't white space. No pre-token reaches
    over such a place, so counts of the runs add up. Memory is bounded: long runs are not kept, a full table is emptied.
    """

    def __init__(self, path: str, whole: list[str]):
        import regex

        self.tok, self.whole = load_tokenizer(path), frozenset(whole)
        self.split = regex.compile(PRE_TOKENS)
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())

    def merged(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def run(self, run: str) -> int:
        if run[-1:].isspace() or not run:
            return -1
        if any(s in run for s in self.special):
            return self.merged(run)
        n = 0
        for piece in self.split.findall(run):
            n += 1 if piece in self.whole else self.merged(piece)
        return n

    def __missing__(self, part: str) -> int:
        n = self.run(part if part[:1] == "\n" else " " + part)
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[part] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = text.replace("\n", " \n").split(" ")
        counts = list(map(self.__getitem__, rest))
        head = 0 if not first else self.run(first)
        if head < 0 or -1 in counts:
            return self.whole_text(text)
        return head + sum(counts)

    def whole_text(self, text: str) -> int:
        """The same without runs, for texts with white space that stands together; special strings are cut out first, as the library does."""
        if any(s in text for s in self.special):
            return self.merged(text)
        n = 0
        for piece in self.split.findall(text):
            n += 1 if piece in self.whole else self.merged(piece)
        return n


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_bytes and n_tokens (long) of the whole text; a null or empty text has none of either.

    Columns of docs with these names are replaced, all others pass through; rows are judged one by one, so repeats and an
    empty table need no care. There is no shuffle. The proof runs once on the driver and is sent out with the function
    (bounded by the vocabulary); path must be readable on every executor, as an installed package is.
    """
    docs = docs.drop("n_bytes", "n_tokens")
    shared = docs.sparkSession.sparkContext.broadcast(proven_whole_tokens(path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _counters:
            _counters[path] = Counter(path, shared.value)
        counter = _counters[path]
        for texts in batches:
            yield pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": counted(text)})


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op2_token_counts": op2_token_counts}
