"""Token counts: every distinct pre-token is split into pieces once, its count is joined to the documents' pre-tokens.

A text is cut where the tokenizer's own normalization and pre-tokenization never look across: at ASCII white space, between
letters and ASCII punctuation, and around digits. So a text's ids are its pre-tokens' ids in order. A task gathers the distinct pre-tokens of a
slice of rows, splits those that it has not met before, and joins the counts back through their codes. The frequencies
of a document never leave the task: shuffling (document, pre-token) pairs would move several times the input.
"""
from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattlens.llm.arrow_text import LOWER, REMEMBERED, SPACE, U64, add_columns, flat, span_hashes

KNOWN_PRETOKENS = 800_000  # distinct pre-tokens a worker remembers; beyond that it starts anew, results stay the same
LEARNED_AT_ONCE = 4_000  # pre-tokens; the tokenizer's answers hold much more than the ids
TOKEN_LIMIT = 2048
OWNER = "tokens"
LETTER, DIGIT, POINT, OTHER = 1, 2, 3, 0  # classes of bytes; OTHER never is cut from a neighbour
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = POINT
CUT = np.array([[a and b and (a != b or a == DIGIT) for b in range(4)] for a in range(4)], bool)


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and text indexes of the pre-tokens, and the bytes of each text.

    An apostrophe and the signs of special tokens stay with their neighbours, as do characters beyond Latin-1 letters.
    Pre-tokens of letters alone are lower-cased here (the tokenizers' normalization does it anyway), so that
    fewer are distinct.
    """
    data, offsets = flat(texts)
    size = np.diff(offsets)
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, none, size
    kind = CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]  # letters from U+00C0 to U+00FF
    kind[lead] = kind[lead + 1] = LETTER
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | CUT[kind[:-1], kind[1:]]
    firsts = offsets[:-1][size > 0]
    begins[firsts] = inside[firsts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | begins[1:]
    closes[firsts[1:] - 1] = inside[firsts[1:] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    odd = np.concatenate([[0], np.cumsum((kind == OTHER) & inside)])
    plain = np.repeat(odd[ends] == odd[starts], ends - starts)
    where = np.flatnonzero(inside)[plain]
    data = data.copy()
    data[where] = LOWER[data[where]]
    return data, starts, ends, np.searchsorted(offsets[:-1], starts, "right") - 1, size


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Pieces:
    """Ids of pre-tokens, remembered by hash: `pool` holds all ids, `start` and `count` the place of each pre-token. The sorted
    `keys` and the number of each pre-token, `number`, are arrays: a dictionary of Python integers takes ten times their memory."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.clear()

    def clear(self) -> None:
        self.keys, self.number = np.zeros(0, U64), np.zeros(0, np.int32)
        self.known = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.filled = 0

    def learn(self, texts: list[str]) -> None:
        """Ids of pre-tokens that take the next numbers."""
        encoded = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        known, sizes = self.known, np.fromiter(map(len, encoded), np.int64, len(encoded))
        total = int(sizes.sum())
        for name, need in (("pool", self.filled + total), ("start", known + len(texts)), ("count", known + len(texts))):
            array = getattr(self, name)
            if need > len(array):
                setattr(self, name, np.concatenate([array, np.zeros(max(need, len(array)), array.dtype)]))
        self.pool[self.filled:self.filled + total] = np.fromiter((i for ids in encoded for i in ids), np.uint32, total)
        self.start[known:known + len(texts)] = self.filled + np.cumsum(sizes) - sizes
        self.count[known:known + len(texts)] = sizes
        self.filled += total
        self.known += len(texts)

    def codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each pre-token among the remembered ones; new ones are split into pieces here, once."""
        distinct, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.known + len(distinct) > KNOWN_PRETOKENS:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        old = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == distinct[inside]
        new = np.flatnonzero(~old)
        numbers = np.empty(len(distinct), np.int32)
        numbers[old] = self.number[at[old]]
        numbers[new] = np.arange(self.known, self.known + len(new))
        begins, closes, raw = starts[first[new]].tolist(), ends[first[new]].tolist(), data.tobytes()
        for low in range(0, len(new), LEARNED_AT_ONCE):
            high = low + LEARNED_AT_ONCE
            self.learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(begins[low:high], closes[low:high])])
        self.keys = np.insert(self.keys, at[new], distinct[new])
        self.number = np.insert(self.number, at[new], numbers[new])
        return numbers[inverse]

    def count_tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        data, starts, ends, doc, size = pre_tokens(texts)
        if not len(starts):
            return size, np.zeros(len(texts), np.int64)
        codes = self.codes(data, starts, ends)  # may grow self.count
        return size, np.bincount(doc, self.count[codes], len(texts)).astype(np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        data, starts, ends, doc, _ = pre_tokens(texts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        codes = self.codes(data, starts, ends)
        sizes = self.count[codes]
        ahead = np.cumsum(sizes) - sizes
        where = np.repeat(self.start[codes] - ahead, sizes) + np.arange(int(sizes.sum()))
        return self.pool[where], np.bincount(doc, sizes, len(texts)).astype(np.int64)


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """One per Python worker."""
    return Pieces(path)


REMEMBERED[OWNER] = pieces.cache_clear


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """Add `n_bytes` (UTF-8) and `n_tokens` of the whole text, as the tokenizer's library counts them.

    No begin, end or added tokens; strings of special tokens inside a text count as the library's default has it. A
    null or empty text has 0 bytes and 0 tokens. Equal and repeated rows keep their own rows; an empty table gives
    an empty table. `keep` limits the input columns that stay; one called n_bytes or n_tokens is replaced.
    """
    path = tokenizer or default_tokenizer()

    def setup():
        own = pieces(path)
        return lambda texts: list(own.count_tokens(texts))

    return add_columns(docs, text_col, "n_bytes bigint, n_tokens bigint", None, keep, setup, OWNER)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = token_counts(docs, keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
