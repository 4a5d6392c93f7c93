"""Byte-pair encoding with a priority queue of merge ranks over a doubly linked list of symbols.

The merges and the vocabulary come from a tokenizer file whose path is a parameter. Texts are normalised and cut
into words as the file says; each distinct word is merged once and then kept in a table of bounded size.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import kept, released, slices

#: Words whose ids are kept; the table is emptied when it is full.
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class _Words(dict):
    """Ids of words already merged, in two generations: when the younger is full it becomes the older."""

    def __init__(self, merge):
        self.merge, self.old = merge, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = self.merge(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordBPE:
    """Encoder and decoder of one tokenizer file with NFC, white-space and lower-case normalisation, a word pattern
    and an end-of-word suffix."""

    #: Characters on whose class and lower case all Unicode versions agree; texts with others go through the
    #: library's own normaliser and splitter before they are merged here.
    COMMON = re.compile("[\x00-\x1b\x20-\x84\x86-\u024f\u0391-\u03a9\u03b1-\u03c9\u0400-\u045f\u2010-\u2027\u20ac]*")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        #: (left id << 20 | right id) to (rank << 32, id of the merged symbol)
        self.pairs = {vocab[a] << 20 | vocab[b]: (k << 32, vocab[a + b]) for k, (a, b) in enumerate(model["merges"])}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        self.byte = {s: b for b, s in enumerate(symbols)}
        self.path, self.library = path, None
        self.cache = _Words(lambda w: self.merge(w.encode("utf-8")))

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word.

        Symbols form a doubly linked list. The queue holds rank and position of neighbours that merge; an entry is stale,
        and is skipped, when its left symbol is gone or the pair there has another rank by now.
        """
        n = len(word)
        ids = [self.first[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if n == 1:
            return tuple(ids)
        pairs = self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [r[0] | i for i in range(n - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            a, j = ids[i], after[i]
            if a < 0 or j == n or not (r := pairs.get(a << 20 | ids[j])) or r[0] | i != entry:
                continue
            ids[i] = a = r[1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := pairs.get(a << 20 | ids[k]):
                    heapq.heappush(queue, r[0] | i)
            h = before[i]
            if h >= 0 and (r := pairs.get(ids[h] << 20 | a)):
                heapq.heappush(queue, r[0] | h)
        return tuple([x for x in ids if x >= 0])

    def words(self, text: str) -> list[str]:
        """Normalised words: NFC, characters in lower case one by one. White space only parts words."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = text.lower()
        if "\u03a3" in text:  # str.lower() looks at a sigma's neighbours
            low = "".join("\u03c3" if c == "\u03a3" else c.lower() for c in text)
        return self.pattern.findall(low)

    def library_words(self, text: str) -> list[bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in found]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special_pattern.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            elif self.COMMON.fullmatch(part):
                out += chain.from_iterable(map(self.cache.__getitem__, self.words(part)))
            else:
                out += chain.from_iterable(map(self.merge_long, self.library_words(part)))
        return out

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        return self.cache[word.decode("utf-8")]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings one after another; a file without a decoder has them parted by spaces."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(4)
def load(path: str) -> WordBPE:
    return WordBPE(path)


kept("bpe", load.cache_clear)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the tokens of the whole text by the file at ``path``; null counts as empty.

    Row by row: repeated rows, nulls elsewhere and empty tables pass through. A column ``ids`` is replaced.
    """
    docs = docs.drop("ids")
    names = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for batch in slices(whole, text):
                ids = pa.array([bpe.encode(t or "") for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*names, "ids"])

    return docs.mapInArrow(released(kernel, "bpe"), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of ``ids``; null or no ids give an empty text. A column ``decoded`` is replaced."""
    docs = docs.drop("decoded")
    names = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(ids)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
                flat = column.flatten().to_numpy(zero_copy_only=False).tolist()  # several times as fast as lists of Arrow's own
                texts = pa.array([bpe.decode(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*names, "decoded"])

    return docs.mapInArrow(released(kernel, "bpe"), T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())]))
