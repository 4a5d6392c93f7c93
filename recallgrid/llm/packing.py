"""Packing of tokenised documents into windows by order-preserving dynamic programming.

Documents follow each other as a partition has them, so nothing is shuffled. A partition is worked through in stretches of about
``STRETCH`` tokens. In a stretch a window may end at the end of a document, at the end of a sentence, or, where those are
far apart, at fill points in between. The ends are chosen to minimise padding plus penalties for cut documents:

    cost(j) = min over i, 0 < j - i <= length, of cost(i) + (length - (j - i)) + penalty(j)

As length - (j - i) = (i) + (length - j), the best i is the least of cost(i) + i in a sliding range, which a monotone
queue keeps. The last window of a stretch opens the next one; the last of a partition is split at powers of two, which
need no padding, where that costs less than its padding.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import binary_array, kept, released, slices

#: Tokens that a cut at the end of a sentence, and one elsewhere, count like.
SENTENCE_PENALTY, CUT_PENALTY = 4, 48
#: Tokens without an end of a sentence after which windows may end anyway.
FILL_EVERY = 128
STRETCH = 1 << 19


class Encoder:
    """Token ids of whole texts by a byte-level rank file; ``end`` follows each document."""

    def __init__(self, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...], end: int):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        self.end = end
        closes = np.zeros(max([*ranks.values(), *(i for _, i in special), end]) + 1, bool)
        for token, i in ranks.items():
            closes[i] = token.rstrip(b"\"')]} ")[-1:] in (b".", b"!", b"?") or b"\n" in token
        closes[end] = True
        self.closes = closes

    def __call__(self, text: str) -> np.ndarray:
        ids = self.inner.encode_to_numpy(text, allowed_special="all")
        return np.append(ids, np.uint32(self.end)).astype(np.uint32, copy=False)


@lru_cache(2)
def encoder(ranks_path: str, pattern: str, special: tuple, end: int) -> Encoder:
    return Encoder(ranks_path, pattern, special, end)


kept("packing", encoder.cache_clear)


def candidates(sentence_ends: np.ndarray, document_ends: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, ascending and ``total`` last, and the penalty of each. Gaps are ``FILL_EVERY`` at most."""
    known = np.unique(np.concatenate([sentence_ends, document_ends, [total]]))
    known = known[known > 0]
    starts = np.concatenate([[0], known[:-1]])
    more = (known - starts - 1) // FILL_EVERY
    fills = np.repeat(starts, more) + (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1) * FILL_EVERY
    where = np.concatenate([known, fills])
    penalty = np.full(len(where), CUT_PENALTY)
    penalty[: len(known)] = SENTENCE_PENALTY
    penalty[: len(known)][np.isin(known, document_ends)] = 0
    order = np.argsort(where, kind="stable")
    return where[order], penalty[order]


def window_ends(where: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """The ends of the cheapest windows; of equal costs the longer window."""
    at = [0, *where.tolist()]
    extra = [0, *penalty.tolist()]
    cost, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost(i) + i, index of i), values ascending
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - length:
            queue.popleft()
        value, i = queue[0]
        c = value + length - here + extra[j]
        cost[j], back[j] = c, i
        value = c + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    ends, j = [], len(at) - 1
    while j:
        ends.append(at[j])
        j = back[j]
    return ends[::-1]


def tail_lengths(left: int, length: int) -> list[int]:
    """How the last ``left`` tokens are split: powers of two, which take no padding, then what is padded."""
    if left <= 0:
        return []
    power = 1 << (left.bit_length() - 1)
    if power == left:
        return [left]
    rest = tail_lengths(left - power, length)

    def padding(parts):
        return sum(0 if p & (p - 1) == 0 else length - p for p in parts)

    return [power, *rest] if padding(rest) + CUT_PENALTY * len(rest) < length - left else [left]


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = (), end: int = 1, length: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens.

    A document is the tokens of its whole text (null: empty) and ``end``; each of its tokens is in exactly one piece. Columns:
    the id, ``start`` (tokens of the document before the piece), ``length``, ``doc_tokens``, ``sequence_id``, ``offset``
    (place in the sequence) and ``ids`` (binary, unsigned 32-bit little-endian). Sequence ids are those of a partition
    (high 31 bits) and count up in it; they depend on how the input is partitioned. Repeated rows and null ids are packed
    like others; an empty table gives no rows.
    """
    fields = [docs.schema[doc_id], *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern, special, end)
        first_sequence = TaskContext.get().partitionId() << 32
        made = 0
        names, tokens, before = [], [], []  # the open stretch: ids, tokens left, tokens of the document before them
        totals = []
        held = 0
        id_type = None

        def emit(last: bool) -> pa.RecordBatch | None:
            nonlocal names, tokens, before, totals, held, made
            stream = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
            sizes = np.array([len(t) for t in tokens], np.int64)
            doc_ends = np.cumsum(sizes)
            if not len(stream):
                return None
            where, penalty = candidates(np.flatnonzero(encode.closes[stream]) + 1, doc_ends, len(stream))
            ends = window_ends(where, penalty, length)
            opened = ends[-2] if len(ends) > 1 else 0
            if last:
                ends = ends[:-1] + [opened + int(x) for x in np.cumsum(tail_lengths(len(stream) - opened, length))]
            else:
                ends = ends[:-1]
            limit = ends[-1] if ends else 0
            cuts = np.unique(np.concatenate([[0], ends, doc_ends[doc_ends <= limit]]).astype(np.int64))
            begin, stop = cuts[:-1], cuts[1:]
            owner = np.searchsorted(doc_ends, begin, side="right")
            window = np.searchsorted(ends, begin, side="right")
            window_start = np.concatenate([[0], ends]).astype(np.int64)[window]
            doc_start = doc_ends - sizes
            raw = stream.astype("<u4", copy=False).tobytes()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in owner.tolist()], id_type),
                    pa.array(begin - doc_start[owner] + np.array(before, np.int64)[owner]),
                    pa.array(stop - begin),
                    pa.array(np.array(totals, np.int64)[owner]),
                    pa.array(window + (first_sequence + made)),
                    pa.array(begin - window_start),
                    binary_array([raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]),
                ],
                [f.name for f in fields],
            )
            made += len(ends)
            k = int(np.searchsorted(doc_ends, limit, side="right"))
            names, totals = names[k:], totals[k:]
            tokens, before = tokens[k:], before[k:]
            if tokens and (gone := limit - int(doc_start[k])) > 0:
                tokens[0] = tokens[0][gone:]
                before[0] += gone
            held = sum(map(len, tokens))
            return out

        for whole in batches:
            for batch in slices(whole, text):
                ids = batch.column(doc_id)
                id_type = ids.type
                for name, t in zip(ids.to_pylist(), batch.column(text).to_pylist(), strict=True):
                    made_ids = encode(t or "")
                    names.append(name)
                    tokens.append(made_ids)
                    before.append(0)
                    totals.append(len(made_ids))
                    held += len(made_ids)
                    if held >= STRETCH:
                        yield emit(False)
        if (rest := emit(True)) is not None:
            yield rest

    return docs.select(doc_id, text).mapInArrow(released(kernel, "packing"), T.StructType(fields))
