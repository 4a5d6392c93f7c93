"""Periodic runs of words: stretches that repeat with some period, found by comparing a text's words with themselves at every lag.

Words become numbers by their bytes. At each lag up to n / 4 the array is compared with itself shifted, and stretches of equal words
become runs. A stretch that counts is at least three lags long, so it holds several places of a coarse grid: the shift is compared on
that grid first, and word by word only around places where enough neighbours on the grid are equal. No stretch can slip through.

All texts of a slice are compared at once, longest first, so that a lag costs one comparison for all texts that are long enough for
it. A very long text is dealt to several tasks by ranges of lags; their runs meet again by the text's key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SLICE_BYTES, binary_array, flat, released, slices
from ._text import SPACE

#: A run is as long as so many of its periods, and has so many words, at least.
LEAST_EXPONENT, LEAST_WORDS = 4, 6
#: Places of the grid that a stretch holds, about.
GRID = 8
#: Lags of a text that one task compares. A word and the space after it are two bytes at least.
RANGE_LAGS = 1 << 18
BYTES_PER_LAG = 2 * LEAST_EXPONENT

RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


def least_stretch(lag: int) -> int:
    """Words equal to those a lag on that make a run."""
    return max(LEAST_WORDS, LEAST_EXPONENT * lag) - lag


def numbered_words(data: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts that stand one after another, the first word of each text with the number of words at the
    end, and a number for each word, the same for the same bytes only."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=solid[1:-1])
    begin, stop = solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    touching = inner[solid[inner] & solid[inner + 1]]  # a word ends where a text ends
    begin[touching] = stop[touching] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    whole = data.tobytes()
    words = [whole[a:e] for a, e in zip(start.tolist(), end.tolist(), strict=True)]
    number = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return words, np.searchsorted(start, bounds), number


def _true_stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of at least so many true values begin and end."""
    edge = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def _primes_of(n: int) -> list[int]:
    """The prime factors of a number, each as often as it divides it."""
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _smallest_period(ids: np.ndarray, at: int, lag: int) -> int:
    """The smallest divisor of ``lag`` that is a period of the ``lag`` words from ``at`` on."""
    period = lag
    for p in _primes_of(lag):
        d = period // p
        if np.array_equal(ids[at : at + period - d], ids[at + d : at + period]):
            period = d
    return period


class _Known:
    """Runs found so far, by period, ascending in start."""

    def __init__(self) -> None:
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        starts, ends = self.starts.setdefault(period, []), self.ends.setdefault(period, [])
        i = bisect_right(starts, start)
        starts.insert(i, start)
        ends.insert(i, end)

    def end_of(self, period: int, at: int, to: int) -> int:
        """The end of a run of this period that holds the words from ``at`` to ``to``; 0 if there is none."""
        starts = self.starts.get(period)
        i = bisect_right(starts, at) - 1 if starts else -1
        return self.ends[period][i] if i >= 0 and self.ends[period][i] >= to else 0


def runs_in(ids: np.ndarray, first: np.ndarray, lags: tuple[int, int]) -> np.ndarray:
    """Runs (start, end, period) with periods from ``lags[0]`` to before ``lags[1]``, of texts that stand one after another by falling length.

    ``first``: the first word of each text, and the number of words. No word is equal to one of another text.
    """
    sizes = np.diff(first)
    known, out = _Known(), []
    for lag in range(max(1, lags[0]), min(lags[1], int(sizes.max(initial=0)) // LEAST_EXPONENT + 1)):
        least = least_stretch(lag)
        n_texts = int(np.searchsorted(-sizes, -(least + lag), side="right"))
        if n_texts == 0:
            break
        n = int(first[n_texts]) - lag
        step = max(1, least // GRID)
        begin, end = _true_stretches(ids[:n:step] == ids[lag : n + lag : step], least // step)
        # A stretch may begin just after the place on the grid before its first, and end just before the one after its last.
        for a, e in zip(begin.tolist(), end.tolist(), strict=True):
            out += _around(ids, max(0, (a - 1) * step + 1), min(n, e * step), step, lag, known)
    return np.array(out, np.int64).reshape(-1, 3)


def _around(ids: np.ndarray, at: int, to: int, step: int, lag: int, known: _Known) -> list[tuple[int, int, int]]:
    """The runs with smallest period ``lag`` whose stretches lie in [at, to)."""
    least = least_stretch(lag)
    while at + least <= to:
        # A run whose period divides the lag and that covers a lag's words from here on is all that is equal around here, as the lag
        # repeats those words; a stretch before this place on the grid would be too short.
        here = -(-at // step) * step
        end = max((known.end_of(d, here, here + lag) for d in known.starts if lag % d == 0), default=0)
        if not end:
            break
        at = end - lag + 1
    out = []
    if at + least <= to:
        begin, end = _true_stretches(ids[at:to] == ids[at + lag : to + lag], least)
        for a, e in zip((begin + at).tolist(), (end + at).tolist(), strict=True):
            period = _smallest_period(ids, a, lag)
            known.add(a, e + lag, period)
            if period == lag:
                out.append((a, e + lag, lag))
    return out


def _texts(column: pa.Array, lags: tuple[int, int] = (1, 1 << 62)) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """The number of each text, its words and its runs (start, end, period), ascending in start and then period."""
    data, bounds = flat(column)
    words, first, number = numbered_words(data, bounds)
    order = np.argsort(-np.diff(first), kind="stable")
    sizes = np.diff(first)[order]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    owner = np.repeat(np.arange(len(order)), sizes)
    at = np.arange(starts[-1]) - starts[owner] + first[:-1][order][owner]
    ids = (owner.astype(np.int64) << 32) | number[at]
    runs = runs_in(ids, starts, lags)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cut = np.searchsorted(runs[:, 0], starts)
    for k, text in enumerate(order.tolist()):
        own = runs[cut[k] : cut[k + 1]] - [starts[k], starts[k], 0]
        yield text, words[first[text] : first[text + 1]], own


def collapsed_words(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stay, one space between them: those of a run's first period, and those in no run."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words)


def _run_lists(runs: list[np.ndarray]) -> pa.Array:
    every = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1] - every[:, 0]), pa.array(every[:, 2])], RUN.names)
    return pa.ListArray.from_arrays(pa.array(offsets), rows)


def _with_columns(batch: pa.RecordBatch, n_words: list[int], runs: pa.Array, collapsed: list[bytes]) -> pa.RecordBatch:
    made = [pa.array(n_words, pa.int64()), runs, binary_array(collapsed).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "n_words", "runs", "collapsed"])


def _collapse(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 2 * SLICE_BYTES):
                n_words, runs, left = [0] * part.num_rows, [np.zeros((0, 3), np.int64)] * part.num_rows, [b""] * part.num_rows
                for i, words, own in _texts(part.column(text)):
                    n_words[i], runs[i], left[i] = len(words), own, collapsed_words(words, own)
                yield _with_columns(part, n_words, _run_lists(runs), left)

    return kernel


def _range_runs(range_lags: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lag = row.column("lag")[0].as_py()
                for _, _, own in _texts(row.column("text"), (lag, lag + range_lags)):
                    sha = pa.array(row.column("sha").to_pylist() * len(own), pa.binary())
                    yield pa.RecordBatch.from_arrays([sha, pa.array(own[:, 0]), pa.array(own[:, 1] - own[:, 0]), pa.array(own[:, 2])], ["sha", *RUN.names])

    return kernel


def _collapse_long(text: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                words, _, _ = numbered_words(*flat(row.column(text)))
                x = row.column("_rg_runs")[0].values
                own = np.stack([x.field(c).to_numpy(zero_copy_only=False) for c in RUN.names], 1).astype(np.int64) if x is not None else np.zeros((0, 3), np.int64)
                own[:, 1] += own[:, 0]
                yield _with_columns(row.select(names), [len(words)], _run_lists([own]), [collapsed_words(words, own)])

    return kernel


def collapse_runs(docs: DataFrame, text: str = "text", range_lags: int = RANGE_LAGS) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (``start`` and ``length`` in words, ``period``; ascending in start, then period) and ``collapsed``, the
    text in which each run is left with its first period, words joined by one space.

    A run is a stretch of ``LEAST_WORDS`` words and ``LEAST_EXPONENT`` of its smallest periods, at least, that no neighbouring word
    extends. A word goes if any run has it after its first period. Null and empty texts have no words. Columns of these names that
    ``docs`` brings along are replaced. Texts of more than ``range_lags`` possible lags are compared by ranges of lags in several tasks,
    each distinct one once; texts are the same when their SHA-256 is.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    out = T.StructType([*docs.schema.fields]).add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "string")
    lags = F.octet_length(F.coalesce(F.col(text), F.lit(""))) / BYTES_PER_LAG
    short = docs.where(lags <= range_lags).mapInArrow(released(_collapse(text)), out)
    long = docs.where(lags > range_lags).withColumn("_rg_sha", F.unhex(F.sha2(F.col(text), 256)))
    ranges = long.groupBy(F.col("_rg_sha").alias("sha")).agg(F.first(text).alias("text")).withColumn("lag", F.explode(F.expr(f"sequence(1, octet_length(text) div {BYTES_PER_LAG}, {range_lags})")))
    kind = T.StructType().add("sha", "binary")
    for field in RUN:
        kind = kind.add(field)
    found = ranges.repartition("sha", "lag").mapInArrow(released(_range_runs(range_lags)), kind).groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("r"))
    found = found.select(F.col("sha").alias("_rg_sha"), F.transform("r", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("_rg_runs"))
    return short.unionByName(long.join(found, "_rg_sha", "left").mapInArrow(released(_collapse_long(text, docs.columns)), out))
