"""An interpolated modified Kneser-Ney model of word n-grams, counted in Spark and memory-mapped for scoring.

The order is a parameter, 2 or 3. Training gathers blocks of numbers that are summed within a task before they are shuffled:

1. word hashes and their counts, by ranges of the hash; a word's place in these sorted arrays is its number;
2. at order 3 the triples and their counts, by a hash of the first two words, and from each task the pairs that end distinct
   triples; at order 2 the pairs and their counts. Texts begin with ``order`` - 1 words of their own;
3. pairs by a hash of the pair, so that those of a common first word are spread over all parts; and from each task, summed
   again, what is known of each first word and of each second;
4. for each first word its count and how many words follow it once, twice and more often; for each second word the number
   of first words before it.

An n-gram is kept as a 64-bit hash (a pair is its two numbers), sorted in the arrays of its part. Triples that occur once are kept
as hashes alone, apart from the others; contexts of a single such triple aren't kept, as they are the pairs that have no statistics as
a context. Without ``singles`` they have the discount 1
and needn't be kept, as their share goes to the pair. Two triples with one hash would share a count; for 10**12 triples a lookup meets one with a probability of 6e-8. Counts are unsigned integers as wide
as the largest of an array needs, up to 64 bits. Vocabularies of 2**32 - 2 words or more are refused.

Each task writes its arrays as files of its own in the shared folder, under a temporary name first, so that a task that runs
again after the loss of an executor leaves the same files. The driver sees names, sizes and totals only. Workers map the
files into memory; from a folder that can't be mapped they copy a file first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import BLOCK, blocks, by_part, distinct, fitted, grouped, mapped, merged, pack_columns, save, summed, unpack_columns
from ._common import flat, new_path, parts_for, released, released_group, slices, written
from ._text import mix, word_hashes

#: Hash of the end of a text, which counts as a token; the start has the number after all words.
END = np.uint64(0x5EED0FE0D0C0FFEE)
#: Words, or n-grams, gathered before a block is made.
BLOCK_WORDS = 6_000_000
LOG10 = float(np.log(10))
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
#: What is known of a context: its count, and how many words follow it once, twice and more often.
STATS = ("total", "once", "twice", "more")


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << _HALF | second.astype(np.uint64)


def _triple(pair: np.ndarray, third: np.ndarray) -> np.ndarray:
    """A hash of a pair and the word after it."""
    return mix(mix(pair) + third.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Model:
    """Names and sizes of the arrays, the discounts and the totals; small, and sent to workers with the code."""

    def __init__(self, folder: str, n_parts: int, order: int):
        self.folder, self.n_parts, self.order = folder, n_parts, order
        self.words: list[tuple[int, int, int, str]] = []  # part, first number, words, kind of their counts
        self.tables: dict[str, dict[int, tuple[int, list[str]]]] = {}  # by name and part: rows, kinds of the values
        self.n_tokens = self.n_words = self.n_pairs = 0
        self.discounts: dict[int, np.ndarray] = {}  # by order; by count 0, 1, 2, 3 and more
        self.lower_mass = 0.0

    def array(self, name: str, part: int, kind: str, n: int) -> np.ndarray:
        return mapped(f"{self.folder}/{name}-{part:05d}", kind, n)

    def hash_part(self, h: np.ndarray) -> np.ndarray:
        return ((h >> _HALF) * np.uint64(self.n_parts) >> _HALF).astype(np.int64)

    def spread_part(self, key: np.ndarray) -> np.ndarray:
        return self.hash_part(mix(key.astype(np.uint64)))

    def put(self, name: str, part: int, key: np.ndarray, values: list[np.ndarray]) -> list[str]:
        """Save a sorted key with its values; the kinds of these."""
        fit = [fitted(v) for v in values]
        save(f"{self.folder}/{name}-key-{part:05d}", key.astype("<u8"))
        for k, v in enumerate(fit):
            save(f"{self.folder}/{name}-{k}-{part:05d}", v)
        return [v.dtype.str for v in fit]

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words (-1: unknown) and their counts; ``h`` ascending."""
        number, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        part = self.hash_part(h)
        for p, first, n, kind in self.words:
            a, b = np.searchsorted(part, [p, p + 1])
            if a == b or not n:
                continue
            known = self.array("word-key", p, "<u8", n)
            at = np.minimum(np.searchsorted(known, h[a:b]), n - 1)
            hit = known[at] == h[a:b]
            number[a:b][hit] = at[hit] + first
            count[a:b][hit] = self.array("word-0", p, kind, n)[at[hit]]
        return number, count

    def find(self, name: str, key: np.ndarray, part: np.ndarray, n_values: int) -> list[np.ndarray]:
        """The values of the keys in a table, 0 where it hasn't one; faster if the keys are ascending."""
        out = [np.zeros(len(key), np.int64) for _ in range(n_values)]
        table = self.tables.get(name, {})
        order = by_part(part)
        cuts = np.searchsorted(part[order], np.arange(self.n_parts + 1))
        for p, (n, kinds) in table.items():
            here = order[cuts[p] : cuts[p + 1]]
            if not len(here) or not n:
                continue
            known = self.array(f"{name}-key", p, "<u8", n)
            at = np.minimum(np.searchsorted(known, key[here]), n - 1)
            hit = known[at] == key[here]
            for k, (o, kind) in enumerate(zip(out, kinds, strict=True)):
                o[here[hit]] = self.array(f"{name}-{k}", p, kind, n)[at[hit]]
        return out

    def has(self, name: str, key: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Whether a table without values has the keys; faster if they are ascending."""
        out = np.zeros(len(key), bool)
        order = by_part(part)
        cuts = np.searchsorted(part[order], np.arange(self.n_parts + 1))
        for p, (n, _) in self.tables.get(name, {}).items():
            here = order[cuts[p] : cuts[p + 1]]
            if len(here) and n:
                known = self.array(f"{name}-key", p, "<u8", n)
                out[here] = known[np.minimum(np.searchsorted(known, key[here]), n - 1)] == key[here]
        return out

    def _interpolated(self, n: int, count: np.ndarray, stats: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
        d = self.discounts[n]
        total, *kinds = stats
        mass = sum(d[k] * kinds[k - 1] for k in (1, 2, 3))
        return np.where(total > 0, (np.maximum(count - d[np.minimum(count, 3)], 0) + mass * lower) / np.maximum(total, 1), lower)

    def log10(self, before: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        """log10 P(word | the words before it, nearest last) of numbers; -1 is an unknown word."""
        words, _, at = distinct(word)
        known = np.maximum(words, 0).astype(np.uint64)
        (follow,) = self.find("before", known, self.spread_part(known), 1)
        follow[words < 0] = 0
        uniform, d = 1 / (self.n_words + 1), self.discounts[1]
        p = (np.maximum(follow - d[np.minimum(follow, 3)], 0) + self.lower_mass * uniform) / self.n_pairs if self.n_pairs else np.full(len(words), uniform)
        # Numbers go up by one, so that 0 is unknown; no table has a key with an unknown word.
        pairs, first, back = distinct(_pair(before[-1] + 1, word + 1))
        u, w = before[-1][first], word[first]
        contexts, _, of = distinct(u)
        seen = np.maximum(contexts, 0).astype(np.uint64)
        stats = self.find("first", seen, self.spread_part(seen), 4)
        key = _pair(np.maximum(u, 0), np.maximum(w, 0))
        (count,) = self.find("pair", key, self.spread_part(key), 1)
        count[(u < 0) | (w < 0)] = 0
        for s in stats:
            s[contexts < 0] = 0
        p2 = self._interpolated(2, count, [s[of] for s in stats], p[at[first]])
        if self.order == 2:
            return np.log10(p2)[back]
        _, first3, back3 = distinct(_triple(pairs[back], before[-2] + 1))
        t, u, w = before[-2][first3], before[-1][first3], word[first3]
        none = (t < 0) | (u < 0)
        context = _pair(np.maximum(t, 0), np.maximum(u, 0))
        contexts, _, of = distinct(context)
        part = self.spread_part(contexts)
        stats = self.find("first3", contexts, part, 4)
        # A pair that occurs but has no statistics begins a single triple; no context ends a text.
        rest = np.flatnonzero(stats[0] == 0) if "triple1" in self.tables else np.zeros(0, np.int64)
        lone = rest[self.find("pair", contexts[rest], part[rest], 1)[0] > 0]
        for s in stats[:2]:
            s[lone] = 1
        stats = [s[of] for s in stats]
        for s in stats:
            s[none] = 0
        key = _triple(context, np.maximum(w, 0))
        order = np.argsort(key)
        count = np.empty(len(key), np.int64)
        key, part = key[order], part[of][order]
        (found,) = self.find("triple", key, part, 1)
        # A context of no triple that occurs once has none to look for.
        rest = np.flatnonzero((found == 0) & (stats[1][order] > 0)) if "triple1" in self.tables else np.zeros(0, np.int64)
        found[rest] = self.has("triple1", key[rest], part[rest])
        count[order] = found
        count[none | (w < 0)] = 0
        return np.log10(self._interpolated(3, count, stats, p2[back[first3]]))[back3]


def _discounts(n: list[int]) -> np.ndarray:
    """Those of modified Kneser-Ney from the counts of counts; 0.75 at most of a count where these are too few."""
    if min(n[:3]) == 0:
        return np.array([0, 0.5, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


def _tokens(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts with ``END`` after each, and where each text's begin."""
    h, first = word_hashes(*flat(batch.column(text)))
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _gathered(text: str, max_bytes: int, of: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], block: Callable[[list[tuple[np.ndarray, ...]]], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel that makes a block of what ``of`` finds in slices, each time it has ``BLOCK_WORDS`` of it, and of the rest."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for whole in batches:
            for batch in slices(whole, text, max_bytes):
                held.append(of(batch))
                if sum(len(h[0]) for h in held) > BLOCK_WORDS:
                    made, held = block(held), []
                    yield made
        yield block(held)

    return kernel


def _summed_stats(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of ascending ``keys`` and their ``STATS``."""
    context, at = np.unique(keys, return_index=True)
    if not len(context):
        return context, [np.zeros(0, np.int64)] * 4
    return context, [np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts > 2)]


_TOLD = "at int, rows long, kinds array<string>, of_counts array<long>"


def _told(part: int, rows: int, kinds: list[str], of_counts: list[int]) -> dict[str, object]:
    return {"at": part, "rows": rows, "kinds": kinds, "of_counts": of_counts}


_PLAIN = pa.schema([("at", pa.int32()), ("rows", pa.int64()), ("kinds", pa.list_(pa.string())), ("of_counts", pa.list_(pa.int64()))])


def _with_told(made: pa.RecordBatch, told: dict[str, object]) -> pa.Table:
    """The blocks with what the driver is told beside each; at least one row."""
    if not made.num_rows:
        made = pa.RecordBatch.from_arrays([pa.array([None], f.type) for f in made.schema], schema=made.schema)
    n = made.num_rows
    return pa.table([*made.columns, *(pa.array([told[f.name]] * n, f.type) for f in _PLAIN)], [*made.schema.names, *_PLAIN.names])


def _hear(model: Model, name: str, rows: DataFrame) -> np.ndarray:
    """Note the sizes of a table from what its writers tell; the counts of counts."""
    of_counts = np.zeros(4, np.int64)
    model.tables[name] = {}
    for p, n, kinds, counts in map(tuple, rows.select("at", "rows", "kinds", "of_counts").distinct().collect()):
        model.tables[name][p] = (n, kinds)
        of_counts += np.array(counts)
    return of_counts


def train(docs: DataFrame, text: str = "text", order: int = 3, singles: bool = False) -> Model:
    """The model of all texts of ``docs`` (null: empty). Tokens are words with A-Z lower-cased, and the end of each text. ``singles``: whether triples that occur
    once have the discount that the counts of counts give, as the method has it; else they are pruned by a discount of 1."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    model = Model(new_path(spark, "lm"), parts_for(docs, text), order)
    _count_words(model, docs.select(text), text)
    ends = _count_triples(model, docs.select(text), text, singles) if order == 3 else None
    _count_pairs(model, docs.select(text), text, ends)
    return model


def _count_words(model: Model, docs: DataFrame, text: str) -> None:
    def block(held: list) -> pa.RecordBatch:
        k, c = summed([h[0] for h in held], [h[1] for h in held])
        return blocks(k, c, model.hash_part(k))

    def write(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        k, c = merged(table)
        kinds = model.put("word", p, k, [c])
        return pa.table({"part": pa.array([p], pa.int32()), "n": [len(k)], "tokens": [int(c.sum())], "kind": kinds})

    kernel = _gathered(text, 1 << 20, lambda b: np.unique(_tokens(b, text)[0], return_counts=True), block)
    found = docs.mapInArrow(released(kernel, "arrays"), BLOCK).groupBy("part").applyInArrow(released_group(write), "part int, n long, tokens long, kind string").collect()
    for p, n, tokens, kind in sorted(map(tuple, found)):
        model.words.append((p, model.n_words, n, kind))
        model.n_words += n
        model.n_tokens += tokens
    if model.n_words >= 2**32 - 2:
        raise ValueError("more words than 32 bits can number")


_TRIPLES = "part int, n long, pairs binary, thirds binary, counts binary"
_PAIRS = f"{BLOCK}, {_TOLD}"


def _count_triples(model: Model, docs: DataFrame, text: str, singles: bool) -> DataFrame:
    """Write the tables of order 3; blocks of the pairs that end distinct triples, with how many those are."""
    starts = np.uint64(model.n_words) << _HALF | np.uint64(model.n_words)

    def summed_triples(pair: np.ndarray, third: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        order, starts = grouped(_triple(pair, third))
        at = order[starts]
        return pair[at], third[at], np.add.reduceat(count[order], starts) if len(order) else count

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        before, word, _ = _numbered(model, batch, text)
        return summed_triples(_pair(before[-2], before[-1]), word.astype(np.uint32), np.ones(len(word), np.int64))

    def block(held: list) -> pa.RecordBatch:
        pair, third, count = summed_triples(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        order = np.argsort(pair)
        part = model.spread_part(pair[order])
        rows = by_part(part)
        order, part = order[rows], part[rows]
        return pack_columns(part, [pair[order], third[order], count[order]], ["pairs", "thirds", "counts"])

    def write(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        found: list[tuple[np.ndarray, ...]] = []
        for pair, third, count in unpack_columns(table, ["pairs", "thirds", "counts"], ["<u8", "<u4", "<i8"]):
            here = pair, third, count
            while found and len(found[-1][0]) <= 2 * len(here[0]):
                here = summed_triples(*(np.concatenate(x) for x in zip(found.pop(), here, strict=True)))
            found.append(here)
        pair, third, count = summed_triples(*(np.concatenate(x) for x in zip(*found, strict=True)))
        kept = count > 1
        key = _triple(pair[kept], third[kept])
        order = np.argsort(key)
        kinds = model.put("triple", p, key[order], [count[kept][order]])
        if singles:
            model.put("triple1", p, np.sort(_triple(pair[~kept], third[~kept])), [])
        by = np.argsort(pair)
        context, stats = _summed_stats(pair[by], count[by])
        # Elsewhere all goes to the pair. The start of a text is no pair of the table below.
        some = (stats[0] > 1) | (context == starts) if singles else stats[2] + stats[3] > 0
        first_kinds = model.put("first3", p, context[some], [s[some] for s in stats])
        w, n = np.unique(pair << _HALF | third.astype(np.uint64), return_counts=True)
        part = model.spread_part(w)
        order = by_part(part)
        sizes = (int(x) for x in (some.sum(), (~kept).sum()))
        told = _told(p, len(key), [*kinds, *first_kinds, *map(str, sizes)], _of_counts(count))
        return _with_told(blocks(w[order], n[order], part[order]), told)

    triples = docs.mapInArrow(released(_gathered(text, 4 << 20, of, block), "arrays"), _TRIPLES)
    made = written(triples.groupBy("part").applyInArrow(released_group(write), _PAIRS), "lm-ends")
    model.discounts[3] = _discounts(_hear(model, "triple", made).tolist())
    told = model.tables["triple"].items()
    model.tables["first3"] = {p: (int(kinds[5]), kinds[1:5]) for p, (_, kinds) in told}
    if singles:
        model.tables["triple1"] = {p: (int(kinds[6]), []) for p, (_, kinds) in told}
    else:
        model.discounts[3][1] = 1.0
    model.tables["triple"] = {p: (n, kinds[:1]) for p, (n, kinds) in model.tables["triple"].items()}
    return made.where("part IS NOT NULL").select("part", "n", "keys", "counts")


_STATS_BLOCK = "part int, n long, keys binary, s0 binary, s1 binary, s2 binary, s3 binary"


def _count_pairs(model: Model, docs: DataFrame, text: str, ends: DataFrame | None) -> None:
    """Write the tables of pairs and of single words; ``ends``: blocks of pairs, where a higher order has counted them."""

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        before, word, _ = _numbered(model, batch, text)
        return np.unique(_pair(before[-1], word), return_counts=True)

    def block(held: list) -> pa.RecordBatch:
        k, c = summed([h[0] for h in held], [h[1] for h in held])
        part = model.spread_part(k)
        order = by_part(part)
        return blocks(k[order], c[order], part[order])

    def write(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        k, c = merged(table)
        kinds = model.put("pair", p, k, [c])
        made = []
        context, stats = _summed_stats(k >> _HALF, c)
        w, n = np.unique(k & _LOW, return_counts=True)
        for kind, key, values in (("first", context, stats), ("before", w, [n, n, n, n])):
            part = model.spread_part(key)
            order = by_part(part)
            rows = pack_columns(part[order], [key[order], *(v[order] for v in values)], ["keys", "s0", "s1", "s2", "s3"])
            made.append(rows.append_column("kind", pa.array([kind] * rows.num_rows, pa.string())))
        return _with_told(pa.Table.from_batches(made).combine_chunks().to_batches(max_chunksize=None)[0], _told(p, len(k), kinds, _of_counts(c)))

    def sums(name: str, n_values: int) -> Callable[[pa.Table], pa.Table]:
        def write_sums(table: pa.Table) -> pa.Table:
            p = table["part"][0].as_py()
            key, values = np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * n_values
            for found in unpack_columns(table, ["keys", *(f"s{i}" for i in range(n_values))], ["<u8"] + ["<i8"] * n_values):
                both = np.concatenate([key, found[0]])
                order, starts = grouped(both)
                key = both[order[starts]]
                values = [np.add.reduceat(np.concatenate(v)[order], starts) for v in zip(values, found[1:], strict=True)]
            kinds = model.put(name, p, key, values)
            return pa.Table.from_pylist([_told(p, len(key), kinds, _of_counts(values[0]))], _PLAIN)

        return write_sums

    if ends is None:
        ends = docs.mapInArrow(released(_gathered(text, 4 << 20, of, block), "arrays"), BLOCK)
    made = written(ends.groupBy("part").applyInArrow(released_group(write), f"{_STATS_BLOCK}, kind string, {_TOLD}"), "lm-stats")
    model.discounts[2] = _discounts(_hear(model, "pair", made).tolist())
    model.n_pairs = sum(n for n, _ in model.tables["pair"].values())
    first, before = (made.where(F.col("kind") == k).select("part", "n", "keys", "s0", "s1", "s2", "s3") for k in ("first", "before"))
    _hear(model, "first", first.groupBy("part").applyInArrow(released_group(sums("first", 4)), _TOLD))
    n = _hear(model, "before", before.groupBy("part").applyInArrow(released_group(sums("before", 1)), _TOLD))
    model.discounts[1] = d = _discounts(n.tolist())
    n_seconds = sum(rows for rows, _ in model.tables["before"].values())
    model.lower_mass = float(d[1] * n[0] + d[2] * n[1] + d[3] * (n_seconds - n[0] - n[1]))


def _numbered(model: Model, batch: pa.RecordBatch, text: str) -> tuple[list[np.ndarray], np.ndarray, tuple]:
    """Numbers of the words before each token, nearest last, and of the token; the counts of the tokens and where each text
    begins."""
    h, first = _tokens(batch, text)
    words, _, back = distinct(h)
    number, count = model.lookup(words)
    word = number[back]
    before = [word]
    for _ in range(model.order - 1):
        moved = np.empty_like(word)
        moved[1:] = before[0][:-1]
        moved[first[:-1]] = model.n_words
        before.insert(0, moved)
    return before[:-1], word, (count[back], first)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``n_known``, ``base_score``, ``score`` (log10 probability) and ``perplexity``.

    The base is the smoothed share of each token in the training texts. Every text has its end as a token, so that null and
    empty texts have one. Repeated rows score alike. Columns of these names are replaced.
    """
    docs = docs.drop("n_tokens", "n_known", "base_score", "score", "perplexity")
    kept = [c for c in docs.columns if c != text]
    n, v = model.n_tokens, model.n_words

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                before, word, (count, first) = _numbered(model, batch, text)
                log10 = model.log10(before, word)
                base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
                at, size = first[:-1], np.diff(first)
                total = np.add.reduceat(log10, at)
                made = [pa.array(size), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(total), pa.array(np.exp(-total * LOG10 / size))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [f.name for f in schema])

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity"))]
    schema = T.StructType([*(docs.schema[c] for c in kept), *added])
    return docs.select(*[F.col(f"`{c}`") for c in kept], text).mapInArrow(released(kernel, "arrays"), schema)
