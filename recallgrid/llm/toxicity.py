"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

The models spell words: they give each byte of a word the probability that it follows the up to ``ORDER`` - 1 bytes before it in
the word, so that invented forms of an insult count like the insult. Orders above ``SHARED`` are counted by class; the
orders from there down, to which rare expressions back off, are counted over both classes together. What is compared is the
log-likelihood of either model, divided by the length: over the whole text, over its passages of ``PASSAGE`` words and over
its words. These three figures go into a logistic scale that is fitted on labelled texts which were not counted.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import distinct
from ._common import flat, released, slices
from ._text import LOWER, SPACE, mix, prefix_hash, span_hash

ORDER, SHARED = 6, 3
PASSAGE = 4
#: Labelled texts that are learned from, at most (those whose id has the smallest hashes), and how much text in all.
MAX_LABELLED, MAX_LABELLED_BYTES = 16_000, 64 << 20
#: Of so many labelled texts one serves to fit the scale.
FOLDS = 4
#: The probability of a byte of which nothing is known.
BYTES = 1 / 256

_PARTS = SPACE.copy()
_PARTS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of several texts, spelled one after another with a space around each; where each starts (and the
    last ends); for each word of the texts the number of its spelling; where the words of each text start."""
    low = LOWER[data]
    solid = ~_PARTS[low]
    begin, stop = solid.copy(), np.zeros(len(low), bool)
    begin[1:] &= ~solid[:-1]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(low))]
    begin[inner] = solid[inner]
    stop[:-1] = solid[:-1] & (~solid[1:] | begin[1:])
    if len(low):
        stop[-1] = solid[-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, bounds)
    if not len(start):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), first
    h = mix(span_hash(prefix_hash(low), start, end) + (end - start).astype(np.uint64))
    _, at, which = distinct(h)
    size = end[at] - start[at] + 2
    where = np.concatenate([[0], np.cumsum(size)])
    spelled = np.full(where[-1], 32, np.uint8)
    inside = np.ones(where[-1], bool)
    inside[where[:-1]] = inside[where[1:] - 1] = False
    spelled[inside] = low[np.repeat(start[at], size - 2) + np.arange(inside.sum()) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)]
    return spelled, where, which, first


def _grams(spelled: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte but the opening spaces: the word it is in, the number of bytes of its longest n-gram, and the n-gram
    packed into an integer, last byte lowest."""
    owner = np.repeat(np.arange(len(where) - 1), np.diff(where))
    place = np.arange(len(spelled)) - where[owner]
    packed = spelled.astype(np.int64)
    for k in range(1, ORDER):
        packed[k:] |= np.where(place[k:] >= k, spelled[:-k].astype(np.int64) << (8 * k), 0)
    use = place > 0
    return owner[use], np.minimum(place[use] + 1, ORDER), packed[use]


def count_grams(rows: DataFrame, text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(``size``, ``gram``, ``ordinary``, ``toxic``) counts of the longest n-gram at each byte of all texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, bounds = flat(batch.column(text))
                spelled, where, which, first = _words(data, bounds)
                label = np.repeat(batch.column(toxic).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(first))
                owner, size, gram = _grams(spelled, where)
                by = [np.bincount(which[label == c], minlength=len(where) - 1)[owner] for c in (0, 1)]
                key, back = np.unique(gram | (size << 48), return_inverse=True)
                totals = [np.bincount(back, b, len(key)).astype(np.int64) for b in by]
                yield pa.RecordBatch.from_arrays([pa.array((key >> 48).astype(np.int32)), pa.array(key & ((1 << 48) - 1)), *map(pa.array, totals)], ["size", "gram", "ordinary", "toxic"])

    made = rows.select(text, toxic).mapInArrow(released(kernel), "size int, gram long, ordinary long, toxic long")
    return made.groupBy("size", "gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


class Model:
    """Interpolated Kneser-Ney probabilities of bytes in words, for ordinary (0) and toxic (1) texts."""

    def __init__(self, size: np.ndarray, gram: np.ndarray, counts: np.ndarray):
        """``counts``: a row of two for each n-gram."""
        here = {n: (gram[size == n], counts[size == n]) for n in range(2, ORDER + 1)}
        key, count = here[ORDER]
        levels = []
        for n in range(ORDER, 0, -1):
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            if n == SHARED == ORDER:
                count = count.sum(1, keepdims=True)
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            context, first, of = np.unique(key >> 8, return_index=True, return_inverse=True)
            total = np.add.reduceat(count, first) if len(first) else count[:0]
            kinds = np.add.reduceat((count > 0).astype(np.int64), first) if len(first) else count[:0]
            # What a class leaves of a context to the order below: all, where it has not seen the context.
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.maximum(count - discount, 0) / np.maximum(total[of], 1)
            levels.append((n, key, own, of, context, left))
            if n > 1:
                # Lower orders count the bytes that came before an n-gram: by class, or in either; at the start of a word, its uses.
                lower, at = np.unique(key & ((1 << (8 * (n - 1))) - 1), return_inverse=True)
                start, uses = here.get(n - 1, (lower[:0], np.zeros((0, 2), np.int64)))
                before = count > 0
                if n - 1 <= SHARED:
                    before, uses = before.any(1, keepdims=True), uses.sum(1, keepdims=True)
                key, to = np.unique(np.concatenate([lower, start]), return_inverse=True)
                count = np.zeros((len(key), before.shape[1]), np.int64)
                np.add.at(count, to[at], before)
                np.add.at(count, to[len(lower) :], uses)
        #: From the highest order down: n-grams seen with their probabilities, contexts seen with what they leave.
        self.levels = []
        below, known = np.full((1, 2), BYTES), np.zeros(1, np.int64)
        for n, key, own, of, context, left in reversed(levels):
            suffix = np.searchsorted(known, key & ((1 << (8 * (n - 1))) - 1))  # every suffix of an n-gram is an n-gram below
            known, below = key, own + left[of] * below[suffix]
            self.levels.insert(0, (n, key, below, context, left))

    def probabilities(self, size: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """P(last byte | bytes before it) of each n-gram, in a column for each class."""
        p = np.ones((len(gram), 2))
        rest = np.arange(len(gram))
        for n, key, known, context, left in self.levels:
            if not len(key) or not len(rest):
                continue
            at = rest[size[rest] >= n]
            g = gram[at] & ((1 << (8 * n)) - 1)
            k = np.minimum(np.searchsorted(key, g), len(key) - 1)
            hit = key[k] == g
            p[at[hit]] *= known[k[hit]]
            miss, g = at[~hit], g[~hit] >> 8
            c = np.minimum(np.searchsorted(context, g), len(context) - 1)
            seen = context[c] == g
            p[miss[seen]] *= left[c[seen]]
            rest = np.concatenate([miss, rest[size[rest] < n]])
        p[rest] *= BYTES
        return p

    def word_ratios(self, spelled: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word log P(toxic model) - log P(ordinary model), and the bytes it is over."""
        owner, size, gram = _grams(spelled, where)
        p = np.log(np.maximum(self.probabilities(size, gram), 1e-12))
        n_words = len(where) - 1
        return np.bincount(owner, p[:, 1] - p[:, 0], n_words), np.bincount(owner, minlength=n_words)

    def figures(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text: the length-normalised ratio of the whole, of its most toxic passage and of its most toxic word."""
        spelled, where, which, first = _words(data, bounds)
        n = len(bounds) - 1
        out = np.zeros((n, 3))
        if not len(which):
            return out
        ratio, size = self.word_ratios(spelled, where)
        ratio, size = ratio[which], size[which]
        sums, sizes = np.concatenate([[0], np.cumsum(ratio)]), np.concatenate([[0], np.cumsum(size)])
        full = np.diff(first) > 0
        a, b = first[:-1][full], first[1:][full]
        out[full, 0] = (sums[b] - sums[a]) / (sizes[b] - sizes[a])
        end = np.repeat(b, b - a)
        i = np.arange(a[0], b[-1])
        to = np.minimum(i + PASSAGE, end)
        out[full, 1] = np.maximum.reduceat((sums[to] - sums[i]) / (sizes[to] - sizes[i] + 8), a - a[0])
        out[full, 2] = np.maximum.reduceat(ratio[i] / (size[i] + 4), a - a[0])
        return out


def fit_scale(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights and constant of a logistic scale by Newton's method; without rows a constant that calls nothing toxic."""
    if not len(x):
        return np.append(np.zeros(x.shape[1]), -1.0)
    spread = np.maximum(x.std(0), 1e-9)
    z = np.concatenate([x / spread, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
    return np.append(w[:-1] / spread, w[-1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_LABELLED_BYTES) -> tuple[Model, np.ndarray]:
    """The model and its scale from the rows of ``labels`` (``doc_id``, ``toxic``) that have a text in ``docs``.

    Rows without an id or a label are left out. If there are more than ``max_labelled`` rows or ``max_bytes`` of text, those
    with the smallest hashes of their id are taken.
    """
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("_rg_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.withColumn("_rg_h", F.xxhash64("_rg_id")).orderBy("_rg_h", "_rg_id", "toxic").limit(max_labelled)
    rows = docs.select(F.col(doc_id).alias("_rg_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "_rg_id")
    sizes = sorted((tuple(r) for r in rows.select("_rg_h", F.octet_length("text")).collect()), key=lambda r: r[0])
    inside = np.searchsorted(np.cumsum([n for _, n in sizes]), max_bytes, side="right")
    rows = rows.where(F.col("_rg_h") <= (sizes[min(inside, len(sizes) - 1)][0] if sizes else 0))
    fold = F.pmod(F.xxhash64(F.lit(3), "_rg_h"), F.lit(FOLDS))
    counted = count_grams(rows.where(fold != 0)).toArrow()
    model = Model(counted["size"].to_numpy(), counted["gram"].to_numpy(), np.stack([counted["ordinary"].to_numpy(), counted["toxic"].to_numpy()], 1))
    shown = figures(rows.where(fold == 0).select("text", "toxic"), model).select("toxic", "_rg_figures").toArrow()
    x = np.array(shown["_rg_figures"].to_pylist(), np.float64).reshape(-1, 3)
    return model, fit_scale(x, shown["toxic"].to_numpy().astype(np.float64))


def figures(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs``, without the text unless ``keep_text``, with ``_rg_figures`` (three doubles)."""
    kept = [c for c in docs.columns if keep_text or c != text]
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # its size follows from the bound on labelled text
    return _map(docs, kept, held, text)


_loaded: dict[int, Model] = {}


def _map(docs: DataFrame, kept: list[str], held, text: str) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held._jbroadcast.id() if hasattr(held, "_jbroadcast") and held._jbroadcast is not None else id(held)
        model = _loaded.get(key)
        if model is None:
            _loaded.clear()
            model = _loaded[key] = pickle.loads(held.value)
        for whole in batches:
            for batch in slices(whole, text):
                found = model.figures(*flat(batch.column(text)))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), 3).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], [*kept, "_rg_figures"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("_rg_figures", T.ArrayType(T.DoubleType()))])
    inner = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    return inner.mapInArrow(released(kernel), schema)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    ``labels`` are all rows to learn from. Null and empty texts have figures of 0 and so the score of the scale's constant.
    Repeated rows score alike; without labels of both kinds all scores are below 0.5. Columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted", "_rg_figures")
    model, scale = train(docs, labels, text, doc_id)
    rows = figures(docs, model, text, keep_text)
    z = sum((F.col("_rg_figures")[k] * float(scale[k]) for k in range(3)), F.lit(float(scale[3])))
    return rows.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("_rg_figures")
