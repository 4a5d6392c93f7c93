"""Removal of long byte strings that stand anywhere else, by a hash-compared suffix sort.

Every window of ``LENGTH`` bytes picks an anchor: the place in it with the least hash of ``GRAM`` bytes, the leftmost of equals.
Equal windows pick the same place, so only windows with the same anchor bytes need be compared. The texts are read three
times and never shuffled:

1. the anchor hashes are counted; those that occur again are kept as sorted arrays in the shared folder;
2. for those, the bytes around the anchor that its windows cover (a context) are written, each once from a task, and sent by
   anchor hash. Contexts that are equal are repeated as a whole. Different contexts of one hash are sorted from the anchor
   to the right, and from it to the left, by mergesort; suffixes are compared by prefix polynomial hashes, whose binary
   search finds the common extension in a logarithmic number of steps, and what is found is verified byte by byte. The
   neighbours in both orders give the repeated windows; where a third context could give more, all windows of the hash
   are compared by their hashes;
3. the windows found repeated, kept as sorted arrays by context, are looked up and their bytes removed.

An anchor hash with more than ``MANY`` occurrences (a passage that stands in a large part of the corpus) isn't sorted by one
task. Its equal contexts are first made one. The different ones are dealt out by ranges of both orders (the bytes from the
anchor on, then those before it, and the reverse), so that no range has more than its share however many contexts agree on
one side; each range is sorted as above, and the neighbours across the ends of ranges are compared in a step of their
own. Windows for which a third context could give more are counted by digests of 128 bits, packed into blocks; the bytes of
those that stand more than once are compared.

Passages are found alike, in words: each word is a code of ``CODE`` bytes, and windows and anchors start at codes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import BLOCK, blocks, mapped, merged, save, summed
from ._common import binary_array, files_for, flat, new_path, released, released_group, slices, written
from ._text import mix, powers, prefix_hash, span_hash, words

LENGTH, GRAM = 400, 64
MANY = 500
#: Words of a passage, the bytes of a word's code, and the codes of a gram. 49 words of a passage of over 50 are whole wherever
#: it stands, even if its first and last word run into their neighbours.
WORDS, CODE, GRAM_WORDS = 49, 8, 8
#: Bytes of contexts that are sorted together, hashes gathered before a block is made, bytes a task remembers to send once.
SORT_BYTES, BLOCK_HASHES, REMEMBER_BYTES = 1 << 20, 2_000_000, 16 << 20
#: Bytes of contexts in a range of an order that is split.
RANGE_BYTES = 4 << 20


class Anchors:
    """Anchors of several texts that stand one after another: the text, the place of the anchor, its hash, and the first
    and last start of the windows that picked it. Windows and anchors start at multiples of ``step``, as the texts do."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int, gram: int, step: int = 1):
        n, width = len(data), (length - gram) // step + 1
        empty = np.zeros(0, np.int64)
        self.doc = self.place = self.first = self.last = empty
        self.hash = np.zeros(0, np.uint64)
        size = np.diff(bounds)
        if n < length or (size < length).all():
            return
        prefix = prefix_hash(data)
        at = np.arange(0, n - gram + 1, step)
        h = mix(span_hash(prefix, at, at + gram))
        ranked = (h & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)  # the place breaks ties, leftmost first
        whole = -(-len(ranked) // width) * width
        padded = np.full(whole, np.uint64(2**64 - 1))
        padded[: len(ranked)] = ranked
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(0, n - length + 1, step)
        k = np.arange(len(starts))
        picked = (np.minimum(behind[k], ahead[k + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size // step)[: len(starts)]
        fits = starts + length <= bounds[1:][owner]
        starts, picked, owner = starts[fits], picked[fits], owner[fits]
        new = np.ones(len(starts), bool)
        new[1:] = (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1])
        k = np.flatnonzero(new)
        self.doc, self.place, self.first = owner[k], picked[k], starts[k]
        self.last = np.append(starts[k[1:] - 1], starts[-1])
        self.hash = h[self.place // step]

    def only(self, chosen: np.ndarray) -> Anchors:
        for name in ("doc", "place", "first", "last", "hash"):
            setattr(self, name, getattr(self, name)[chosen])
        return self


def _read(column: pa.Array, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts and where each begins; with a step of ``CODE``, the codes of their words."""
    data, bounds = flat(column)
    if step == 1:
        return data, bounds
    _, start, end, first = words(data, bounds)
    h = span_hash(prefix_hash(data), start, end) if len(start) else np.zeros(0, np.uint64)
    return mix(h + (end - start).astype(np.uint64)).astype("<u8").view(np.uint8), first * CODE


def _word_bytes(gone: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which bytes of the texts go with the words whose codes are gone: the words, and the white space from each to the next
    word of its text; what stands before the first of them stays."""
    _, start, end, first = words(data, bounds)
    lost = gone.reshape(-1, CODE).all(1)
    until = np.append(start[1:], 0)[: len(start)]
    final = first[1:][first[1:] > first[:-1]] - 1
    until[final] = end[final]
    delta = np.zeros(len(data) + 1, np.int64)
    np.add.at(delta, start[lost], 1)
    np.add.at(delta, until[lost], -1)
    return np.cumsum(delta[:-1]) > 0


def _digest(*parts: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(b"".join(parts))
    return d >> 64, d & (2**64 - 1)


# ---- sorted arrays of one key, in parts by its high bits ----------------------------------------------------------------


class Shelf:
    """Sorted 64-bit keys with values, in files by ranges of the key."""

    def __init__(self, folder: str, name: str, n_parts: int):
        self.folder, self.name, self.n_parts = folder, name, n_parts
        self.sizes: dict[int, tuple[int, ...]] = {}

    def part_of(self, key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(32)) * np.uint64(self.n_parts) >> np.uint64(32)).astype(np.int64)

    def path(self, part: int, column: str) -> str:
        return f"{self.folder}/{self.name}-{column}-{part:05d}"

    def array(self, part: int, column: str, kind: str, size: int) -> np.ndarray:
        return mapped(self.path(part, column), kind, size)

    def find(self, key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, indices into ``key``, first place of each in the part) of the keys that are there."""
        part = self.part_of(key)
        for p in np.unique(part).tolist():
            n = self.sizes.get(p, (0,))[0]
            if not n:
                continue
            here = np.flatnonzero(part == p)
            known = self.array(p, "key", "<u8", n)
            at = np.minimum(np.searchsorted(known, key[here]), n - 1)
            hit = known[at] == key[here]
            yield p, here[hit], at[hit]


# ---- pass 1 -------------------------------------------------------------------------------------------------------------


def _repeated_anchors(docs: DataFrame, text: str, folder: str, n_parts: int, length: int, gram: int, step: int) -> Shelf:
    shelf = Shelf(folder, "anchor", n_parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for whole in batches:
            for batch in slices(whole, text):
                k, c = np.unique(Anchors(*_read(batch.column(text), step), length, gram, step).hash, return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > BLOCK_HASHES:
                    k, c = summed(keys, counts)
                    yield blocks(k, c, shelf.part_of(k))
                    keys, counts, held = [], [], 0
        k, c = summed(keys, counts)
        yield blocks(k, c, shelf.part_of(k))

    def write(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        k, c = merged(table)
        k, c = k[c > 1], c[c > 1]
        save(shelf.path(p, "key"), k.astype("<u8"))
        save(shelf.path(p, "count"), np.minimum(c, 2**32 - 1).astype("<u4"))
        return pa.table({"part": pa.array([p], pa.int32()), "n": [len(k)]})

    for p, n in docs.select(text).mapInArrow(released(count, "arrays"), BLOCK).groupBy("part").applyInArrow(released_group(write), "part int, n long").collect():
        shelf.sizes[p] = (n,)
    return shelf


def _anchors_again(shelf: Shelf, data: np.ndarray, bounds: np.ndarray, length: int, gram: int, step: int) -> tuple[Anchors, np.ndarray]:
    """The anchors that occur again, and how often."""
    a = Anchors(data, bounds, length, gram, step)
    n = np.zeros(len(a.hash), np.int64)
    for p, i, at in shelf.find(a.hash):
        n[i] = shelf.array(p, "count", "<u4", shelf.sizes[p][0])[at]
    return a.only(n > 1), n[n > 1]


def _context_keys(a: Anchors, view: bytes, length: int) -> list[tuple[int, int]]:
    """Digests of contexts; the place of the anchor in them counts too."""
    return [_digest(view[s : e + length], (p - s).to_bytes(4, "little")) for s, e, p in zip(a.first.tolist(), a.last.tolist(), a.place.tolist(), strict=True)]


# ---- pass 2: the suffix sort ----------------------------------------------------------------------------------------------


class Contexts:
    """Contexts of several anchor hashes that stand in one buffer; ``group`` ascending."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, group: np.ndarray, length: int):
        self.buffer, self.group, self.length = buffer, group, length
        self.left, self.right = anchor, size - anchor  # bytes before the anchor and from it on
        self.at = start + anchor
        self.prefix = prefix_hash(buffer)
        self.turn = powers(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64), len(buffer) + 1)
        self.begin = np.searchsorted(group, group, side="left")
        self.end = np.searchsorted(group, group, side="right")

    def _hash(self, i: np.ndarray, n: np.ndarray, forward: bool) -> np.ndarray:
        """Of the ``n`` bytes from the anchor of ``i`` on, or before it."""
        a = self.at[i]
        return (self.prefix[a + n] - self.prefix[a]) * self.turn[a] if forward else (self.prefix[a] - self.prefix[a - n]) * self.turn[a - n]

    def extension(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Bytes in common from the anchors of ``i`` and ``j`` on (or before them), by binary search over hashes."""
        side = self.right if forward else self.left
        low, high = np.zeros(len(i), np.int64), np.minimum(side[i], side[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self._hash(i, mid, forward) == self._hash(j, mid, forward)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        side = self.right if forward else self.left
        n = self.extension(i, j, forward)
        out = side[i] < side[j]
        differ = n < np.minimum(side[i], side[j])
        step = n[differ] if forward else -n[differ] - 1
        out[differ] = self.buffer[self.at[i[differ]] + step] < self.buffer[self.at[j[differ]] + step]
        return out

    def before(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Whether ``i`` stands before ``j`` in the order of one side and, where that side is equal, of the other."""
        out = self.less(i, j, forward)
        side = self.right if forward else self.left
        tied = np.flatnonzero(~out & (side[i] == side[j]))
        tied = tied[self.extension(i[tied], j[tied], forward) == side[i[tied]]]
        out[tied] = self.less(i[tied], j[tied], not forward)
        return out

    def sort(self, forward: bool) -> np.ndarray:
        """The contexts of each group in the order of their suffixes (or reversed prefixes): a mergesort, all groups at a
        time. Runs are merged by ranking each member of one in the other by binary search."""
        order = np.arange(len(self.at))
        place = order - self.begin
        size = self.end - self.begin
        width = 1
        while width < (size.max() if len(size) else 0):
            t = np.flatnonzero(size > width)
            begin, end, r = self.begin[t], self.end[t], place[t]
            run = r // width
            low = np.minimum(begin + (run ^ 1) * width, end)
            high = np.minimum(low + width, end)
            first, later = low.copy(), (run & 1).astype(bool)
            while (low < high).any():
                mid = np.minimum((low + high) >> 1, end - 1)
                other, own = order[mid], order[t]
                # The earlier run stands before equals of the later one.
                before = np.where(later, ~self.before(own, other, forward), self.before(other, own, forward))
                going = low < high
                low = np.where(going & before, mid + 1, low)
                high = np.where(going & ~before, mid, high)
            to = begin + (run & ~1) * width + (r - run * width) + (low - first)
            moved = order.copy()
            moved[to] = order[t]
            order = moved
            width *= 2
        return order

    def same_bytes(self, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the bytes from ``left`` before to ``right`` after the anchors are equal."""
        n = left + right
        base = np.cumsum(n) - n
        offset = np.arange(int(n.sum())) - np.repeat(base, n)
        equal = self.buffer[np.repeat(self.at[i] - left, n) + offset] == self.buffer[np.repeat(self.at[j] - left, n) + offset]
        return np.add.reduceat(equal, base) == n if len(n) else np.zeros(0, bool)

    def neighbours(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of contexts of one group that stand next to each other, and the bytes they share before and from the anchor on;
        what is long enough to matter has been compared byte by byte."""
        one = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]]) if len(order) > 1 else np.zeros(0, np.int64)
        i, j = order[one], order[one + 1]
        right, left = self.extension(i, j, True), self.extension(i, j, False)
        use = np.flatnonzero(left + right >= self.length)
        for k in use[~self.same_bytes(i[use], j[use], left[use], right[use])].tolist():  # different bytes with one hash
            left[k], right[k] = self._by_bytes(i[k], j[k])
        return i, j, left, right

    def repeated(self) -> list[list[tuple[int, int]]]:
        """For each context the windows that another context of its group has too, as ranges of their starts in it."""
        m, length = len(self.at), self.length
        low_o, high_o = length - self.right, self.left  # a window starts o bytes before the anchor
        found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
        best_left, best_right = np.zeros(m, np.int64), np.zeros(m, np.int64)
        spans = []
        for forward, best in ((True, best_right), (False, best_left)):
            i, j, left, right = self.neighbours(self.sort(forward))
            np.maximum.at(best, i, right if forward else left)
            np.maximum.at(best, j, right if forward else left)
            spans += [(i, left, right), (j, left, right)]
        left_over = np.zeros(m, np.int64)
        cover = [np.concatenate(x) for x in zip(*spans, strict=True)] if spans else [np.zeros(0, np.int64)] * 3
        for i, left, right in zip(*(x.tolist() for x in cover), strict=True):
            a, b = max(length - right, int(low_o[i])), min(left, int(high_o[i]))
            if a <= b:
                found[i].append((a, b))
        for i in range(m):
            found[i] = _joined(found[i])
            a, b = max(length - int(best_right[i]), int(low_o[i])), min(int(best_left[i]), int(high_o[i]))
            left_over[i] = max(0, b - a + 1) - sum(max(0, min(y, b) - max(x, a) + 1) for x, y in found[i])
        for g in np.unique(self.group[left_over > 0]):
            self._all_windows(np.flatnonzero(self.group == g), found)
        return [[(int(high_o[i]) - b, int(high_o[i]) - a) for a, b in found[i]] for i in range(m)]

    def _by_bytes(self, i: int, j: int) -> tuple[int, int]:
        a, b = int(self.at[i]), int(self.at[j])
        right, left = min(self.right[i], self.right[j]), min(self.left[i], self.left[j])
        x = np.flatnonzero(self.buffer[a : a + right] != self.buffer[b : b + right])
        y = np.flatnonzero(self.buffer[a - left : a][::-1] != self.buffer[b - left : b][::-1])
        return (int(y[0]) if len(y) else int(left)), (int(x[0]) if len(x) else int(right))

    def _all_windows(self, those: np.ndarray, found: list) -> None:
        """Find the repeated windows of one group by the hash of each."""
        low, high = self.length - self.right[those], self.left[those]
        n = high - low + 1
        i = np.repeat(those, n)
        o = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        start = self.at[i] - o
        h = span_hash(self.prefix, start, start + self.length)
        order = np.lexsort((i, h, o))
        i, o, h, start = i[order], o[order], h[order], start[order]
        same = np.flatnonzero((o[1:] == o[:-1]) & (h[1:] == h[:-1]))
        hits = np.zeros(len(i), bool)
        for k in same.tolist():
            if np.array_equal(self.buffer[start[k] : start[k] + self.length], self.buffer[start[k + 1] : start[k + 1] + self.length]):
                hits[k] = hits[k + 1] = True
        for k in np.flatnonzero(hits).tolist():
            found[i[k]].append((int(o[k]), int(o[k])))
        for k in those.tolist():
            found[k] = _joined(found[k])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (both ends included) that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_CONTEXT = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor_hash", "key", "check", "anchor", "times")] + [T.StructField("often", T.BooleanType()), T.StructField("data", T.BinaryType())])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _contexts(docs: DataFrame, text: str, anchors: Shelf, length: int, gram: int, many: int, step: int) -> DataFrame:
    """Contexts of the anchors that occur again, each once from a task, with its occurrences; ``often``: over ``many`` of the anchor."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        held = 0

        def out() -> pa.RecordBatch:
            rows = list(seen.items())
            columns = [[_signed(v[0]) for _, v in rows], [_signed(k[0]) for k, _ in rows], [_signed(k[1]) for k, _ in rows], [v[1] for _, v in rows], [v[2] for _, v in rows]]
            seen.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([v[4] for _, v in rows], pa.bool_()), binary_array([v[3] for _, v in rows])], _CONTEXT.names)

        for whole in batches:
            for batch in slices(whole, text):
                data, bounds = _read(batch.column(text), step)
                a, n = _anchors_again(anchors, data, bounds, length, gram, step)
                view = data.tobytes()
                for key, h, s, e, p, often in zip(_context_keys(a, view, length), a.hash.tolist(), a.first.tolist(), a.last.tolist(), a.place.tolist(), (n > many).tolist(), strict=True):
                    if (was := seen.get(key)) is not None:
                        was[2] += 1
                    else:
                        seen[key] = [h, p - s, 1, view[s : e + length], often]
                        held += e + length - s
                if held > REMEMBER_BYTES:
                    yield out()
                    held = 0
        yield out()

    return docs.select(text).mapInArrow(released(kernel, "arrays"), _CONTEXT)


_RANGES = "part int, key binary, check binary, n binary, ranges binary"


def _repeated_windows(contexts: DataFrame, shelf: Shelf, length: int) -> DataFrame:
    """Blocks of contexts that have repeated windows: keys, the ranges of window starts and how many each has."""
    names = ["anchor_hash", "key", "check", "anchor", "times", "data"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: list[tuple]) -> pa.RecordBatch:
            """``rows``: whole anchor hashes, sorted by hash and key."""
            unique: list[list] = []
            for h, key, check, anchor, times, data in rows:
                if unique and unique[-1][:3] == [h, key, check]:
                    if unique[-1][5] != data:
                        raise ValueError("two contexts with one digest")
                    unique[-1][4] += times
                else:
                    unique.append([h, key, check, anchor, times, data])
            size = np.array([len(u[5]) for u in unique], np.int64)
            group = np.unique(np.array([u[0] for u in unique], np.int64), return_inverse=True)[1]
            several = np.bincount(group)[group] > 1
            ranges: list[list[tuple[int, int]]] = [[(0, int(s) - length)] if u[4] > 1 else [] for u, s in zip(unique, size, strict=True)]
            some = np.flatnonzero(several)
            some = some[np.argsort(group[some], kind="stable")]
            if len(some):
                buffer = np.frombuffer(b"".join([unique[i][5] for i in some]), np.uint8)
                anchor = np.array([unique[i][3] for i in some], np.int64)
                made = Contexts(buffer, np.cumsum(size[some]) - size[some], size[some], anchor, group[some], length).repeated()
                for i, r in zip(some.tolist(), made, strict=True):
                    ranges[i] = ranges[i] or r
            hit = [i for i, r in enumerate(ranges) if r]
            key = np.array([unique[i][1] for i in hit], np.int64).astype(np.uint64)
            check = np.array([unique[i][2] for i in hit], np.int64).astype(np.uint64)
            return _range_blocks(shelf, key, check, [ranges[i] for i in hit])

        rows, held = [], 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if held > SORT_BYTES and r[0] != rows[-1][0]:
                    yield of(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[5])
        if rows:
            yield of(rows)

    ordered = contexts.select(*names).repartition(shelf.n_parts, "anchor_hash").sortWithinPartitions("anchor_hash", "key", "check")
    return ordered.mapInArrow(released(kernel, "arrays"), _RANGES)


def _range_blocks(shelf: Shelf, key: np.ndarray, check: np.ndarray, ranges: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    part = shelf.part_of(key)
    rows = []
    for p in np.unique(part).tolist():
        here = np.flatnonzero(part == p).tolist()
        flat_ranges = np.array([x for i in here for pair in ranges[i] for x in pair], "<u2")
        rows.append((p, key[here].astype("<u8").tobytes(), check[here].astype("<u8").tobytes(), np.array([len(ranges[i]) for i in here], "<u4").tobytes(), flat_ranges.tobytes()))
    columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(binary_array(list(c)) for c in columns[1:])], ["part", "key", "check", "n", "ranges"])


def _write_ranges(made: DataFrame, shelf: Shelf) -> None:
    def write(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        key, check, n, ranges = (np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in (("key", "<u8"), ("check", "<u8"), ("n", "<u4"), ("ranges", "<u2")))
        order = np.argsort(key, kind="stable")
        n = n.astype(np.int64)
        to = np.cumsum(n) - n
        n_sorted = n[order]
        pick = np.repeat(to[order], n_sorted) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n_sorted) - n_sorted, n_sorted)
        save(shelf.path(p, "key"), key[order])
        save(shelf.path(p, "check"), check[order])
        save(shelf.path(p, "to"), np.cumsum(n_sorted).astype("<u8"))
        save(shelf.path(p, "ranges"), ranges.reshape(-1, 2)[pick])
        return pa.table({"part": pa.array([p], pa.int32()), "n": [len(key)], "ranges": [int(n.sum())]})

    for p, n, r in made.groupBy("part").applyInArrow(released_group(write), "part int, n long, ranges long").collect():
        shelf.sizes[p] = (n, r)


# ---- the suffix sort of very frequent anchors, over many tasks -----------------------------------------------------------------

_SIDES = "forward boolean, anchor_hash long, one binary, other binary, key long, check long, times long"
_NEIGHBOURS = "anchor_hash long, key long, check long, times long, own_left int, own_right int, left int, right int, task int, last boolean, forward boolean, one binary, other binary"


def _sides(hot: DataFrame) -> DataFrame:
    """Each context twice, with what an order looks at first and next: the bytes from the anchor on, and those before it
    backwards; and the reverse."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, data = batch.column("anchor").to_pylist(), batch.column("data").to_pylist()
            right = binary_array([d[p:] for d, p in zip(data, anchors, strict=True)])
            left = binary_array([d[:p][::-1] for d, p in zip(data, anchors, strict=True)])
            rest = [batch.column(c) for c in ("key", "check", "times")]
            for forward, one, other in ((True, right, left), (False, left, right)):
                yield pa.RecordBatch.from_arrays([pa.array([forward] * batch.num_rows, pa.bool_()), batch.column("anchor_hash"), one, other, *rest], [n.split()[0] for n in _SIDES.split(", ")])

    return hot.select("anchor_hash", "key", "check", "anchor", "times", "data").mapInArrow(released(kernel, "arrays"), _SIDES)


def _sided(forward: bool, one: list[bytes], other: list[bytes], anchor: list[int], length: int) -> Contexts:
    """Contexts of one direction; ``anchor`` in ascending order of groups."""
    data = [o[::-1] + x if forward else x[::-1] + o for x, o in zip(one, other, strict=True)]
    size = np.array([len(d) for d in data], np.int64)
    left = np.array([len(o if forward else x) for x, o in zip(one, other, strict=True)], np.int64)
    group = np.unique(np.array(anchor, np.int64), return_inverse=True)[1]
    return Contexts(np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size, size, left, group, length)


def _neighbours(hot: DataFrame, length: int, n_ranges: int, files: int) -> DataFrame:
    """Rows of contexts and what they share with a neighbour in either order, one row with nothing for each; with a ``task``,
    the first and the last context of a range in its order."""
    names = [n.split()[0] for n in _NEIGHBOURS.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches))  # a range has about RANGE_BYTES
        for forward in (True, False):
            part = table.filter(pa.compute.equal(table["forward"], forward)).sort_by("anchor_hash") if len(table) else table
            if not len(part):
                continue
            made = _sided(forward, part["one"].to_pylist(), part["other"].to_pylist(), part["anchor_hash"].to_pylist(), length)
            order = made.sort(forward)
            i, j, left, right = made.neighbours(order)
            ends = order[[0, -1]]
            alone = np.arange(len(order)) if forward else order[:0]
            who = np.concatenate([i, j, alone, ends])
            n = len(who) - 2
            zero = np.zeros(len(alone) + 2, np.int64)
            rows = part.take(pa.array(who)).combine_chunks()
            nothing = [None] * n
            columns = [
                *(rows[c] for c in ("anchor_hash", "key", "check", "times")),
                *(pa.array(x, pa.int32()) for x in (made.left[who], made.right[who], np.concatenate([left, left, zero]), np.concatenate([right, right, zero]))),
                pa.array([*nothing, task, task], pa.int32()),
                pa.array([*nothing, False, True], pa.bool_()),
                pa.array([*nothing, forward, forward], pa.bool_()),
                *(pa.concat_arrays([pa.nulls(n, pa.binary()), rows[c].combine_chunks().slice(n)]) for c in ("one", "other")),
            ]
            yield from pa.table(columns, names).combine_chunks().to_batches()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares the last context of a range with the first of the next, of the same anchor."""
        for batch in batches:
            out = []
            for pair in batch.to_pylist():
                both = (pair["before"], pair["after"])
                made = _sided(pair["forward"], [x["one"] for x in both], [x["other"] for x in both], [0, 0], length)
                _, _, left, right = made.neighbours(np.arange(2))
                out += [x | {"left": int(left[0]), "right": int(right[0]), "task": None, "last": None, "forward": None, "one": None, "other": None} for x in both]
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n.split()[0], kinds[n.split()[1]]) for n in _NEIGHBOURS.split(", ")])
    ranged = _sides(hot).repartitionByRange(n_ranges, "forward", "anchor_hash", "one", "other")
    found = written(ranged.mapInArrow(released(kernel, "arrays"), _NEIGHBOURS), "neighbours", files)
    # Each range is joined with the next that has rows of its direction; only the numbers of ranges stand in one window.
    ends = found.where("task IS NOT NULL")
    following = F.lead("task").over(Window.partitionBy("forward").orderBy("task"))
    chain = ends.select("forward", "task").distinct().withColumn("next", following).where("next IS NOT NULL")
    before = ends.where("last").join(chain, ["forward", "task"]).select("forward", "anchor_hash", "next", F.struct(*names).alias("before"))
    after = ends.where("NOT last").select("forward", "anchor_hash", F.col("task").alias("next"), F.struct(*names).alias("after"))
    pairs = before.join(after, ["forward", "anchor_hash", "next"]).select("forward", "before", "after")
    return found.where("task IS NULL").unionByName(pairs.mapInArrow(released(across), _NEIGHBOURS))


_SPANS = "anchor_hash long, key long, check long, high int, low int, best int, found array<int>, open array<int>"


def _spans(neighbours: DataFrame, length: int) -> DataFrame:
    """For each context the offsets (bytes before the anchor) of windows found repeated, and of those a third context might
    have: flat lists of first and last. ``low`` and ``best`` are the least and greatest offset that any other could share."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            columns = (batch.column(c).to_pylist() for c in ("times", "own_left", "own_right", "shared"))
            for times, own_left, own_right, shared in zip(*columns, strict=True):
                least, most = length - own_right, own_left
                low = max(length - max(x["right"] for x in shared), least)
                best = min(max(x["left"] for x in shared), most)
                spans = [(max(length - x["right"], least), min(x["left"], most)) for x in shared]
                found = [(least, most)] if times > 1 else _joined([s for s in spans if s[0] <= s[1]])
                still, at = [], low
                for a, b in found:
                    if at < a:
                        still += [at, min(a - 1, best)] if at <= best else []
                    at = max(at, b + 1)
                if at <= best:
                    still += [at, best]
                for o, v in zip(out, (most, low, best, [x for s in found for x in s], still), strict=True):
                    o.append(v)
            kinds = [pa.int32()] * 3 + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("anchor_hash", "key", "check")), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], [n.split()[0] for n in _SPANS.split(", ")])

    # A context has two neighbours in each order.
    grouped = neighbours.groupBy("anchor_hash", "key", "check", "times", "own_left", "own_right").agg(F.collect_list(F.struct("left", "right")).alias("shared"))
    return grouped.mapInArrow(released(kernel, "arrays"), _SPANS)


def _window_keys(view: bytes, starts: list[int], length: int, more: bytes) -> np.ndarray:
    """The two halves of the digests of windows, in two columns; ``more`` counts too."""
    made = [xxhash.xxh3_128_digest(view[s : s + length] + more) for s in starts]
    return np.frombuffer(b"".join(made), ">u8").reshape(-1, 2).astype(np.uint64)


def _third_contexts(hot: DataFrame, spans: DataFrame, shelf: Shelf, length: int, step: int, files: int) -> DataFrame:
    """``spans`` with all repeated windows in ``found``: those still open are compared with all of their anchor, by digest and then by their bytes."""
    asked = spans.where("size(open) > 0").groupBy("anchor_hash").agg(F.min("low").alias("ask_low"), F.max("best").alias("ask_high"))
    rows = spans.join(asked, "anchor_hash").join(hot.select("key", "check", "data"), ["key", "check"])
    rows = written(rows.select("anchor_hash", "key", "check", "high", "low", "best", "found", "open", "ask_low", "ask_high", "data"), "open", files)

    def windows(batch: pa.RecordBatch, opens: bool) -> Iterator[tuple[int, list[int], np.ndarray]]:
        """For each row the offsets of its windows, all that others could ask for or only those open, and their digests."""
        columns = (batch.column(c).to_pylist() for c in ("anchor_hash", "high", "low", "best", "open", "ask_low", "ask_high", "data"))
        for k, (anchor, high, low, best, still, ask_low, ask_high, data) in enumerate(zip(*columns, strict=True)):
            pairs = zip(still[::2], still[1::2], strict=True) if opens else [(max(low, ask_low), min(best, ask_high))]
            offsets = [o for a, b in pairs for o in range(a, b + 1) if (high - o) % step == 0]
            if offsets:
                keys = np.concatenate([_window_keys(data, [high - o], length, anchor.to_bytes(8, "little", signed=True) + o.to_bytes(4, "little", signed=True)) for o in offsets])
                yield k, offsets, keys

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [keys for _, _, keys in windows(batch, False)]
            both = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
            part = shelf.part_of(both[:, 0])
            rows = [(p, both[part == p].tobytes()) for p in np.unique(part).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), binary_array([b for _, b in rows])], ["part", "keys"])

    def write(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        both = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64).reshape(-1, 2)
        pairs, times = np.unique(both, axis=0, return_counts=True)  # contexts are different, so each has a window once
        pairs = pairs[times > 1]
        save(shelf.path(p, "key"), pairs[:, 0].astype("<u8"))
        save(shelf.path(p, "check"), pairs[:, 1].astype("<u8"))
        return pa.table({"part": pa.array([p], pa.int32()), "n": [len(pairs)]})

    for p, n in rows.mapInArrow(released(packed), "part int, keys binary").groupBy("part").applyInArrow(released_group(write), "part int, n long").collect():
        shelf.sizes[p] = (n,)

    def repeated(keys: np.ndarray) -> np.ndarray:
        """Which digests stand more than once."""
        out = np.zeros(len(keys), bool)
        for p, i, at in shelf.find(keys[:, 0]):
            n = shelf.sizes[p][0]
            key, check = shelf.array(p, "key", "<u8", n), shelf.array(p, "check", "<u8", n)
            while len(i):
                hit = check[at] == keys[i, 1]
                out[i[hit]] = True
                i, at = i[~hit], at[~hit] + 1
                again = (at < n) & (key[np.minimum(at, n - 1)] == keys[i, 0])
                i, at = i[again], at[again]
        return out

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the windows whose digests stand more than once, each digest once from a batch after its bytes were compared."""
        for batch in batches:
            own: dict[tuple[int, int], bytes] = {}
            columns = [batch.column(c).to_pylist() for c in ("anchor_hash", "high", "data")]
            for k, offsets, keys in windows(batch, False):
                anchor, high, data = (c[k] for c in columns)
                for n in np.flatnonzero(repeated(keys)).tolist():
                    at = high - offsets[n]
                    body = data[at : at + length] + anchor.to_bytes(8, "little", signed=True) + offsets[n].to_bytes(4, "little", signed=True)
                    if own.setdefault((int(keys[n, 0]), int(keys[n, 1])), body) != body:
                        raise ValueError("two windows with one digest")
            key = np.array(list(own), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), binary_array(list(own.values()))], ["key", "check", "body"])

    # Bytes are compared for every digest: a task's first, then those of all tasks.
    seen = rows.mapInArrow(released(bodies, "arrays"), "key long, check long, body binary").groupBy("key", "check").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    if not seen.where("least <> most").isEmpty():
        raise ValueError("two windows with one digest")

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(zip(f[::2], f[1::2], strict=True)) for f in batch.column("found").to_pylist()]
            for k, offsets, keys in windows(batch, True):
                found[k] += [(offsets[n], offsets[n]) for n in np.flatnonzero(repeated(keys)).tolist()]
            lists = pa.array([[x for s in _joined(f) for x in s] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "check", "high")), lists], ["key", "check", "high", "found"])

    settled = spans.join(asked.select("anchor_hash"), "anchor_hash", "left_anti").select("key", "check", "high", "found")
    return settled.unionByName(rows.mapInArrow(released(more, "arrays"), "key long, check long, high int, found array<int>"))


def _often_repeated(contexts: DataFrame, shelf: Shelf, windows: Shelf, length: int, step: int, files: int) -> DataFrame | None:
    """What ``_repeated_windows`` makes, for the contexts of very frequent anchors; None if there are none."""
    hot = contexts.where("often").groupBy("anchor_hash", "key", "check", "anchor", "data").agg(F.sum("times").alias("times"))
    hot = written(hot, "often", files)
    n_bytes = hot.agg(F.sum(F.octet_length("data"))).first()[0]
    if not n_bytes:
        return None
    spans = written(_spans(_neighbours(hot, length, max(1, -(-2 * n_bytes // RANGE_BYTES)), files), length), "spans", files)
    if spans.where("size(open) > 0").isEmpty():
        done = spans.select("key", "check", "high", "found")
    else:
        done = _third_contexts(hot, spans, windows, length, step, files)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, check = (batch.column(c).to_numpy().astype(np.uint64) for c in ("key", "check"))
            lists = [[(h - b, h - a) for a, b in zip(f[::2], f[1::2], strict=True)] for h, f in zip(batch.column("high").to_pylist(), batch.column("found").to_pylist(), strict=True)]
            yield _range_blocks(shelf, key, check, lists)

    return done.where("size(found) > 0").mapInArrow(released(kernel, "arrays"), _RANGES)


# ---- pass 3 ----------------------------------------------------------------------------------------------------------------


def _lookup(shelf: Shelf, key: np.ndarray, check: np.ndarray, start: np.ndarray, length: int, delta: np.ndarray) -> None:
    """Add the byte ranges of the contexts found on the shelf to ``delta``."""
    for p, i, at in shelf.find(key):
        n, r = shelf.sizes[p]
        checks, to, ranges = shelf.array(p, "check", "<u8", n), shelf.array(p, "to", "<u8", n), shelf.array(p, "ranges", "<u2", 2 * r).reshape(-1, 2)
        keys = shelf.array(p, "key", "<u8", n)
        while len(i):
            hit = checks[at] == check[i]
            ends, starts = to[at[hit]].astype(np.int64), start[i[hit]]
            first = np.where(at[hit] > 0, to[np.maximum(at[hit] - 1, 0)], 0).astype(np.int64)
            m = ends - first
            rows = np.repeat(first, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            base = np.repeat(starts, m)
            np.add.at(delta, base + ranges[rows, 0], 1)
            np.add.at(delta, base + ranges[rows, 1] + length, -1)
            i, at = i[~hit], at[~hit] + 1  # another context with the same first half
            more = (at < n) & (keys[np.minimum(at, n - 1)] == key[i])
            i, at = i[more], at[more]


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` (binary).

    Every byte covered by a string of ``length`` bytes that also starts anywhere else in the corpus, the same text included, is
    removed; strings are judged on the input. Matches don't cross texts. Null counts as empty; texts shorter than
    ``length`` stay whole. Of texts repeated in full all copies go, if they are that long. An empty table gives no rows.
    Columns of the names above that ``docs`` brings along are replaced.
    """
    return _removed(docs, text, length, gram, many, 1)


def remove_passages(docs: DataFrame, text: str = "text", n_words: int = WORDS, gram: int = GRAM_WORDS, many: int = MANY) -> DataFrame:
    """As ``remove_repeats``, in words: every word covered by ``n_words`` words in a row that also stand anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+``, equal if their bytes are (by hashes of 64 bits); the white space between them doesn't
    count. Words go with the white space up to the next, so that the words around a passage stay apart.
    """
    return _removed(docs, text, n_words * CODE, gram * CODE, many, CODE)


def _removed(docs: DataFrame, text: str, length: int, gram: int, many: int, step: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_bytes")
    folder, files = new_path(spark, "repeats"), files_for(docs, text)
    n_parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), files)
    anchors = _repeated_anchors(docs, text, folder, n_parts, length, gram, step)
    contexts, windows = Shelf(folder, "context", n_parts), Shelf(folder, "window", n_parts)
    around = written(_contexts(docs, text, anchors, length, gram, many, step), "contexts", files)
    found = _repeated_windows(around.where("NOT often"), contexts, length)
    often = _often_repeated(around, contexts, windows, length, step, files)
    _write_ranges(found if often is None else found.unionByName(often), contexts)
    names = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, bounds = _read(batch.column(text), step)
                view = data.tobytes()
                delta = np.zeros(len(data) + 1, np.int64)
                a, _ = _anchors_again(anchors, data, bounds, length, gram, step)
                keys = np.array(_context_keys(a, view, length), np.uint64).reshape(-1, 2)
                _lookup(contexts, keys[:, 0], keys[:, 1], a.first, length, delta)
                gone = np.cumsum(delta[:-1]) > 0
                if step > 1:
                    data, bounds = flat(batch.column(text))
                    gone = _word_bytes(gone, data, bounds)
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = bounds[1:-1][bounds[1:-1] < len(data)]
                opens[inner] = gone[inner]
                removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(opens)])
                kept = data[~gone].tobytes()
                at = (bounds - removed[bounds]).tolist()
                made = [pa.array(np.diff(bounds)), pa.array(np.diff(removed[bounds])), pa.array(np.diff(spans[bounds])), binary_array([kept[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    added = [*(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_bytes", T.BinaryType())]
    return docs.mapInArrow(released(kernel, "arrays"), T.StructType([*docs.schema.fields, *added]))
