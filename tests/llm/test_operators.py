"""Each operator against a plain version of itself, with nulls, ties, empty and long texts, and no rows at all."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recallgrid.llm import bpe, dedup_exact, dedup_lines, dedup_near, dedup_substrings, ngram_lm, packing, sharding, toxicity, video

LOWER = {i: i + 32 for i in range(65, 91)}
RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),), 1)


def lower(text):
    return (text or "").translate(LOWER)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def union_find(items, links):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


# ---- sharding -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_smallest_capacity_is_smallest(seed):
    sizes = np.random.default_rng(seed).integers(1, 50, 40)
    got = sharding.smallest_capacity(sizes, 6)
    feasible = [c for c in range(int(sizes.max()), int(sizes.sum()) + 1) if sharding.greedy(np.cumsum(sizes), c, 6)]
    assert got == feasible[0]
    cuts = sharding.near_equal(np.cumsum(sizes), got, 6)
    parts = np.split(sizes, cuts[:-1])
    assert len(parts) == 6 and max(p.sum() for p in parts) <= got and sum(map(len, parts)) == len(sizes)


def test_shards(docs, rows):
    got = sharding.shard(docs, 5).toPandas()
    assert len(got) == len(rows)
    assert (got["size"] == [len((t or "").encode()) + 1 for t in got.text]).all()
    by = got.assign(t=got.text.fillna("")).groupby("t").shard.nunique()
    assert (by == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    # The hash order of the groups is that of the shards, and no partition of it has a smaller largest shard.
    sized = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("s")).groupBy("h").agg(F.sum("s").alias("s")).toPandas()
    order = sized.assign(u=[int(h) % 2**64 for h in sized.h]).sort_values("u").s.to_numpy()
    assert got.groupby("shard")["size"].sum().max() == sharding.smallest_capacity(order, 5)


def test_shards_of_nothing(empty):
    assert sharding.shard(empty, 4).count() == 0


# ---- media --------------------------------------------------------------------------------------------------------------


def test_frames_decode_alike_both_ways():
    samples = np.random.default_rng(3).integers(0, 256, (3, video.FRAME)).astype(np.uint8)
    coded = video.code_frames(samples)
    assert (video.decode_frames(coded) == samples).all()
    for k in range(3):
        jpeg = video.HEAD + coded[k].tobytes().replace(b"\xff", b"\xff\x00") + video.TAIL
        assert (video.decode_jpeg(jpeg).ravel() == samples[k]).all()


def test_index_of_a_file():
    frames = [b"\xff\xd8abc\xff\xd9", b"\xff\xd8abcd\xff\xd9"]
    avi = video.write_avi(frames)
    index, us = video.read_index(avi)
    assert [avi[a : a + n] for a, n in index] == frames and us == 1_000_000 // video.FRAMES_PER_SECOND
    with pytest.raises(ValueError):
        video.read_index(b"RIFX" + avi[4:])


def test_shots_are_found():
    rng = np.random.default_rng(1)
    dark, light = rng.integers(0, 40, (12, video.FRAME)), rng.integers(180, 255, (9, video.FRAME))
    opens = video.shot_starts(np.concatenate([dark, light, dark]).astype(np.uint8), np.array([0, 33]))
    assert np.flatnonzero(opens).tolist() == [0, 12, 21]


def test_texts_come_back(docs, rows):
    got = video.read(video.store(docs)).select("text", "payload", "clips").toPandas()
    assert len(got) == len(rows)
    for t, payload, clips in zip(got.text, got.payload, got.clips, strict=True):
        raw = (t or "").encode()
        size = max(1, -(-len(raw) // video.FRAME)) * video.FRAME
        assert bytes(payload) == raw + b"\xff" * (size - len(raw))
        assert clips[0]["first_frame"] == 0 and clips[-1]["last_frame"] == size // video.FRAME - 1
        assert all(a["last_frame"] + 1 == b["first_frame"] and a["end_us"] == b["start_us"] for a, b in zip(clips[:-1], clips[1:], strict=True))


def test_clip_rows_and_null_files(spark, empty):
    assert video.clip_rows(video.store(empty).select("doc_id", "media")).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert video.read(null).first()["payload"] is None


# ---- exact dedup ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hash_bytes", [16, 1])
def test_exact_dedup(docs, rows, hash_bytes):
    """With one byte of hash most chunk names are ambiguous and must be told apart by their bytes."""
    got = dedup_exact.exact_dedup(docs.select("doc_id", "text", "kept", "recipe"), hash_bytes=hash_bytes).toPandas()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(lower(t).encode()).digest()].append(i)
    assert len(got) == len(rows)
    for r in got.itertuples():
        ids = groups[bytes(r.text_sha)]
        best = max((i for i in ids if i is not None), default=None)
        assert r.group_size == len(ids)
        assert (best is None and np.isnan(r.keep_id)) or r.keep_id == best
    kept = got[got.kept].groupby(got.text_sha.map(bytes)).size()
    assert len(kept) == len(groups) and (kept == 1).all()


def test_chunks_resist_shifts():
    data = np.random.default_rng(2).integers(97, 123, 60_000).astype(np.uint8)
    whole = dedup_exact.cuts(data, np.array([0, len(data)]))[0]
    moved = dedup_exact.cuts(np.concatenate([data[:100], data]), np.array([0, 100, len(data) + 100]))
    assert [c - 100 for c in moved[1]] == whole and whole[-1] == len(data)
    assert all(b - a <= dedup_exact.MOST for a, b in zip([0, *whole], whole, strict=False))
    late = dedup_exact.cuts(data[7:], np.array([0, len(data) - 7]))[0]
    assert len({c + 7 for c in late} & set(whole)) > len(whole) // 2


def test_keep_one(docs, rows, empty):
    kept = dedup_exact.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(lower(t) for t in kept.toPandas().text) == sorted({lower(t) for _, t in rows})
    assert dedup_exact.exact_dedup(empty).count() == 0


# ---- toxicity -------------------------------------------------------------------------------------------------------------


def spelled_words(rng, n):
    """``n`` random words over four letters with a space around each, and where each starts."""
    words = [bytes([32, *rng.integers(97, 101, rng.integers(1, 9)).tolist(), 32]) for _ in range(n)]
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])


def grams_of(rng, n):
    spelled, where = spelled_words(rng, n)
    owner, size, gram = toxicity._grams(spelled, where)
    label = rng.integers(0, 3, n) == 0
    key, back = np.unique(gram | (size << 48), return_inverse=True)
    counts = np.stack([np.bincount(back, ~label[owner], len(key)), np.bincount(back, label[owner], len(key))], 1).astype(np.int64)
    return key >> 48, key & ((1 << 48) - 1), counts


class PlainSpelling:
    """The same model from dictionaries of byte strings, by its recursive definition."""

    def __init__(self, size, gram, counts):
        grams = {int(g).to_bytes(6, "big")[-int(n) :]: tuple(c) for n, g, c in zip(size, gram, counts.tolist(), strict=True)}
        self.level = {}
        level = {g: c for g, c in grams.items() if len(g) == toxicity.ORDER}
        for n in range(toxicity.ORDER, 0, -1):
            n_classes = 1 if n <= toxicity.SHARED else 2
            level = {g: (c if len(c) == n_classes else (sum(c),)) for g, c in level.items()}
            flat_counts = [x for c in level.values() for x in c]
            once, twice = flat_counts.count(1), flat_counts.count(2)
            d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            contexts = defaultdict(list)
            for g, c in level.items():
                contexts[g[:-1]].append(c)
            self.level[n] = (level, contexts, d, n_classes)
            before = defaultdict(list)
            for g, c in level.items():
                before[g[1:]].append(c)
            to = 1 if n - 1 <= toxicity.SHARED else 2
            level = {g: tuple(sum(any(c) if to == 1 else c[k] > 0 for c in cs) for k in range(to)) for g, cs in before.items()}
            for g, c in grams.items():
                if len(g) == n - 1:
                    level[g] = tuple(x + y for x, y in zip(level.get(g, (0,) * to), c if to == 2 else (sum(c),), strict=True))

    def p(self, gram, cls, n=None):
        n = len(gram) if n is None else n
        if n == 0:
            return 1 / 256
        g = gram[len(gram) - n :]
        level, contexts, d, n_classes = self.level[n]
        k = cls if n_classes == 2 else 0
        below = self.p(gram, cls, n - 1)
        here = [c[k] for c in contexts.get(g[:-1], [])]
        if not sum(here):
            return below
        return (max(level.get(g, (0,) * n_classes)[k] - d, 0) + d * sum(x > 0 for x in here) * below) / sum(here)


def test_probabilities_sum_to_one():
    """Over all 256 next bytes, after contexts of every length that were seen and some that were not, in both classes."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(*grams_of(rng, 300))
    spelled, where = spelled_words(rng, 60)
    _, size, gram = toxicity._grams(spelled, where)
    for n, g in {(int(n), int(g) >> 8) for n, g in zip(size, gram, strict=True)}:
        p = model.probabilities(np.full(256, n), np.arange(256) | (g << 8))
        assert np.allclose(p.sum(0), 1, atol=1e-9) and (p > 0).all()


@pytest.mark.parametrize(("seed", "n"), [(5, 400), (6, 12), (7, 0)])
def test_spelling_equals_a_plain_one(seed, n):
    rng = np.random.default_rng(seed)
    trained = grams_of(rng, n)
    model, plain = toxicity.Model(*trained), PlainSpelling(*trained)
    spelled, where = spelled_words(rng, 80)
    owner, size, gram = toxicity._grams(spelled, where)
    p = model.probabilities(size, gram)
    want = np.array([[plain.p(int(g).to_bytes(6, "big")[-int(k) :], c) for c in (0, 1)] for k, g in zip(size, gram, strict=True)])
    assert np.allclose(p, want, rtol=1e-9)
    ratio, n_bytes = model.word_ratios(spelled, where)
    assert np.allclose(ratio, np.bincount(owner, np.log(want[:, 1] / want[:, 0]), len(where) - 1), atol=1e-9) and (n_bytes == np.diff(where) - 1).all()
    data, bounds = np.delete(spelled, where[1:-1]), np.array([0, len(spelled) - len(where) + 2])  # one space between words
    figures = model.figures(data, bounds)
    assert np.isclose(figures[0, 0], ratio.sum() / n_bytes.sum(), atol=1e-9)


def test_labels_that_repeat_or_disagree(spark, docs):
    """A label row that is there twice counts twice; an id with both labels is an example of both; neither breaks a score."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (1, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


def test_toxic_words_are_learned(spark):
    import random

    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(80)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = "zorr" + rng.choice(["ak", "ik", "ok"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(500, ""), (501, None), (None, "zorrak"), (502, "abcd " * 5000 + "zorrik")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("figures", F.lit("clash"))
    got = toxicity.score(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int").where("doc_id IS NULL OR doc_id % 5 > 0")).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[(got.doc_id % 5 == 0) & (got.doc_id < 400)]
    assert ((held.doc_id % 4 == 0) == (held.predicted == 1)).mean() > 0.95
    assert (got[got.doc_id.isin([500, 501])].predicted == 0).all()


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert (toxicity.score(docs, none).toPandas().predicted == 0).all()
    assert toxicity.score(empty, none).count() == 0


# ---- BPE ------------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs, path), path).select("text", "ids", "decoded").toPandas()
    assert len(got) == len(rows)
    for t, ids, decoded in zip(got.text, got.ids, got.decoded, strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(ids) == want and decoded == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["I'M we'LL", "ΣΑΣ İstanbul ǅ ß", "é Å Ⅷ ½", "a\x85b c\x1cd", "<|startoftext|>x<|endoftext|", "𖨫 \U0001f468‍\U0001f469"])
def test_bpe_odd_texts(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.load(path).encode(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_bpe_of_nothing(empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0


# ---- packing ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_windows_are_cheapest(seed):
    rng = np.random.default_rng(seed)
    where = np.unique(np.append(rng.integers(1, 400, 60), 400))
    where = where[np.append(True, np.diff(where) <= 40)] if (np.diff(where) > 40).any() else where
    penalty, length = rng.integers(0, 20, len(where)), 50
    at, extra = [0, *where.tolist()], [0, *penalty.tolist()]
    best = [0] + [math.inf] * len(where)
    for j in range(1, len(at)):
        best[j] = min((best[i] + length - (at[j] - at[i]) + extra[j] for i in range(j) if at[j] - at[i] <= length), default=math.inf)
    ends = packing.window_ends(where, penalty, length)
    cost = sum(length - (b - a) + extra[at.index(b)] for a, b in zip([0, *ends[:-1]], ends, strict=True))
    assert cost == best[-1] and all(b - a <= length for a, b in zip([0, *ends[:-1]], ends, strict=True))


def test_tails_are_split_where_it_pays():
    for n in (1, 5, 1000, 1024, 1500, 2047, 2048):
        parts = packing.tail_lengths(n, 2048)
        assert sum(parts) == n and max(parts) <= 2048


@pytest.mark.parametrize("stretch", [1 << 19, 700])
def test_pieces_cover_all_tokens(docs, rows, stretch, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), *RANKS, length=256).toPandas()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows if i is not None}
    assert set(got.doc_id) == set(want)
    for i, g in got.sort_values("start").groupby("doc_id"):
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in g.ids])
        assert ids.tolist() == want[i] and (g.doc_tokens == len(want[i])).all()
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 256


def test_packing_of_nothing(empty, docs, rows):
    assert packing.pack(empty, *RANKS).count() == 0
    assert packing.pack(docs, *RANKS).where("doc_id IS NULL AND start = 0").count() == sum(i is None for i, _ in rows)


# ---- repeated strings ---------------------------------------------------------------------------------------------------------


def removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize(("length", "gram", "many"), [(400, 64, 2000), (24, 8, 2000), (24, 8, 2), (16, 4, 50)])
def test_repeated_strings(spark, rows, length, gram, many):
    import random

    rng = random.Random(length)
    base = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(6)]
    small = ["".join(rng.choice([rng.choice(base)[rng.randrange(30) :], "é" * rng.randrange(30), "ab" * rng.randrange(30), "".join(rng.choice("abcd") for _ in range(40))]) for _ in range(rng.randrange(6))) for _ in range(120)]
    texts = small + [t for _, t in rows if len(t or "") < 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_removed", F.lit("clash")).repartition(3)
    got = dedup_substrings.remove_repeats(docs, length=length, gram=gram, many=many).orderBy("doc_id").toPandas()
    want = removed([(t or "").encode() for t in texts], length)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got.itertuples()] == want


def test_hash_collisions_are_seen(monkeypatch):
    """With a hash that is always equal, bytes decide."""
    rng = np.random.default_rng(9)
    shared = rng.integers(97, 99, 60).astype(np.uint8)
    parts = [np.concatenate([rng.integers(97, 99, 20).astype(np.uint8), shared, rng.integers(97, 99, 20).astype(np.uint8)]) for _ in range(2)]
    made = dedup_substrings.Contexts(np.concatenate(parts), np.array([0, 100]), np.array([100, 100]), np.array([40, 40]), np.array([0, 0]), 30)
    want = made.repeated()
    monkeypatch.setattr(dedup_substrings.Contexts, "_hash", lambda self, i, n, forward: np.zeros(len(i), np.uint64))
    assert made.repeated() == want and want[0]


def test_suffixes_are_sorted():
    rng = np.random.default_rng(5)
    parts = [rng.integers(97, 99, rng.integers(30, 60)).astype(np.uint8) for _ in range(40)]
    size = np.array([len(p) for p in parts])
    group = np.sort(rng.integers(0, 4, 40))
    made = dedup_substrings.Contexts(np.concatenate(parts), np.cumsum(size) - size, size, np.full(40, 10), group, 16)
    for forward in (True, False):
        order = made.sort(forward).tolist()
        keys = [(group[i], parts[i][10:].tobytes() if forward else parts[i][:10][::-1].tobytes()) for i in order]
        assert keys == sorted(keys)


def without_passages(texts, n):
    """Texts as (words, white space after each) without the words covered by ``n`` in a row that stand elsewhere."""
    found = [re.findall(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", t) for t in texts]
    seen = Counter(tuple(w for w, _ in f[i : i + n]) for f in found for i in range(len(f) - n + 1))
    out = []
    for t, f in zip(texts, found, strict=True):
        gone = [False] * len(f)
        for i in range(len(f) - n + 1):
            if seen[tuple(w for w, _ in f[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = "".join("" if g else w + s for (w, s), g in zip(f[:-1], gone[:-1], strict=True))
        if f:
            kept += f[-1][1] if gone[-1] else "".join(f[-1])
        out.append(re.match(r"[\x20\x09-\x0D]*", t).group() + kept)
    return out


@pytest.mark.parametrize(("n", "gram", "many"), [(49, 8, 2000), (4, 2, 2000), (4, 2, 2), (3, 1, 50)])
def test_passages(spark, rows, n, gram, many):
    import random

    rng = random.Random(n)
    base = [[rng.choice(["a", "b", "é", "Cd"]) for _ in range(70)] for _ in range(5)]
    small = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n\t"]).join(w for _ in range(rng.randrange(5)) for w in rng.choice(base)[rng.randrange(60) :]) + rng.choice(["", "  "]) for _ in range(120)]
    texts = small + [t or "" for _, t in rows if len(t or "") < 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dedup_substrings.remove_passages(docs, n_words=n, gram=gram, many=many).orderBy("doc_id").toPandas()
    want = without_passages(texts, n)
    assert [bytes(r.kept_bytes).decode() for r in got.itertuples()] == want
    assert [(r.n_bytes, r.n_removed) for r in got.itertuples()] == [(len(t.encode()), len(t.encode()) - len(w.encode())) for t, w in zip(texts, want, strict=True)]
    assert any(t != w for t, w in zip(texts, want, strict=True)) and any(t == w for t, w in zip(texts, want, strict=True) if t)


def test_no_strings(empty):
    assert dedup_substrings.remove_repeats(empty).count() == 0


# ---- near duplicates ----------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [2048, 4])
def test_near_classes(docs, rows, block, monkeypatch):
    monkeypatch.setattr(dedup_near, "BLOCK", block)
    got = dedup_near.near_classes(docs.where("doc_id IS NOT NULL"), 85).toPandas()
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = union_find(sets, links)
    assert len(got) == sum(i is not None for i, _ in rows)
    for r in got.itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_estimates():
    rng = np.random.default_rng(6)
    pool = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[400:2400])
    found = dedup_near.minima(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    sig = dedup_near.signatures(found)
    fields = dedup_near.equal_fields(sig[0], sig[1:])
    low = dedup_near.mix(found) & np.uint64(15)
    assert fields[0] == (low[0] == low[1]).sum()
    assert abs(dedup_near.estimate(fields)[0] - 1600 / 2400) < 0.2


def test_bands_fit_the_threshold():
    """Of 60,000 pairs that share 8 of 10 values all have a band in common at 80; with the 24 bands of 85 some have none."""
    assert dedup_near.bands_for(85) == dedup_near.BANDS
    assert all((1 - (p / 100) ** dedup_near.ROWS) ** dedup_near.bands_for(p) <= dedup_near.MISS for p in range(50, 100))
    rng = np.random.default_rng(80)
    values = rng.integers(0, 2**64, (60_000, 10), dtype=np.uint64)
    a, b = np.sort(values[:, :9]), np.sort(np.delete(values, 8, axis=1))
    starts = np.arange(0, 9 * len(values) + 1, 9)

    def apart(bands):
        one, other = (dedup_near.band_keys(dedup_near.minima(x.ravel(), starts, bands)) for x in (a, b))
        return np.flatnonzero(~(one == other).any(1))

    missed = apart(dedup_near.BANDS)
    assert len(missed) and not len(apart(dedup_near.bands_for(80)))
    for i in missed:
        assert dedup_near.block_links(np.array([5, 6]), np.array([0, 0]), [a[i], b[i]], 80) == [(5, 6)]


def test_links_across_blocks():
    rng = np.random.default_rng(7)
    base = np.sort(rng.integers(1, 2**63, 200, dtype=np.uint64))
    sets = [base, base[3:], np.sort(rng.integers(1, 2**63, 200, dtype=np.uint64))]
    assert dedup_near.block_links(np.array([5, 6, 7]), np.array([0, 1, 1]), sets, 85) == [(5, 6)]
    assert dedup_near.block_links(np.array([5, 6]), np.array([0, 0]), sets[:2], 85) == [(5, 6)]


def test_near_dedup_keeps_one(docs, empty):
    kept = dedup_near.near_dedup(docs, 80)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 1
    assert dedup_near.near_classes(empty).count() == 0


# ---- lines ----------------------------------------------------------------------------------------------------------------------


def without_runs(rows, long_lines=True):
    """Lines to keep of each (id, text), by a plain rule over all windows of lines."""
    def windows(t):
        ls = (t or "").split("\n")
        found = [(i, 2, (ls[i], ls[i + 1])) for i in range(len(ls) - 1)] + [(i, 1, (x,)) for i, x in enumerate(ls) if long_lines and len(x.split()) > 50]
        return ls, [w for w in found if " ".join(w[2]).strip(" ")]

    first = {}
    for k, t in rows:
        for i, _, key in windows(t)[1]:
            first[key] = min(first.get(key, (k, i)), (k, i))
    out = []
    for k, t in rows:
        ls, found = windows(t)
        gone = {j for i, n, key in found if (k, i) > first[key] for j in range(i, i + n)}
        out.append((len(ls), len(gone), "\n".join(x for j, x in enumerate(ls) if j not in gone)))
    return out


def test_line_runs(spark, docs, rows, empty):
    import random

    rng = random.Random(3)
    pool = [" ".join(f"w{k}x{j}" for j in range(60 if k % 9 == 0 else 6)) for k in range(60)] + ["", " "]
    own = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"line {k} {j}" for j in range(rng.randrange(1, 12)))) for k in range(80)]
    # A run of three lines between other lines, whose edges no chunk shows.
    own += [(100 + k, f"before {k}\nrun a\nrun b\nrun c\nafter {k}") for k in range(4)]
    got = dedup_lines.line_runs(spark.createDataFrame(own, "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    want = without_runs(own)
    assert [(r.n_lines, r.n_removed, r.kept_text) for r in got] == want
    assert [r.kept_text for r in got if r.doc_id > 100] == [f"before {k}\nafter {k}" for k in (1, 2, 3)]
    kept = {x for _, _, t in want for x in t.split("\n")}
    assert all(x in kept for _, t in own for x in t.split("\n") if x.strip())
    assert dedup_lines.line_runs(docs).count() == len(rows) and dedup_lines.line_runs(empty).count() == 0


def test_line_dedup_finds_every_run(spark, docs, rows, empty):
    """Runs of two lines and more between lines of their own, at the ends of texts, in repeated rows and in rows without an id."""
    import random

    rng = random.Random(5)
    pool = [f"w{k} of the pool" for k in range(40)] + ["", " ", "  \t"]
    own = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"line {k} {j}" for j in range(rng.randrange(1, 12)))) for k in range(150)]
    own += [(200 + k, f"before {k}\nrun a\nrun b\nafter {k}") for k in range(20)] + [(300 + k, "run b\nrun c" if k % 2 else "x\nx\nx\nx") for k in range(4)]
    got = dedup_lines.line_dedup(spark.createDataFrame(own, "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_removed, r.kept_text) for r in got] == without_runs(own, False)
    least = -(2**63)
    rows = [(least if i is None else i, t) for i, t in rows]
    want = Counter((i, t, *x) for (i, t), x in zip(rows, without_runs(rows, False), strict=True))
    found = dedup_lines.line_dedup(docs).select("doc_id", "text", "n_lines", "n_removed", "kept_text", "shard").collect()
    assert Counter((least if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_removed, r.kept_text) for r in found) == want and {r.shard for r in found} == {"clash"}
    assert dedup_lines.line_dedup(empty).count() == 0


def test_lines_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a hash of few values many chunks collide; bytes tell them apart."""
    from pyspark.sql import functions as F

    whole = F.xxhash64
    monkeypatch.setattr(dedup_lines.F, "xxhash64", lambda *c: F.pmod(whole(*c), F.lit(3)))
    own = [(k, "\n".join(f"l{(k * j) % 7}" for j in range(6))) for k in range(40)]
    got = dedup_lines.line_dedup(spark.createDataFrame(own, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_removed, r.kept_text) for r in got] == without_runs(own, False)


def test_line_dedup_runs_no_python(docs, capsys):
    dedup_lines.line_dedup(docs).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


# ---- language model ---------------------------------------------------------------------------------------------------------------


class PlainKneserNey:
    """Interpolated modified Kneser-Ney from dictionaries; triples that occur once have the discount 1."""

    def __init__(self, texts, order):
        self.words = Counter(w for t in texts for w in t)
        grams = Counter(g for t in texts for g in zip(*(["<start>"] * k + t for k in range(order - 1, -1, -1)), strict=False))
        self.levels = {}
        for n in range(order, 1, -1):
            total, kinds = Counter(), defaultdict(lambda: [0] * 4)
            for g, c in grams.items():
                total[g[:-1]] += c
                kinds[g[:-1]][min(c, 3)] += 1
            d = self.discounts(grams.values())
            if n == 3:
                d[1] = 1.0
            self.levels[n] = grams, total, kinds, d
            self.n_pairs = len(grams)
            grams = Counter(g[1:] for g in grams)
        self.before = {g[0]: c for g, c in grams.items()}
        self.d = self.discounts(self.before.values())
        self.mass = sum(self.d[min(x, 3)] for x in self.before.values())

    @staticmethod
    def discounts(values):
        n = Counter(values)
        if min(n[1], n[2], n[3]) == 0:
            return [0, 0.5, 0.75, 0.75]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))]

    def p(self, gram):
        if len(gram) == 1:
            c = self.before.get(gram[0], 0)
            return (max(c - self.d[min(c, 3)], 0) + self.mass / (len(self.words) + 1)) / self.n_pairs
        grams, total, kinds, d = self.levels[len(gram)]
        low = self.p(gram[1:])
        if gram[:-1] not in total:
            return low
        n = grams[gram]
        return (max(n - d[min(n, 3)], 0) + sum(d[k] * kinds[gram[:-1]][k] for k in (1, 2, 3)) * low) / total[gram[:-1]]


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_equals_a_plain_one(docs, rows, order, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_WORDS", 20_000)  # several blocks a task
    model = ngram_lm.train(docs.where("doc_id IS NULL OR doc_id % 10 > 0"), order=order)
    got = ngram_lm.score(docs, model).select("doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity").toPandas()
    plain = PlainKneserNey([[*words(t), None] for i, t in rows if i is None or i % 10], order)
    c, n_all = plain.words, sum(plain.words.values())
    assert model.n_tokens == n_all and len(got) == len(rows)
    for context in (["<start>"] * (order - 1), list(plain.levels[order][0])[7][:-1]):
        assert abs(sum(plain.p((*context, w)) for w in [*c, "never seen"]) - 1) < 1e-9
    want = {i: [*words(t), None] for i, t in rows if i is not None}
    for r in got[got.doc_id.notna()].itertuples():
        t = want[r.doc_id]
        assert r.n_tokens == len(t) and r.n_known == sum(w in c for w in t)
        grams = zip(*(["<start>"] * k + t for k in range(order - 1, -1, -1)), strict=False)
        assert math.isclose(r.score, sum(math.log10(plain.p(g)) for g in grams), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n_all + 0.1 * (len(c) + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


def test_model_of_nothing(docs, empty, rows):
    for order in (2, 3):
        model = ngram_lm.train(empty, order=order)
        assert ngram_lm.score(docs, model).count() == len(rows)
        assert ngram_lm.score(empty, model).count() == 0


class WholeKneserNey(PlainKneserNey):
    """The same, with the discount of the counts of counts for triples that occur once too."""

    def __init__(self, texts, order):
        super().__init__(texts, order)
        grams, total, kinds, _ = self.levels[3]
        self.levels[3] = grams, total, kinds, self.discounts(grams.values())


def test_kneser_ney_with_triples_that_occur_once(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_WORDS", 20_000)
    model = ngram_lm.train(docs.where("doc_id IS NULL OR doc_id % 10 > 0"), singles=True)
    plain = WholeKneserNey([[*words(t), None] for i, t in rows if i is None or i % 10], 3)
    assert math.isclose(model.discounts[3][1], plain.levels[3][3][1]) and model.discounts[3][1] < 1
    want = {i: [*words(t), None] for i, t in rows if i is not None}
    for r in ngram_lm.score(docs, model).where("doc_id IS NOT NULL").select("doc_id", "score").collect():
        t = want[r.doc_id]
        assert math.isclose(r.score, sum(math.log10(plain.p(g)) for g in zip(["<start>"] * 2 + t, ["<start>"] + t, t, strict=False)), rel_tol=1e-9)


def test_query_of_the_model_keeps_triples_that_occur_once(spark, tmp_path):
    """The registered query trains with them: a text's rarest triples count."""
    from recallgrid.llm.queries import QUERIES

    seen = []
    whole = ngram_lm.train
    texts = [(i, f"w{i % 7} x{i % 3} y{i % 5} z{i}") for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    try:
        ngram_lm.train = lambda *a, **more: seen.append(more) or whole(*a, **more)
        assert QUERIES["op10_kneser_ney"](spark, str(tmp_path)).count() == 60
    finally:
        ngram_lm.train = whole
    assert [m.get("singles") for m in seen] == [True]


def test_contexts_of_one_triple_are_not_kept(spark):
    """They are known by the pairs; a text alone, of which even the start is such a context, too."""
    for texts in (["a b c a b d"], ["a b c a b c", "b c a d", "x y z"]):
        docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
        model = ngram_lm.train(docs, singles=True)
        assert set(model.tables) == {"triple", "triple1", "first3", "pair", "first", "before"}
        asked = [r.score for r in ngram_lm.score(docs, model).orderBy("doc_id").collect()]
        unknown = spark.createDataFrame([(n, "q " + t) for n, t in enumerate(texts)], "doc_id long, text string")
        assert all(a > b for a, b in zip(asked, [r.score for r in ngram_lm.score(unknown, model).orderBy("doc_id").collect()], strict=True))
