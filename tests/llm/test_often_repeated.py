"""The suffix sort of frequent anchors over many ranges, against a count of all windows."""

import random
from collections import Counter

import pytest

from recallgrid.llm import dedup_substrings


def windows_removed(texts: list[bytes], length: int) -> list[tuple[int, int]]:
    """Bytes that go and the runs they form, by counting every window."""
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((sum(gone), sum(b and not a for a, b in zip([False, *gone], gone, strict=False))))
    return out


@pytest.mark.parametrize("range_bytes", [4 << 20, 3_000])
@pytest.mark.parametrize("core", [18, 23, 40])
def test_frequent_passages(spark, core, range_bytes, monkeypatch):
    """A passage a little shorter or longer than a window, in texts of two letters, so that neighbours in one order share
    less than a third text does; in one range and in many."""
    monkeypatch.setattr(dedup_substrings, "RANGE_BYTES", range_bytes)
    rng = random.Random(core)
    passage = "".join(rng.choice("ABCDEFGH") for _ in range(core))

    def noise(n):
        return "".join(rng.choice("xy") for _ in range(n))

    texts = [noise(rng.randrange(3, 30)) + passage + noise(rng.randrange(3, 30)) for _ in range(120)]
    texts += texts[:5] + ["", passage, passage * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in dedup_substrings.remove_repeats(docs, length=24, gram=8, many=3).collect()}
    assert [got[i] for i in range(len(texts))] == windows_removed([t.encode() for t in texts], 24)


def test_open_windows_are_settled(spark, monkeypatch):
    """The test above is one of windows that only a third context has."""
    asked = []
    real = dedup_substrings._third_contexts
    monkeypatch.setattr(dedup_substrings, "_third_contexts", lambda *a: asked.append(1) or real(*a))
    rng = random.Random(7)
    passage = "".join(rng.choice("ABCDEFGH") for _ in range(20))
    texts = ["".join(rng.choice("xy") for _ in range(9)) + passage + "".join(rng.choice("xy") for _ in range(9)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in dedup_substrings.remove_repeats(docs, length=24, gram=8, many=3).collect()}
    assert asked and [got[i] for i in range(len(texts))] == windows_removed([t.encode() for t in texts], 24)
