"""Repair of conversations, exact top-k and periodic runs against brute force, on small tables and on the registered queries."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from recallgrid.llm import periodic, topk, turn_repair
from recallgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Conversations: every repair is tried, cheapest first.


def fault_of(rows, i):
    role, text = rows[i]
    solid = re.sub(r"[\x20\x09-\x0D]", "", text)
    if not solid:
        return "blank"
    if (role, text) in rows[:i]:
        return "duplicate"
    return None if solid[-1] in ".!?" else "truncated"


def best_repair(rows):
    """(cost, audit, repaired) by plain dynamic programming over whole audits; rows are (role, text)."""
    faults = [fault_of(rows, i) for i in range(len(rows))]
    names = {"s": "system", "u": "user", "a": "assistant"}

    def fits(initials):
        return re.fullmatch(r"s?(ua)*u?", initials)

    # By the initials so far, as a state: only its first and last letters matter for what may follow.
    def state(initials):
        return initials[-1:]

    def keep_best(options):
        out = {}
        for option in options:
            key = state(option[2])
            if key not in out or option[:2] < out[key][:2]:
                out[key] = option
        return list(out.values())

    def inserted(options):
        for _ in range(3):
            options = keep_best(options + [(c + 2, a + "I", s + r, t + [f"{names[r]}:"]) for c, a, s, t in options for r in "ua" if fits(s + r)])
        return options

    now = inserted([(0, "", "", [])])
    for (role, text), fault in zip(rows, faults, strict=True):
        new = [(c + 3, a + "D", s, t) for c, a, s, t in now]
        if fault not in ("blank", "duplicate"):
            late = fault == "truncated"
            new += [(c + late, a + "K", s + role[:1], [*t, f"{role}:{text}"]) for c, a, s, t in now if role and fits(s + role[:1])]
            new += [(c + 2 + late, a + "R", s + r, [*t, f"{names[r]}:{text}"]) for c, a, s, t in now for r in "ua" if fits(s + r)]
        now = inserted(keep_best(new))
    cost, audit, _, repaired = min(o for o in now if re.fullmatch(r"(s?(ua)+)?", o[2]))
    return cost, audit, repaired


def report_of(rows):
    """The report of one conversation's (turn, role, text) in order."""
    pairs = [(r, t) for _, r, t in rows]
    faults = [fault_of(pairs, i) for i in range(len(pairs))]
    numbers = [n for n, _, _ in rows if n is not None]
    cost, audit, repaired = best_repair(pairs)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs)),
        "cost": cost, "audit": audit, "repaired_sha256": sha("\n".join(repaired)),
    }


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest()))


def test_search_of_every_short_conversation():
    """All conversations of up to four turns over the kinds, against trying all edits."""
    spelled = {"s": ("system", "x{}."), "u": ("user", "x{}."), "a": ("assistant", "x{}."), "o": ("tool", "x{}."), "U": ("user", "x{}"), "S": ("system", "x{}"), "-": ("user", " ")}
    for n in range(5):
        for kinds in itertools.product(spelled, repeat=n):
            rows = [(role, text.format(i)) for i, (role, text) in enumerate(spelled[k] for k in kinds)]
            assert turn_repair.cheapest_edits("".join(kinds)) == best_repair(rows)[:2], kinds


@pytest.mark.parametrize("size", [1, 2, 5])
def test_parts_join_to_the_whole(size):
    rng = random.Random(size)
    for _ in range(150):
        kinds = "".join(rng.choice("suaoSUAO-") for _ in range(rng.randrange(1, 24)))
        taken = turn_repair.joined_paths([turn_repair.paths_across(kinds[i : i + size]) for i in range(0, len(kinds), size)])
        assert (sum(x["cost"] for x in taken), "".join(x["audit"] for x in taken)) == turn_repair.cheapest_edits(kinds)


def conversations():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", "é", "Ende. \n", "x" * 5000 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*texts, f"text {c} {t}.", None])) for c in range(40) for t in range(rng.randrange(0, 9))]
    rows += [(c, None, "user", rng.choice(texts)) for c in range(10)]
    rows += [(100, t, "assistant" if t % 2 else "user", f"long {t % 40}" + ".?"[t % 3 == 0 :][:1]) for t in range(700)]
    rows += [(101, 5, "user", "the same.")] * 50 + [(102, t, "user", "the same.") for t in range(60)] + [(103, None, None, None)] * 7
    rows += [(None, t, "user", "no conversation.") for t in range(3)] + rows[:20]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment_rows", [1024, 7])
def test_repair_of_many_shapes(spark, segment_rows):
    """Short and long conversations, nulls anywhere, ties and repeats, clashing columns, whole or cut into parts."""
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, edit string, n int").repartition(5)
    segments = turn_repair.repair(df, segment_rows=segment_rows)
    got = {r.conv_id: r.asDict() for r in turn_repair.conversation_reports(segments).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(by)
    for c, turns in by.items():
        want = report_of(ordered(turns))
        assert {k: got[c][k] for k in want} == want, c
    lines = defaultdict(list)
    for r in turn_repair.repaired_turns(segments).orderBy("part", "ord", "pos").collect():
        lines[r.conv_id].append(r)
    for c in by:
        assert "".join(r.edit for r in lines[c]) == got[c]["audit"]
        assert sha("\n".join(f"{r.role}:{r.text}" for r in lines[c] if r.edit != "D")) == got[c]["repaired_sha256"]


def test_repair_of_no_rows(spark):
    segments = turn_repair.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert segments.isEmpty() and turn_repair.conversation_reports(segments).isEmpty() and turn_repair.repaired_turns(segments).isEmpty()


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if x == 0:
            continue
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        out[c] += [(t, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)
    return out


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r.asDict() for r in QUERIES["op11_turn_repair"](spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    by = damaged(rows)
    for c, row in got.items():
        want = report_of(ordered(by[c])) if c in by else {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": sha("")}
        assert {k: row[k] for k in want} == want


def test_op11_where_every_turn_is_dropped(spark, tmp_path):
    lost = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = [(c, 0, "user", "Gone.") for c in lost] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect()}
    assert set(got) == {*lost, None}
    for c in lost:
        assert got[c] == {"conv_id": c, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": sha("")}


# Top-k.


def brute_top(vectors, asks, k):
    """{query: [(vec_id, score)]}; both are lists of (id, tuple of ints)."""
    out = defaultdict(set)
    for q, v in asks:
        for i, w in vectors:
            if i != q and len(w) == len(v):
                out[q].add((-sum(a * b for a, b in zip(v, w, strict=True)), i, w, v))
    return {q: [(x[1], -x[0]) for x in sorted(found)[:k]] for q, found in out.items()}


def floors(x):
    return tuple(int(np.floor(256 * float(c))) for c in x)


@pytest.mark.parametrize("block_rows", [8192, 40])
def test_top_k_of_many_shapes(spark, block_rows):
    """Copies, ties, zeros, nulls, lone lengths, repeated ids and large components."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, -0.25, 0.125, 0.0, 1.0, -1.0]) for i in range(200)]
    rows += [(2000 + i, (rng.integers(-1, 2, 6) / 2).tolist()) for i in range(150)]
    rows += [(3000 + i, [0.0] * 6) for i in range(10)] + [(3100, [1.0]), (3150, [2.0]), (3200, []), (3250, [])]
    rows += [(3300 + i, (rng.normal(size=9) * 1e6).tolist()) for i in range(60)]
    rows += [(4000, None), (4050, [None] * 6), (4100, [float("nan")] * 6), (4150, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [rows[0], rows[0], (50, rng.normal(size=6).tolist()), (7, rng.normal(size=6).tolist())]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(7)
    vectors = topk.whole_vectors(df)
    got = topk.top_k(vectors, vectors.where("id % 50 = 0"), 5, block_rows).collect()
    usable = {(i, floors(v)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = brute_top(sorted(usable), [x for x in usable if x[0] % 50 == 0], 5)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    assert found == want


def test_top_k_stops_early():
    """The bound ends the walk before the lists do: rows are met in part only where a few of them stand out, and where all are equal."""
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(5000, 4)) * 20)
    rows[:10] = 4000
    met = []
    best = topk._best

    def counting(old, scores, ids, k):
        met.append(len(ids))
        return best(old, scores, ids, k)

    for table in (rows, np.ones((5000, 4))):
        met.clear()
        topk._best, lists = counting, topk.Lists(np.arange(5000), table)
        try:
            got = lists.top(np.array([1.0, 2.0, 3.0, 1.0]), 3, 5)
        finally:
            topk._best = best
        scores = table @ np.array([1.0, 2.0, 3.0, 1.0])
        assert got == [(int(scores[i]), i) for i in sorted((j for j in range(5000) if j != 3), key=lambda j: (-scores[j], j))[:5]]
        assert sum(met) < 500


def test_top_k_of_no_rows(spark):
    vectors = topk.whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(vectors, vectors).isEmpty()


def test_op12(spark):
    rows = [(r.vec_id, floors(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_top(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = defaultdict(list)
    for r in QUERIES["op12_threshold_top"](spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == want


# Periodic runs.


def plain_runs(words):
    """(start, length, period) of every run by comparing all pairs of places."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(6, 4 * q):
                found.setdefault((a, i + q - a), q)
    return sorted((a, m, q) for (a, m), q in found.items())


def plain_collapse(words, runs):
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def periodic_texts():
    rng = random.Random(9)
    out = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "x " * 300, "a b " * 200 + "a c " * 200, "ab　c " * 9, "a a a b " * 30]
    for _ in range(60):
        words = [rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            p, times = rng.randrange(1, 20), rng.randrange(2, 9)
            block = [rng.choice(["p", "q", "rr", "é"]) for _ in range(p)] * times
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = block[: len(block) - rng.randrange(0, p)]
        out.append(rng.choice([" ", "\n", "\t "]).join(words))
    block = [f"w{i}" for i in range(1500)]
    out.append(" ".join(f"u{i}" for i in range(2000)) + " " + " ".join(block * 5) + " end")
    return [*out, out[20], out[20]]


@pytest.mark.parametrize("range_lags", [periodic.RANGE_LAGS, 16])
def test_periodic_runs(spark, range_lags):
    """Texts whole and by ranges of lags, with nulls, repeats and clashing columns."""
    texts = periodic_texts()
    df = spark.createDataFrame([(None if i == 7 else i % 70, t, i, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, at int, runs string, collapsed string").repartition(4)
    got = {r["at"]: r for r in periodic.collapse_runs(df, range_lags=range_lags).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = split(text)
        want = plain_runs(words)
        assert [tuple(r) for r in got[i].runs] == want, (i, text)
        assert (got[i].n_words, got[i].collapsed, got[i].text) == (len(words), plain_collapse(words, want), text)


def test_periodic_runs_of_no_rows(spark, empty):
    assert periodic.collapse_runs(empty).isEmpty()


def test_one_word_many_times():
    """A long text of one word, and one of two periods, cost a lag little more than others."""
    ids = np.zeros(200_000, np.int64)
    assert periodic.runs_in(ids, np.array([0, len(ids)]), (1, 1 << 62)).tolist() == [[0, len(ids), 1]]
    assert periodic.runs_in(ids, np.array([0, len(ids)]), (1000, 1 << 62)).tolist() == []


def test_op13(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        words, h = split(text), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = plain_runs(words)
        r = got[i]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)) and r.collapsed_sha256 == sha(plain_collapse(words, runs))


def test_a_text_of_megabytes(spark):
    """Six megabytes in one row, whose lags are compared by several tasks, beside short rows."""
    block = [f"b{i}" for i in range(40_000)]
    text = " ".join([f"u{i}" for i in range(500_000)] + block * 5 + ["end"])
    assert len(text) > 2 * periodic.RANGE_LAGS * periodic.BYTES_PER_LAG
    df = spark.createDataFrame([(1, text), (2, "a b a b a b a b"), (3, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.collapse_runs(df).select("doc_id", "n_words", "runs", "collapsed").collect()}
    for i in (1, 3):
        assert got[i].n_words == 700_001 and [tuple(r) for r in got[i].runs] == [(500_000, 200_000, 40_000)]
        assert got[i].collapsed == " ".join([f"u{k}" for k in range(500_000)] + block + ["end"])
    assert got[2].collapsed == "a b" and [tuple(r) for r in got[2].runs] == [(0, 8, 2)]


def test_texts_without_words_that_are_made_periodic(spark, tmp_path):
    """A remainder by the number of words, where there are none, is an error under ANSI rules."""
    import hashlib
    import zlib

    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = list(zip(ids, ["", None, " \n ", "a b c"], strict=True))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert [got[i].n_words for i in ids] == [0, 0, 0, 3]
    assert all((got[i].n_runs, got[i].start, got[i].runs_sha256, got[i].collapsed_sha256) == (0, None, empty, empty) for i in ids[:3])
